from pyspark.sql import functions as F

from evidentia.operators.ordering import numbered


def test_numbers_are_gapless_in_order_over_partitions(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("a"), (F.col("id") % 3).alias("n__kind"))
    found = numbered(rows.repartition(7), [F.desc("n__kind"), F.asc("a")], start=10).collect()
    found.sort(key=lambda r: r["n"])
    assert [r["n"] for r in found] == list(range(10, 5010))
    assert [(-r["n__kind"], r["a"]) for r in found] == sorted((-r["n__kind"], r["a"]) for r in found)


def test_repeated_keys_and_no_rows(spark):
    rows = spark.createDataFrame([(1,), (1,), (None,)], "a long")
    assert sorted(r["n"] for r in numbered(rows, [F.asc("a")]).collect()) == [1, 2, 3]
    assert numbered(rows.where("a > 5"), [F.asc("a")]).collect() == []

"""Tables larger than a task's share are dealt out to more tasks, with the same results."""

from pyspark.sql import functions as F

from evidentia.operators import dealing, evidence, similarity, vectors

LINK = "product_id long, ingredient_id long, position int, is_trace boolean, conc_low double, conc_high double"


def largest(rows):
    """Rows of the fullest partition."""
    return rows.withColumn("part", F.spark_partition_id()).groupBy("part").count().agg(F.max("count")).first()[0]


def test_costs_are_dealt_out_by_links(spark, monkeypatch):
    links = spark.createDataFrame([(k % 50, k % 997, 1, False, 1.0 + k % 3, 2.0) for k in range(8000)], LINK)
    items = spark.createDataFrame([(k, 10.0 + k, "30ml") for k in range(50)], "product_id long, price double, spec string")
    assertions = spark.createDataFrame([(k, 0.5 + k % 7) for k in range(990)] + [(k, 3.0) for k in range(500)], "ingredient_id long, effective_low double")
    grouped = lambda rows: sorted(map(tuple, rows.groupBy("product_id", "ingredient_id").agg(F.min("cost"), F.count("cost")).collect()))
    few = grouped(evidence.costs(items, links, assertions))
    monkeypatch.setattr(dealing, "ROWS_A_TASK", 100)
    costed = evidence.costs(items, links, assertions)
    assert largest(costed) < 400
    assert grouped(costed) == few and len(few) > 7000


def test_decided_searches_compare_no_items_again(spark, monkeypatch):
    """Where rarer components decide every query, similarity by all components isn't worked out at all."""
    links = spark.createDataFrame([(i, i // 2 * 10 + k) for i in range(40) for k in range(5)] + [(i, 1000 + i // 4) for i in range(40)], "product_id long, ingredient_id long")
    queries = spark.createDataFrame([(0,), (13,), (99,)], "product_id long")

    def never(*_):
        raise AssertionError("compared with all items")

    for name in ("component_overlap", "_overlap"):
        monkeypatch.setattr(similarity, name, never, raising=False)
    found = similarity.similar_by_components(links, queries, 2).collect()
    assert sorted((r.query_id, r["rank"], r.product_id, r.score, r.shared) for r in found) == [(0, 1, 1, 1.0, 6), (0, 2, 2, 0.0909, 1), (13, 1, 12, 1.0, 6), (13, 2, 14, 0.0909, 1)]


def test_lists_are_dealt_out_by_item(spark, monkeypatch):
    links = spark.createDataFrame([(k % 211, k * k % 503, k % 7 + 1) for k in range(8000)], "product_id long, ingredient_id long, position int")
    queries = spark.createDataFrame([(k,) for k in range(0, 211, 50)], "product_id long")
    both = lambda: vectors.hybrid(vectors.one_hot(links), vectors.rank_decay(links))
    near = lambda rows: sorted(map(tuple, vectors.cosine_neighbours(rows, queries, 5).collect()))
    few = near(both()), near(vectors.tf_idf(links))
    monkeypatch.setattr(dealing, "ROWS_A_TASK", 100)
    assert largest(vectors.one_hot(links)) < 400 and largest(vectors.rank_decay(links)) < 400
    assert (near(both()), near(vectors.tf_idf(links))) == few and len(few[0]) == 25


def test_items_stream_past_queries_unsorted(spark):
    rows = spark.createDataFrame([(1, 1, 1.0), (2, 1, 2.0), (3, 2, 1.0)], "product_id long, ingredient_id long, weight double")
    plan = similarity._meet(rows.select(F.col("product_id").alias("query_id"), "ingredient_id", F.col("weight").alias("query_weight")), rows, "ingredient_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text

from collections import Counter

from evidentia.sources import ranges


def test_ranges_pages_and_completeness(spark):
    ids = [*map(str, range(100, 160)), "9", "95", "1000", None]
    rows = spark.createDataFrame([(x, "v") for x in [*ids, "100"]], "id string, name string").repartition(3)
    found = sorted(ranges.key_ranges(rows, "id", 20).collect(), key=lambda r: r["range_no"])
    order = sorted({x for x in ids if x})
    assert [(r["low"], r["high"], r["n"]) for r in found] == [(order[0], order[20], 20), (order[20], order[40], 20), (order[40], order[60], 20), (order[60], None, 3)]
    paged = ranges.pages_of(rows, "id", 20, 8).collect()
    assert Counter((r["range_no"], r["page_no"]) for r in paged) == {(0, 1): 8, (0, 2): 8, (0, 3): 5, (1, 1): 8, (1, 2): 8, (1, 3): 4, (2, 1): 8, (2, 2): 8, (2, 3): 4, (3, 1): 3}
    stated = spark.createDataFrame([(63,), (None,), (60,)], "total int")
    assert tuple(ranges.completeness(rows.where("id is not null"), "id", stated).first()) == (63, 64, 63, True)
    assert tuple(ranges.completeness(rows.where("id < '2'"), "id", stated).first()) == (63, 62, 61, False)


def test_no_keys(spark):
    none = spark.createDataFrame([], "id string")
    assert ranges.key_ranges(none, "id", 5).collect() == [] and ranges.pages_of(none, "id", 5, 5).collect() == []

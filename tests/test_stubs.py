from evidentia.operators.stubs import find_or_create

SCHEMA = "ingredient_id long, inci_name string, cn_name string"


def test_lookup_by_tiers_creation_and_a_second_run(spark):
    register = spark.createDataFrame([(3, "GLYCERIN", "甘油"), (5, "甘油", "甘油"), (7, "WATER", None), (9, "水", "水（去离子）")], SCHEMA)
    names = spark.createDataFrame([("甘油",), ("水",), ("WATER",), ("新",), ("乙",), ("新",), (None,), ("",)], "name string")
    after, found = find_or_create(names, register)
    got = {r["name"]: (r["ingredient_id"], r["via"]) for r in found.collect()}
    assert got == {"甘油": (3, "chinese"), "水": (9, "name"), "WATER": (7, "name"), "乙": (10, "new"), "新": (11, "new")}
    rows = sorted(map(tuple, after.collect()))
    assert rows[4:] == [(10, "乙", "乙"), (11, "新", "新")] and len(rows) == 6
    again, found = find_or_create(names, spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, again.collect())) == rows and {r["via"] for r in found.collect()} == {"chinese", "name"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    after, found = find_or_create(spark.createDataFrame([("a",)], "name string"), none)
    assert [tuple(r) for r in after.collect()] == [(1, "a", "a")]
    after, found = find_or_create(spark.createDataFrame([], "name string"), none)
    assert after.collect() == [] and found.collect() == []

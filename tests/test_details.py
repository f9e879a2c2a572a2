"""Details, reports and names on hand-checked rows."""

import time

import pytest
from pyspark.sql import functions as F

from evidentia import storage
from evidentia.functions import dose
from evidentia.functions import text as t
from evidentia.operators import changes, details, evidence, resolution, vectors
from evidentia.sources import files


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_lookup_and_pages(spark):
    rows = spark.createDataFrame([(k, k % 2) for k in range(10)], "id long, odd long")
    assert details.lookup(rows, "id", 3).collect() == [(3, 1)] and details.lookup(rows, "id", 99).count() == 0
    page = details.page_with_total(rows.where("odd = 1"), [F.col("id")], limit=2, offset=1).collect()
    assert page == [(3, 1, 5), (5, 1, 5)]
    assert details.page_with_total(rows, [F.col("id")], limit=0, offset=8).count() == 2


def test_details_count_links_once(spark):
    links = spark.createDataFrame([(1, 10, 1, False), (1, 10, 2, False), (2, 10, None, True), (3, 11, 1, False)], "product_id long, ingredient_id long, position int, is_trace boolean")
    components = spark.createDataFrame([(10, "A", "甲", 1.0, None, None), (11, "B", None, None, None, None), (12, "C", None, None, None, None)], "ingredient_id long, inci_name string, cn_name string, legal_cap double, max_leave_on double, max_rinse_off double")
    assertions = spark.createDataFrame([(10,), (10,)], "ingredient_id long")
    found = {r.ingredient_id: (r.total, r.assertion_count, r["items"]) for r in details.component_details(components, links, assertions, limit=1, offset=1).collect()}
    assert found == {10: (2, 2, "2"), 11: (1, 0, ""), 12: (0, 0, "")}
    items = spark.createDataFrame([(1, "x"), (3, "y"), (4, "z")], "product_id long, name string")
    rows = details.item_details(items, links, components, assertions).collect()
    assert sorted((r.product_id, r.ingredient_id or 0, r.has_evidence) for r in rows) == [(1, 10, True), (1, 10, True), (3, 11, False), (4, 0, None)]


def test_orders_and_shares(spark):
    rows = spark.createDataFrame([("file10",), ("file2",), ("b",)], "stem string")
    assert [r.stem for r in rows.orderBy(*details.natural_order("stem")).collect()] == ["b", "file2", "file10"]
    states = spark.createDataFrame([("z",), ("uncertain",), ("effective",)], "s string")
    assert [r.s for r in states.orderBy(details.in_order_of("s", ["effective", "uncertain"])).collect()] == ["effective", "uncertain", "z"]
    shares = details.share_of_greatest(spark.createDataFrame([(1, 4.0), (1, 1.0), (2, 0.0), (2, None)], "k long, v double"), "k", "v")
    assert sorted((r.k, r.v or 0, r.share) for r in shares.where("v is not null").collect()) == [(1, 1.0, 25.0), (1, 4.0, 100.0), (2, 0.0, None)]
    lists = [spark.createDataFrame(x, "id long, place long") for x in ([(3, 0), (1, 1)], [(1, 0), (2, 1)])]
    assert [r.id for r in details.ordered_union(lists, "id").orderBy("list", "place").collect()] == [3, 1, 2]


def test_following_lines(spark):
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate(["T one", "english", "more", "ok", "T two", "x", "x", "x", "x", "x", "x", "ok"])], "doc long, pos int, line string")
    found = details.following_lines(lines, "doc", "pos", "line", F.col("line").startswith("T"), F.col("line") == "ok").collect()
    assert [(r.pos, r.distance, r.between) for r in found] == [(0, 3, "english more")]


def test_names_in_names(spark):
    name = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    found = details.mutual_names(name("理肤泉", "OLAY", "X", None), name("理肤泉 La Roche-Posay", "OLAY", "LAY", ""))
    assert sorted(map(tuple, found.collect())) == [("OLAY", "LAY"), ("OLAY", "OLAY"), ("理肤泉", "理肤泉 La Roche-Posay")]
    assert one(spark, t.same_brand(F.lit("理肤泉"), F.lit(" 理肤泉 La Roche")), t.same_brand(F.lit(""), F.lit("a")), t.same_brand(F.lit(None), F.lit("a"))) == (True, False, False)


def test_repairs_and_reviews(spark):
    stored = spark.createDataFrame([(1, "A-b", None), (2, "c", 5.0), (3, "d", None)], "id long, name string, price double")
    backup = spark.createDataFrame([(9, "AB", 3.0), (8, "a b", 4.0), (7, "C", 1.0)], "id long, name string, price double")
    found = details.repair(stored, backup, t.collapse(F.col("name")), t.collapse(F.col("name")), ["price"], [F.col("id")]).collect()
    assert sorted((r.id, r.price, r.repaired) for r in found) == [(1, 4.0, True), (2, 5.0, False), (3, None, False)]
    review = spark.createDataFrame([(1, "withdraw", None), (2, "set", 9.0)], "id long, action string, value double")
    assert sorted((r.id, r.price, r.action) for r in details.override(stored, review, "id", "price").collect()) == [(2, 9.0, "set"), (3, None, "keep")]
    hits = details.unique_hits(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2)], "k string, v long"), "k", "v")
    assert sorted(map(tuple, hits.collect())) == [("a", 1, 1), ("b", 2, None), ("c", 0, None)]
    new = spark.createDataFrame([(1, 7.0), (2, None), (3, None)], "id long, price double")
    filled = changes.backfill(stored, new, ["id"], "price", correct=True, clear_none=True).collect()
    assert sorted((r.id, r.price, r.action) for r in filled) == [(1, 7.0, "set"), (2, None, "cleared"), (3, None, "none")]


def test_match_score_has_four_rules(spark):
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 11)], "product_id long, ingredient_id long")
    assertions = spark.createDataFrame([(10, "美白", "美白", 0.8, "human_rct", "paper"), (11, "保湿", "保湿", 0.3, "animal", "paper"), (11, "美白", "美白", 0.9, "regulation", "paper")], "ingredient_id long, effect string, family string, strength double, level string, kind string")
    verdicts = spark.createDataFrame([(1, "美白提亮", "effective"), (1, "抗皱", "effective"), (2, "保湿", "insufficient")], "product_id long, effect string, verdict string")
    avoided = spark.createDataFrame([(1, "alcohol"), (1, "alcohol"), (2, None)], "product_id long, kind string")
    claims = spark.createDataFrame([(1, "美白（备案）"), (1, "紧致"), (2, "保湿修护")], "product_id long, claim string")
    facts = evidence.match_facts(links, assertions, verdicts, avoided, claims, {"美白": ["美白"], "抗老": ["抗皱"]})
    items = spark.createDataFrame([(1,), (2,), (3,)], "product_id long")
    assert {tuple(r) for r in evidence.match_score(items, facts).collect()} == {(1, 1, 1, 1, 1, 5), (2, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0)}


def test_name_and_cell_expressions(spark):
    lit = F.lit
    assert one(spark, t.component_key(lit("alcohol denat."), lit("x"), lit("变性  乙醇")), t.component_key(lit("a"), lit("水  杨酸"), lit(None)), t.component_key(lit(" aqua "), lit("water"), lit(None))) == ("变性 乙醇", "水 杨酸", "INCI:AQUA")
    assert one(spark, t.official_keys(lit("Alcohol Denat."))) == (["ALCOHOL DENAT.", "ALCOHOL DENAT", "ALCOHOL DENAT.."],)
    assert one(spark, t.is_alcohol(lit("Alcohol Denat."), lit(None)), t.is_acid(lit("x"), lit("乳酸")), t.is_fragrance(lit("Parfum (x)"), lit(None)), t.is_alcohol(lit(None), lit(None))) == (True, True, True, False)
    assert one(spark, t.join_wrapped(lit("成分\n名称")), t.join_wrapped(lit("Sodium \n PCA")), t.join_wrapped(lit("C12-\n15"))) == ("成分名称", "Sodium PCA", "C12-15")
    assert one(spark, t.marked_price(lit("￥1,299.50")), t.marked_price(lit("none")), t.latin_parts(lit("WATER、甘油，B"))) == (1299.5, None, ["WATER", "B"])
    assert one(spark, t.stated_phrases(lit("抗氧化、抗老化"), lit("美白"), "其他")["phrases"]) == (["美白", "抗氧化", "抗老化"],)
    # by hand: 5381 * 33 + 97 = 177670, then 177670 * 33 + 98
    assert one(spark, t.profile_key(lit("a")), t.profile_key(lit("ab")), t.profile_key(lit(""))) == (177670, 5863208, 5381)
    assert one(spark, t.profile_key(lit("x" * 40)))[0] == signed(hashed("x" * 40))


def hashed(text):
    h = 5381
    for c in text:
        h = (h * 33 + ord(c)) & 0xFFFFFFFF
    return h


def signed(h):
    return h - (1 << 32) if h >= 1 << 31 else h


def test_dose_axis_and_caps(spark):
    lit = lambda x: F.lit(x).cast("double")
    assert one(spark, dose.axis_place(lit(1.0)), dose.axis_place(lit(0.0)), dose.axis_place(lit(500.0)), dose.axis_place(lit(None))) == (50.0, 0.0, 100.0, None)
    cap = lambda on: dose.upper_cap(lit(5.0), lit(3.0), lit(4.0), lit(None), lit(8.0), F.lit(on))
    assert one(spark, cap(True), cap(False), dose.upper_cap(*[lit(None)] * 5, F.lit(True))) == (3.0, 4.0, None)


def test_hybrid_vectors_average_cosines(spark):
    a = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (2, 1, 2.0)], "product_id long, ingredient_id long, weight double")
    b = spark.createDataFrame([(1, 1, 3.0), (2, 2, 1.0)], "product_id long, ingredient_id long, weight double")
    near = vectors.cosine_neighbours(vectors.hybrid(a, b), spark.createDataFrame([(1,)], "product_id long"), 3).first()
    assert near.score == pytest.approx(0.5 * 2**-0.5, abs=1e-4)


def test_indexes_reports_and_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    assert files.with_neighbours(spark, path, 1) == ("unavailable", None)
    files.write_index(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id long, embedding array<double>"), path)
    state, found = files.with_neighbours(spark, path, 1, 1)
    assert (state, [r.id for r in found.collect()]) == ("ok", [2])
    assert files.with_neighbours(spark, path, 77)[1].count() == 0
    held = files.Snapshots(spark)
    assert held.table(path) is held.table(path) and held.table(path).count() == 3
    files.write_index(spark.createDataFrame([(5, [1.0, 0.0])], "id long, embedding array<double>"), path)
    assert [r.id for r in held.table(path).collect()] == [5]
    files.write_report(spark.createDataFrame([("a", 1)], "name string, n long"), f"{path}-report")
    assert files.json_lines(spark, f"{path}-report", "name string, n long").collect() == [("a", 1)]


def test_documents_in_natural_order(spark, tmp_path):
    for name in ("b/file10.json", "a/file2.json", "a/x.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text('{"v": 1}')
    rows = files.json_documents_in_order(spark, f"file://{tmp_path}", "v long")
    assert [r.stem for r in rows.orderBy("place").collect()] == ["x", "file2", "file10"]


def test_shared_folder_must_be_set_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

            class _Conf:
                get = staticmethod(lambda key, default: default)

            getConf = staticmethod(lambda: Session.sparkContext._Conf)

    with pytest.raises(ValueError):
        storage.shared_dir(Session)


def test_multi_key_match_narrows_until_one_is_left(spark):
    assert one(spark, resolution.product_keys(F.lit("Brand 紫米精華（H.A. Intensifier）"), "Brand")) == (["紫米精华", "HAINTENSIFIER"],)
    items = [(1, "Brand A (Discontinued)", True), (2, "Brand A", False), (3, "Brand A", True), (4, "B（A）", False), (5, "C", None), (6, "C", None)]
    items = spark.createDataFrame(items, "product_id long, name string, placed boolean")
    pages = spark.createDataFrame([(1, ["A"]), (2, ["C"]), (3, ["none"]), (4, ["B", "A"])], "page_id long, keys array<string>")
    steps = [~F.col("name").contains("Discontinued"), F.col("placed")]
    found = resolution.match_by_keys(pages, items, steps, "Brand").collect()
    assert sorted(map(tuple, found)) == [(1, 4, 3), (2, 2, None), (3, 0, None), (4, 4, 3)]


def test_resolving_by_tiers(spark):
    register = spark.createDataFrame([(1, "Retinol"), (2, "Retinol Ester"), (3, "Hydro Retinol"), (4, "PEG-8"), (5, "PEG-80")], "ingredient_id long, name string")
    aliases = spark.createDataFrame([("vitamin a", 1)], "alias string, ingredient_id long")
    queries = spark.createDataFrame([(x,) for x in (" RETINOL", "Vitamin A", "peg", "ro ret", "x y", "", None, "Retinol E")], "query string")
    found = {r.query: (r.ingredient_id, r.via) for r in resolution.resolve(queries, register, aliases).collect()}
    assert found == {" RETINOL": (1, "exact"), "Vitamin A": (1, "alias"), "peg": (4, "prefix"), "ro ret": (3, "part"), "x y": (None, None), "": (None, None), None: (None, None), "Retinol E": (2, "prefix")}


def test_page_texts(spark):
    lit = F.lit
    xml = "<loc>a/p-1.html</loc>\n<loc>m/mobile/p-2.html</loc><loc>b/p-1.html</loc><loc>none</loc>"
    assert one(spark, t.page_slugs(lit(xml), r"/p-(\d+)\.html", "/mobile/"), t.page_slugs(lit(""), "(x)", "y")) == (["1"], [])
    assert one(spark, t.stream_parts(lit('data: {"x": "1"}\n\ndata: oops\n\nid: 3\n\ndata: [DONE]'), "x")) == (["1"],)
    assert one(spark, t.answer_field(lit('so {"a": {"b": 2}} it is'), "a"), t.answer_field(lit("none"), "a")) == ('{"b":2}', None)
    dates = [t.safe_date(lit(x)).cast("string") for x in ("2026-01-31", "2026/1/5", "20260102", "2026-02-30", "20261", None)]
    assert one(spark, *dates) == ("2026-01-31", "2026-01-05", "2026-01-02", None, None, None)


def test_verdict_agreement(spark):
    verdicts = spark.createDataFrame([(1, 1, "effective"), (1, 1, "unknown"), (2, 1, "unknown"), (2, 1, "effective"), (1, 2, "effective"), (2, 2, "insufficient"), (2, 3, None)], "product_id long, ingredient_id long, verdict string")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert resolution.verdict_agreement(verdicts, pairs).collect() == [(1, 2, 2, 1)]


def test_lines_are_not_walked_letter_by_letter_where_nothing_asks_for_it(spark):
    # a walk of 80 million letters took minutes
    text = F.repeat(F.lit("no slash here, \u4fdd\u6e7f \U0001f600. "), 20_000)
    rows = spark.range(200, numPartitions=1).select(F.concat(text, F.col("id").cast("string")).alias("line"))
    began = time.perf_counter()
    found = rows.select(t.slash_in_parentheses(F.col("line")).alias("inside"), t.profile_key(F.col("line")).alias("key")).agg(F.count_if("inside").alias("inside"), F.count_distinct("key").alias("keys")).first()
    assert tuple(found) == (0, 200) and time.perf_counter() - began < 60
    odd = spark.createDataFrame([(None,), ("",), ("a\n(b\n/",), ("\U0001f600",), ("(a)/",)], "line string")
    assert [tuple(r) for r in odd.select(t.slash_in_parentheses(F.col("line")), t.profile_key(F.col("line"))).collect()] == [(None, None), (False, 5381), (True, signed(hashed("a\n(b\n/"))), (False, signed(hashed("\ud83d\ude00"))), (False, signed(hashed("(a)/")))]

"""Operators on hand-checked toy tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import changes, concentration, dedup, evaluation, evidence, listing, matching, pages, similarity, vectors
from evidentia.operators.components import components

LINK = "product_id long, ingredient_id long, position int, is_trace boolean, conc_low double, conc_high double"
ASSERTION = "assertion_id long, ingredient_id long, effect string, family string, effective_low double, strength double, level string, kind string"


def make_links(spark, pairs):
    return spark.createDataFrame([(p, i, k, False, None, None) for k, (p, i) in enumerate(pairs, 1)], LINK)


@pytest.fixture(scope="module")
def shop(spark):
    """Items 1 {1,2,3}, 2 {1,2,4}, 3 {4,5}, 4 {9}, 5 {1}."""
    return make_links(spark, [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 4), (3, 4), (3, 5), (4, 9), (5, 1), (1, 1)])


def test_shared_components(spark, shop):
    found = similarity.similar_by_components(shop, spark.createDataFrame([(1,)], "product_id long"), 5).collect()
    assert {(r.product_id, r.score, r.rank) for r in found} == {(2, 0.5, 1), (5, 0.3333, 2)}


def test_effect_profiles(spark, shop):
    rows = [(1, 1, "美白", None, None, 0.8, None, "paper"), (2, 2, "保湿", None, None, 0.4, None, "paper"), (3, 4, "美白", None, None, 0.6, None, "paper"), (4, 5, "抗皱", None, None, 0.5, None, "paper"), (5, 9, "其他", None, None, 0.9, None, "paper")]
    profiles = similarity.fingerprints(shop, spark.createDataFrame(rows, ASSERTION))
    found = {r.product_id: r for r in similarity.similar_by_effects(profiles, spark.createDataFrame([(1,)], "product_id long"), 5).collect()}
    assert {k: r.score for k, r in found.items()} == {2: 0.9829, 5: 0.8944, 3: 0.6871}
    assert found[2].dimensions == 2 and found[2].top_families == "美白,保湿"


def test_doses(spark):
    rows = [(1, 1, 1.0, 3.0), (1, 2, 2.0, 4.0), (2, 1, 1.0, 3.0), (2, 3, 0.0, 2.0), (3, 1, None, None), (4, 5, 1.0, 3.0)]
    links = spark.createDataFrame([(p, i, 1, False, a, b) for p, i, a, b in rows], LINK)
    ask = lambda k: similarity.similar_by_dose(links, spark.createDataFrame([(k,)], "product_id long"), 5).collect()
    assert [(r.product_id, r.score) for r in ask(1)] == [(2, 0.4961)] and ask(3) == []


def test_fingerprint_takes_the_best_assertion(spark):
    links = spark.createDataFrame([(1, 1, 1, False, 1.0, 3.0), (1, 2, 2, False, None, None), (1, 3, 3, False, None, None)], LINK)
    rows = [
        (1, 1, "美白", None, 2.0, 0.8, None, "paper"), (2, 1, "美白", None, 1.0, 0.5, None, "paper"), (3, 1, "保湿", None, None, 0.4, None, "paper"), (4, 2, "美白", None, 2.0, 0.6, None, "paper"),
        (5, 2, "防腐", None, None, 0.9, None, "paper"), (6, 2, "美白", None, None, 0.9, "regulation", "paper"), (7, 2, "抗皱", None, None, 0.9, None, "supplier"),
    ]
    assertions = spark.createDataFrame(rows, ASSERTION)
    assert {(r.family, r.weight) for r in similarity.fingerprints(links, assertions).collect()} == {("美白", 1.1), ("保湿", 0.4)}
    assert tuple(similarity.fingerprint_coverage(links, assertions).first()) == (1, 3, 2, 1, 2, 3)


def test_scorecard(spark):
    links = make_links(spark, [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 2), (3, 3), (4, 2), (4, 4), (5, 5)])
    items = spark.createDataFrame([(1, 100.0), (2, 150.0), (3, 100.0), (4, None), (5, 1.0)], "product_id long, price double")
    rows = [(1, 1, "保湿", None, None, 0.5, None, "paper"), (2, 4, "美白", None, None, 0.5, None, "paper")]
    found = similarity.substitutes(items, links, similarity.fingerprints(links, spark.createDataFrame(rows, ASSERTION)), spark.createDataFrame([(1,)], "product_id long"), 5)
    by_id = {r.product_id: r for r in found.collect()}
    assert [k for k, _ in sorted(by_id.items(), key=lambda x: x[1]["rank"])] == [2, 3, 4]
    assert by_id[2].score == round(0.5 + 0.3 + 0.2 * 100 / 150, 4)
    assert by_id[3].score == round((0.5 * 2 / 3 + 0.2) / 0.7, 4) and by_id[3].efficacy_score is None
    assert by_id[4].score == pytest.approx(0.5 * 0.25 / 0.8, abs=1e-4) and by_id[4].price_weight == 0.0 and by_id[4].efficacy_weight == 0.375


def test_ranking(spark):
    links = make_links(spark, [(1, 1), (1, 1), (2, 2), (3, 3), (3, 4), (4, 3), (5, 5)])
    rows = [
        (1, 1, "美白", "美白", None, None, "human_rct", "paper"), (2, 2, "美白提亮", None, None, None, "human_open", "paper"), (3, 3, "美白", "美白", None, None, "in_vitro", "paper"), (4, 4, "美白", "美白", None, None, None, "paper"),
        (5, 5, "美白", "美白", None, None, "regulation", "paper"), (6, 5, "美白", "美白", None, None, "human_rct", "supplier"),
    ]
    top = evidence.efficacy_ranking(links, spark.createDataFrame(rows, ASSERTION), "美白", 20).collect()
    assert [(r.product_id, r.ingredient_hits, r.human_evidence, r.score) for r in top] == [(1, 1, 2, 7), (2, 1, 1, 4), (3, 2, 0, 2), (4, 1, 0, 1)]
    with pytest.raises(ValueError):
        evidence.efficacy_ranking(links, links, "unknown")


def test_evidence_profile(spark):
    links = make_links(spark, [(1, 1), (1, 2), (1, 3)])
    rows = [(k, i, "x", None, None, None, level, "paper") for k, (i, level) in enumerate([(1, "human_rct"), (1, "in_vitro"), (2, "regulation"), (2, None)])]
    found = {r.level: (r["count"], r.ratio) for r in evidence.evidence_profile(links, spark.createDataFrame(rows, ASSERTION)).collect()}
    assert len(found) == 9 and found["human_rct"] == (1, 0.25) and found["unknown"] == (1, 0.25) and found["animal"] == (0, 0.0)


def test_lists(spark, shop):
    items = spark.createDataFrame([(1, "Cream", "B"), (2, "Gel", "A"), (3, "cream 2", "")], "product_id long, name string, brand string")
    claims = spark.createDataFrame([(1, "保湿"), (1, "美白"), (3, "x")], "product_id long, claim string")
    listed = listing.list_items(items, shop, claims, words="CREAM")
    assert {(r.product_id, r.claim_count, r.ingredient_count) for r in listed.collect()} == {(1, 2, 4), (3, 1, 2)}
    assert [r.product_id for r in listing.list_items(items, shop, claims, claim_words=["湿"]).collect()] == [1]
    assert [r.product_id for r in listing.list_items(items, shop, claims, has_claims="false").collect()] == [2]
    assert [r.product_id for r in listing.page(items, listing.sort_order(None), 1, 1).collect()] == [2]
    assert [r.brand for r in listing.brands(items).collect()] == ["A", "B"]
    with pytest.raises(ValueError):
        listing.sort_order("price")
    one = {r.ingredient_id: r for r in listing.penetration(shop.where("product_id < 5")).collect()}[1]
    assert (one.products, one.penetration) == (2, 0.5)


def test_latest(spark):
    rows = spark.createDataFrame([(1, 1, "2026-03-01"), (2, 1, "2026-07-05"), (3, 1, "2026-07-05")], "id long, product_id long, date string")
    assert [r.id for r in listing.latest_and_history(rows, "product_id", ["date", "id"]).orderBy("age_rank").collect()] == [3, 2, 1]


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(1)
    matrix = rng.normal(size=(60, 8)).astype(np.float32)
    matrix[7] = matrix[3]
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], "id long, vector array<float>").repartition(3)
    exact = matrix.astype(float) @ matrix.astype(float).T
    for block_rows in (4096, 7):
        found = vectors.nearest(rows, rows, 5, block_rows)
        by = {}
        for r in found.orderBy("query_id", "rank").collect():
            by.setdefault(r.query_id, []).append(r.id)
        for q in range(60):
            order = sorted((i for i in range(60) if i != q), key=lambda i: (-round(exact[q, i], 6), i))
            assert by[q] == order[:5]
    assert vectors.nearest(rows, rows.limit(0), 5).count() == 0
    assert all(len(x) == 3 for x in [[r.id for r in vectors.pooled_nearest(rows, rows.where("id < 3").select("id"), rows.where("id = 9"), 5).collect()]])


def test_profiles_of_lists(spark):
    links = make_links(spark, [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 3)])
    assert 1 not in {r.ingredient_id for r in vectors.tf_idf(links).collect()}
    placed = spark.createDataFrame([(1, 1, 1), (1, 1, 3), (1, 2, 2)], "product_id long, ingredient_id long, position int")
    assert {(r.ingredient_id, round(r.weight, 6)) for r in vectors.rank_decay(placed).collect()} == {(1, 1.0), (2, 0.63093)}


def test_list_agreement(spark):
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "query_id long, product_id long, rank int")
    b = spark.createDataFrame([(1, 1, 1), (1, 3, 2), (1, 2, 3)], "query_id long, product_id long, rank int")
    c = spark.createDataFrame([(1, 1, 1), (1, 8, 2)], "query_id long, product_id long, rank int")
    assert tuple(vectors.list_agreement(a, b).first()) == (1, 1.0, 3, 0.5)
    assert tuple(vectors.list_agreement(a, c).first()) == (1, 0.25, 1, None)


def test_probe(spark):
    score, kind = vectors.linear_probe(F.array(F.lit(1.0), F.lit(2.0)), [1.0, -0.5], 3.0)
    row = spark.range(1).select(score.alias("s"), kind.alias("k")).first()
    assert row.s == pytest.approx(1 / (1 + np.exp(-3))) and row.k == "generated"


def test_tiers(spark):
    register = spark.createDataFrame([(1, "Trideceth-3"), (2, "Trideceth-12"), (3, "A-B"), (4, "AB")], "value long, name string")
    aliases = spark.createDataFrame([("VC", 9)], "alias string, value long")
    names = spark.createDataFrame([("TRIDECETH 3",), ("trideceth-12",), ("a b",), ("vc",), ("none",), (None,)], "written string")
    tiers = matching.standard_tiers(register, "name", "value", "written", aliases)
    found = {r.written: (r.matched, r.via) for r in matching.match_tiers(names, "written", tiers).collect()}
    assert found == {"TRIDECETH 3": (1, "collapsed"), "trideceth-12": (2, "exact"), "a b": (None, None), "vc": (9, "alias"), "none": (None, None), None: (None, None)}


def test_votes_and_gaps(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")], "k string, v string")
    assert [tuple(r) for r in matching.majority(rows, "k", "v").collect()] == [("a", "x", 2)]
    numbers = spark.createDataFrame([("a", 1), ("a", 2), ("a", 5), ("a", 5), ("b", 7)], "k string, n long")
    assert [tuple(r) for r in matching.id_gaps(numbers, "k", "n").collect()] == [("a", 3, 4, 2)]


@pytest.mark.parametrize("most_chars", [matching.MOST_PHRASE_CHARS, 0])
def test_phrases(spark, most_chars):
    found = lambda *x, **y: {tuple(r) for r in matching.phrases_in_texts(*x, **y, most_chars=most_chars).collect()}
    texts = spark.createDataFrame([(1, "one two  three four"), (2, "two three"), (3, None), (4, "xone two three")], "text_id long, text string")
    phrases = spark.createDataFrame([(1, "two three"), (2, "one two three four"), (3, ""), (4, "four"), (5, "three four five"), (6, None)], "phrase_id long, phrase string")
    assert found(texts, phrases, 3, by_words=True) == {(1, 1), (1, 2), (1, 4), (2, 1), (4, 1)}
    want = {(1, 4), (2, 1), (4, 1)}
    assert found(texts, phrases) == want
    chinese = spark.createDataFrame([(1, "含烟酰胺和维生素C吗"), (2, "水"), (2, "水")], "text_id long, text string")
    names = spark.createDataFrame([(1, "烟酰胺"), (2, "维生素C"), (3, "水"), (4, "维生素E"), (5, "水"), (6, "胺和")], "phrase_id long, phrase string")
    assert found(chinese, names, 2) == {(1, 1), (1, 2), (1, 6), (2, 3), (2, 5)}
    assert found(chinese, names.where("phrase_id > 9"), 2) == found(chinese.where("text_id > 9"), names, 2) == set()


def test_pack(spark):
    hits = spark.createDataFrame([(1, 10, 2, 4), (1, 11, 2, 6), (1, 12, 1, 2), (1, 13, 1, 2), (1, 14, 3, 9), (2, 10, 3, 4)], "question_id long, entity_id long, stage int, length int")
    facts = spark.createDataFrame([(e, k, f"{e}.{k}") for e in (10, 11, 12, 13, 14) for k in (1, 2, 3)], "entity_id long, evidence_id long, text string")
    found = matching.evidence_pack(hits, facts).orderBy("question_id", "item").collect()
    assert [r.text for r in found if r.question_id == 1] == ["12.1", "12.2", "12.3", "13.1", "13.2", "13.3", "11.1", "11.2"]
    assert [r.text for r in found if r.question_id == 2] == ["10.1", "10.2", "10.3"]


def test_ordered_text(spark):
    rows = spark.createDataFrame([(1, "抗坏血酸", None), (1, "水", 1), (1, "烟酰胺", 2), (1, "水", 5)], "p long, name string, position int")
    assert matching.ordered_text(rows, "p", "name", "position").first().text == "水、烟酰胺、抗坏血酸"


def test_duplicate_clusters(spark):
    base = [f"w{k}" for k in range(30)]
    sets = {1: base, 2: base, 3: [*base[:29], "x"], 4: base[:20], 5: [*base[:28], "x", "y"], 6: ["a", "b", "c"], 7: ["a", "b", "c"], 8: base}
    blocks = {8: "other"}
    keys = spark.createDataFrame([(i, blocks.get(i, "b"), key) for i, own in sets.items() for key in own], "id long, block string, key string")
    found = {r.id: (r.class_id, r.cluster_id, r.n_links) for r in dedup.duplicate_clusters(keys).collect()}
    assert found == {1: (1, 1, 1), 2: (1, 1, 1), 3: (3, 1, 2), 5: (5, 1, 1), 4: (4, 4, 0), 6: (6, 6, 0), 7: (6, 6, 0), 8: (8, 8, 0)}


def test_prefixes_lose_no_pair(spark):
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(12):
        core = rng.choice(200, 25, replace=False)
        for _ in range(6):
            own = set(core.tolist())
            for _ in range(int(rng.integers(0, 4))):
                own.discard(int(rng.choice(sorted(own))))
                own.add(int(rng.integers(0, 200)))
            sets.append(own)
    keys = spark.createDataFrame([(i, "b", str(k)) for i, own in enumerate(sets) for k in own], "id long, block string, key string")
    classes = dedup.set_classes(keys)
    edges = {(r.u, r.v) for r in dedup.duplicate_edges(classes, F.col("jaccard") >= 0.8, 0.8, 5).collect()}
    firsts = [i for i, own in enumerate(sets) if own not in sets[:i]]
    want = {(a, b) for a in firsts for b in firsts if a > b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert edges == want and want


def test_mutual_best(spark):
    edges = spark.createDataFrame([(10, 1, 0.95, 1.0), (11, 1, 0.9, 1.0), (11, 2, 0.85, 1.0)], "u long, v long, jaccard double, containment double")
    assert [(r.u, r.v) for r in dedup.mutual_best(edges).collect()] == [(10, 1)]


def test_merging(spark):
    items = spark.createDataFrame([(1, None, 5.0), (2, "x", None), (3, "y", 7.0)], "id long, spec string, price double")
    placed = dedup.keepers(spark.createDataFrame([(1, 1), (2, 1)], "id long, cluster_id long"), [F.asc("id")])
    assert {tuple(r) for r in dedup.merge_items(items, placed, "id", ["spec", "price"]).collect()} == {(1, "x", 5.0), (3, "y", 7.0)}
    children = spark.createDataFrame([(2, "a"), (3, "b")], "id long, v string")
    assert {tuple(r) for r in dedup.repoint(children, placed, "id").select("id", "v").collect()} == {(1, "a"), (3, "b")}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 1)], "u long, v long")
    assert {r.node: r.root for r in components(links).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_changes_repeat(spark):
    stored = spark.createDataFrame([(1, "a", 5.0), (2, None, None)], "id long, source string, price double")
    new = spark.createDataFrame([(1, "a", 6.0), (1, "a", 7.0), (2, None, 3.0), (3, "c", 1.0)], "id long, source string, price double")
    keys, order = ["id", "source"], [F.desc("price")]
    once = changes.upsert(stored, new, keys, order)
    assert {tuple(r) for r in once.collect()} == {(1, "a", 7.0), (2, None, 3.0), (3, "c", 1.0)} == {tuple(r) for r in changes.upsert(once, new, keys, order).collect()}
    added = changes.insert_absent(stored, new, keys, order)
    assert {tuple(r) for r in added.collect()} == {(1, "a", 5.0), (2, None, None), (3, "c", 1.0)} == {tuple(r) for r in changes.insert_absent(added, new, keys, order).collect()}


def test_backfill_and_sync(spark):
    stored = spark.createDataFrame([(1, None), (2, 5.0), (3, 5.0), (4, 1.0)], "id long, cap double")
    new = spark.createDataFrame([(1, 2.0), (2, 6.0), (3, None)], "id long, cap double")
    assert {tuple(r) for r in changes.backfill(stored, new, ["id"], "cap").collect()} == {(1, 2.0, "set"), (2, 5.0, "conflict"), (3, 5.0, "none"), (4, 1.0, "none")}
    assert (2, 6.0, "corrected") in {tuple(r) for r in changes.backfill(stored, new, ["id"], "cap", correct=True).collect()}
    assert {tuple(r) for r in changes.sync(stored, new, ["id"], ["cap"]).collect()} == {(1, 2.0, True), (2, 6.0, True), (3, None, True), (4, 1.0, False)}
    good, bad = changes.split_rows(stored, F.col("cap") > 2)
    assert {r.id for r in good.collect()} == {2, 3} and {r.id for r in bad.collect()} == {1, 4}
    assert {r.id for r in changes.orphans(stored, new, "id").collect()} == {4}


def test_scores(spark):
    schema = "question_id int, refused boolean, must_cite array<int>, cited array<int>, n_unsupported int, n_unhedged int"
    rows = [(1, False, [7], [7, 8], 0, 0), (2, True, [], [], 0, 0), (3, False, [], [1], 0, 0), (4, False, [7], [8], 1, 1)]
    scored = evaluation.answer_scores(spark.createDataFrame(rows, schema))
    assert [r.score for r in scored.orderBy("question_id").collect()] == [1, 1, 0, 0]
    assert tuple(evaluation.mean_scores(scored).first()) == (4, 0.5, 0.75, 0.75, 0.5)


def test_replies_and_rounds(spark):
    rows = spark.createDataFrame([('{"supported": true}',), ('so: {"supported": false} ok',), ("none",)], "r string")
    assert [r[0] and r[0].supported for r in rows.select(evaluation.json_reply(F.col("r"), "supported boolean")).collect()] == [True, False, None]
    fixed = evaluation.verify_rounds("a[1]。b[2]。", [], lambda s, _: s != "b[2]", lambda a, bad: a.replace("b[2]", "c[2]"))
    assert fixed == ("a[1]。c[2]。", [], 1)
    marked = evaluation.verify_rounds("b[2]。", [], lambda s, _: False, lambda a, bad: a)
    assert marked == ("⚠️b[2]。", ["b[2]"], 2)


def test_sampling_keeps_all_constraints():
    rng = np.random.default_rng(0)
    for _ in range(6):
        n_main, n_trace = int(rng.integers(3, 7)), int(rng.integers(0, 3))
        trace = np.array([False] * n_main + [True] * n_trace)
        water = np.zeros(len(trace), bool)
        water[0] = True
        cap = np.full(len(trace), np.nan)
        cap[1] = 40.0
        listed = concentration.Listed(trace, water, cap)
        rows = concentration.draw(listed, True, 300, 42, 0.44, 0.15, (30.0, 95.0))
        assert rows.shape == (300, len(trace)) and np.allclose(rows.sum(axis=1), 100, atol=1e-6)
        assert (np.diff(rows[:, :n_main], axis=1) <= 1e-9).all() and (rows[:, trace] <= 0.1).all() and (rows[:, 1] <= 40).all()
        assert ((rows[:, 0] >= 30) & (rows[:, 0] <= 95)).all()
        assert (rows == concentration.draw(listed, True, 300, 42, 0.44, 0.15, (30.0, 95.0))).all()


@pytest.mark.parametrize("trace, water, cap", [([True], [False], [np.nan]), ([False, False], [True, True], [np.nan] * 2), ([False], [True], [np.nan]), ([False, False], [False, False], [0.05, np.nan]), ([False, False], [False, False], [40.0, 40.0]), ([False, False], [True, False], [40.0, np.nan])])
def test_contradictions(trace, water, cap):
    with pytest.raises(concentration.Contradiction):
        concentration.draw(concentration.Listed(np.array(trace), np.array(water), np.array(cap)), True, 10, 1)


def test_estimates(spark):
    schema = "product_id long, ingredient_id long, position int, is_trace boolean, cap double, water boolean, leave_on boolean"
    rows = [(1, 10, 1, False, None, True, True), (1, 11, 2, False, None, False, True), (1, 12, 3, False, 5.0, False, True), (2, 10, 1, True, None, False, True)]
    rows += [(3, i, i, False, None, False, True) for i in range(1001)]
    found = {(r.product_id, r.ingredient_id): r for r in concentration.estimate(spark.createDataFrame(rows, schema), 200).collect()}
    assert {r.reason for (p, _), r in found.items() if p == 3} == {"more main components than 100 % can hold"}
    found = {key: r for key, r in found.items() if key[0] != 3}
    assert found[2, 10].low is None and found[2, 10].reason == "no main components"
    assert 50 <= found[1, 10].low < found[1, 10].high <= 95 and found[1, 12].high <= 5 and found[1, 10].reason is None
    disclosed = spark.createDataFrame([(1, 10, 70.0), (2, 10, 1.0)], "product_id long, ingredient_id long, disclosed double")
    estimates = spark.createDataFrame([(r.product_id, r.ingredient_id, r.low, r.high) for r in found.values()], "product_id long, ingredient_id long, low double, high double")
    assert concentration.anchor_coverage(estimates, disclosed).first().anchors == 2


def test_pages(spark):
    html = '<ul><li>One <b>x</b></li><li class="c">T&amp;wo</li></ul><a class="k" href="/p">go <i>on</i></a><a name="n">no</a>'
    rows = spark.createDataFrame([(1, html), (2, None)], "id long, html string")
    assert [(r.href, r.text) for r in pages.links(rows, "id", "html").collect()] == [("/p", "go on")]
    assert [r.text for r in pages.elements(rows, "id", "html", "li").collect()] == ["One x", "T&wo"]
    lines = pages.lines(spark.createDataFrame([(1, "pre\n# a\nx\n# b\ny\nz")], "id long, text string"), "id", "text")
    assert [(r.entry_no, r.n_lines, r.text) for r in pages.joined_entries(lines, "id", F.col("line").startswith("#")).orderBy("entry_no").collect()] == [(0, 1, "pre"), (1, 2, "# a x"), (2, 3, "# b y z")]


def test_reading_order(spark):
    rows = [("title", 10.0, 90.0, 0.0), ("r1", 55.0, 90.0, 10.0), ("l1", 5.0, 45.0, 12.0), ("l2", 5.0, 45.0, 20.0), ("wide", 10.0, 90.0, 30.0), ("l3", 5.0, 45.0, 40.0), ("r2", 55.0, 95.0, 35.0)]
    boxes = spark.createDataFrame([(1, t, a, b, y, y + 5, 100.0) for t, a, b, y in rows], "page int, text string, left double, right double, top double, bottom double, width double")
    assert [r.text for r in pages.reading_order(boxes, ["page"]).orderBy("reading_no").collect()] == ["title", "l1", "l2", "r1", "wide", "l3", "r2"]


def test_quartiles(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (1, 2, 2, 4, 9)] + [("b", 3.0), ("c", None)], "k string, v double")
    assert {tuple(r) for r in evaluation.exclusive_quartiles(rows, "k", "v").collect()} == {("a", 1.5, 2.0, 6.5), ("b", None, None, None)}


def test_decoding(spark):
    register = spark.createDataFrame([("Aqua", 1), ("Rose Oil", 2), ("rose-oil", 3)], "name string, value long")
    lists = spark.createDataFrame([(1, ["AQUA", "rose oil", "x"])], "id long, words array<string>")
    found = matching.decode(lists, "id", "words", register, "name", "value").orderBy("place").collect()
    assert [(r.word, r.status, r.value) for r in found] == [("AQUA", "hit", 1), ("rose oil", "doubt", None), ("x", "miss", None)]


def test_search_all(spark):
    items = spark.createDataFrame([(1, "Oil rose"), (2, "rose oil"), (3, "ROSE"), (4, "rosehip"), (5, "x")], "id long, name string")
    assert [r.id for r in matching.search_all("rose", 3, item=(items, "id", "name")).collect()] == [3, 4, 2]


def test_question_items(spark):
    rows = spark.createDataFrame([(1, 1, "a", "human_rct"), (2, 1, "a", "human_open"), (3, 2, "a", "animal"), (4, 1, "b", "animal"), (5, 3, "a", "human_ct")], "assertion_id long, ingredient_id long, family string, level string")
    found = {(r.ingredient_id, r.family): (r.kind, r.must_cite) for r in evaluation.question_items(rows, ["human_rct", "human_open", "human_ct"]).collect()}
    assert found == {(1, "a"): ("fact_check", [1, 2]), (2, "a"): ("refusal", [])}


def test_a_component_of_every_item_brings_no_pairs(spark):
    """Ten thousand items share one component: only those that share a rarer one meet, and the result is that of all pairs."""
    n = 3000
    rows = [(i, 0) for i in range(n)] + [(i, 1 + i // 4) for i in range(n)] + [(i, 10_000 + i // 6) for i in range(n)] + [(i, 20_000 + i) for i in range(n)]
    rows += [(n, 0), (n, 30_000), (n + 1, 0)]
    links = spark.createDataFrame(rows, "product_id long, ingredient_id long").repartition(4)
    queries = spark.createDataFrame([(0,), (50,), (n,), (n + 1,)], "product_id long")
    found, decided = similarity.decided_by_rare(links, queries, 2)
    assert found.count() < 20 * 4 and {r.product_id for r in decided.collect()} == {0, 50}
    got = {(r.query_id, r["rank"]): (r.product_id, r.score, r.shared) for r in similarity.similar_by_components(links, queries, 2).collect()}
    sets = {}
    for item, component in rows:
        sets.setdefault(item, set()).add(component)
    for q in (0, 50, n, n + 1):
        ranked = sorted(((-len(sets[q] & s) / len(sets[q] | s), i, len(sets[q] & s)) for i, s in sets.items() if i != q and sets[q] & s))[:2]
        assert [got[q, k + 1] for k in range(2)] == [(i, round(-j, 4), shared) for j, i, shared in ranked]


def test_decay_weighs_earlier_places_more():
    listed = concentration.Listed(np.array([False] * 6 + [True]), np.array([True] + [False] * 6), np.array([np.nan, 30.0, np.nan, np.nan, np.nan, 4.0, np.nan]))
    alike = concentration.draw(listed, True, 400, 1)
    falling = concentration.draw(listed, True, 400, 1, decay=0.5)
    for rows in (alike, falling):
        assert np.allclose(rows.sum(axis=1), 100) and (np.diff(rows[:, :6], axis=1) <= 1e-9).all() and (rows[:, 5] >= 0.1).all() and (rows[:, 1] <= 30 + 1e-9).all() and (rows[:, 6] <= 0.1).all()
    assert falling[:, 1].mean() > alike[:, 1].mean() and falling[:, 4].mean() < alike[:, 4].mean()
    assert (concentration.draw(listed, True, 400, 1, decay=0.5) == falling).all()
    for wrong in ({"decay": 0.0}, {"decay": 1.5}, {"alpha": 0.0}):
        with pytest.raises(ValueError):
            concentration.draw(listed, True, 10, 1, **wrong)


def test_sets_of_common_tokens_meet_by_whole_parts_only(spark, monkeypatch):
    """No token is rare here, so that any one of them would bring a set together with a tenth of all."""
    rng = np.random.default_rng(3)
    sets = [set(rng.choice(300, 30, replace=False).tolist()) for _ in range(500)]
    for i in range(0, 40, 2):
        sets[i + 1] = (sets[i] - set(sorted(sets[i])[: i % 3])) | set(range(300, 300 + (i // 2) % 3))
    written, materialize = {}, dedup.materialize
    monkeypatch.setattr(dedup, "materialize", lambda df, name: written.setdefault(name, materialize(df, name)))
    keys = spark.createDataFrame([(i, "b", str(k)) for i, own in enumerate(sets) for k in own], "id long, block string, key string")
    edges = {(r.u, r.v) for r in dedup.duplicate_edges(dedup.set_classes(keys)).collect()}
    want = set()
    for a in range(500):
        for b in range(a):
            n = len(sets[a] & sets[b])
            jaccard, containment = n / len(sets[a] | sets[b]), n / min(len(sets[a]), len(sets[b]))
            if sets[a] != sets[b] and containment >= 0.93 and abs(len(sets[a]) - len(sets[b])) <= 2 and (jaccard >= 0.9 or (jaccard >= 0.85 and containment >= 0.96)):
                want.add((a, b))
    assert edges == want and want
    assert written["candidates"].count() <= 2 * len(want) + 20


def test_nearest_holds_few_scores_at_once():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(8)
    # small whole numbers: exact products, many ties
    rows, ids = rng.integers(-3, 4, (12_000, 8)).astype(float), np.arange(12_000)
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 9_000]), pa.array([*rows[i : i + 9_000]])], names=["id", "vector"]) for i in (0, 9_000)]
    asked = ids[::16]
    tracemalloc.start()
    found = next(vectors._block_best(asked, rows[asked], 5, 6)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # all scores of a batch are 54 MB, and were held several times
    scores = rows[asked] @ rows.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :5]
    assert found.column(1).to_pylist() == best.ravel().tolist()
    assert found.column(2).to_pylist() == np.take_along_axis(scores, best, 1).ravel().tolist()


def test_lists_of_one_pattern_are_drawn_once(spark, monkeypatch):
    """Of 40 items, caps that no draw can reach and repeated lists leave two patterns to draw; each item's interval is that of its own draws."""
    schema = "product_id long, ingredient_id long, position int, is_trace boolean, cap double, water boolean, leave_on boolean"
    own = lambda i: [60.0, 40.0 if i % 2 else None, 71.0 + i, None if i % 3 else 150.0]
    rows = [(i, 10 * i + k, k, k == 4, cap, k == 1, True) for i in range(40) for k, cap in enumerate(own(i), 1)]
    written, materialize = {}, concentration.materialize
    monkeypatch.setattr(concentration, "materialize", lambda df, name: written.setdefault(name, materialize(df, name)))
    found = {(r.product_id, r.position): r for r in concentration.estimate(spark.createDataFrame(rows, schema), 200).collect()}
    assert len(found) == 160 and written["draws"].count() == 2
    for i in (0, 1, 2, 39):
        caps = np.array([np.nan if x is None else x for x in own(i)])
        samples = concentration.draw(concentration.Listed(np.array([False] * 3 + [True]), np.array([True] + [False] * 3), caps), True, 200, 42)
        low, high = np.percentile(samples, [5, 95], axis=0)
        for k in range(4):
            r, told = found[i, k + 1], k == 0 or not np.isnan(caps[k])
            assert (r.low, r.high) == (low[k], high[k]) and r.confidence == pytest.approx(0.5 + 0.3 * told + 0.2 * (1 - (high[k] - low[k]) / 100))


def test_lists_that_differ_in_caps_choose_among_the_same_draws(monkeypatch):
    made, shares = [], concentration._shares
    monkeypatch.setattr(concentration, "_shares", lambda *args: made.append(1) or shares(*args))
    trace, water = np.array([False, True, False, False, False]), np.array([True] + [False] * 4)
    raw = list(concentration._new_draws(1, True, 3, 200, 7, 0.44, None))
    assert sum(len(wet[0]) for _, wet, _ in raw) == 200 * concentration.MAX_ROUNDS
    made.clear()
    told = set()
    for caps in [(x, y, z) for x in (3.0, 8.0, 30.0, np.nan) for y in (1.0, 7.0, np.nan) for z in (0.2, 0.5, np.nan)]:
        listed = concentration.Listed(trace, water, np.array([np.nan, np.nan, *caps]))
        want = []
        for traces, wet, parts in raw:
            wet = 50 + 45 * wet[0]
            rows = np.column_stack([wet, 0.1 * traces[0], *(parts * (100 - wet - 0.1 * traces[0] - 3 * 0.15) + 0.15)])
            want.append(rows[(rows[:, 2] <= rows[:, 0] + 1e-12) & ~(rows[:, 2:] > np.array(caps) + 1e-12).any(axis=1)])
        want = np.concatenate(want)
        told.add(len(want) >= 200)
        if len(want) >= 200:
            assert np.allclose(concentration.draw(listed, True, 200, 7, 0.44, 0.15), want[:200], atol=1e-9)
        else:
            with pytest.raises(concentration.Contradiction, match=f"^{len(want)} of 200 samples after 4000 draws$|caps"):
                concentration.draw(listed, True, 200, 7, 0.44, 0.15)
    assert told == {True, False} and len(made) <= concentration.MAX_ROUNDS // 2


def test_near_sets_are_sent_to_groups_and_not_along_with_pairs(spark, monkeypatch):
    """60 near copies of each of two sets, and some of another block: each set goes to a few groups, though it has 59 partners; groups that are too large are dealt out."""
    rng = np.random.default_rng(4)
    sets = {(i, "a" if i < 120 else "b"): set(range(500 * (i % 2), 500 * (i % 2) + 80)) for i in range(130)}
    for own in sets.values():
        own -= set(rng.choice(sorted(own), 1).tolist())
        own |= set(rng.integers(2000, 9000, rng.integers(0, 3)).tolist())
    # equal sets are one class
    sets = {(i, block): own for (i, block), own in sets.items() if not any(j < i and block == other and own == more for (j, other), more in sets.items())}
    keys = spark.createDataFrame([(i, block, str(k)) for (i, block), own in sets.items() for k in own], "id long, block string, key string")
    want = set()
    for (i, block), own in sets.items():
        for (j, other), more in sets.items():
            n = len(own & more)
            jaccard, containment = n / len(own | more), n / min(len(own), len(more))
            if i > j and block == other and own != more and containment >= 0.93 and abs(len(own) - len(more)) <= 2 and (jaccard >= 0.9 or (jaccard >= 0.85 and containment >= 0.96)):
                want.add((i, j, len(own), len(more), jaccard, containment))
    materialize = dedup.materialize
    for at_once in (512, 16):
        written = {}
        monkeypatch.setattr(dedup, "SETS_AT_ONCE", at_once)
        monkeypatch.setattr(dedup, "materialize", lambda df, name: written.setdefault(name, materialize(df, name)))
        found = dedup.duplicate_edges(dedup.set_classes(keys)).collect()
        assert len(found) == len(want) > 1000 and {tuple(r) for r in found} == want
        groups = written["members"].groupBy("part", "one", "other").count()
        assert groups.agg(F.max("count")).first()[0] <= max(at_once, 40)
        assert at_once < 512 or written["members"].count() < 6 * len(sets)

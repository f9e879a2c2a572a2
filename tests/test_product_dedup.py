from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from evidentia.operators import product_dedup

BASE = ["WATER", "GLYCERIN", "NIACINAMIDE", "PANTHENOL", "CARBOMER", "DIMETHICONE", "PHENOXYETHANOL", "TOCOPHEROL", "SQUALANE", "XANTHAN GUM", "CETEARYL ALCOHOL"]


def tables(spark, products):
    """items and keys of (id, name, block, keys)."""
    items = spark.createDataFrame([(i, name, block, False) for i, name, block, _ in products], "id long, name string, block string, own boolean")
    keys = [(i, key, True) for i, _, _, listed in products for key in listed]
    return items, spark.createDataFrame(keys, "id long, key string, placed boolean")


def found(spark, products):
    return {r["id"]: r for r in product_dedup.dedup_products(*tables(spark, products)).collect()}


def clusters(rows):
    groups = {}
    for i, r in rows.items():
        groups.setdefault(r["cluster_id"], set()).add(i)
    return sorted(map(sorted, (g for g in groups.values() if len(g) > 1)))


def test_across_languages(spark):
    rows = found(spark, [
        (1, "某品牌修护精华乳", "适乐肤", BASE), (2, "CeraVe Repair Serum", "适乐肤", BASE),
        # alike, but no duplicates; short formulas; another brand
        (3, "某牌抗老精华", "理肤泉", [*BASE[:8], "SQUALANE", "RETINOL", "CERAMIDE NP"]), (4, "La Roche-Posay Vitamin C Serum", "理肤泉", [*BASE[:8], "ASCORBIC ACID", "XANTHAN GUM", "CETEARYL ALCOHOL"]),
        (5, "某洁面", "短", BASE[:3]), (6, "Cleanser", "短", BASE[:3]), (7, "某霜", "甲", BASE), (8, "Cream", "乙", BASE),
        # Chinese rows are never linked with each other
        (9, "霜一", "丙", BASE), (10, "霜二", "丙", BASE),
    ])
    assert clusters(rows) == [[1, 2]]
    assert {i: (r["n_cross"], r["n_same"]) for i, r in rows.items() if r["n_cross"] or r["n_same"]} == {1: (1, 0), 2: (1, 0)}


def test_only_each_others_best_across_languages(spark):
    rows = found(spark, [(1, "La Roche-Posay Micellar Water", "理肤泉", BASE), (2, "理肤泉修护卸妆液", "理肤泉", BASE), (3, "理肤泉补水卸妆液", "理肤泉", [*BASE, "RETINOL"])])
    assert clusters(rows) == [[1, 2]]


def test_names_written_twice_but_not_variants(spark):
    f1, f2 = [*BASE, "RETINOL"], [*BASE, "ASCORBIC ACID"]
    rows = found(spark, [
        (1, "Shiseido Illuminator (Rose Gold)", "资生堂", f1), (2, "Shiseido Illuminator (Pure Gold)", "资生堂", f1),
        (3, "La Roche-Posay Effaclar Medicated Acne Face Wash", "理肤泉", f2), (4, "La Roche-Posay Effaclear Medicated Acne Face Wash", "理肤泉", f2),
        (5, "La Roche-Posay Effaclar Effaclar Medicated Acne Face Wash", "理肤泉", f2), (6, "la roche posay effaclar medicated acne face wash（effaclar-2）", "理肤泉", f2),
        (7, "Lotion Intense Moist", "丁", f1), (8, "Lotion Fresh Moist", "丁", f1), (9, "Firming Cream", "丁", f1), (10, "Firming Cream Enriched", "丁", f1),
        (11, "CeraVe Mosturising Cream", "戊", f1), (12, "CeraVe Moisturizing Cream", "戊", f1), (13, "CeraVe Moisturising Cream (Europe)", "戊", f1),
    ])
    # 6 and 3 have one multiset of words, 5 repeats one, 4 differs by a letter
    assert clusters(rows) == [[3, 4, 5, 6], [11, 12]]
    assert [rows[i]["n_same"] for i in (3, 4, 5, 6)] == [3, 2, 2, 3]
    assert rows[3]["place"] == 1 and [rows[i]["place"] for i in (4, 5, 6)] == [2, 3, 4]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def one_name(a, b):
    """Names as multisets of words, by plain loops."""
    more_a, more_b = Counter(a) - Counter(b), Counter(b) - Counter(a)
    if set(more_a) <= set(b) and set(more_b) <= set(a):
        return True
    left, right = sorted(more_a.elements()), sorted(more_b.elements())
    return len(left) == len(right) <= 2 and all(edit(x, y) <= 2 for x, y in zip(left, right))


def test_neighbourhoods_lose_no_name(spark):
    """Names of few letters, so that many are near: whatever brute force links has a key in common."""
    import random

    draw = random.Random(4)
    names = sorted({tuple(sorted("".join(draw.choice("ab") for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(1, 4)))) for _ in range(120)})
    rows = spark.createDataFrame([(list(n),) for n in names], "tokens array<string>").select("tokens", product_dedup.name_keys(F.col("tokens")).alias("keys"))
    keys = {tuple(r["tokens"]): set(r["keys"]) for r in rows.collect()}
    linked = [(a, b) for a, b in combinations(names, 2) if one_name(a, b)]
    assert len(linked) > 100 and all(keys[a] & keys[b] for a, b in linked)


def test_links_by_kind_against_brute_force(spark):
    import random

    draw = random.Random(9)
    words = ["cream", "creme", "gel", "gell", "lotion", "day", "night", "rich"]
    formulas = [[f"k{i}" for i in range(14)], [f"k{i}" for i in range(1, 15)], [f"z{i}" for i in range(60)], [f"z{i}" for i in range(59)]]
    products = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(1, 3))) if i % 4 else f"霜{i}", draw.choice(["甲", "乙"]), draw.choice(formulas)) for i in range(1, 90)]
    rows = found(spark, products)
    latin = [(i, n.split(), b, set(f)) for i, n, b, f in products if i % 4]
    same = [(p[0], q[0]) for p, q in combinations(latin, 2) if p[2] == q[2] and len(p[3] & q[3]) / len(p[3] | q[3]) >= 0.98 and one_name(p[1], q[1])]
    degree = Counter(i for pair in same for i in pair)
    assert {i: r["n_same"] for i, r in rows.items()} == {i: degree.get(i, 0) for i, *_ in products}
    score = lambda p, q: (round(len(p[3] & q[3]) / len(p[3] | q[3]), 4), round(len(p[3] & q[3]) / min(len(p[3]), len(q[3])), 4))
    best_u, best_v = {}, {}
    for p in [(i, n, b, set(f)) for i, n, b, f in products if i % 4 == 0]:
        for q in [x for x in latin if x[2] == p[2]]:
            j, inside = score(p, q)
            if abs(len(p[3]) - len(q[3])) <= 2 and inside >= 0.93 and (j >= 0.9 or (j >= 0.85 and inside >= 0.96)):
                best_u[p[0]] = max(best_u.get(p[0], (0,)), (j, inside, len(q[3]), -q[0], q[0]))
                best_v[q[0]] = max(best_v.get(q[0], (0,)), (j, inside, len(p[3]), -p[0], p[0]))
    mutual = [(u, x[4]) for u, x in best_u.items() if best_v[x[4]][4] == u]
    assert {i for i, r in rows.items() if r["n_cross"]} == {i for pair in mutual for i in pair} and len(mutual) > 0


def test_merged_links_fill_by_key_and_take_over_where_there_are_none(spark):
    links = spark.createDataFrame([(1, "a", None, 1.0), (1, "b", 5, None), (2, "a", 2, 9.0), (2, "b", 6, 3.0), (2, "c", 7, 1.0), (4, "d", 1, None), (5, "d", 3, 2.0), (6, "e", 1, 1.0)], "id long, key string, position int, dose double")
    placed = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 3, 1), (4, 3, 2), (5, 3, 3), (6, 6, 1)], "id long, cluster_id long, place int")
    merged = product_dedup.merged_links(links, placed, ["position", "dose"])
    assert sorted(map(tuple, merged.collect())) == [(1, "a", 2, 1.0), (1, "b", 5, 3.0), (3, "d", 1, 2.0), (6, "e", 1, 1.0)]


def test_brands_in_two_scripts(spark):
    brands = ["理肤泉 La Roche-Posay"] * 2 + ["理肤泉"] * 5 + ["La Roche-Posay"] + ["OLAY 玉兰油"] * 4 + ["OLAY"] * 2 + ["SK-II", None, "丝塔芙 Cetaphil", "Cetaphil", "Cetaphil"]
    items = spark.createDataFrame([(b,) for b in brands], "brand string")
    assert sorted(map(tuple, product_dedup.majority_brands(items).collect())) == [("丝塔芙 Cetaphil", "Cetaphil", 1), ("理肤泉 La Roche-Posay", "理肤泉", 2)]
    after = Counter(r["brand"] for r in product_dedup.normalize_brands(items).collect())
    assert after["理肤泉"] == 7 and after["Cetaphil"] == 3 and after["OLAY 玉兰油"] == 4 and after[None] == 1


def test_no_items(spark):
    items, keys = tables(spark, [(1, "a", "x", ["k"])])
    assert product_dedup.dedup_products(items.where("id < 0"), keys.where("id < 0")).collect() == []
    assert [tuple(r) for r in product_dedup.dedup_products(items, keys.where("id < 0")).collect()] == [(1, 1, 1, 0, 0)]


@pytest.mark.parametrize("name", ["", "---", "1"])
def test_names_without_words(spark, name):
    rows = found(spark, [(1, name, "甲", [*BASE, "X"]), (2, name, "甲", [*BASE, "X"])])
    assert clusters(rows) == [[1, 2]]


def test_few_names_are_compared_and_many_meet_by_keys(spark, monkeypatch):
    formulas = [[*BASE, *[f"K{i}" for i in range(60)]], [*BASE, *[f"K{i}" for i in range(59)], "L"]]
    names = ["Firming Cream", "Firming Craem", "Firm Cream Rich", "Firming Cream Cream", "Lotion", "Lotoin"]
    products = [(2 * i + j, name, "丁", formula) for j, formula in enumerate(formulas) for i, name in enumerate(names)]
    written, materialize = [], product_dedup.materialize
    monkeypatch.setattr(product_dedup, "materialize", lambda df, name: (written.append((name, df.count())), materialize(df, name))[1])
    few = found(spark, products)
    # no key of a name is written for the few
    assert ("names", 0) in written and clusters(few)
    monkeypatch.setattr(product_dedup, "NAMES_COMPARED", 0)
    assert found(spark, products) == few and max(n for name, n in written if name == "names") > 0


def test_only_links_of_merged_documents_meet(spark, tmp_path, monkeypatch):
    """Lone documents keep their links without meeting others; a repeated id, one without text and one without an id don't change what the merge of all links gives."""
    from evidentia.plans import merge_queries

    words = [f"w{i}" for i in range(200)]
    texts = [(i, " ".join(words[i : i + 30]), "en") for i in range(0, 60, 3)] + [(101, " ".join(words[:30]), "en"), (100, " ".join(words[:30]), "en"), (7, None, "fr"), (None, "a b c", "de"), (9, "again", "de"), (9, "again twice", "fr")]
    rows = spark.createDataFrame([(*row, len(row[1] or ""), "s") for row in texts], "doc_id long, text string, lang string, n_chars long, source string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    given, merged = [], product_dedup.merged_links
    monkeypatch.setattr(product_dedup, "merged_links", lambda links, *args: given.append(links) or merged(links, *args))
    found = sorted(map(tuple, merge_queries.dedup_product_links(spark, str(tmp_path)).collect()))
    items = merge_queries.documents_as_items(spark, str(tmp_path))
    keys = merge_queries.listed_keys(items)
    placed = product_dedup.dedup_products(items, keys).select("id", "cluster_id", "place")
    assert sorted(map(tuple, merge_queries.placed_documents(items).na.fill(-1).collect())) == sorted(map(tuple, product_dedup.dedup_products(items, keys).na.fill(-1).collect()))
    of_all = merged(keys.select("id", "key", "position"), placed, ["position"])
    assert found == sorted(map(tuple, of_all.groupBy("id").agg(F.count("*"), F.count("position"), F.sum("position")).collect()))
    met = {r.id for r in given[0].select("id").distinct().collect()}
    several = placed.groupBy("cluster_id").agg(F.collect_list("id").alias("ids")).where("size(ids) > 1").collect()
    assert met == {i for r in several for i in r.ids} and 9 in met and len(met) < len(texts) / 2

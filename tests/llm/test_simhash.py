from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from evidentia.llm import simhash
from evidentia.operators.components import components


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def expected(rows):
    of_row = [fingerprint(text) for _, text, *_ in rows]
    root = brute_components(set(of_row), lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for (doc_id, *_), fp in zip(rows, of_row):
        if doc_id is not None:
            first[root[fp]] = min(first.get(root[fp], doc_id), doc_id)
    return Counter((doc_id, f"{fp:016x}", first.get(root[fp])) for (doc_id, *_), fp in zip(rows, of_row))


def test_components_of_documents(edge_docs, edge_rows):
    assert Counter(map(tuple, simhash.simhash_components(edge_docs).collect())) == expected(edge_rows)


def test_crowded_segments_give_the_same_components(edge_docs, edge_rows):
    assert Counter(map(tuple, simhash.simhash_components(edge_docs, hot=1).collect())) == expected(edge_rows)


def test_clouds(spark):
    # clouds around a few centres, with chains of 3 bits and pairs of 4 bits that must not link
    rng = np.random.default_rng(7)
    fps = set()
    for _ in range(6):
        centre = int(rng.integers(0, 2**63))
        for _ in range(60):
            fp = centre
            for bit in rng.choice(64, size=int(rng.integers(0, 5)), replace=False):
                fp ^= 1 << int(bit)
            fps.add(fp - 2**64 if fp >= 2**63 else fp)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    mask = 2**64 - 1
    want = brute_components(fps, lambda a, b: ((a ^ b) & mask).bit_count() <= 3)
    classes = lambda m: {frozenset(n for n in m if m[n] == r) for r in set(m.values())}
    for hot in (2, 8, 64, 1000):
        links = simhash.fingerprint_links(df, hot)
        assert all(((r.u ^ r.v) & mask).bit_count() <= 3 for r in links.collect()) or hot < 64
        found = {n: n for n in fps} | {r.node: r.root for r in components(links).collect()}
        assert classes(found) == classes(want), hot


def test_cold_links_are_complete(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 2**62))
    fps = {centre} | {centre ^ sum(1 << int(b) for b in rng.choice(64, size=k, replace=False)) for k in (1, 2, 3) for _ in range(12)}
    fps = {x - 2**64 if x >= 2**63 else x for x in fps}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    mask = 2**64 - 1
    found = {frozenset((r.u, r.v)) for r in simhash.fingerprint_links(df, hot=10_000).collect()}
    assert found == {frozenset((a, b)) for a in fps for b in fps if a != b and ((a ^ b) & mask).bit_count() <= 3}


def test_dropping(edge_docs, edge_rows):
    left = simhash.drop_near_copies(edge_docs)
    assert left.columns == edge_docs.columns
    want = Counter({d: 1 for d, _, c in expected(edge_rows) if d == c})
    assert Counter(r.doc_id for r in left.select("doc_id").collect()) == want


def test_one_row_of_each_component_stays_whatever_its_id(spark):
    # repeated rows, an id shared by different texts, and components of rows without an id only
    rows = [(7, "a b c d e"), (7, "a b c d e"), (8, "v w x y z"), (9, "V w x y z"), (9, "something else it is"), (None, "no id here at all"), (None, "no id here at all"), (None, "v w x y z")]
    for hot in (0, simhash.HOT):
        left = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), hot)
        assert Counter(map(tuple, left.collect())) == Counter([(7, "a b c d e"), (8, "v w x y z"), (9, "something else it is"), (None, "no id here at all")])


def test_rows_of_files_are_told_by_their_places(spark, tmp_path):
    rows = [(7, "a b c d e"), (7, "a b c d e"), (8, "v w x y z"), (9, "V w x y z"), (9, "something else it is"), (None, "no id here at all")] * 2
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"file://{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    want = Counter([(7, "a b c d e"), (8, "v w x y z"), (9, "something else it is"), (None, "no id here at all")])
    assert Counter(map(tuple, simhash.drop_near_copies(docs, from_files=True).collect())) == want
    clash = docs.withColumn("_metadata", F.lit("x"))
    assert Counter((r.doc_id, r.text) for r in simhash.drop_near_copies(clash, from_files=True).collect()) == want


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (501, 501), (None, 3)], "u long, v long")
    found = {r.node: r.root for r in components(links).collect()}
    assert found == {i: 0 for i in range(301)} | {500: 500, 501: 500}


def test_empty_table(no_docs):
    assert simhash.simhash_components(no_docs).count() == 0
    assert simhash.drop_near_copies(no_docs).count() == 0

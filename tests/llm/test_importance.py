import hashlib
import math
import re
import zlib

import pytest

from evidentia.llm import importance

DATA = "/root/testdata/sf0.001"


def words_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text) if w]


def runs_of(text, most):
    words = words_of(text)
    return [" ".join(words[i : i + k]).encode() for k in range(1, most + 1) for i in range(len(words) - k + 1)]


def brute(texts, targets, most=1, buckets=10_000, least=20, percent=10, seed=2024):
    """Features as strings, scores and draws by plain loops; texts: (doc_id, text)."""
    bucket = lambda run: zlib.crc32(run) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, text in texts:
        for run in runs_of(text, most):
            s[bucket(run)] += 1
    for text in targets:
        for run in runs_of(text, most):
            t[bucket(run)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in texts:
        runs = runs_of(text, most)
        weight = sum(gain[bucket(run)] for run in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0))), len(words_of(text)) >= least))
    enough = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = enough[: len(enough) * percent // 100]
    return rows, drawn


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
def test_composed_crcs_are_those_of_the_strings(monkeypatch, piece):
    monkeypatch.setattr(importance, "PIECE", piece)
    for text in ("", " ,;", "one", "One two, THREE naïve 你好 four-five " * 9, "x" * 500 + " y " + "z" * 300 + " end"):
        for most in (1, 2, 3, 5):
            found = [int(c) for _, part in importance.feature_crcs(text.encode(), most) for c in part]
            assert sorted(found) == sorted(zlib.crc32(run) for run in runs_of(text, most))


def test_matrices_append_zero_bytes():
    import numpy as np

    for a, b in ((b"ab", b"c"), (b"", b"xyz"), (b"q" * 100, b"long" * 70_000)):
        joined = importance.lengthened(np.array([zlib.crc32(a)], dtype=np.uint32), np.array([len(b)], dtype=np.uint32))
        assert int(joined[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize("most", [1, 3])
def test_against_brute_force(spark, edge_docs, edge_rows, most):
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    targets = [r["text"] for r in benchmark.collect()]
    rows, drawn = brute([(r[0], r[1]) for r in edge_rows], targets, most)
    found = importance.resample(edge_docs, benchmark, most_words=most).collect()
    assert sorted(map(repr, (tuple(r)[:4] for r in found))) == sorted(map(repr, (r[:4] for r in rows)))
    got = sorted((r for r in found if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, len(drawn) + 1))
    assert [(r["doc_id"], r["score"]) for r in got] == [(r[0], r[3]) for r in drawn]


def test_repeated_rows_are_drawn_each_and_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "word " * 30, "a"), (1, "word " * 30, "a"), (2, "other " * 30, "b"), (3, "few", "c"), (None, None, "d")], "doc_id long, text string, rank string")
    target = spark.createDataFrame([("word word",), (None,)], "text string")
    found = importance.resample(docs, target, percent=100).collect()
    assert len(found) == 5 and sorted(r["rank"] for r in found if r["rank"]) == [1, 2, 3]
    kept = importance.drawn(docs, target, percent=100)
    assert kept.columns == docs.columns and sorted(r["rank"] for r in kept.collect()) == ["a", "a", "b"]


def test_target_like_documents_weigh_more(spark):
    docs = spark.createDataFrame([(k, ("apple pear " if k % 2 else "stone brick ") * 20) for k in range(40)], "doc_id long, text string")
    target = spark.createDataFrame([("apple pear plum",)], "text string")
    found = {r["doc_id"]: r["weight"] for r in importance.resample(docs, target).collect()}
    assert min(found[k] for k in found if k % 2) > max(found[k] for k in found if not k % 2)


def test_empty_tables(spark, no_docs):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(no_docs, none).collect() == []
    docs = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert [r["rank"] for r in importance.resample(docs, none, percent=100).collect()] == [1]

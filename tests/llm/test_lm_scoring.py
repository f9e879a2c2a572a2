import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from evidentia.llm import lm_scoring

MODEL = {"max_words": 200, "max_grams": 300, "least_count": 2}


def tokens(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


class Plain:
    """The interpolated model by direct recursion over counts, without states or arcs."""

    def __init__(self, rows):
        self.words, twos, threes = Counter(), Counter(), Counter()
        for doc_id, text, *_ in rows:
            if held(doc_id):
                continue
            own = tokens(text)
            self.words.update(own)
        self.n, self.v = sum(self.words.values()), len(self.words)
        often = {w for w, c in self.words.items() if c >= max(MODEL["least_count"], -(-self.n // MODEL["max_words"]))}
        for doc_id, text, *_ in rows:
            if held(doc_id):
                continue
            own = tokens(text)
            twos.update(g for g in zip(own, own[1:]) if set(g) <= often)
            threes.update(g for g in zip(own, own[1:], own[2:]) if set(g) <= often)
        least = max(MODEL["least_count"], -(-self.n // MODEL["max_grams"]))
        self.twos = {g: c for g, c in twos.items() if c >= least}
        self.threes = {g: c for g, c in threes.items() if c >= least and g[:2] in self.twos}

    def p(self, word, history):
        if not history:
            return (self.words[word] + 1) / (self.n + self.v + 1)
        grams = self.threes if len(history) == 2 else self.twos
        own = {g[-1]: c for g, c in grams.items() if g[:-1] == tuple(history)}
        below = self.p(word, history[1:])
        if not own:
            return below
        total = self.twos[tuple(history)] if len(history) == 2 else self.words[history[0]]
        weight = 1 - sum(c - lm_scoring.DISCOUNT for c in own.values()) / total
        return max(own.get(word, 0) - lm_scoring.DISCOUNT, 0) / total + weight * below

    def score(self, text):
        own, total, memo = tokens(text), 0.0, self.__dict__.setdefault("memo", {})
        for i, word in enumerate(own):
            key = (word, tuple(own[max(0, i - 2) : i]))
            if key not in memo:
                memo[key] = math.log10(self.p(*key))
            total += memo[key]
        return total


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


@pytest.mark.parametrize("chunk_bytes", [lm_scoring.CHUNK_BYTES, 5000])
def test_scores(edge_docs, edge_rows, chunk_bytes):
    model = Plain(edge_rows)
    assert model.threes and model.twos
    rows = lm_scoring.lm_scores(edge_docs, chunk_bytes=chunk_bytes, **MODEL).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:5], round(r[5], 4))
    expected = []
    for doc_id, text, *_ in edge_rows:
        own = tokens(text)
        base = sum(math.log10((model.words[w] + 1) / (model.n + model.v + 1)) for w in own)
        expected.append((doc_id, held(doc_id), len(own), sum(model.words[w] > 0 for w in own), model.n, base, model.score(text)))
    assert len(rows) == len(expected)
    for got, want in zip(sorted(map(tuple, rows), key=key), sorted(expected, key=key)):
        assert got[:5] == want[:5]
        assert got[5] == pytest.approx(want[5], rel=1e-9) and got[6] == pytest.approx(want[6], rel=1e-9)


def test_probabilities_sum_to_one():
    grams = {2: {1 << 16 | 2: 5, 2 << 16 | 1: 3, 2 << 16 | 2: 2}, 3: {1 << 32 | 2 << 16 | 1: 3}}
    counts = [0, 9, 11]
    total = sum(counts) + len(counts)
    automaton = lm_scoring.Automaton([0.0, *[math.log10((c + 1) / total) for c in counts[1:]]], counts, grams)
    unknown = 1 / total
    for state in range(len(automaton.fail)):
        known = sum(10 ** automaton.log_probability(state, word)[1] for word in (1, 2))
        assert known + unknown * 10 ** automaton.log_probability(state, 0)[1] == pytest.approx(1.0)


def test_model_beats_its_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    better = lm_scoring.lm_scores(docs).where("held_out").selectExpr("sum(score) > sum(base_score) as better").first().better
    assert better


def test_what_is_kept_does_not_shrink_with_the_corpus(spark):
    # "qa qb qc" occurs 3 times, among so many other words that it is far below any share of the corpus
    ids = [i for i in range(200) if not held(i)]
    texts = ["qa qb qc"] * 3 + ["filler words here " * 12_000] * 4
    test = next(i for i in range(1000, 2000) if held(i))
    docs = spark.createDataFrame([*zip(ids, texts), (test, "qa qb qc")], "doc_id long, text string")
    row = lm_scoring.lm_scores(docs).where(f"doc_id = {test}").first()
    n, v, d = row.train_tokens, 7, lm_scoring.DISCOUNT
    base = lambda c: (c + 1) / (n + v + 1)
    after = lambda low: (3 - d) / 3 + d / 3 * low
    want = [base(3), after(base(3)), after(after(base(3))), after(after(base(7)))]
    assert n == 3 * 4 + 4 * 36_001 and row.score == pytest.approx(sum(map(math.log10, want)), rel=1e-9)


def test_empty_tables(no_docs, spark):
    assert lm_scoring.lm_scores(no_docs).count() == 0
    one = spark.createDataFrame([(next(i for i in range(1000) if not held(i)), None)], "doc_id long, text string")
    row = lm_scoring.lm_scores(one).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (1, 1, 1)


def test_no_training_rows(spark):
    doc_id = next(i for i in range(1000) if held(i))
    row = lm_scoring.lm_scores(spark.createDataFrame([(doc_id, "a b")], "doc_id long, text string")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.score) == (True, 3, 0, 0, row.base_score)


def test_mixed_numbers_are_a_bijection_and_packed_ones_come_back():
    for bits in (22, 37, 63):
        keys = np.unique(np.random.default_rng(1).integers(0, 1 << bits, 5000))
        mixed = np.sort(lm_scoring._mixed(keys, bits))
        assert len(np.unique(mixed)) == len(keys) and mixed.min() >= 0 and mixed.max() < 1 << bits
        assert np.array_equal(np.sort(lm_scoring._unmixed(mixed, bits)), keys)
        assert np.array_equal(lm_scoring._climbed(lm_scoring._steps(mixed)), mixed)
        wanted = np.concatenate([mixed[::7], [-1, int(mixed[0]) ^ 1]])
        assert np.array_equal(lm_scoring._find_mixed(mixed, wanted, bits), lm_scoring._find(mixed, wanted))
    assert len(lm_scoring._unpacked(lm_scoring._packed(np.zeros(0, np.int64)))) == 0


def test_a_chunk_sends_each_part_one_row_of_few_bytes_an_n_gram():
    bits = 40
    mixed = lm_scoring._mixed(np.random.default_rng(5).integers(0, 1 << bits, 1_000_000), bits)
    sent = lm_scoring._grams(7, mixed, np.ones(len(mixed), bool), bits)
    assert sent.num_rows == lm_scoring.PARTS
    assert sent.nbytes < 4 * len(mixed)
    gram, n = np.unique(mixed, return_counts=True)
    assert np.array_equal(lm_scoring._joined(sent["x"], lm_scoring._climbed), gram) and np.array_equal(lm_scoring._joined(sent["n"]), n)

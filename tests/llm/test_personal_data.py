import hashlib
import re
import time

import numpy as np
import pytest

from evidentia.llm import personal_data
from evidentia.llm.personal_data import KINDS, base_spans

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ODD = [
    "a@b.c@d.e f@g h@i.j. k@l..m @n.o p@-.q r@s.t-u%",
    "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255 1..2.3.4.5 9.9.9 256.1.1.1.1",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111 1111 1111 79927398713 0000000000000000000 00000000000000",
    "+1 (017) 555-7713 rest +12 +1 2 +49 (0)30.123-4567- +123456789012345 +1234567890123456 +1() +1-",
    "é+1 415 555 0953x@y.z\n10.0.0.1@h.i 5 5 5 5 5 5 5 5 5 5 5 5 5 5",
]


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    found = []
    for order, (kind, form) in enumerate(BASE.items()):
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), order, m.end()))
    return sorted(found)


@pytest.mark.parametrize("text", ODD)
def test_base_spans_are_those_of_the_patterns(text):
    assert base_spans(text) == brute(text)


def test_base_spans_of_random_texts():
    at = np.random.default_rng(7)
    for _ in range(3000):
        text = "".join(at.choice(list("ab@.+-( )0123456789 é%"), size=60))
        assert base_spans(text) == brute(text), text


def test_against_brute_force(spark, edge_docs, edge_rows):
    docs = edge_docs.unionByName(spark.createDataFrame([(2_000_000 + k, t, "en", "web") for k, t in enumerate(ODD)], "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    found = personal_data.personal_data(docs)
    assert found.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    expected = []
    for doc_id, text in [(r[0], r[1]) for r in edge_rows] + [(2_000_000 + k, t) for k, t in enumerate(ODD)]:
        base = brute(text)
        written = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base]
        expected.append((doc_id, *[sum(1 for s in base if s[1] == k) for k in range(4)], hashlib.sha256(",".join(written).encode()).hexdigest(), set(written)))
    got = [(*r[:6], set(filter(None, r[6].split(",")))) for r in map(tuple, found.collect())]
    key = lambda r: repr(r[:6])
    for mine, theirs in zip(sorted(got, key=key), sorted(expected, key=key), strict=True):
        assert mine[:6] == theirs[:6] and theirs[6] <= mine[6]


def corpus():
    """Texts with personal data of wider forms, numbers and capitals that are none, and the spans that should be found."""
    at = np.random.default_rng(11)
    words = "the report shows how many parts of each kind were sold in the north last year".split()
    first, last = ["Anna", "Peter", "Maria", "Thomas", "Laura"], ["Miller", "Schmidt", "Rossi", "Garcia", "Dubois"]
    texts, truth = [], []
    for k in range(600):
        prose = [str(w) for w in at.choice(words, size=30)]
        digits = lambda n: "".join(map(str, at.integers(0, 10, size=n)))
        number = f"({int(at.integers(200, 999))}) 555-{digits(4)}"
        kind, before, span = [
            ("phone", "please call", number),
            ("secret", "token =", "x" + "".join(at.choice(list("0123456789abcdef"), size=39))),
            ("name", "signed Dr", f"{at.choice(first)} {at.choice(last)}"),
            ("email", "mail", f"{at.choice(first).lower()} (at) example{digits(1)} (dot) org"),
            (None, "see section", f"{digits(3)}.{digits(3)}.{digits(4)}"),
            (None, "of The", "North And South"),
        ][k % 6]
        prose.insert(15, f"{before} {span}")
        text = " ".join(prose)
        texts.append((k, text))
        truth.append((kind, text.index(span), text.index(span) + len(span)) if kind else None)
    return texts, truth


def test_wider_spans_are_found_and_others_left_alone(spark):
    texts, truth = corpus()
    found = {r["doc_id"]: r["spans"] for r in personal_data.personal_data(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    hit = [f"{t[0]}:{t[1]}:{t[2]}" in found[k].split(",") for k, t in enumerate(truth) if t]
    wrong = [bool(found[k]) for k, t in enumerate(truth) if not t]
    assert sum(hit) >= 0.95 * len(hit) and sum(wrong) <= 0.02 * len(wrong)


def test_reliabilities_are_recovered():
    at = np.random.default_rng(5)
    right = [0.95, 0.9, 0.8, 0.7, 0.55]
    counts = {}
    for _ in range(20_000):
        y = at.random() < 0.4
        pattern = sum(int(2 if (at.random() < p) == y else 0) * 3**j for j, p in enumerate(right))
        counts[7, pattern] = counts.get((7, pattern), 0) + 1
    chance, told = personal_data.reliabilities(counts)
    assert abs(told["name"]["share"] - 0.4) < 0.03
    for p, name in zip(right, personal_data.LABELERS):
        assert all(abs(x - p) < 0.04 for x in told["name"]["right"][name])
    assert chance[7, max(p for _, p in counts)] > 0.99


def test_the_classifier_sees_no_votes(spark):
    """Spans whose labelers are silent are told by their words and form."""
    rows = [[1, 5], [1, 6], [2, 5], [2, 6]] * 50
    weights = personal_data.fit_classifier(rows, np.array([0.9, 0.9, 0.1, 0.1] * 50))
    assert personal_data.probability([1, 7], weights) > 0.7 > 0.3 > personal_data.probability([2, 7], weights)
    assert not personal_data.fit_classifier([], np.zeros(0)).any()


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, "a@" * 200_000, "+1 " * 100_000, "1." * 200_000, "Aa " * 100_000, "=" * 300_000, " at " * 100_000, "1-" * 200_000, "1:" * 200_000, "A1" * 200_000])
def test_long_texts_take_linear_time(text):
    began = time.process_time()
    personal_data.candidates(text)
    assert time.process_time() - began < 6


def test_masked_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([("x", 1, "mail a.b@c.de or +1 (017) 555-7713 now", 2), ("y", 2, None, 3), ("z", None, "", None)], "spans string, doc_id long, text string, start int")
    rows = {r["spans"]: r for r in personal_data.masked(docs).collect()}
    assert rows["x"]["text"] == "mail [EMAIL] or [PHONE] now" and rows["x"]["start"] == 2
    assert rows["y"]["text"] is None and rows["z"]["text"] == ""


def test_empty_tables(spark, no_docs):
    assert personal_data.personal_data(no_docs).collect() == [] and personal_data.masked(no_docs).collect() == []

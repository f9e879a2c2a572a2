import math

import numpy as np
import pytest

from evidentia.llm import hard_negatives
from evidentia.llm.hard_negatives import labelled_vectors

SCHEMA = "label int, extra string, vec_id long, embedding array<float>, anchor string"


def brute(rows):
    """The contract by plain loops; rows: (vec_id, embedding, label)."""
    part = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        part.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for a, label, v in part:
        if a is None or a % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), b, other) for b, other, w in part if b is None or b != a]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for score, positive, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 30 * score <= 100 * s[0] <= 90 * score][:10]
            out += [(a, positive, k + 1, s[1], score, s[0]) for k, s in enumerate(fits)]
    return sorted(out, key=repr)


def table(spark, rows, parts=3):
    return spark.createDataFrame([(label, "x", vec_id, vector, None) for vec_id, vector, label in rows], SCHEMA).repartition(parts)


def mined(df):
    found = hard_negatives.hard_negatives(labelled_vectors(df))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()), key=repr)


def vectors(n, width=8, centres=6, seed=3):
    at = np.random.default_rng(seed)
    middle = at.normal(size=(centres, width))
    return [(k * 4 + 1, (middle[k % centres] * 0.6 + at.normal(size=width) * 0.3).tolist(), int(at.integers(0, 4))) for k in range(n)]


ODD = [
    (None, [0.5] * 8, 1),
    (None, [0.5] * 8, 1),
    (200, [0.5] * 8, 1),
    (200, [0.5] * 8, 1),
    (203, None, 1),
    (204, [0.1] * 8, None),
    (205, [0.1, None] + [0.2] * 6, 2),
    (206, [float("nan")] + [0.2] * 7, 2),
    (207, [float("inf")] + [0.2] * 7, 2),
    (300, [], 2),
    (302, [0.9, 0.8], 2),
    (400, [0.3] * 12, 2),
    (500, [-0.4] * 8, 3),
    (600, [0.0] * 8, 3),
    (700, [0.25] * 8, 9),
    (707, [0.25] * 8, 0),
    (3, [1e6, -1e6] * 4, 0),
    (800, [3e6, -3e6] * 4, 0),
    (801, [3e6, -2.9e6] * 4, 2),
]


@pytest.mark.parametrize("block, group, shard, batch", [(1024, 64, 64, 4096), (5, 2, 2, 3)])
def test_against_brute_force(spark, monkeypatch, block, group, shard, batch):
    for name, value in (("BLOCK", block), ("GROUP", group), ("SHARD", shard), ("BATCH", batch)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = [(25 * k, v, label) for k, (_, v, label) in enumerate(vectors(160))] + ODD
    assert mined(table(spark, rows)) == brute(rows)


def test_very_many_equal_vectors_and_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    rows = [(k, v, label) for k, (_, v, label) in enumerate(vectors(200))] + [(1000 + k, [0.5] * 8, k % 3) for k in range(150)]
    assert mined(table(spark, rows)) == brute(rows)


def test_pruning_by_nodes_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 32)
    rows = [(k, v, label) for k, (_, v, label) in enumerate(vectors(900, width=3, centres=40, seed=5))]
    cells = hard_negatives.sampled(labelled_vectors(table(spark, rows)))
    assert len(cells.axes) > 10
    counted = []
    whole = hard_negatives._pairs

    def counting(groups, blocks, cells, same):
        found = whole(groups, blocks, cells, same)
        counted.append((found.count(), groups.count() * blocks.count()))
        return found

    monkeypatch.setattr(hard_negatives, "_pairs", counting)
    assert mined(table(spark, rows)) == brute(rows)
    assert all(left < every for left, every in counted) and counted[0][0] < 0.7 * counted[0][1]


def test_bounds_hold(spark):
    at = np.random.default_rng(1)
    for _ in range(50):
        a, b = (at.integers(-300, 300, size=(int(at.integers(1, 9)), 5)) for _ in range(2))
        low, high = hard_negatives.interval(a.mean(0), hard_negatives.radius(a - a.mean(0)), b.mean(0), hard_negatives.radius(b - b.mean(0)))
        assert low <= (a @ b.T).min() and (a @ b.T).max() <= high


def test_products_are_exact_beyond_doubles():
    a, b = np.array([[2**31 + 1, 3]]), np.array([[2**31 + 3, 5]])
    assert hard_negatives.products(a, b)[0, 0] == (2**31 + 1) * (2**31 + 3) + 15


def test_empty_tables_and_no_anchors(spark):
    assert mined(table(spark, [(100, None, 1)]).where("vec_id < 0")) == []
    assert mined(table(spark, [(1, [0.5], 1), (2, [0.5], 2)])) == []
    assert mined(table(spark, [(100, [0.5], 1)])) == []

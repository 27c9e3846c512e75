"""Hard negatives against all pairs."""

import random

import numpy as np
import pytest

from servicelens.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, key int, slot int, score string"


def slow(rows, step=100, positives=5, negatives=10, low=30, high=90):
    """rows: (vec_id, vector, label), ids distinct."""
    valid = [
        (i, [int(np.floor(256 * x)) for x in v], label)
        for i, v, label in rows
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)
    ]
    found = []
    for i, v, label in valid:
        if i % step:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, w, other in valid if j != i and len(w) == len(v)]
        scored = sorted(((min(max(s, -(1 << 63)), (1 << 63) - 1), j, o) for s, j, o in scored), key=lambda x: (-x[0], x[1]))
        for p, j, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [x for x in scored if x[2] != label and low * p <= 100 * x[0] <= high * p]
            found += [(i, j, r + 1, k, p, s) for r, (s, k, _) in enumerate(inside[:negatives])]
    return sorted(found)


def fast(spark, rows, **kwargs):
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    out = hn.hard_negatives(frame.repartition(3), **kwargs)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def vectors(rng, n, dim=8, labels=3):
    centre = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    return [(i, [x + rng.gauss(0, 0.7) for x in rng.choice(centre)], rng.randrange(labels)) for i in range(n)]


def test_against_all_pairs(spark):
    rng = random.Random(5)
    rows = vectors(rng, 300, dim=20)
    assert fast(spark, rows, anchor_step=20) == slow(rows, 20)


def test_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(hn, "ANCHOR_ROWS", 7)
    monkeypatch.setattr(hn, "CANDIDATE_ROWS", 60)
    rows = vectors(random.Random(6), 250)
    assert fast(spark, rows, anchor_step=10) == slow(rows, 10)


def test_copies_and_ties(spark):
    rng = random.Random(7)
    rows = vectors(rng, 60) + [(i, [0.5] * 8, i % 3) for i in range(60, 200)]
    assert fast(spark, rows, anchor_step=10) == slow(rows, 10)
    # whole numbers in few steps: many equal scores, zeros and negative products
    rows = [(i, [rng.choice([-1, 0, 0, 1]) / 256 for _ in range(5)], rng.randrange(2)) for i in range(200)]
    assert fast(spark, rows, anchor_step=10) == slow(rows, 10)


def test_awkward_rows(spark):
    rng = random.Random(8)
    rows = vectors(rng, 80)
    rows += [(100, None, 1), (200, [], 1), (300, [1.0, None] * 4, 1), (400, [float("nan")] * 8, 1), (500, [1.0] * 8, None)]
    rows += [(None, [1.0] * 8, 1), (600, [float("inf")] * 8, 1), (700, [1.0, 2.0, 3.0], 1), (701, [1.0, 1.0, 3.0], 1), (702, [0.5, 1.0, 1.5], 0)]
    rows += [(800, [0.0] * 8, 1), (900, [1e9] * 8, 1), (901, [1e9] * 8, 1), (902, [5e8] * 8, 0), (903, [1e30] * 8, 0), (904, [-1e30] * 8, 1)]
    assert fast(spark, rows, anchor_step=20) == slow(rows, 20)
    assert fast(spark, []) == []


def test_repeated_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.8, 0.0], 2), (2, [0.8, 0.0], 2)]
    found = fast(spark, [*rows, rows[0]])
    assert found == [(0, 1, 1, 2, 65536, 52224), (0, 1, 2, 2, 65536, 52224)]


@pytest.mark.parametrize("same", [True, False])
def test_index_leaves_out_pairs(same):
    rng = np.random.default_rng(1)
    centre = np.zeros((1000, 64))
    centre[:, :8] = rng.normal(0, 60, (1000, 8))  # most energy in few dimensions
    rows = np.floor(centre + rng.normal(0, 3, (1000, 64)))
    labels = rng.integers(0, 2, 1000)
    low = np.full((10, 1), 30_000)
    tile = hn.WindowTile(np.arange(10), labels[:10], rows[:10], low, np.full((10, 1), hn._MOST), 1000, same)
    tile.see(np.arange(1000), labels, rows)
    exact = (rows @ rows[:10].T).T
    fits = (exact >= 30_000) & ((labels[:10, None] == labels) == same) & (np.arange(1000) != np.arange(10)[:, None])
    (_, anchors, scores, ids), = tile.best()
    assert sorted(zip(anchors, ids, scores, strict=True)) == [(a, i, exact[a, i]) for a, i in np.argwhere(fits)]
    assert tile.scored < 1.5 * (exact >= 30_000).sum() < 3000


def test_windows_filled_early_ask_no_more(spark, monkeypatch):
    asked = []
    plain = hn._join
    monkeypatch.setattr(hn, "_join", lambda anchors, windows, *rest: asked.append(windows.count()) or plain(anchors, windows, *rest))
    rows = vectors(random.Random(9), 400, dim=6)
    assert fast(spark, rows, anchor_step=50, negatives=1) == slow(rows, 50, negatives=1)
    assert asked == [8, 40]  # all are full at the first threshold
    asked.clear()
    assert fast(spark, rows, anchor_step=50, negatives=60) == slow(rows, 50, negatives=60)
    assert len(asked) == 4 and 0 < asked[3] < 40

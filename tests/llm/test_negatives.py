"""Hard negatives next to a plain search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, is_anchor, positives=5, count=10, low=30, high=90):
    known = []
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None or any(c is None or not np.isfinite(c) for c in vector):
            continue
        known.append((vec_id, label, [int(np.floor(256 * float(np.float32(c)))) for c in vector]))
    out = []
    for anchor, own, q in known:
        if not is_anchor(anchor):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), i, label) for i, label, v in known if i != anchor)
        for p, pos, _ in [s for s in scored if s[2] == own][:positives]:
            fits = [s for s in scored if s[2] != own and low * -p <= 100 * -s[0] <= high * -p][:count]
            out += [(anchor, pos, k, neg, -p, -n) for k, (n, neg, _) in enumerate(fits, 1)]
    return sorted(out)


def vectors(count, width, seed, labels=4, spread=1.0):
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((labels, width))
    out = []
    for i in range(count):
        label = int(rnd.integers(labels)) if rnd.random() < 0.6 else 0
        out.append((i, label, [float(c) for c in np.float32(0.2 * centres[label] + 0.1 * spread * rnd.standard_normal(width))]))
    return out


def mined(spark, rows, **more):
    found = negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("width", [1, 3, 20])
def test_as_brute_force(spark, width):
    rows = vectors(700, width, seed=width)
    assert mined(spark, rows, tile_rows=200) == plain(rows, lambda i: i % 10 == 0)


def test_ties_copies_and_a_hot_label(spark):
    rnd = random.Random(5)
    few = [[round(rnd.uniform(-1, 1), 1) for _ in range(4)] for _ in range(6)]
    rows = [(i, 0 if i % 3 else i % 5, rnd.choice(few)) for i in range(400)]
    assert mined(spark, rows, tile_rows=64) == plain(rows, lambda i: i % 10 == 0)


def test_awkward_rows(spark):
    rows = vectors(120, 3, seed=2)
    rows += [(200, None, [1.0, 1.0, 1.0]), (210, 1, None), (220, 1, [1.0, None, 1.0]), (230, 1, [1.0, float("nan"), 0.0]), (240, 1, [float("inf"), 0.0, 0.0]), (None, 1, [1.0, 0.0, 0.0]), (250, 1, []), (260, 2, [0.5]), (270, 3, [0.1, 0.1, 0.1, 0.4])]
    rows += [(10, 1, [0.3, 0.2, 0.1]), (20, 2, [0.1, 0.1, 0.1]), (20, 2, [0.1, 0.1, 0.1])]  # ids that are there already
    want = plain(rows, lambda i: i % 10 == 0)
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in ("a", "x", "tile", "rank", "score")})
    got = sorted(tuple(r) for r in negatives.mine(clash, F.col("vec_id") % 10 == 0).collect())
    assert got == want
    assert negatives.mine(clash.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert mined(spark, [(10, 1, [1.0]), (11, 2, [1.0])]) == []  # no positive


def test_large_components_are_exact(spark):
    rows = [(i, i % 2, [float(1 << 20) + 64 * i, 3.0, -float(1 << 19) + i]) for i in range(60)]
    assert mined(spark, rows) == plain(rows, lambda i: i % 10 == 0)


def test_boxes_are_pruned_and_leaves_are_full():
    rnd = np.random.default_rng(3)
    x = np.floor(1000 * rnd.standard_normal((4096, 2))).astype(np.int64)
    parts = negatives.str_order(x, 64)
    assert sorted(np.concatenate(parts).tolist()) == list(range(4096)) and {len(p) for p in parts} == {64}
    # Tiles, not slabs: about as wide in both coordinates.
    extents = np.array([np.ptp(x[p], axis=0) for p in parts])
    assert 0.2 < np.median(extents[:, 0]) / np.median(extents[:, 1]) < 5
    labels = np.arange(4096) % 2
    leaves = negatives.leaves_of(labels, x)
    assert all(len(set(labels[p].tolist())) == 1 for p in leaves)
    tree = negatives.Tree(*[[np.ascontiguousarray(a[p]).tobytes() for p in leaves] for a in (np.arange(4096), labels, x)], 2)
    q = np.array([700, -300])
    (scores, ids), = tree.search(q, -1, 1, True, [(-np.inf, np.inf)], 5)
    dots = np.where(labels == 1, x @ q, -(1 << 60))
    want = np.lexsort((np.arange(4096), -dots))[:5]
    assert ids.tolist() == want.tolist() and scores.tolist() == dots[want].tolist()
    assert tree.scored < 1000
    before = tree.scored
    (scores, _), = tree.search(q, -1, 1, False, [(400_000, 450_000)], 10)
    assert ((scores >= 400_000) & (scores <= 450_000)).all() and len(scores) == 10
    assert tree.scored - before < 2000

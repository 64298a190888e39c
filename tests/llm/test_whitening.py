"""Whitening next to numpy's eigenvectors, and its solver next to numpy's singular values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import whitening

CASES = {
    "random": lambda r: r.standard_normal((300, 40)),
    "pairs of equal columns": lambda r: np.repeat(r.standard_normal((200, 12)), 2, axis=1),
    "constant columns": lambda r: np.c_[r.standard_normal((100, 8)), np.zeros((100, 4))],
    "all values equal": lambda r: np.linalg.qr(r.standard_normal((80, 20)))[0],
    "fewer rows than columns": lambda r: r.standard_normal((5, 20)),
    "one column": lambda r: r.standard_normal((50, 1)),
    "graded": lambda r: r.standard_normal((60, 16)) * 10.0 ** -np.arange(16),
    "clusters": lambda r: np.diag([1, 1 + 1e-9, 1 - 1e-9, 1, 1, 2, 2, 2 + 1e-13]) @ np.linalg.qr(r.standard_normal((8, 8)))[0],
    "zeros": lambda r: np.zeros((4, 3)),
}


@pytest.mark.parametrize("case", CASES)
def test_singular_values_and_directions(case):
    a = CASES[case](np.random.default_rng(11))
    width = a.shape[1]
    r = whitening._fold([np.zeros((width, width)), a])
    values, vectors = whitening.singular(r)
    want = np.zeros(width)
    s = np.linalg.svd(a, compute_uv=False) ** 2
    want[: len(s)] = s
    top = max(want[0], 1e-300)
    assert np.abs(values - want).max() <= 1e-13 * top
    rank = int((want > 1e-24 * top).sum())
    z = vectors[:, :rank]
    assert np.abs(z.T @ z - np.eye(rank)).max(initial=0) < 1e-11
    assert np.abs(a.T @ (a @ z) - z * values[:rank]).max(initial=0) <= 1e-13 * top


def test_dqds_keeps_the_digits_of_small_values():
    b, c = 10.0 ** -np.arange(12), 0.5 * 10.0 ** -np.arange(11)
    got = np.sqrt(whitening.dqds(b, c))
    full = np.diag(b) + np.diag(c, 1)
    # The product of all values is the determinant, however small the least are.
    assert np.isclose(np.prod(got), np.prod(b), rtol=1e-12)
    assert np.allclose(got[:4], np.linalg.svd(full, compute_uv=False)[:4], rtol=1e-12)


def plain(vectors):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    spread = n * x - sums
    centred = spread / n
    v = centred.T @ centred / n
    values, vecs = np.linalg.eigh(v)
    order = np.argsort(-values)
    return n, (spread * spread).sum(axis=1), centred, values[order], vecs[:, order], np.trace(v)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_whitened_as_numpy(spark):
    rnd = np.random.default_rng(4)
    vectors = (rnd.standard_normal((500, 6)) @ np.diag([3, 2, 1.5, 1, 0.7, 0.5]) @ rnd.standard_normal((6, 6))).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0])]
    docs = frame(spark, rows + bad).repartition(7).withColumns({n: F.lit("clash") for n in ("n", "component", "x", "r")})
    got = whitening.whiten(docs, components=4).collect()
    n, deviation, centred, values, vecs, trace = plain(vectors)
    assert len(got) == 500 * 4 and {r.n for r in got} == {n} and {r.component for r in got} == {1, 2, 3, 4}
    table = np.zeros((500, 4))
    for r in got:
        assert r.deviation == deviation[r.vec_id]
        assert abs(r.explained - values[r.component - 1] / trace) < 1e-12
        assert 0 <= r.identity_error < 1e-9
        table[r.vec_id, r.component - 1] = r.whitened
    want = centred @ vecs[:, :4] / np.sqrt(values[:4])
    signs = np.sign((table * want).sum(axis=0))
    assert np.abs(table * signs - want).max() < 1e-9
    assert np.abs(table.T @ table / n - np.eye(4)).max() < 1e-9


def test_awkward_rows(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance
    # Two rows vary in one direction; a short vector is filled up with zeros; an id may be missing or repeated.
    got = whitening.whiten(frame(spark, [(None, [1.0, 0.0]), (5, [0.0]), (5, [0.0, 0.0])])).collect()
    assert sorted((r.vec_id or -1, r.component) for r in got) == [(-1, 1), (5, 1), (5, 1)]
    assert sorted(r.deviation for r in got) == [64 * 64, 64 * 64, 4 * 64 * 64]
    assert all(abs(r.explained - 1) < 1e-12 for r in got)
    # Beyond 64 bits: exact sums all the same, and no deviation that a long could hold.
    huge = whitening.whiten(frame(spark, [(1, [1e18, 1.0]), (2, [-1e18, 2.0]), (3, [3.0, 4.0])])).collect()
    assert {r.deviation for r in huge if r.vec_id in (1, 2)} == {None}


def test_deviations_of_whole_tables_are_exact(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in rows.collect()}
    n, deviation, _, values, _, trace = plain(list(vectors.values()))
    want = dict(zip(vectors, deviation.tolist(), strict=True))
    got = whitening.whiten(rows).collect()
    assert len(got) == 32 * n and all(r.deviation == want[r.vec_id] and r.n == n for r in got)
    assert max(abs(r.explained - values[r.component - 1] / trace) for r in got) < 1e-12
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9

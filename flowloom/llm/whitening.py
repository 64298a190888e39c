"""Whitening of embeddings: blockwise QR, bidiagonal singular values by dqds, directions by twisted factorisations.

1. Spark sums the integer vectors exactly: x = floor(``scale`` * c) + ``shift``; n rows, sums S.
2. Every task centres its rows exactly (n * x - S, then / n) and folds them, block by block, into one triangle R by QR. Triangles
   are folded ``FAN`` at a time in rounds of Spark tasks, until one is left: R'R / n is the covariance of all rows.
3. R has the size of the dimension, whatever the number of rows. It is made bidiagonal by Householder reflections; dqds
   finds the singular values (differential, shifted, so small ones keep their digits); for each, the twist of the two
   factorisations of B'B - s^2 with the smallest pivot gives the direction. Values closer than ``CLUSTER`` are kept
   orthogonal, by inverse iteration with the same factorisations where needed.
4. Rows are projected in a second pass. The covariance of what comes out is summed in a pass before it.

Nulls and edges: rows with a null vector or a null or non-finite entry are left out. A shorter vector counts as filled up with
zeros. Directions in which the rows do not vary (singular value below rounding) have no component, so fewer may come out. Entries
beyond 64 bits are held at the ends of a long; a deviation beyond 64 bits is null. Repeated rows and rows without an id are
rows like others. Other columns are not read. Empty tables, and tables without variance, give no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.lineage import cut

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Rows of one QR step, and triangles that one task folds.
BLOCK, FAN = 4096, 16
#: Relative distance of eigenvalues below which their directions are orthogonalised.
CLUSTER = 1e-3
_EPS = np.finfo(float).eps


# ---- a triangle's singular values and directions (the size of the dimension) ----


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal b and upper diagonal c of Q'RP, and the orthogonal P, by Householder reflections from both sides."""
    a, d = r.astype(float).copy(), len(r)
    p = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size == 0 or not len(x):
            return None
        v = x.copy()
        v[0] += math.copysign(size, x[0])
        return v / np.linalg.norm(v)

    for k in range(d):
        v = reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        v = reflector(a[k, k + 1 :])
        if v is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            p[:, k + 1 :] -= 2 * np.outer(p[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def _dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | float:
    """One differential qd transform with a shift; when the shift is above the least value, a smaller one to try."""
    d = q[0] - shift
    out_q, out_e = [], []
    for k in range(len(e)):
        if not d >= 0:
            return shift / 4
        s = d + e[k]
        ratio = q[k + 1] / s if s > 0 else 0.0
        out_q.append(s)
        out_e.append(e[k] * ratio)
        d = d * ratio - shift if s > 0 else q[k + 1] - shift
    if not d >= 0:  # only the last pivot is negative: it says by how much
        return max(shift / 16, (shift + d) * (1 - 4 * _EPS))
    out_q.append(d)
    return out_q, out_e


def dqds(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling."""
    found: list[float] = []
    work = [([float(x) ** 2 for x in b], [float(x) ** 2 for x in c], 0.0, 0.0)]  # q, e, sum of shifts and its rounding
    tiny = _EPS * _EPS
    while work:
        q, e, sigma, lost = work.pop()
        turns = 0
        while q:
            if len(q) == 1:
                found.append(sigma + (q[0] + lost))
                break
            if e[-1] <= tiny * (sigma + q[-1]) or e[-1] <= tiny * tiny * q[-2]:
                found.append(sigma + (q.pop() + lost))
                e.pop()
                turns = 0
                continue
            at = next((k for k in range(len(e) - 2, -1, -1) if e[k] <= tiny * (sigma + min(q[k], q[k + 1]))), None)
            if at is not None:
                work.append((q[: at + 1], e[:at], sigma, lost))
                q, e = q[at + 1 :], e[at + 1 :]
                continue
            if q[0] < 1.5 * q[-1] and turns % 8 == 0:  # the small end belongs below
                q, e = q[::-1], e[::-1]
            # The trailing two rows bound the least value from above; a transform that fails asks for a smaller shift.
            above = e[-2] if len(e) > 1 else 0.0
            half, product = q[-2] + above + q[-1] + e[-1], q[-2] * q[-1] + above * (q[-1] + e[-1])
            shift = 2 * product / (half + math.sqrt(max(0.0, half * half - 4 * product))) if half > 0 and turns < 100 else 0.0
            step = _dqds_step(q, e, shift)
            for attempt in range(8):
                if not isinstance(step, float):
                    break
                shift = step if attempt < 7 else 0.0
                step = _dqds_step(q, e, shift)
            if isinstance(step, float) or turns > 4000:
                raise ArithmeticError("dqds does not converge")
            q, e = step
            total = sigma + (shift + lost)
            lost = (shift + lost) - (total - sigma)
            sigma, turns = total, turns + 1
    return np.sort(np.maximum(found, 0.0))[::-1]


class Twisted:
    """Both triangular factorisations of B'B - value, joined at the row with the smallest pivot."""

    def __init__(self, b: np.ndarray, c: np.ndarray, value: float):
        n, floor = len(b), _EPS * _EPS * max(float((b * b).max()), 1e-300)
        square, off, across = b * b, c * c, b[:-1] * c
        self.down, self.up = np.zeros(max(0, n - 1)), np.zeros(max(0, n - 1))
        s, p, plus, minus = np.empty(n), np.empty(n), np.empty(n), np.empty(n)
        s[0] = -value
        for k in range(n - 1):
            plus[k] = s[k] + square[k]
            plus[k] = plus[k] if abs(plus[k]) > floor else -floor
            self.down[k] = across[k] / plus[k]
            s[k + 1] = off[k] / plus[k] * s[k] - value
        p[n - 1] = square[n - 1] - value
        for k in range(n - 2, -1, -1):
            minus[k + 1] = off[k] + p[k + 1]
            minus[k + 1] = minus[k + 1] if abs(minus[k + 1]) > floor else -floor
            self.up[k] = across[k] / minus[k + 1]
            p[k] = p[k + 1] * square[k] / minus[k + 1] - value
        pivots = s + p + value
        self.twist = int(np.argmin(np.abs(pivots)))
        pivot = pivots[self.twist]
        plus[self.twist] = pivot if abs(pivot) > floor else floor
        plus[self.twist + 1 :] = minus[self.twist + 1 :]
        self.pivots = plus

    def solve(self, right: np.ndarray) -> np.ndarray:
        """The vector that B'B - value maps to ``right``."""
        z, r = right.astype(float).copy(), self.twist
        for k in range(r):
            z[k + 1] -= self.down[k] * z[k]
        for k in range(len(z) - 2, r - 1, -1):
            z[k] -= self.up[k] * z[k + 1]
        z /= self.pivots
        for k in range(r - 1, -1, -1):
            z[k] -= self.down[k] * z[k + 1]
        for k in range(r, len(z) - 1):
            z[k + 1] -= self.up[k] * z[k]
        return z

    def direction(self) -> np.ndarray:
        right = np.zeros(len(self.pivots))
        right[self.twist] = self.pivots[self.twist]
        z = self.solve(right)
        return z / np.linalg.norm(z)


def directions(b: np.ndarray, c: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors of an unsplit bidiagonal matrix, as columns, for its squared singular values (falling)."""
    out = np.zeros((len(b), len(values)))
    rng = np.random.default_rng(7)
    first = 0  # of the cluster
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * values[k - 1]:
            first = k
        z, near = Twisted(b, c, value).direction(), out[:, first:k]

        def apart(z: np.ndarray, near: np.ndarray = near) -> np.ndarray:
            for _ in range(2):
                z = z - near @ (near.T @ z)
            return z

        turn = 0
        while np.linalg.norm(z := apart(z)) < 0.1 and turn < 40:
            # A direction that is there already: inverse iteration from another start, beside the value by a few roundings.
            turn += 1
            z = apart(rng.standard_normal(len(b)))
            beside = Twisted(b, c, value * (1 + 16 * turn * _EPS))
            z = beside.solve(z / np.linalg.norm(z))
            z /= np.linalg.norm(z)
        z = apart(z / np.linalg.norm(z))
        out[:, k] = z / np.linalg.norm(z)
    return out


def singular(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of a square matrix, falling, and its right singular vectors as columns."""
    size = float(np.abs(r).max()) if r.size else 0.0
    if size == 0 or not math.isfinite(size):
        return np.zeros(len(r)), np.eye(len(r))
    b, c, p = bidiagonal(r / size)
    # Below rounding, zeros are as good as small values, and small values are safe to divide by.
    low = 1e-3 * _EPS * float(max(np.abs(b).max(), np.abs(c).max(initial=0.0)))
    b = np.where(np.abs(b) < low, low, b)
    c[np.abs(c) <= _EPS * np.minimum(np.abs(b[:-1]), np.abs(b[1:]))] = 0.0
    borders = np.append(np.append(0, np.flatnonzero(c == 0) + 1), len(b))
    values, vectors = [], np.zeros((len(b), len(b)))
    for start, stop in zip(borders[:-1], borders[1:], strict=True):
        own = dqds(b[start:stop], c[start : stop - 1])
        values += own.tolist()
        vectors[start:stop, start:stop] = directions(b[start:stop], c[start : stop - 1], own)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order] * size * size, (p @ vectors)[:, order]


# ---- over all rows ----


def _usable(rows: DataFrame, vector: str) -> DataFrame:
    return rows.filter(F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))))


def _integers(lists: pa.Array, width: int, scale: int, shift: int) -> np.ndarray:
    """x of every row, shorter vectors filled up."""
    sizes = np.diff(lists.offsets.to_numpy())
    c = np.zeros((len(sizes), width))
    c[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy().astype(float)
    end = 2.0**62
    return np.clip(np.floor(scale * c), -end, end).astype(np.int64) + shift


def _spread(x: np.ndarray, n: int, sums: list[int], small: bool) -> np.ndarray:
    """n * x - S, as 64-bit or as Python integers."""
    if small:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            yield batch.slice(start, BLOCK)


def totals(rows: DataFrame, vector: str, scale: int, shift: int) -> tuple[int, list[int], int]:
    """Number of rows, exact sum of each dimension of x, and the largest absolute x."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, largest, sums, seen = 0, 0, [], []
        for batch in _batches(batches, 0):
            lists = batch.column(0)
            width = int(np.diff(lists.offsets.to_numpy()).max(initial=0))
            x = _integers(lists, width, scale, shift)
            count += len(x)
            largest = max([largest, *(abs(int(v)) for v in (x.max(), x.min()))]) if x.size else largest
            own = x.sum(axis=0).tolist() if largest < 1 << 49 else x.astype(object).sum(axis=0).tolist()
            for k in range(width):
                if k == len(sums):
                    sums.append(0)
                    seen.append(0)
                sums[k], seen[k] = sums[k] + own[k], seen[k] + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(sums))], pa.int32()), pa.array([count, *seen]), pa.array([str(v) for v in [0, *sums]]), pa.array([str(largest)] * (len(sums) + 1))], names=["k", "seen", "total", "largest"])

    parts = rows.select(vector).mapInArrow(step, "k int, seen long, total string, largest string")
    exact = {n: F.col(n).cast("decimal(38,0)") for n in ("total", "largest")}
    # One row a dimension.
    found = {r["k"]: r for r in parts.groupBy("k").agg(F.sum("seen").alias("seen"), F.sum(exact["total"]).alias("total"), F.max(exact["largest"]).alias("largest")).collect()}
    if not found:
        return 0, [], 0
    n = int(found[-1]["seen"])
    # Rows that end before a dimension count as zeros there.
    return n, [int(found[k]["total"]) + (n - int(found[k]["seen"])) * shift for k in range(len(found) - 1)], int(found[-1]["largest"])


def _fold(triangles: list[np.ndarray]) -> np.ndarray:
    width = triangles[0].shape[1]
    r = np.linalg.qr(np.vstack(triangles), mode="r")
    return np.vstack([r, np.zeros((width - len(r), width))]) if len(r) < width else r


def triangle(rows: DataFrame, vector: str, n: int, sums: list[int], small: bool, scale: int, shift: int) -> np.ndarray:
    """R with R'R the sum of outer products of the centred rows."""
    width = len(sums)

    def from_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((width, width))
        for batch in _batches(batches, 0):
            r = _fold([r, (_spread(_integers(batch.column(0), width, scale, shift), n, sums, small) / n).astype(float)])
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def from_triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((width, width))
        for batch in batches:
            for part in batch.column(0):
                r = _fold([r, np.frombuffer(part.as_py()).reshape(width, width)])
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    parts = cut(rows.select(vector).mapInArrow(from_rows, "r binary"))
    while (count := parts.count()) > 1:
        parts = cut(parts.repartition(-(-count // FAN)).mapInArrow(from_triangles, "r binary"))
    return np.frombuffer(parts.first()["r"]).reshape(width, width)


def whiten(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error, a row for each vector and component."""
    kept = _usable(rows.select("vec_id", vector), vector)
    kind = kept.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, sums, largest = totals(kept, vector, scale, shift)
    width = len(sums)
    if not n or not width:
        return kept.sparkSession.createDataFrame([], schema)
    small = 2 * n * largest < 1 << 62
    r = triangle(kept, vector, n, sums, small, scale, shift)
    values, vectors = singular(r)
    some = int((np.sqrt(values) > 8 * width * _EPS * math.sqrt(values[0])).sum()) if values[0] > 0 else 0
    some = min(components, some)
    if not some:
        return kept.sparkSession.createDataFrame([], schema)
    weights = vectors[:, :some] / np.sqrt(values[:some] / n)
    explained = values[:some] / float((r * r).sum())

    def projected(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
        spread = _spread(_integers(batch.column(column), width, scale, shift), n, sums, small)
        return spread, (spread / n).astype(float) @ weights

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows' mean is zero, since n * x - S is exact and adds up to zero.
        total = np.zeros((some, some))
        for batch in _batches(batches, 0):
            z = projected(batch, 0)[1]
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(some * some, dtype=np.int32)), pa.array(total.ravel())], names=["k", "v"])

    entry = F.abs(F.sum("v") / n - F.when(F.col("k") % (some + 1) == 0, 1.0).otherwise(0.0))
    error = float(kept.select(vector).mapInArrow(squares, "k int, v double").groupBy("k").agg(entry.alias("error")).agg(F.max("error")).first()[0])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, 1):
            spread, z = projected(batch, 1)
            peak = int(np.abs(spread).max(initial=0)) if small else 1 << 62
            exact = spread if width * peak * peak < 1 << 63 else spread.astype(object)
            deviation = [int(v) if v < 1 << 63 else None for v in (exact * exact).sum(axis=1)]
            each = np.repeat(np.arange(len(z)), some)
            fixed = [pa.array(np.full(len(each), v)) for v in (n, error)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, some + 1, dtype=np.int32), len(z))), fixed[0], pa.array(deviation, pa.int64()).take(pa.array(each)), pa.array(z.ravel()), pa.array(np.tile(explained, len(z))), fixed[1]],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return kept.select("vec_id", vector).mapInArrow(step, schema)

"""Embedding whitening: exact moments on Spark, components by FEAST contour integration, whitened rows back on Spark.

The covariance (dimension by dimension, whatever the number of rows) is summed by the tasks. Its
largest eigenvalues are found by slicing the spectrum: counts of negative pivots (inertia) cut the
axis into intervals of few eigenvalues, on each interval a quadrature of complex shifted solves
projects random vectors onto its eigenspace, Rayleigh-Ritz takes the components out, and the inertia
counts at the interval's ends say how many there must be.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An interval is cut until it has at most so many eigenvalues; points of the quadrature on the upper half circle; the most rounds; share of the largest eigenvalue below which one counts as nothing.
PER_INTERVAL, POINTS, ROUNDS, NOTHING = 4, 8, 20, 1e-12
#: Whole numbers up to here stay themselves in double precision.
_EXACT = 1 << 53


def inertia(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix are above ``shift``: the positive pivots of an LDL' with complete pivoting (blocks of one or two)."""
    a = matrix - shift * np.eye(len(matrix))
    above = 0
    while len(a):
        n, diagonal = len(a), np.abs(np.diagonal(a))
        i = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diagonal(a)))
        p, q = divmod(int(off.argmax()), n)
        if off[p, q] == 0 and diagonal[i] == 0:
            break  # the rest is zero: not above
        if diagonal[i] >= 0.6404 * off[p, q]:  # (1 + sqrt 17) / 8, the bound of Bunch and Parlett
            above += a[i, i] > 0
            row = np.delete(a[i], i)
            a = np.delete(np.delete(a, i, 0), i, 1) - np.outer(row, row) / a[i, i]
        else:
            above += 1  # a block of two with a large off-diagonal entry has one eigenvalue of each sign
            block, rows = a[np.ix_([p, q], [p, q])], np.delete(a[[p, q]], [p, q], 1)
            a = np.delete(np.delete(a, [p, q], 0), [p, q], 1) - rows.T @ np.linalg.solve(block, rows)
        a = (a + a.T) / 2
    return above


def intervals(matrix: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(low, high, number): disjoint intervals, the highest first, that hold the k largest eigenvalues at least.

    The number is the inertia count of each. One that has more than PER_INTERVAL is halved, until it is
    too narrow for double precision to tell its ends apart: then its eigenvalues are as good as equal.
    """
    radius = np.abs(matrix).sum(axis=1).max()  # all eigenvalues are within (Gershgorin)
    top = radius * (1 + 1e-6) + 1e-300
    found, have = [], 0
    todo = [(-top, top, len(matrix))]
    while todo and have < k:
        low, high, number = todo.pop()
        if number <= PER_INTERVAL or high - low <= 1e-11 * top:
            if number:
                found.append((low, high, number))
            have += number
            continue
        mid = (low + high) / 2
        upper = inertia(matrix, mid) - inertia(matrix, high) if high < top else inertia(matrix, mid)
        todo += [(low, mid, number - upper), (mid, high, upper)]
    return found


def contour(matrix: np.ndarray, low: float, high: float, number: int, rng: np.random.Generator) -> np.ndarray:
    """A basis of the eigenspace of the ``number`` eigenvalues between ``low`` and ``high``, to working precision."""
    n = len(matrix)
    basis = rng.standard_normal((n, min(n, 2 * number + 4)))
    centre, radius = (low + high) / 2, (high - low) / 2
    at, weight = np.polynomial.legendre.leggauss(POINTS)
    angle = np.pi / 2 * (1 - at)
    scale = np.abs(matrix).sum(axis=1).max()
    for _ in range(ROUNDS):
        total = np.zeros_like(basis)
        for t, w in zip(angle, weight, strict=True):
            z = centre + radius * np.exp(1j * t)
            total += w / 2 * (radius * np.exp(1j * t) * np.linalg.solve(z * np.eye(n) - matrix, basis.astype(complex))).real
        basis, _ = np.linalg.qr(total)
        value, turn = np.linalg.eigh(basis.T @ matrix @ basis)  # Rayleigh-Ritz
        ritz = basis @ turn
        slack = 1e-9 * scale
        inside = np.argsort(np.maximum(low - slack - value, value - high - slack))[:number]
        rest = np.abs(matrix @ ritz[:, inside] - ritz[:, inside] * value[inside]).max(initial=0)
        if rest <= 1e-13 * scale * np.sqrt(n):
            return ritz[:, inside]
        basis = ritz
    raise ArithmeticError(f"no {number} eigenvectors between {low} and {high} after {ROUNDS} rounds")


def largest_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of the k largest; fewer if the others are nothing."""
    k = min(k, len(matrix))
    if not k or not np.abs(matrix).max(initial=0):
        return np.zeros(0), np.zeros((len(matrix), 0))
    rng = np.random.default_rng(5)
    pieces = [contour(matrix, *x, rng) for x in intervals(matrix, k)]
    basis, _ = np.linalg.qr(np.concatenate(pieces, axis=1))  # intervals that nearly touch are made orthogonal together
    value, turn = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(-value)[:k]
    order = order[value[order] > NOTHING * value[order].max(initial=0)]
    if len(order) and inertia(matrix, value[order[-1]] - 1e-9 * value.max()) < len(order):
        raise ArithmeticError("fewer eigenvalues than components")
    return value[order], (basis @ turn)[:, order]


@dataclass
class Whitening:
    """What the fit found: rows, sums, covariance (of vectors divided by ``unit``, 1 unless squares would overflow), and the components with their eigenvalues."""

    n: int
    sums: list[int]
    unit: float
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        return self.values / np.trace(self.covariance)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): rows whose vector is finite, without nulls, and as long as most such vectors (ties: the shorter). Empty vectors are none."""
    inf = float("inf")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    rows = rows.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & (F.size("vec") > 0))
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (size["n"] if size else 0))


def whole(batch: pa.Array, scale: int, offset: int) -> np.ndarray:
    """Rows of floor(scale * c) + offset; integers of Python where 64 bits could overflow."""
    width = len(batch[0])
    flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    if np.abs(flat).max() < _EXACT / (2 * scale):
        return np.floor(flat * scale).astype(np.int64) + offset
    exact = [(n * scale) // d + offset for n, d in (c.as_integer_ratio() for c in flat.ravel().tolist())]
    return np.array(exact, object).reshape(flat.shape)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly."""
    if x.dtype != object and n * int(np.abs(x).max()) + max(abs(s) for s in sums) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _batches(batches: Iterator[pa.RecordBatch], scale: int, offset: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield b, whole(b.column("vec"), scale, offset)


def _added(parts: DataFrame, cells: int) -> np.ndarray:
    """The sums of (cell, v) by cell."""
    got = np.zeros(cells)
    for r in parts.groupBy("cell").agg(F.sum("v").alias("v")).collect():
        got[r.cell] = r.v
    return got


def fit(rows: DataFrame, k: int, scale: int, offset: int) -> Whitening:
    """Two passes over (id, vec): sums, then the covariance of what is centred by them. Each task sends one number a dimension, then one a pair of dimensions."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, most = 0, None, 0
        for _, x in _batches(batches, scale, offset):
            n, most = n + len(x), max(most, int(np.abs(x).max()))
            small = x.dtype != object and int(np.abs(x).max()) < 1 << 40
            now = x.sum(axis=0).astype(object) if small else x.astype(object).sum(axis=0)
            total = now if total is None else total + now
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-2, len(total)), pa.int32()), pa.array([str(v) for v in [most, n, *total.tolist()]])], ["cell", "v"])

    def gathered(part: pa.Table) -> pa.Table:
        return pa.table({"cell": part["cell"][:1], "v": [str(sum(map(int, part["v"].to_pylist())))]})

    # sums travel as text, so that none is too large; one a task and dimension goes to the dimension's group
    parts = rows.select("id", "vec").mapInArrow(summed, "cell int, v string").groupBy("cell").applyInArrow(gathered, "cell int, v string").collect()
    sums = {r.cell: int(r.v) for r in parts}
    n, most = sums.pop(-1, 0), sums.pop(-2, 0)
    unit = 1.0 if most < 1 << 400 else 2.0 ** min(1023, most.bit_length())
    s = [sums[i] for i in range(len(sums))]
    width = len(s)
    if not n:
        return Whitening(0, s, unit, np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, x in _batches(batches, scale, offset):
            d = (centred(x, n, s) / n).astype(np.float64) / unit
            total += d.T @ d
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width), pa.int32()), pa.array(total.ravel())], ["cell", "v"])

    v = _added(rows.select("id", "vec").mapInArrow(products, "cell int, v double"), width * width).reshape(width, width) / n
    v = (v + v.T) / 2
    return Whitening(n, s, unit, v, *largest_components(v, k))


def transform(rows: DataFrame, model: Whitening, scale: int, offset: int) -> DataFrame:
    """(id, deviation, whitened): for each row the exact sum of squares of n * x - sums, null if it is beyond 64 bits, and its whitened components."""
    n, s, unit = model.n, model.sums, model.unit
    project = model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _batches(batches, scale, offset):
            z = centred(x, n, s)
            wide = z if z.dtype == object or int(np.abs(z).max()) ** 2 * z.shape[1] >= 1 << 63 else None
            square = (z**2).sum(axis=1).tolist() if wide is None else [y if y < 1 << 63 else None for y in (z.astype(object) ** 2).sum(axis=1).tolist()]
            white = (z / n).astype(np.float64) / unit @ project
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(square, pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(white.ravel()), white.shape[1]).cast(pa.list_(pa.float64()))], ["id", "deviation", "whitened"])

    return rows.select("id", "vec").mapInArrow(run, "id long, deviation long, whitened array<double>")


def identity_error(white: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the covariance of ``whitened`` less the identity: two passes, centred before multiplying."""
    mean = np.array(white.agg(*[F.avg(F.col("whitened")[i]) for i in range(k)]).first(), np.float64)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            d = b.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(-1, k) - mean
            total += d.T @ d
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k), pa.int32()), pa.array(total.ravel())], ["cell", "v"])

    got = _added(white.select("whitened").mapInArrow(products, "cell int, v double"), k * k).reshape(k, k) / n
    return float(np.abs(got - np.eye(k)).max())


def whiten(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): every usable vector along the k largest components.

    Entries become whole numbers, floor(scale * entry) + offset; sums and deviations are exact whatever
    their size, but a deviation beyond 64 bits is null. Rows whose vector is null, empty, of another
    length than most, or holds null or non-finite entries take no part; null and repeated ids and
    repeated vectors are rows like any other. A component that nothing varies along (its eigenvalue is
    not above NOTHING times the largest) cannot be scaled to one and is left out, so a table whose
    vectors are all equal, and an empty one, give no rows. Of equal eigenvalues any basis is taken, the
    same for all rows. The driver holds matrices of dimension by dimension alone.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    model = fit(rows, k, scale, offset)
    found = len(model.values)
    if not found:
        return spark.createDataFrame([], "id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    white = transform(rows, model, scale, offset)
    off = identity_error(white, model.n, found)
    one = F.explode(F.arrays_zip(F.sequence(F.lit(1), F.lit(found)).alias("component"), F.col("whitened").alias("w"), F.array(*[F.lit(float(x)) for x in model.explained]).alias("share")))
    return white.select("id", "deviation", one.alias("c")).select("id", F.col("c.component").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("c.w").alias("whitened"), F.col("c.share").alias("explained"), F.lit(off).alias("identity_error"))

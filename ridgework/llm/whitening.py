"""Whitening of embeddings by an eigendecomposition that is kept up to date row by row.

1. Every partition keeps the eigenvalues and eigenvectors of the scatter of its rows around their mean. A row
   enters as a *centred rank-one update*: the spectrum of ``D + z z'`` has one eigenvalue between every two of ``D``, the
   roots of the secular equation ``1 + sum z_i**2 / (d_i - m) = 0``, and its eigenvectors follow from them (Bunch,
   Nielsen and Sorensen, 1978; Gu and Eisenstat, 1994). Entries of ``z`` that are negligible, and equal
   eigenvalues, are deflated first. The rows of a block enter as the rows of the triangular factor of the centred block, whose
   scatter is the same, and one more update for the shift of the mean, so that a block
   costs as many updates as there are dimensions.
2. Spectra of partitions are combined in groups of ``FAN_IN``, each by successive rank-one updates with the
   other's scaled eigenvectors.
3. Rounding is taken out by one distributed Rayleigh-Ritz step: all rows are projected on the combined basis,
   their covariance there is summed over the tasks, and its small eigenproblem turns the basis.

Coordinates are whole numbers ``floor(64 * c) + 1000000``, so sums and deviations are exact. What the driver holds grows with
the square of the dimensions only.

Defined cases: vectors that are NULL or hold a NULL, NaN or infinite entry have no rows; of vectors of several lengths those
of the commonest count (the longest of equally common), the others have no rows; coordinates saturate
at 2**60; a deviation beyond 64 bits is NULL; only components whose eigenvalue exceeds 1e-12 of the largest exist, so equal
vectors, a single one, or none give no rows; repeated rows, or a NULL ``vec_id``, repeat their result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ridgework.session import stage

COMPONENTS = 32
SCALE, OFFSET = 64.0, 1_000_000
LIMIT = 2.0**60
BLOCK_ROWS = 2048
FAN_IN = 8
NEGLIGIBLE = 1e-12
EPS = np.finfo(float).eps
RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues ``m`` of ``diag(d) + z z'`` for ascending, distinct ``d``, and ``d[i] - m[j]`` at ``[j, i]``.

    Each root is sought as the distance to the nearer of the two poles around it, by fitting a fraction with
    both poles, kept inside a bracket that bisection shrinks where the fit leaves it.
    """
    k = len(d)
    rows = np.arange(k)
    right = np.append(d[1:], d[-1] + z2.sum())
    width = right - d
    below = np.tri(k, dtype=bool)
    between = (d[None, :] - d[:, None])
    at_middle = 1 + (z2 / (between - width[:, None] / 2)).sum(axis=1)
    from_right = (at_middle < 0) & (rows < k - 1)
    origin = rows + from_right
    poles = d[None, :] - d[origin][:, None]
    one, two = d - d[origin], np.where(from_right, 0.0, width)
    low = np.where(from_right, -width / 2, np.where(at_middle < 0, width / 2, 0.0))
    high = np.where(from_right, 0.0, np.where(at_middle < 0, width, width / 2))
    at = (low + high) / 2
    for _ in range(100):
        gaps = poles - at[:, None]
        terms = z2 / gaps
        f = 1 + terms.sum(axis=1)
        slopes = terms / gaps
        low, high = np.where(f < 0, at, low), np.where(f < 0, high, at)
        size = 1 + np.abs(terms).sum(axis=1)
        if np.all((np.abs(f) <= 4 * EPS * size) | (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)))):
            break
        left = np.where(below, slopes, 0.0).sum(axis=1)
        rest = slopes.sum(axis=1) - left
        g1, g2 = one - at, two - at
        a, b, c = (g1 + g2) * f - g1 * g2 * (left + rest), g1 * g2 * f, f - g1 * left - g2 * rest
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
        step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        fitted = at + step
        at = np.where((fitted > low) & (fitted < high), fitted, (low + high) / 2)
    return d[origin] + at, poles - at[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and eigenvectors after ``v v'`` is added."""
    z = vectors.T @ v
    norm = float(z @ z)
    if norm == 0.0:
        return values, vectors
    d, q = values.copy(), vectors
    least = 8 * EPS * max(np.abs(d).max(), norm)
    live = np.flatnonzero(np.abs(z) * np.sqrt(norm) > least)
    if len(live) > 1:
        p, n = z[live[:-1]], z[live[1:]]
        if np.any(np.abs((d[live[1:]] - d[live[:-1]]) * p * n) <= least * (p * p + n * n)):
            # Turn pairs of equal eigenvalues so that only one of them is touched by the update.
            q = q.copy()
            before = live[0]
            for after in live[1:]:
                length = np.hypot(z[before], z[after])
                c, s = z[after] / length, -z[before] / length
                if abs((d[after] - d[before]) * c * s) <= least:
                    z[before], z[after] = 0.0, length
                    q[:, before], q[:, after] = c * q[:, before] + s * q[:, after], c * q[:, after] - s * q[:, before]
                    d[before], d[after] = d[before] * c * c + d[after] * s * s, d[before] * s * s + d[after] * c * c
                before = after
            live = live[z[live] != 0.0]
    if len(live) == 0:
        return values, vectors
    order = live[np.argsort(d[live], kind="stable")]
    d_live, z_live = d[order], z[order]
    roots, gaps = secular_roots(d_live, z_live * z_live)
    # Entries of z for which the computed roots are exact keep the vectors orthogonal.
    apart = d_live[:, None] - d_live[None, :]
    np.fill_diagonal(apart, 1.0)
    exact = np.sign(z_live) * np.sqrt(np.abs(np.prod(-gaps / apart, axis=0)))
    turn = exact[:, None] / gaps.T
    turn /= np.sqrt((turn * turn).sum(axis=0))
    quiet = np.setdiff1d(np.arange(len(d)), order, assume_unique=True)
    values = np.concatenate([roots, d[quiet]])
    vectors = np.concatenate([q[:, order] @ turn, q[:, quiet]], axis=1)
    ascending = np.argsort(values, kind="stable")
    return values[ascending], vectors[:, ascending]


class Spectrum:
    """Number, mean and spectrum of the scatter of the rows seen so far."""

    def __init__(self, width: int):
        self.n, self.mean = 0, np.zeros(width)
        self.values, self.vectors = np.zeros(width), np.eye(width)

    def _add(self, n: int, mean: np.ndarray, parts: Iterable[np.ndarray]) -> None:
        """Take in ``n`` rows around ``mean`` whose scatter is the sum of ``p p'`` over ``parts``."""
        shift = mean - self.mean
        for part in (*parts, shift * np.sqrt(self.n * n / (self.n + n))):
            self.values, self.vectors = rank_one(self.values, self.vectors, part)
        self.n += n
        self.mean = self.mean + shift * (n / self.n)

    def add_rows(self, block: np.ndarray) -> None:
        if len(block):
            mean = block.mean(axis=0)
            self._add(len(block), mean, np.linalg.qr(block - mean, mode="r"))

    def add(self, n: int, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> None:
        self._add(n, mean, (np.sqrt(max(value, 0.0)) * vector for value, vector in zip(values, vectors.T)))


def whole(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that count, and their coordinates less ``OFFSET``, as whole doubles."""
    rows = np.flatnonzero(vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == width)
    values = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    finite = np.isfinite(values).all(axis=1)
    with np.errstate(over="ignore"):
        return rows[finite], np.clip(np.floor(SCALE * values[finite]), -LIMIT, LIMIT)


def blocks(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            rows, x = whole(part.column(1), width)
            if len(rows):
                yield part, rows, x


PARTIAL = pa.schema([("slot", pa.int64()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("values", pa.list_(pa.float64())), ("matrix", pa.list_(pa.float64()))])
PARTIAL_DDL = "slot bigint, n bigint, mean array<double>, values array<double>, matrix array<double>"


def _partial(slot: int, n: int, mean: np.ndarray, values: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"slot": slot, "n": n, "mean": mean.tolist(), "values": values.tolist(), "matrix": matrix.ravel().tolist()}], schema=PARTIAL)


def tree_merged(partials: DataFrame, merge: Callable[[list[tuple]], tuple]) -> tuple:
    """``n, mean, values, matrix`` of all partial results, merged ``FAN_IN`` at a time in tasks."""

    def unpacked(row: dict) -> tuple:
        mean = np.array(row["mean"])
        return row["n"], mean, np.array(row["values"]), np.array(row["matrix"]).reshape(len(mean), -1)

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda row: row["slot"])
        return pa.Table.from_batches([_partial(key[0].as_py(), *merge([unpacked(row) for row in rows]))])

    partials = stage(partials.withColumn("slot", F.spark_partition_id().cast("bigint")), "partials")
    most = partials.agg(F.max("slot")).first()[0]
    while most > 0:
        most //= FAN_IN
        partials = partials.select(F.floor(F.col("slot") / FAN_IN).cast("bigint").alias("group"), "*").groupBy("group").applyInArrow(merged, PARTIAL_DDL)
        partials = stage(partials, "partials")
    return unpacked(partials.first().asDict())


def combined_spectrum(rows: DataFrame, width: int) -> tuple:
    def grow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum(width)
        for _, _, x in blocks(batches, width):
            own.add_rows(x)
        if own.n:
            yield _partial(0, own.n, own.mean, own.values, own.vectors)

    def merge(parts: list[tuple]) -> tuple:
        own = Spectrum(width)
        own.n, own.mean, own.values, own.vectors = parts[0]
        for part in parts[1:]:
            own.add(*part)
        return own.n, own.mean, own.values, own.vectors

    return tree_merged(rows.mapInArrow(grow, PARTIAL_DDL), merge)


def covariance(rows: DataFrame, width: int, centre: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Covariance of all rows less ``centre``, projected on ``basis``; centred again on their own mean."""
    none = np.zeros(0)

    def joined(one: tuple, two: tuple) -> tuple:
        n, shift = one[0] + two[0], two[1] - one[1]
        return n, one[1] + shift * (two[0] / n), none, one[3] + two[3] + np.outer(shift, shift) * (one[0] * two[0] / n)

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for _, _, x in blocks(batches, width):
            y = (x - centre) @ basis
            mean = y.mean(axis=0)
            part = (len(y), mean, none, (y - mean).T @ (y - mean))
            own = part if own is None else joined(own, part)
        if own is not None:
            yield _partial(0, *own)

    def merge(parts: list[tuple]) -> tuple:
        out = parts[0]
        for part in parts[1:]:
            out = joined(out, part)
        return out

    n, _, _, scatter = tree_merged(rows.mapInArrow(summed, PARTIAL_DDL), merge)
    return scatter / n


def exact_sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of vectors and the sum of every coordinate less ``OFFSET``."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for _, _, x in blocks(batches, width):
            high, low = (part.sum(axis=0).tolist() for part in np.divmod(x.astype(np.int64), 1 << 32))
            n += len(x)
            sums = [s + (h << 32) + l for s, h, l in zip(sums, high, low)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int64()), pa.array([[Decimal(s) for s in sums]], pa.list_(pa.decimal128(38, 0)))], names=["n", "sums"])

    found = rows.mapInArrow(add, "n bigint, sums array<decimal(38,0)>").select("n", F.posexplode("sums").alias("at", "s"))
    totals = found.groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).orderBy("at").collect()
    return totals[0]["n"], [int(row["s"]) for row in totals]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact ``sum((n * x - S)**2)`` per row; NULL beyond 64 bits."""
    most = n * int(np.abs(x).max()) + max(map(abs, sums))
    if most * most * len(sums) < 1 << 63:
        away = n * x.astype(np.int64) - np.array(sums, np.int64)
        return (away * away).sum(axis=1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whitened(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component (see the module); components are numbered by falling eigenvalue."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("bigint"), F.col(vector).cast("array<double>").alias("x"))
    usable = rows.where(F.col("x").isNotNull() & F.forall("x", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))))
    common = usable.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).first()
    if common is None or not common["width"]:
        return spark.createDataFrame([], RESULT)
    width = common["width"]
    n, sums = exact_sums(rows, width)
    centre = np.array([s / n for s in sums])
    basis = np.linalg.qr(combined_spectrum(rows, width)[3])[0]
    values, turn = np.linalg.eigh(covariance(rows, width, centre, basis))
    values, axes = values[::-1], (basis @ turn)[:, ::-1]
    kept = min(components, int((values > NEGLIGIBLE * values[0]).sum()) if values[0] > 0 else 0)
    if not kept:
        return spark.createDataFrame([], RESULT)
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(width)] < 0, -1.0, 1.0)
    to_white = axes[:, :kept] / np.sqrt(values[:kept])
    error = float(np.abs(covariance(rows, width, centre, to_white) - np.eye(kept)).max())
    shares = values[:kept] / values.sum()

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, x in blocks(batches, width):
            each = pa.array(np.repeat(np.arange(len(at)), kept))
            count = len(at) * kept
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(at)).take(each), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(at))),
                pa.array(np.full(count, n, np.int64)), pa.array(deviations(x, n, sums), pa.int64()).take(each),
                pa.array(((x - centre) @ to_white).ravel()), pa.array(np.tile(shares, len(at))), pa.array(np.full(count, error)),
            ], names=[field.split()[0] for field in RESULT.split(", ")])

    return rows.mapInArrow(project, RESULT)

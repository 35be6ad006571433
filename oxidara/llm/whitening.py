"""Whitening of embeddings by matrix-free block subspace iteration.

Components c become whole numbers floor(scale * c) + shift.  Their covariance V is never formed: a pass over the centred rows X gives Xᵀ(XQ) for a block Q of
orthonormal directions, so a task keeps dimension x block numbers, whatever the dimension.  After each pass the driver takes the block's Rayleigh-Ritz
pairs (the eigenvectors of QᵀVQ) with their residuals |Vq - eq|, and the next block is the QR factor of VQ.  The iteration ends when the residuals of all k
components are below TOLERANCE of the largest eigenvalue.  Random or evenly spread vectors have no gap behind the k-th eigenvalue and would take hundreds
of passes; where a pass has not shrunk the largest residual by FACTOR, the block is widened by new orthogonal directions, twice as many as it has, up to the whole space, where
one pass is exact.  Every pass reads all rows, a table of whole numbers that is written once.

Partial blocks of tasks are added up by Spark, one row of V for each group; dimension x block numbers come to the driver.  Sums, the trace and each row's
deviation are exact whole numbers.  The identity error is measured on the whitened values themselves, in a pass of its own.

Results for unusual rows: vectors that are null or empty, hold null or non-finite components, or whose length is not the commonest one (of equally common ones, the shorter) are left out.  Rows that
repeat an id, or have none, count and are returned as rows of their own.  Directions without variance (eigenvalue below LEAST of the trace) have no whitened value and are no
components: fewer than k may be returned, and none for a single or only equal vectors.  Without vectors the result is empty.  A component beyond +-2**40 after scaling is an error.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oxidara.llm.rows import own_columns, stored

COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
#: Residual of a component, as a share of the largest eigenvalue.
TOLERANCE = 1e-12
#: Directions beside the k that are asked for, at first.
BESIDE = 8
#: A pass must shrink the largest residual by so much, else the block gets wider.
FACTOR = 10.0
#: Share of the trace below which an eigenvalue is none.
LEAST = 1e-13
MOST_PASSES = 300
MOST = 1 << 40


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, y = floor(scale * c) of the rows that take part."""
    rows = own_columns(vectors, {"vec_id": id_col, "v": vector_col}).where(F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    rows = rows.where("NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))")
    wide = F.exists("v", lambda x: F.abs(x) * scale > MOST)
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("bigint"))
    return rows.select("vec_id", F.when(wide, F.raise_error(F.lit("a vector's component is too large"))).otherwise(whole).cast("array<bigint>").alias("y"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _added(parts: DataFrame, width: int) -> np.ndarray:
    """The rows (at, part, x) of all tasks added up by at, always in the same order: one row for each at comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, x in zip(batch.column("at").to_numpy(), batch.column("x").flatten().to_numpy().reshape(-1, width) if batch.num_rows else [], strict=True):
                sums[at] = sums[at] + x if at in sums else x.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["at", "x"])

    found = parts.repartition("at").sortWithinPartitions("at", "part").mapInArrow(run, "at int, x array<double>").collect()
    return np.array([row["x"] for row in sorted(found, key=lambda row: row["at"])])


class Moments:
    """Number of rows and exact sums of y and of its squares by dimension."""

    def __init__(self, n: int, sums: list[int], squares: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = [s % n for s in sums]
        self.part = np.array([r / n for r in self.rest])
        #: The trace of V: sum over dimensions of (n * squares - sums**2) / n**2.
        self.scatter = sum(n * q - s * s for q, s in zip(squares, sums, strict=True))
        self.trace = self.scatter / (n * n)

    def centred(self, y: np.ndarray) -> np.ndarray:
        return (y - self.whole).astype(np.float64) - self.part

    def deviations(self, y: np.ndarray) -> list[int]:
        """Exact sums over dimensions of (n * y - sums)**2, in which y may be shifted as sums are."""
        apart = y - self.whole  # n * y - s = n * apart - rest
        square = (apart.astype(object) ** 2).sum(axis=1) if np.abs(apart).max(initial=0) > 1 << 27 else (apart * apart).sum(axis=1)
        mixed = apart.astype(object) @ np.array(self.rest, dtype=object) if self.n * int(np.abs(apart).max(initial=0)) * apart.shape[1] >= 1 << 62 else apart @ np.array(self.rest, dtype=np.int64)
        n, own = self.n, sum(r * r for r in self.rest)
        return [n * n * int(a) - 2 * n * int(b) + own for a, b in zip(square, mixed, strict=True)]


def moments(rows: DataFrame) -> Moments | None:
    """Exact sums: each task gives a row for each dimension, Spark adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                y = _matrix(batch.column("y"))
                n += len(y)
                sums = sums + y.sum(axis=0).astype(object)
                fits = int(np.abs(y).max()) ** 2 * len(y) < 1 << 62
                squares = squares + ((y * y).sum(axis=0).astype(object) if fits else (y.astype(object) ** 2).sum(axis=0))
        if n:
            d = len(sums)
            exact = [pa.array([Decimal(int(v)) for v in x], pa.decimal128(38, 0)) for x in (sums, squares)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n, dtype=np.int64)), *exact], names=["at", "n", "s", "q"])

    parts = rows.select("y").mapInArrow(run, "at int, n bigint, s decimal(38,0), q decimal(38,0)")
    found = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("at").collect()  # a row for each dimension
    return Moments(found[0]["n"], [int(r["s"]) for r in found], [int(r["q"]) for r in found]) if found else None


def product(rows: DataFrame, known: Moments, block: np.ndarray) -> np.ndarray:
    """V Q: one pass over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast((known, block))  # dimension x block numbers
    width = block.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, q = shared.value
        total = np.zeros(q.shape)
        for batch in batches:
            if batch.num_rows:
                x = now.centred(_matrix(batch.column("y")))
                total += x.T @ (x @ q)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q), dtype=np.int32)), pa.array(np.full(len(q), part, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["at", "part", "x"])

    return _added(rows.select("y").mapInArrow(run, "at int, part int, x array<double>"), width) / known.n


def components(rows: DataFrame, known: Moments, k: int, beside: int = BESIDE, seed: int = 5, report: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of the first k components that have variance.

    report gets the width of the block and the largest residual, as a share of the largest eigenvalue, of each pass."""
    d = len(known.whole)
    r = np.random.default_rng(seed)
    if not known.scatter:
        return np.empty(0), np.empty((d, 0))
    q = np.linalg.qr(r.normal(size=(d, min(d, k + beside))))[0]
    before = np.inf
    for _ in range(MOST_PASSES):
        z = product(rows, known, q)
        h = q.T @ z
        e, u = np.linalg.eigh((h + h.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        vectors = q @ u
        residual = np.sqrt(((z @ u - vectors * e) ** 2).sum(axis=0))[:k] / max(e[0], np.finfo(float).tiny)
        worst = float(residual.max())
        if report is not None:
            report.append((q.shape[1], worst))
        if worst <= TOLERANCE or q.shape[1] == d:
            some = e[:k] > LEAST * known.trace
            return e[:k][some], vectors[:, :k][:, some]
        new = z @ u
        if worst > before / FACTOR:
            new = np.concatenate((new, r.normal(size=(d, min(2 * q.shape[1], d - q.shape[1])))), axis=1)
        before = worst
        q = np.linalg.qr(new / np.maximum(np.sqrt((new * new).sum(axis=0)), np.finfo(float).tiny))[0]
    raise ArithmeticError(f"components not settled after {MOST_PASSES} passes: residual {worst}")


def identity_error(rows: DataFrame, known: Moments, axes: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the whitened values less the identity.  axes: eigenvectors over the roots of their eigenvalues."""
    shared = rows.sparkSession.sparkContext.broadcast((known, axes))
    k = axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, by = shared.value
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                w = now.centred(_matrix(batch.column("y"))) @ by
                total[:k] += w.T @ w
                total[k] += w.sum(axis=0)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1, dtype=np.int32)), pa.array(np.full(k + 1, part, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["at", "part", "x"])

    total = _added(rows.select("y").mapInArrow(run, "at int, part int, x array<double>"), k) / known.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, k: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vector_col: str = "embedding", report: list | None = None) -> DataFrame:
    """vec_id, component, n, deviation (decimal, as it outgrows 64 bits with n), whitened, explained, identity_error: a row for each vector and component.

    ``shift`` moves all numbers alike, so it leaves deviations and covariances as they are and need not be added."""
    spark = vectors.sparkSession
    columns = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = usable(vectors, id_col, vector_col, scale)
    lengths = rows.groupBy(F.size("y").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], columns)
    rows = stored(rows.where(F.size("y") == lengths[0]["d"]))
    known = moments(rows)
    e, axes = components(rows, known, k, report=report)
    if not len(e):
        return spark.createDataFrame([], columns)
    scaled = axes / np.sqrt(e)
    error, explained = identity_error(rows, known, scaled), e / known.trace
    shared = spark.sparkContext.broadcast((known, scaled))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, by = shared.value
        m = by.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _matrix(batch.column("y"))
            w = now.centred(y) @ by
            far = pa.array([Decimal(x) for x in now.deviations(y)], pa.decimal128(38, 0))
            take = pa.array(np.repeat(np.arange(len(y)), m))
            size = len(y) * m
            arrays = [
                batch.column("vec_id").take(take),
                pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(y))),
                pa.array(np.full(size, now.n, dtype=np.int64)),
                far.take(take),
                pa.array(w.ravel()),
                pa.array(np.tile(explained, len(y))),
                pa.array(np.full(size, error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, columns)

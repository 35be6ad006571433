"""Clustering of vectors around centroids with Hamerly's bounds, in whole numbers.

Every component x becomes floor(scale * x), so distances are exact and a result does not depend on how rows are dealt.  Beside a vector its
row keeps the number of its centroid, an upper bound of the distance to it and a lower bound of the distance to the second nearest one.
When centroids move, the upper bound grows by the drift of the own centroid and the lower one shrinks by the largest drift of the others.
While the upper bound is below the lower one, or below half of the way from the own centroid to the nearest other one, the vector stays and no distance
is computed.  Else the upper bound is made exact, and if it is still ambiguous, the vector is compared with all centroids in whole numbers.  Bounds are
doubles; all roundings are to the safe side, so they only decide what is computed, never the result.

A round is one pass: tasks read the rows of the round before, write them with their new bounds as a table in the shared folder, and beside them, for each centroid, by how much the
sum of its members has changed.  These changes (a row for each task and centroid) are added up by Spark; only centroids x components numbers come to the driver.

Results for unusual rows: vectors that are null, of another length, or hold null or non-finite components are left out.  Repeated ids and vectors are rows of
their own.  A row without an id is clustered, and is no centroid at the start; equal hashes (a repeated id) are taken in order of their components.
With fewer vectors than centroids there are as many centroids as vectors with an id; without any the result is empty.
A component beyond +-2**26 after scaling is an error, as a squared distance would not fit.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oxidara.llm.rows import own_columns, stored

DIMENSION, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Components beyond this are an error.
MOST = 1 << 26
#: Relative room of the bounds for rounding, far more than a few operations can lose.
ROOM = 1e-12
#: Vectors compared with all centroids at a time.
STEP = 4096


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of whole numbers) of the rows that take part."""
    rows = own_columns(vectors, {"vec_id": id_col, "v": vector_col}).where(F.col("v").isNotNull() & (F.size("v") == dimension))
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    rows = rows.where("NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))")
    whole = F.transform("v", lambda x: F.floor(x * scale))
    wide = F.exists("v", lambda x: F.abs(x) * scale > MOST)
    return rows.select("vec_id", F.when(wide, F.raise_error(F.lit("a vector's component is too large for exact distances"))).otherwise(whole).cast("array<int>").alias("v"))


def starts(rows: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:<vec_id>``, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id IS NOT NULL").select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()  # k rows
    return np.array([row["v"] for row in first], dtype=np.int64)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all of c: by a product of doubles where all its sums are whole numbers below 2**53."""
    widest = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * widest * widest < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(c)), dtype=np.int64)
    for j, one in enumerate(c):
        out[:, j] = ((x - one) ** 2).sum(axis=1)
    return out


def own_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The exact squared distance of each row of x to the same row of c."""
    apart = x - c
    return (apart * apart).sum(axis=1)


@dataclass
class Move:
    """Centroids, and what their last move does to bounds."""

    centroids: np.ndarray
    drift: np.ndarray  # of each centroid, rounded up
    half: np.ndarray  # half of the distance to the nearest other centroid, rounded down

    @staticmethod
    def to(centroids: np.ndarray, before: np.ndarray | None = None) -> Move:
        drift = np.zeros(len(centroids)) if before is None else np.sqrt(own_distances(centroids, before).astype(np.float64)) * (1 + ROOM)
        apart = squared_distances(centroids, centroids).astype(np.float64)
        np.fill_diagonal(apart, np.inf)
        return Move(centroids, drift, np.sqrt(apart.min(axis=1)) / 2 * (1 - ROOM))

    def others_drift(self) -> np.ndarray:
        """For each centroid, the largest drift of the other ones."""
        if len(self.drift) < 2:
            return np.zeros(len(self.drift))
        order = np.argsort(self.drift)
        out = np.full(len(self.drift), self.drift[order[-1]])
        out[order[-1]] = self.drift[order[-2]]
        return out


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: smaller number), distance to it rounded up, distance to the second nearest rounded down."""
    nearest, upper, lower = np.empty(len(x), dtype=np.int32), np.empty(len(x)), np.empty(len(x))
    for at in range(0, len(x), STEP):
        d = squared_distances(x[at : at + STEP], centroids)
        own = np.arange(len(d))
        best = d.argmin(axis=1)
        nearest[at : at + STEP] = best
        upper[at : at + STEP] = np.sqrt(d[own, best].astype(np.float64)) * (1 + ROOM)
        d[own, best] = np.iinfo(np.int64).max
        lower[at : at + STEP] = np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - ROOM) if d.shape[1] > 1 else np.inf
    return nearest, upper, lower


def reassign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, move: Move) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """cluster, upper, lower after a move of the centroids, and how many vectors were compared with all of them.  A cluster of -1 is none yet."""
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    fresh = cluster < 0
    old = np.flatnonzero(~fresh)
    if len(old):
        own = cluster[old]
        upper[old] = (upper[old] + move.drift[own]) * (1 + ROOM)
        lower[old] = np.maximum((lower[old] - move.others_drift()[own]) * (1 - ROOM) - ROOM, 0)
        open_ = old[upper[old] >= np.maximum(lower[old], move.half[own])]
        upper[open_] = np.sqrt(own_distances(x[open_], move.centroids[cluster[open_]]).astype(np.float64)) * (1 + ROOM)
        fresh[open_] = upper[open_] >= np.maximum(lower[open_], move.half[cluster[open_]])
    some = np.flatnonzero(fresh)
    cluster[some], upper[some], lower[some] = scan(x[some], move.centroids)
    return cluster, upper, lower, len(some)


_STATE = "vec_id bigint, v array<int>, cluster int, upper double, lower double"


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _round(state: DataFrame, move: Move) -> DataFrame:
    """The rows with their new clusters and bounds, and for each task and centroid a row (v null) with the change of its members: sums, members; of all, scanned."""
    shared = state.sparkSession.sparkContext.broadcast(move)  # centroids x components numbers
    names = ["vec_id", "v", "cluster", "upper", "lower", "sums", "members", "scanned"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        k, d = now.centroids.shape
        sums, members, scanned = np.zeros((k, d), dtype=np.int64), np.zeros(k, dtype=np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"))
            was = batch.column("cluster").to_numpy()
            cluster, upper, lower, compared = reassign(x, was, batch.column("upper").to_numpy(), batch.column("lower").to_numpy(), now)
            scanned += compared
            moved = np.flatnonzero(cluster != was)
            np.add.at(sums, cluster[moved], x[moved])
            members += np.bincount(cluster[moved], minlength=k)
            left = moved[was[moved] >= 0]
            np.subtract.at(sums, was[left], x[left])
            members -= np.bincount(was[left], minlength=k)
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster), pa.array(upper), pa.array(lower), pa.nulls(batch.num_rows, pa.list_(pa.int64())), none, none], names=names)
        changed = np.flatnonzero((sums != 0).any(axis=1) | (members != 0))
        if not len(changed) and scanned:
            changed = np.zeros(1, dtype=np.int64)
        if len(changed):
            m, nulls = len(changed), lambda kind: pa.nulls(len(changed), kind)
            counts = np.zeros(m, dtype=np.int64)
            counts[0] = scanned
            arrays = [nulls(pa.int64()), nulls(pa.list_(pa.int32())), pa.array(changed.astype(np.int32)), nulls(pa.float64()), nulls(pa.float64()), pa.array(list(sums[changed]), pa.list_(pa.int64())), pa.array(members[changed]), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return state.mapInArrow(run, f"{_STATE}, sums array<bigint>, members bigint, scanned bigint")


def _changes(passed: DataFrame, k: int, dimension: int) -> tuple[list[list[int]], list[int], int]:
    """Sums and members of all tasks added up: a number for each centroid and component comes to the driver."""
    rows = passed.where("sums IS NOT NULL")
    exact = "decimal(38,0)"
    sums = [[0] * dimension for _ in range(k)]
    for row in rows.select("cluster", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum(F.col("x").cast(exact)).alias("x")).collect():
        sums[row["cluster"]][row["at"]] = int(row["x"])
    members, scanned = [0] * k, 0
    for row in rows.groupBy("cluster").agg(F.sum("members").alias("n"), F.sum("scanned").alias("scanned")).collect():
        members[row["cluster"]] = row["n"]
        scanned += row["scanned"]
    return sums, members, scanned


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimension: int = DIMENSION, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", report: list | None = None) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector after ``rounds`` rounds and a last assignment.

    report gets, for each pass, how many vectors were compared with all centroids."""
    spark = vectors.sparkSession
    state = stored(usable(vectors, id_col, vector_col, dimension, scale).select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower")))
    centroids = starts(state, k, seed)
    columns = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], columns)
    k = len(centroids)
    sums, members = [[0] * dimension for _ in range(k)], [0] * k
    move = Move.to(centroids)
    for _ in range(rounds):
        passed = stored(_round(state, move))
        more, joined, scanned = _changes(passed, k, dimension)
        sums = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(sums, more, strict=True)]
        members = [a + b for a, b in zip(members, joined, strict=True)]
        if report is not None:
            report.append(scanned)
        after = np.array([[s // n for s in one] if n else old.tolist() for one, n, old in zip(sums, members, move.centroids, strict=True)], dtype=np.int64)
        move = Move.to(after, move.centroids)
        state = passed.where("v IS NOT NULL").select("vec_id", "v", "cluster", "upper", "lower")
    shared = spark.sparkContext.broadcast(move)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"))
                own = reassign(x, batch.column("cluster").to_numpy(), batch.column("upper").to_numpy(), batch.column("lower").to_numpy(), shared.value)[0]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(own), pa.array(own_distances(x, shared.value.centroids[own]))], names=["vec_id", "cluster", "distance"])

    found = stored(state.mapInArrow(measure, "vec_id bigint, cluster int, distance bigint"))
    inertia = {row["cluster"]: row["inertia"] for row in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # a row for each centroid
    digests = [hashlib.sha256(",".join(map(str, one)).encode()).hexdigest() for one in move.centroids.tolist()]
    about = spark.createDataFrame([(c, x, sum(inertia.values()), digests[c]) for c, x in inertia.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The same in DuckDB SQL: every vector against every centroid in every round."""
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, v, row_number() OVER (ORDER BY vec_id, v) AS row FROM (SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT) FOR x IN embedding] AS v FROM embeddings"
        f" WHERE len(embedding) = {DIMENSION} AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0))",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v AS c FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {CENTROIDS}))",
    ]
    for r in range(ROUNDS + 1):
        apart = f"CAST(list_sum([(v[i] - c[i]) * (v[i] - c[i]) FOR i IN range(1, {DIMENSION + 1})]) AS BIGINT)"
        parts.append(f"a{r} AS MATERIALIZED (SELECT row, min(struct_pack(d := d, cluster := cluster)) AS best FROM (SELECT row, cluster, {apart} AS d FROM kept, c{r}) GROUP BY row)")
        if r < ROUNDS:
            parts.append(f"s{r} AS MATERIALIZED (SELECT best.cluster AS cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{r} JOIN kept USING (row), range(1, {DIMENSION + 1}) t(i) GROUP BY 1, 2)")
            floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT cluster, list({floor} ORDER BY i) AS c FROM s{r} GROUP BY cluster) m ON m.cluster = c{r}.cluster)")
    return (
        "WITH "
        + ",\n".join(parts)
        + f"\nSELECT vec_id, best.cluster AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,"
        f" sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN kept USING (row) JOIN c{ROUNDS} ON c{ROUNDS}.cluster = best.cluster"
    )


ORACLE = _oracle()

"""Approximate nearest neighbours by shifted space-filling curves.

Each of CURVES Hilbert curves orders the vectors: unit vectors are projected on AXES random orthogonal directions,
shifted by an offset of the curve's own, cut into 2**BITS cells for each axis, and the cell's place on the curve is the key.
Spark range-partitions the rows of each curve by key and id, so equal keys are dealt over partitions as well, and
numbers them; blocks of consecutive numbers are the windows.  A query looks at its own block and its neighbours on every
curve, the blocks give their best candidates, and these are merged and reranked by the exact cosine.

How far a query looks is measured, not guessed: for a bounded sample of queries, the exact neighbours are found by
one pass over all vectors in blocks.  For each number of curves, the half-width that brings TARGET of them into some window is known then, and the number with the fewest
candidates in all is taken.  Structured data get narrow windows on several curves.  Independent random vectors of many dimensions have no structure that a projection
keeps: there windows must grow to most of the table for the recall that is asked for, and one curve with such windows is read rather than four, the
work of a brute-force search, spread over blocks.  ``nearest`` reports the curves, the half-width, the share of the table that a query reads and the sample's recall in
``report``; ``exact`` is the way without windows.

A group of the comparison holds one block of candidates and at most about MOST_QUERIES queries; where more are within reach, they are dealt over
several groups.

Of identical vectors only the k + 1 smallest ids are candidates: no other one can be among the k nearest.

Results for unusual rows: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither do vectors of a
length that is not the commonest, nor rows with a null id; ties go to the smaller id; queries with fewer candidates than k
get all of those found; a row is its own if it has its id, so of rows that repeat an id none is a candidate of another; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oxidara.llm.rows import cut, own_columns

CURVES, AXES, BITS = 4, 9, 7
#: Share of the sample's exact neighbours that the windows must hold.
TARGET = 0.96
#: Queries whose exact neighbours set the width; rows that set the scale of the projections.
SAMPLE_QUERIES, SAMPLE_ROWS = 120, 2000
LEAST_BLOCK, MOST_BLOCK = 256, 8192
#: Queries of a group.
MOST_QUERIES = 4096
#: Candidates whose cosine by matrix product is so little less than the k-th best one's are ranked exactly as well.
MARGIN = 1e-9


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of cells (point x axis, each below 2**bits).

    The axes are brought to the transposed form of the index by undoing the rotations from the highest bit down, then
    Gray-decoded, and the bits of all axes are interleaved."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit = np.int64(1) << level
        low = bit - 1
        for i in range(n):
            on = (x[i] & bit) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        bit = np.int64(1) << level
        t ^= np.where((x[-1] & bit) > 0, bit - 1, 0)
    x ^= t
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that neither tiny nor huge components vanish."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Curves:
    """Projections, scale and shifts of all curves."""

    def __init__(self, sample: np.ndarray, dimension: int, seed: int = 11):
        r = np.random.default_rng(seed)
        self.axes = min(AXES, dimension)
        self.planes = [np.linalg.qr(r.normal(size=(dimension, dimension)))[0][:, : self.axes] for _ in range(CURVES)]
        self.shifts = [r.uniform(0, 0.25, self.axes) for _ in range(CURVES)]
        self.middle, self.spread = [], []
        for plane in self.planes:
            p = _unit(sample) @ plane if len(sample) else np.zeros((1, self.axes))
            self.middle.append(p.mean(axis=0))
            self.spread.append(np.maximum(p.std(axis=0), 1e-9))

    def keys(self, unit: np.ndarray, curve: int) -> np.ndarray:
        p = (unit @ self.planes[curve] - self.middle[curve]) / self.spread[curve]
        u = (p + 3) / 8 + self.shifts[curve]  # three deviations to either side fill three quarters, the shift moves them
        cells = np.clip(u * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        return hilbert_keys(cells, BITS)


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The cosine of each row of q with the same row of v, in double precision, by the same steps for any pair."""
    dot = (q * v).sum(axis=1)
    return dot / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> pd.DataFrame:
    """The k best candidates of each query among v, other than itself, with their exact scores; ties to the smaller id, however many there are."""
    out: list[pd.DataFrame] = []
    unit_q, unit_v = _unit(q), _unit(v)
    step = max(1, 4_000_000 // max(len(v), 1))
    for at in range(0, len(q), step):
        s = unit_q[at : at + step] @ unit_v.T
        s[q_ids[at : at + step, None] == ids[None, :]] = -2.0
        # the product only excludes: what is within its rounding of the k-th best is ranked by the exact score
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1] if k < len(v) else np.full(len(s), -1.5)
        a, b = np.nonzero(s >= np.maximum(least - MARGIN, -1.5)[:, None])
        score = cosines(q[at + a], v[b])
        order = np.lexsort((ids[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        place = np.arange(len(a)) - np.searchsorted(a, a, side="left")
        keep = place < k
        out.append(pd.DataFrame({"query_id": q_ids[at + a[keep]], "vec_id": ids[b[keep]], "score": score[keep]}))
    return pd.concat(out, ignore_index=True)


def _rank(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v of the rows that take part."""
    rows = own_columns(vectors, {"vec_id": id_col, "v": vector_col}).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    rows = rows.where("NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(v, x -> x <> 0)")
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (lengths[0]["n"] if lengths else 0))


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each query.  queries: a condition on vec_id.

    report gets curves, half_width, share (of the candidates that a query reads at most, over all curves) and recall (of the sample, by the windows alone)."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    same = Window.partitionBy("v").orderBy("vec_id")
    # a filter on row_number is pushed below the shuffle: of a third of all rows, k + 1 for each task remain
    candidates = rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).select("vec_id", "v", F.lit(True).alias("candidate"))
    asked = rows.where(queries).select("vec_id", "v", F.lit(False).alias("candidate"))
    everything = cut(candidates.unionByName(asked))
    head = everything.limit(1).collect()
    if not head:
        return everything.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    dimension = len(head[0]["v"])
    n = everything.groupBy("candidate").count().collect()
    count = {row["candidate"]: row["count"] for row in n}
    spot = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))

    def some(candidate: bool, most: int) -> DataFrame:
        share = min(1.0, most / max(count.get(candidate, 0), 1))
        return everything.where((F.col("candidate") == candidate) & (spot <= int(share * (1 << 30)))).limit(2 * most)

    scale = np.array([row["v"] for row in some(True, SAMPLE_ROWS).select("v").collect()])
    curves = spark.sparkContext.broadcast(Curves(scale, dimension))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"))
            for c in range(CURVES if len(v) else 0):
                arrays = [pa.array(np.full(len(v), c, dtype=np.int32)), pa.array(curves.value.keys(_unit(v), c)), *(batch.column(x) for x in ("vec_id", "v", "candidate"))]
                yield pa.RecordBatch.from_arrays(arrays, names=["curve", "key", "vec_id", "v", "candidate"])

    keyed = everything.mapInArrow(key, "curve int, key bigint, vec_id bigint, v array<double>, candidate boolean")
    sorted_rows = keyed.repartitionByRange("curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(CURVES, dtype=np.int64)
        for batch in batches:
            curve = batch.column("curve").to_numpy()
            place = np.zeros(len(curve), dtype=np.int64)
            for c in np.unique(curve):
                own = curve == c
                place[own] = seen[c] + np.arange(own.sum())
                seen[c] += own.sum()
            arrays = [batch.column("curve"), pa.array(np.full(len(curve), part, dtype=np.int32)), pa.array(place), *(batch.column(x) for x in ("vec_id", "v", "candidate"))]
            yield pa.RecordBatch.from_arrays(arrays, names=["curve", "part", "place", "vec_id", "v", "candidate"])

    numbered = cut(sorted_rows.mapInArrow(number, "curve int, part int, place bigint, vec_id bigint, v array<double>, candidate boolean"))
    # one row for each partition and curve
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbered.groupBy("curve", "part").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    placed = numbered.join(F.broadcast(starts), ["curve", "part"]).withColumn("place", F.col("place") + F.col("start")).drop("part", "start")

    total = max(sum(count.values()), 1)
    used, width, recall = _half_width(everything, placed, some(False, SAMPLE_QUERIES), k, total)
    block = int(np.clip(width // 4, LEAST_BLOCK, MOST_BLOCK))
    reach = -(-width // block)
    span = (2 * reach + 1) * block
    chunks = max(1, -(-min(span, total) * count.get(False, 0) // (total * MOST_QUERIES)))
    if report is not None:
        report |= {"curves": used, "half_width": width, "share": used * min(1.0, span / total), "recall": recall}
    blocked = placed.where(F.col("curve") < used).withColumn("block", F.expr(f"CAST(place DIV {block} AS INT)")).drop("place")
    members = blocked.where("candidate").select("curve", "block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "vec_id", "v").toDF("of_curve", "of_block", "of_chunk", "member", "vector")
    probes = blocked.where("NOT candidate").select("curve", F.explode(F.sequence(F.col("block") - reach, F.col("block") + reach)).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("chunk"), "vec_id", "v")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        right = right.sort_values("member", kind="stable")
        return _best(left["vec_id"].to_numpy(), np.stack(left["v"].to_numpy()), right["member"].to_numpy(), np.stack(right["vector"].to_numpy()), k)

    found = probes.groupBy("curve", "block", "chunk").cogroup(members.groupBy("of_curve", "of_block", "of_chunk")).applyInPandas(compare, "query_id bigint, vec_id bigint, score double")
    return _rank(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact(vectors: DataFrame, asked: list, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of a few queries, by one pass over all vectors.

    vectors: vec_id and v as ``usable`` gives them; asked: at most MOST_QUERIES rows with vec_id and v."""
    if len(asked) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries")
    shared = vectors.sparkSession.sparkContext.broadcast((np.array([row["vec_id"] for row in asked]), np.array([row["v"] for row in asked])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        for batch in batches:
            if batch.num_rows and len(ids):
                order = np.argsort(batch.column("vec_id").to_numpy(), kind="stable")
                best = _best(ids, q, batch.column("vec_id").to_numpy()[order], _matrix(batch.column("v"))[order], k)
                yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    return _rank(vectors.select("vec_id", "v").mapInArrow(scan, "query_id bigint, vec_id bigint, score double"), k)


def _half_width(everything: DataFrame, placed: DataFrame, sample: DataFrame, k: int, total: int) -> tuple[int, int, float]:
    """How many curves to read, how far from a query on the nearest of them TARGET of the sample's true neighbours lie, and the share that is within: for the fewest candidates."""
    asked = sample.select("vec_id", "v").collect()  # at most 2 * SAMPLE_QUERIES
    if not asked:
        return CURVES, LEAST_BLOCK, 1.0
    true = exact(everything.where("candidate"), asked, k)
    pairs = [(row["query_id"], row["vec_id"]) for row in true.select("query_id", "vec_id").collect()]  # k for each sampled query
    if not pairs:
        return CURVES, LEAST_BLOCK, 1.0
    wanted = everything.sparkSession.createDataFrame([(row["vec_id"], False) for row in asked] + [(b, True) for _, b in pairs], "vec_id bigint, candidate boolean").distinct()
    at: dict[tuple, np.ndarray] = {}
    for row in placed.join(F.broadcast(wanted), ["vec_id", "candidate"]).select("vec_id", "candidate", "curve", "place").collect():
        at.setdefault((row["vec_id"], row["candidate"]), np.full(CURVES, -(1 << 40), dtype=np.int64))[row["curve"]] = row["place"]
    apart = np.array([np.abs(at[a, False] - at[b, True]) for a, b in pairs if (a, False) in at and (b, True) in at])
    found = []
    for used in range(1, CURVES + 1):
        far = apart[:, :used].min(axis=1)
        width = int(np.quantile(far, TARGET, method="higher")) + LEAST_BLOCK // 2
        found.append((used * min(2 * width, total), -used, width, float((far <= width).mean())))
    _, used, width, share = min(found)
    return -used, width, share


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true (query_id, vec_id) pairs that were found."""
    both = truth.join(found, ["query_id", "vec_id"], "left_semi").count()
    return both / max(truth.count(), 1)

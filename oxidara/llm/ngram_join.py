"""N-gram Jaccard join with rare-first prefix filtering: links of every document, and the groups that links connect.

A document's set holds its distinct word n-grams; two documents link when
``100 * |x & y| >= percent * |x | y|``.  The way there:

1. One pass makes each document's set, its size, its signature and the key of its class: documents with equal sets are one class,
   so copies are told apart from nothing and never expanded into pairs.  The same pass counts
   n-grams into a table of fixed size (``sketch_bits``), those of a class once for each task; any function of an n-gram gives a valid
   order, and by this one rare n-grams come first.
2. A second pass sends the prefix of each set in that order, ``|x| - ceil(t |x|) + 1`` n-grams with size and place, once for each
   class and task: one shuffle by n-gram.  Two linked sets share an n-gram of their prefixes, so those that only one class has end here.
   N-grams whose place in the table stands out are dealt over salts; all their classes stay until the salts are merged, and an n-gram
   that only one class has ends there.
3. Candidates pass the length filter and the positional filter where they meet; at n-grams of at most SMALL classes that is at once.
   Each pair is then distinct, and passes the suffix filter: the n-grams are parted by
   fixed pivots of the hash order, and the parities of the parts bound from below in how many n-grams two sets differ.
4. Two classes that pass all filters are *close*, and join a cluster.  At n-grams of more classes, each class is first compared with a few
   pivots.  Then such n-grams that classes of different clusters share are worked off in blocks of bounded size: a task applies the
   filters to all pairs of a block and gives a spanning forest of the close ones, so no row is made for a pair.
5. Every link lies inside a cluster.  The texts of a cluster's classes meet in blocks, once, and all pairs of a block are verified by the
   exact sizes of their intersections.  A task gives the number of links of each class and a spanning forest of the links.

No self-join and no list of all pairs of a group is ever made: work on a group of m near copies is dealt over (m / block)**2 tasks, what
leaves them grows with m times the number of blocks.

Results for unusual rows: null texts and texts without words have an empty set and are linked with nothing, their
component is their own id; fewer words than n are one n-gram; rows that repeat an id stay rows of their own;
a null id counts as no id when the smallest id of a component is taken; ids are whole numbers, or binary keys in
the order of their bytes; an empty table gives no rows; other columns are ignored.

N-grams are 64-bit hashes; two different ones with one hash count as the same.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oxidara.llm.rows import cut, own_columns, stored
from oxidara.llm.words import gram_sets, mix, runs

WORDS, PERCENT = 5, 75
#: The table of n-gram counts has 2**SKETCH_BITS places of 4 bytes, at any size of the input.
SKETCH_BITS = 20
SKETCH_PARTS = 64
#: An n-gram is dealt over salts if its place holds so much more than the average place; a salt gets about so many rows.
HOT = 0x8000
#: Bits of an n-gram that the join uses; above them is the salt.
GRAM_BITS, MOST_SALTS = 48, 0x3FFF
#: Rows that one Arrow batch of prefix n-grams holds.
BATCH_ROWS = 200_000
#: Where at most so many classes share an n-gram, the pairs that pass the first filters are given at once.
SMALL = 32
#: Elsewhere, pivots that a class is compared with before blocks are made.
PIVOTS = 4
#: Members of an n-gram that meet in one block, from either side, and rows that a task looks at together.
BLOCK_MEMBERS, BLOCK_ROWS = 1024, 16_384
#: Bits of the table of ids by which texts that no cluster needs are left out before a shuffle: 16 for each class, in these bounds.
LEAST_ID_BITS, MOST_ID_BITS = 20, 28
#: N-grams and sets of a block of a cluster whose pairs are verified in one task, and n-grams of a step of that.
BLOCK_GRAMS, BLOCK_SETS, STEP_GRAMS = 1 << 18, 1024, 4096


def _class_key(grams: np.ndarray, seed: int) -> tuple[int, int]:
    """Two independent 64-bit sums over a set."""
    with np.errstate(over="ignore"):
        one = mix(grams + np.uint64(2 * seed + 1)).sum(dtype=np.uint64)
        two = mix(grams ^ np.uint64(0x5851F42D4C957F2D + 2 * seed)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def _places(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams >> np.uint64(64 - bits)).astype(np.int64)


def prefix_length(n: int, percent: int) -> int:
    """N-grams of a set of n that a linked set must meet one of."""
    return n - -(-n * percent // 100) + 1


#: Bounds of the bits of a signature, between which there are at least two for each n-gram.
LEAST_BITS, MOST_BITS = 512, 1 << 16


def _signature(grams: np.ndarray) -> bytes:
    """For each remainder of the hashes modulo 2**k, if an odd number of the set's n-grams has it.

    Each n-gram that only one of two sets has changes one bit, so the sets differ in at least as
    many n-grams as their signatures differ in bits.  The halves of a signature put together by xor are the one of half the bits."""
    bits = min(max(LEAST_BITS, 1 << (2 * len(grams) - 1).bit_length()), MOST_BITS)
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _differing_bits(signatures: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits the signatures a[i] and b[i] differ, the longer one folded to the length of the other."""
    size = np.fromiter(map(len, signatures), dtype=np.int64, count=len(signatures))
    width = np.minimum(size[a], size[b])
    out = np.zeros(len(a), dtype=np.int64)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        used, place = np.unique(np.concatenate((a[own], b[own])), return_inverse=True)
        folded = np.empty((len(used), w // 8), dtype=np.uint64)
        for whole in np.unique(size[used]).tolist():
            some = np.flatnonzero(size[used] == whole)
            data = np.frombuffer(b"".join([signatures[i] for i in used[some].tolist()]), dtype=np.uint64)
            folded[some] = np.bitwise_xor.reduce(data.reshape(len(some), whole // w, w // 8), axis=1)
        x, y = place[: len(own)], place[len(own) :]
        step = max(1, STEP_BYTES // w)
        for at in range(0, len(own), step):
            out[own[at : at + step]] = np.bitwise_count(folded[x[at : at + step]] ^ folded[y[at : at + step]]).sum(axis=1, dtype=np.int64)
    return out


#: Bytes of signatures that are compared at a time.
STEP_BYTES = 16 << 20


def _sets(rows: DataFrame, words: int, seed: int, bits: int) -> DataFrame:
    """Rows of each document (part null), and of each task's counts (part and counts).  A task gives one signature for each class."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    width = (1 << bits) // SKETCH_PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.uint32)
        names = ["doc_id", "n", "class", "second", "signature", "part", "counts"]
        known: set[int] = set()  # at most a number for each document of the task
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            n, key, second, signature = [], [], [], []
            for piece in runs(batch.column("text")):
                seen = [np.empty(0, dtype=np.int64)]
                for grams in gram_sets(piece, words):
                    a, b = _class_key(grams, seed) if len(grams) else (None, None)
                    n.append(len(grams))
                    key.append(a)
                    second.append(b)
                    new = a is not None and a not in known
                    signature.append(_signature(grams) if new else None)
                    if new:
                        known.add(a)
                        seen.append(_places(grams, bits))
                np.add.at(total, np.concatenate(seen), np.uint32(1))
            none = [pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, key, second)), pa.array(signature, pa.binary()), *none], names=names)
        if id_type is not None:
            parts = [(p, total[p * width : (p + 1) * width]) for p in range(SKETCH_PARTS)]
            parts = [(p, zlib.compress(c.tobytes(), 1)) for p, c in parts if c.any()]
            m = len(parts)
            nulls = [pa.nulls(m, id_type), *(pa.nulls(m, pa.int64()) for _ in range(3)), pa.nulls(m, pa.binary())]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array([p for p, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())], names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, class bigint, second bigint, signature binary, part int, counts binary")


def _sketch(counted: DataFrame, bits: int) -> np.ndarray:
    """The counts of all tasks added up: a table of fixed size."""
    width = (1 << bits) // SKETCH_PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, c in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = sums.setdefault(p, np.zeros(width, dtype=np.uint64))
                own += np.frombuffer(zlib.decompress(c), dtype=np.uint32)
        for p, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], names=["part", "counts"])

    table = np.zeros((SKETCH_PARTS, width), dtype=np.uint64)
    parts = counted.where("part IS NOT NULL").select("part", "counts").repartition(SKETCH_PARTS // 4, "part")
    for row in parts.mapInArrow(run, "part int, counts binary").collect():  # SKETCH_PARTS rows
        table[row["part"]] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.uint64)
    return table.ravel()


def salts(counts: np.ndarray) -> np.ndarray:
    """For each place of a table of counts over how many salts its n-grams are dealt: by how much it stands above the average place."""
    return np.minimum((counts - np.minimum(counts, np.uint64(counts.mean()))) // np.uint64(HOT), np.uint64(MOST_SALTS)).astype(np.int64)


def _prefixes(rows: DataFrame, table, words: int, percent: int, seed: int, bits: int) -> DataFrame:
    """The prefix n-grams of every class of each task: key (gram, and above it a salt from 1 if the gram may be frequent), class, n, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, dealt = table.value
        names = ["key", "class", "n", "place"]
        seen: set[int] = set()  # at most a number for each document of the task
        out: list[tuple[np.ndarray, int, int]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            lengths = [len(g) for g, _, _ in out]
            columns = [
                pa.array(np.concatenate([g for g, _, _ in out])),
                pa.array(np.repeat(np.array([k for _, k, _ in out], dtype=np.int64), lengths)),
                pa.array(np.repeat(np.array([n for _, _, n in out], dtype=np.int32), lengths)),
                pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for piece in runs(batch.column("text")):
                for grams in gram_sets(piece, words):
                    n = len(grams)
                    key = _class_key(grams, seed)[0] if n else None
                    if not n or key in seen:
                        continue
                    seen.add(key)
                    place = _places(grams, bits)
                    order = np.argsort(often[place], kind="stable")[: prefix_length(n, percent)]
                    # n-grams taken for one by fewer bits only make a candidate more
                    prefix = (grams[order] >> np.uint64(64 - GRAM_BITS)).astype(np.int64)
                    over = dealt[place[order]]
                    prefix += np.where(over > 0, 1 + key % np.maximum(over, 1), 0) << GRAM_BITS
                    out.append((prefix, key, n))
                    held += len(prefix)
                    if held >= BATCH_ROWS:
                        yield flush()
                        out, held = [], 0
        if out:
            yield flush()

    return rows.select("text").mapInArrow(run, "key bigint, class bigint, n int, place int")


def _could_link(n: str, place: str, other_n: str, other_place: str, percent: int):
    """Length filter, and positional filter: what either set still has after the common n-gram."""
    a, b = F.col(n).cast("bigint"), F.col(other_n).cast("bigint")
    left = F.least(a - F.col(place), b - F.col(other_place))
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (100 * left >= percent * (a + b - left))


def _suffix_filter(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures do not differ too much for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.arange(batch.num_rows)
            differ = _differing_bits([*batch.column("x").to_pylist(), *batch.column("y").to_pylist()], m, m + len(m))
            total = sum(batch.column(c).to_numpy().astype(np.int64) for c in ("n", "n_2"))
            yield batch.select(["a", "b"]).filter(pa.array(differ * (100 + percent) <= total * (100 - percent)))

    one = signatures.select(F.col("class").alias("a"), F.col("signature").alias("x"), "n")
    two = signatures.select(F.col("class").alias("b"), F.col("signature").alias("y"), F.col("n").alias("n_2"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y", "n", "n_2").mapInArrow(run, "a bigint, b bigint")


#: Rows of links or pairs that one task writes: small frames are not dealt over as many tasks as the corpus.
ROWS_A_TASK = 50_000


def _few(frame: DataFrame, rows: int) -> DataFrame:
    return frame.coalesce(max(1, rows // ROWS_A_TASK + 1))


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of all nodes that have a link.

    links: bigint columns a and b.  Each node is hooked to its smallest neighbour by turns of large and
    small stars, until nothing changes; a node's neighbours are never gathered in a list."""
    rows = links.count()
    edges = cut(_few(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), rows).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
        large = _few(large, 2 * rows).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(small_low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(small_low.select("u", F.col("low").alias("v")))
        edges = cut(_few(_few(small.where("u <> v"), 2 * rows).distinct(), rows))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _spanning(a: list[int], b: list[int]) -> list[int]:
    """Which of the edges (a[i], b[i]) join two trees when they are taken in order."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    out = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            out.append(i)
    return out


def _close_labels(table: pa.Table, percent: int) -> pa.RecordBatch:
    """a, b: a spanning forest, over labels, of the close pairs in the blocks of a table (sorted by block)."""
    block, n, place, label, side = (table.column(c).to_numpy().astype(np.int64) for c in ("block", "n", "place", "label", "side"))
    either = table.column("one_sided").to_numpy()
    signatures = table.column("signature").to_pylist()
    edges: tuple[list[int], list[int]] = ([], [])
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def test() -> None:
        a, b = (np.concatenate(x) for x in zip(*waiting, strict=True))
        waiting.clear()
        good = _differing_bits(signatures, a, b) * (100 + percent) <= (n[a] + n[b]) * (100 - percent)
        x, y = label[a[good]].tolist(), label[b[good]].tolist()
        for i in _spanning(x, y):
            edges[0].append(x[i])
            edges[1].append(y[i])

    ends = np.searchsorted(block, block, side="right")
    i, apart, held = np.arange(len(block)), 0, 0
    while True:
        apart += 1
        i = i[i + apart < ends[i]]
        if not len(i):
            break
        j = i + apart
        ok = (label[i] != label[j]) & (either[i] | (side[i] != side[j]))
        a, b = i[ok], j[ok]
        left = np.minimum(n[a] - place[a], n[b] - place[b])
        ok = (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (100 * left >= percent * (n[a] + n[b] - left))
        if ok.any():
            waiting.append((a[ok], b[ok]))
            held += int(ok.sum())
            if held > 200_000:
                test()
                held = 0
    if waiting:
        test()
    kept = _spanning(*edges)
    return pa.RecordBatch.from_arrays([pa.array([x[i] for i in kept], pa.int64()) for x in edges], names=["a", "b"])


def _close_in_blocks(members: DataFrame, labels: DataFrame | None, signatures: DataFrame, percent: int) -> DataFrame | None:
    """Edges (a, b) between labels that join all classes of different clusters which pass the filters at some n-gram; None if all are joined.

    An n-gram whose members have more than one label is open.  The members with its commonest label are not compared with one
    another; the others meet each other and those, in blocks of about BLOCK_MEMBERS of either side."""
    if labels is None:
        now = members.withColumn("label", F.col("class"))
    else:
        now = members.join(labels, members["class"] == labels["node"], "left").select(*members.columns, F.coalesce("root", "class").alias("label"))
    by_label = now.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("k"))
    sizes = by_label.groupBy("gram").agg(F.sum("k").alias("m"), F.max(F.struct("k", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    sizes = sizes.select("gram", "m", F.col("main.k").alias("km"), F.col("main.label").alias("main"))
    open_rows = stored(now.join(sizes, "gram"))
    if open_rows.isEmpty():
        return None
    room = BLOCK_MEMBERS
    dealt = open_rows.withColumn("most", F.col("label") == F.col("main")).withColumn("one", F.col("m") <= room)
    dealt = dealt.withColumn("others", F.ceil((F.col("m") - F.col("km")) / room).cast("int")).withColumn("mains", F.ceil(F.col("km") / room).cast("int"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("class"), F.when(F.col("most"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    alone = "array(named_struct('kind', 0, 'p', 0, 'q', 0, 'side', 0))"
    among = "transform(sequence(0, others - 1), r -> named_struct('kind', 0, 'p', least(part, r), 'q', greatest(part, r), 'side', CAST(part > r AS INT)))"
    to_mains = "transform(sequence(0, mains - 1), r -> named_struct('kind', 1, 'p', part, 'q', r, 'side', 0))"
    to_others = "transform(sequence(0, others - 1), r -> named_struct('kind', 1, 'p', r, 'q', part, 'side', 1))"
    at = F.expr(f"CASE WHEN one THEN {alone} WHEN most THEN {to_others} ELSE concat({among}, {to_mains}) END")
    blocks = dealt.join(signatures.select("class", "signature"), "class").select("gram", "n", "place", "label", "signature", F.explode(at).alias("at"))
    blocks = blocks.select(
        F.xxhash64("gram", "at.kind", "at.p", "at.q").alias("block"), "n", "place", "label", "at.side", (F.expr("at.kind = 0 AND at.p = at.q")).alias("one_sided"), "signature"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < BLOCK_ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            block = table.column("block").to_numpy()
            whole = int(np.searchsorted(block, block[-1], side="left"))  # the last block may go on
            if whole:
                yield _close_labels(table.slice(0, whole), percent)
            held = table.slice(whole).combine_chunks().to_batches()
            rows = table.num_rows - whole
        if held:
            yield _close_labels(pa.Table.from_batches(held).combine_chunks(), percent)

    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a bigint, b bigint").distinct()


def _id_bits(classes: int) -> int:
    return min(max(LEAST_ID_BITS, (16 * classes).bit_length()), MOST_ID_BITS)


def _id_table(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit for the hash of each id; of 2**bits bits, so at most 2**(bits-5) rows come to the driver."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    words = ids.select(F.shiftright(place, 5).alias("word"), F.expr("shiftleft(1L, CAST(pmod(xxhash64(doc_id), 32) AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    table = np.zeros(1 << (bits - 5), dtype=np.uint32)
    found = words.toPandas()
    table[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    return table


def _member_texts(rows: DataFrame, table, bits: int, words: int, seed: int) -> DataFrame:
    """class, text of the documents whose id is in the table, one text for each class and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = table.value
        seen: set[int] = set()  # at most a number for each document of the task
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False)
            hit = (wanted[h >> 5] >> (h & 31).astype(np.uint32)) & 1
            some = batch.filter(pa.array(hit.astype(bool)))
            keys: list[int | None] = []
            for piece in runs(some.column("text")):
                for grams in gram_sets(piece, words):
                    key = _class_key(grams, seed)[0] if len(grams) else None
                    keys.append(None if key in seen else key)
                    seen.add(key)
            found = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), some.column("text")], names=["class", "text"])
            yield found.filter(pa.array([k is not None for k in keys], pa.bool_()))

    hashed = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)).alias("h"), "text")
    return hashed.mapInArrow(run, "class bigint, text string")


def _intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all of y."""
    distinct, code = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    cut_at = sum(map(len, x))
    sides = []
    for some, codes in ((x, code[:cut_at]), (y, code[cut_at:])):
        row = np.repeat(np.arange(len(some)), [len(g) for g in some])
        sides.append((row, codes, np.bincount(codes, minlength=len(distinct)) > 0))
    both = sides[0][2] & sides[1][2]
    place = np.cumsum(both) - 1  # n-grams that only one side has are in no intersection
    common = np.zeros((len(x), len(y)), dtype=np.int64)
    parts = []
    for row, codes, _ in sides:
        hit = both[codes]
        at = place[codes[hit]]
        order = np.argsort(at, kind="stable")
        parts.append((row[hit][order], at[order]))
    for low in range(0, int(both.sum()), STEP_GRAMS):
        dense = []
        for n, (row, at) in zip((len(x), len(y)), parts, strict=True):
            a, b = np.searchsorted(at, (low, low + STEP_GRAMS))
            matrix = np.zeros((n, STEP_GRAMS), dtype=np.float32)
            matrix[row[a:b], at[a:b] - low] = 1
            dense.append(matrix)
        common += (dense[0] @ dense[1].T).astype(np.int64)  # at most STEP_GRAMS, so exact
    return common


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """If two sorted sets link, by the exact intersection."""
    a, b = len(x), len(y)
    at = np.searchsorted(y, x)
    common = int((y[np.minimum(at, b - 1)] == x).sum())
    return 100 * common >= percent * (a + b - common)


def _links(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, percent: int) -> np.ndarray:
    """first x second: if the sets link (no set with itself)."""
    if len(sets) == 2 and len(first) == len(second) == 2:
        link = np.zeros((2, 2), dtype=bool)
        link[0, 1] = link[1, 0] = linked(sets[0], sets[1], percent)
        return link
    n = np.array([len(g) for g in sets], dtype=np.int64)
    out = np.zeros((len(first), len(second)), dtype=bool)
    for a in range(0, len(first), BLOCK_SETS):
        one = first[a : a + BLOCK_SETS]
        for b in range(0, len(second), BLOCK_SETS):
            two = second[b : b + BLOCK_SETS]
            common = _intersections([sets[i] for i in one], [sets[i] for i in two])
            out[a : a + BLOCK_SETS, b : b + BLOCK_SETS] = 100 * common >= percent * (n[one][:, None] + n[two][None, :] - common)
    return out & (first[:, None] != second[None, :])


def _block_links(table: pa.Table, words: int, percent: int) -> pa.Table:
    """For the classes of two blocks (side 0 and 1), or of one or more whole clusters (all of side 0): class and linked, the rows of
    linked classes; and class and other, a spanning forest of the links."""
    table = table.combine_chunks()
    side, size, root, classes = (table.column(c).to_numpy() for c in ("side", "size", "root", "class"))
    alone = table.column("alone")[0].as_py()
    sets = [g for piece in runs(table.column("text")) for g in gram_sets(piece, words)]
    counted = np.zeros(len(sets), dtype=np.int64)
    tree = np.arange(len(sets))
    order = np.argsort(root, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
        first = np.flatnonzero(side[own] == 0)
        second = first if alone else np.flatnonzero(side[own] == 1)
        if not len(first) or not len(second):
            continue
        link = _links([sets[i] for i in own], first, second, percent)
        counted[own[first]] += link @ size[own[second]]
        if not alone:
            counted[own[second]] += link.T @ size[own[first]]
        place = np.arange(len(own))  # the smallest place that a set is connected with in this block
        while True:
            low = place.copy()
            low[first] = np.minimum(low[first], np.where(link, place[second][None, :], len(own)).min(axis=1))
            low[second] = np.minimum(low[second], np.where(link, low[first][:, None], len(own)).min(axis=0))
            if (low == place).all():
                break
            place = low[low]
        tree[own] = own[place]
    joined = np.flatnonzero(tree != np.arange(len(sets)))
    return pa.table(
        {
            "class": pa.array(np.concatenate((classes, classes[joined]))),
            "linked": pa.array(np.concatenate((counted, np.zeros(len(joined), dtype=np.int64)))),
            "other": pa.concat_arrays([pa.nulls(len(classes), pa.int64()), pa.array(classes[tree[joined]], pa.int64())]),
        }
    )


def _verified(rows: DataFrame, members: DataFrame, words: int, percent: int, seed: int) -> DataFrame:
    """class, linked (rows of linked classes), other (null, or a class of the same component) for all links inside clusters.

    members: class, root, size (rows), rep (an id), n of all classes of clusters.  Small clusters share blocks.  Of a large one, classes are banded by size, so
    that links lie inside a band or between neighbouring ones, and bands are dealt into parts of bounded size."""
    spark = rows.sparkSession
    whole = stored(members.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("grams")).withColumn("large", F.expr(f"grams > {BLOCK_GRAMS} OR m > {BLOCK_SETS}")))
    small, n_classes = whole.agg(F.sum(F.when(~F.col("large"), F.col("grams"))), F.sum("m")).first()
    bins = max(1, math.ceil((small or 0) / BLOCK_GRAMS))
    # links are inside a band of sizes or between neighbouring ones, with room for rounding
    band = F.floor(F.log("n") / F.lit(-math.log(percent / 100) * 1.001 if percent < 100 else 1.0)).cast("int")
    with_size = members.join(whole.where("large").select("root", "large"), "root", "left")
    with_size = stored(with_size.select("class", "root", "size", "rep", "n", F.when(F.col("large"), band).alias("band")))
    parts = with_size.where("band IS NOT NULL").groupBy("root", "band").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_GRAMS), F.ceil(F.count(F.lit(1)) / BLOCK_SETS)).cast("int").alias("parts"))
    parts = stored(parts)
    above = parts.select("root", (F.col("band") - 1).alias("band"), F.col("parts").alias("above"))
    below = parts.select("root", (F.col("band") + 1).alias("band"), F.col("parts").alias("under"))
    around = parts.join(above, ["root", "band"], "left").join(below, ["root", "band"], "left")
    dealt = with_size.where("band IS NOT NULL").join(around, ["root", "band"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    same = "transform(sequence(0, parts - 1), r -> named_struct('low', band, 'p', least(part, r), 'high', band, 'q', greatest(part, r), 'side', CAST(part > r AS INT), 'alone', part = r))"
    up = "transform(sequence(0, coalesce(above, 1) - 1), r -> named_struct('low', band, 'p', part, 'high', band + 1, 'q', r, 'side', 0, 'alone', false))"
    down = "transform(sequence(0, coalesce(under, 1) - 1), r -> named_struct('low', band - 1, 'p', r, 'high', band, 'q', part, 'side', 1, 'alone', false))"
    in_parts = F.expr(f"concat({same}, CASE WHEN above > 0 THEN {up} ELSE array() END, CASE WHEN under > 0 THEN {down} ELSE array() END)")
    in_bins = F.expr("array(named_struct('low', -9, 'p', 0, 'high', -9, 'q', 0, 'side', 0, 'alone', true))")
    columns = ["class", "root", "size", "rep"]
    large = dealt.select(*columns, F.col("root").alias("meet"), in_parts.alias("blocks"))
    others = with_size.where("band IS NULL").select(*columns, F.pmod(F.xxhash64("root"), F.lit(bins)).alias("meet"), in_bins.alias("blocks"))
    used = stored(others.unionByName(large))
    bits = _id_bits(n_classes or 0)
    table = spark.sparkContext.broadcast(_id_table(used.select(F.col("rep").alias("doc_id")), bits))
    texts = _member_texts(rows, table, bits, words, seed).groupBy("class").agg(F.first("text").alias("text"))
    placed = texts.join(used, "class").select("class", "root", "size", "text", "meet", F.explode("blocks").alias("at")).select("class", "root", "size", "text", "meet", "at.*")
    return placed.groupBy("meet", "low", "p", "high", "q").applyInArrow(lambda x: _block_links(x, words, percent), "class bigint, linked bigint, other bigint")


def _met(key: np.ndarray, klass: np.ndarray, n: np.ndarray, place: np.ndarray, percent: int) -> pa.RecordBatch:
    """What the classes of whole keys (sorted by key) have to do with each other: pairs that pass the length and positional filter where at
    most SMALL classes meet, else the members themselves.  Columns: a, b (a pair), or gram, a, n, place (a member)."""
    alone = key < 1 << GRAM_BITS  # who is alone in a salt may meet others in another one
    alone[1:] &= key[1:] != key[:-1]
    alone[:-1] &= key[1:] != key[:-1]
    some = ~alone
    key, klass, n, place = key[some], klass[some], n[some].astype(np.int64), place[some].astype(np.int64)
    order = np.lexsort((klass, key))
    once = np.ones(len(order), dtype=bool)  # classes that several tasks sent
    once[1:] = (key[order][1:] != key[order][:-1]) | (klass[order][1:] != klass[order][:-1])
    order = order[once]
    key, klass, n, place = key[order], klass[order], n[order], place[order]
    ends = np.searchsorted(key, key, side="right")
    met = ends - np.searchsorted(key, key, side="left")
    large = (met > SMALL) | (key >= 1 << GRAM_BITS)
    i, apart = np.flatnonzero(~large), 0
    a, b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    while True:
        apart += 1
        i = i[i + apart < ends[i]]
        if not len(i):
            break
        j = i + apart
        left = np.minimum(n[i] - place[i], n[j] - place[j])
        ok = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (100 * left >= percent * (n[i] + n[j] - left))
        a.append(klass[i[ok]])  # classes of a key are in order: a < b
        b.append(klass[j[ok]])
    first, second = np.concatenate(a), np.concatenate(b)
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    new = np.ones(len(first), dtype=bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    first, second, pairs, members = first[new], second[new], int(new.sum()), int(large.sum())
    arrays = [
        pa.array(np.concatenate((first, klass[large]))),
        pa.concat_arrays([pa.array(second, pa.int64()), pa.nulls(members, pa.int64())]),
        pa.concat_arrays([pa.nulls(pairs, pa.int64()), pa.array(key[large] & ((1 << GRAM_BITS) - 1), pa.int64())]),
        pa.array(np.concatenate((np.zeros(pairs), n[large])).astype(np.int32)),
        pa.array(np.concatenate((np.zeros(pairs), place[large])).astype(np.int32)),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "gram", "n", "place"])


def _meetings(prefixes: DataFrame, percent: int) -> DataFrame:
    """The rows of ``_met`` for all prefixes: one shuffle by n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("key", "class", "n", "place")])
            rows += batch.num_rows
            if rows < BATCH_ROWS:
                continue
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            whole = int(np.searchsorted(columns[0], columns[0][-1], side="left"))  # the last key may go on
            if whole:
                yield _met(*[c[:whole] for c in columns], percent)
            held = [[c[whole:] for c in columns]]
            rows -= whole
        if held:
            yield _met(*[np.concatenate(c) for c in zip(*held, strict=True)], percent)

    return prefixes.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint, gram bigint, n int, place int")


def _pivot_pairs(members: DataFrame, percent: int) -> DataFrame:
    """a, b: each class with the pivots (smallest classes) of its n-grams that it could link with, PIVOTS of them."""
    pivots = members.groupBy("gram").agg(F.min(F.struct("class", "n", "place")).alias("pivot"))
    pivots = pivots.select("gram", F.col("pivot.class").alias("pivot"), F.col("pivot.n").alias("n_2"), F.col("pivot.place").alias("place_2"))
    met = members.join(pivots, "gram").where("class <> pivot").where(_could_link("n", "place", "n_2", "place_2", percent)).select("class", "pivot").distinct()
    turn = F.row_number().over(Window.partitionBy("class").orderBy("pivot"))
    return met.withColumn("turn", turn).where(F.col("turn") <= PIVOTS).select(F.least("class", "pivot").alias("a"), F.greatest("class", "pivot").alias("b"))


def _clusters(prefixes: DataFrame, signatures: DataFrame, percent: int) -> DataFrame | None:
    """node (class) and root of all classes that are close to some other one; every link is inside a cluster.  None without any."""
    met = stored(_meetings(prefixes, percent))
    members = met.where("gram IS NOT NULL").select("gram", F.col("a").alias("class"), "n", "place").distinct()
    pairs = stored(met.where("b IS NOT NULL").select("a", "b").unionByName(_pivot_pairs(members, percent)).distinct())
    labels = None
    if not pairs.isEmpty():
        close = stored(_suffix_filter(pairs, signatures, percent))
        if not close.isEmpty():
            labels = stored(components(close))
    edges = _close_in_blocks(members, labels, signatures, percent)
    if edges is None:
        return labels
    edges = stored(edges)
    if edges.isEmpty():
        return labels
    if labels is not None:
        edges = edges.unionByName(labels.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    return stored(components(edges))


def ngram_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", sketch_bits: int = SKETCH_BITS, count_links: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, class_id (smallest id with an equal set), component_id.

    With count_links also n_links: other rows that the row is linked with, rows of an equal set included."""
    spark = docs.sparkSession
    rows = own_columns(docs, {"doc_id": id_col, "text": text_col})
    if rows.schema["doc_id"].dataType.simpleString() != "binary":
        rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    for seed in range(8):  # another seed if two different sets should ever get one key
        counted = stored(_sets(rows, words, seed, sketch_bits))
        each = counted.where("part IS NULL").select("doc_id", "n", "class", "second", "signature")
        classes = each.where("class IS NOT NULL").groupBy("class")
        classes = stored(classes.agg(F.min("doc_id").alias("rep"), F.min("second").alias("lo"), F.max("second").alias("hi"), F.count(F.lit(1)).alias("size"), F.min("n").alias("n")))
        if classes.where("lo <> hi").isEmpty():
            break
    else:
        raise RuntimeError("sets can't be told apart")
    table = _sketch(counted, sketch_bits)
    shared = spark.sparkContext.broadcast((table, salts(table)))
    signatures = each.where("signature IS NOT NULL").select("class", "n", "signature").dropDuplicates(["class"])
    labels = _clusters(_prefixes(rows, shared, words, percent, seed, sketch_bits), signatures, percent)
    named = classes.select("class", "rep", "size")
    if labels is None:
        named = named.select("class", "rep", F.col("rep").alias("component_id"), (F.col("size") - 1).alias("n_links"))
    else:
        members = stored(labels.join(classes, labels["node"] == classes["class"]).select("class", "root", "size", "rep", "n"))
        found = stored(_verified(rows, members, words, percent, seed))
        linked_rows = found.where("other IS NULL").groupBy("class").agg(F.sum("linked").alias("linked"))
        final = components(found.where("other IS NOT NULL").select(F.col("class").alias("a"), F.col("other").alias("b")))
        named = named.join(linked_rows, "class", "left").join(final, named["class"] == final["node"], "left")
        named = stored(named.select("class", "rep", F.coalesce("root", "class").alias("root"), (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")))
        smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
        named = named.join(smallest, "root").select("class", "rep", "component_id", "n_links")
    found = each.select("doc_id", "n", "class").join(named, "class", "left")
    found = found.withColumns({"class_id": F.coalesce("rep", "doc_id"), "component_id": F.coalesce("component_id", "doc_id")})
    more = [F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")] if count_links else []
    return found.select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id", *more)


#: The same in DuckDB SQL: every pair of sets that share an n-gram, and the links' components by a recursive query.
ORACLE = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {WORDS} THEN [array_to_string(w[i : i + {WORDS - 1}], ' ') FOR i IN range(1, len(w) - {WORDS - 2})] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS grams FROM words
), keyed AS (SELECT doc_id, len(grams) AS n, sha256(array_to_string(grams, chr(10))) AS k, grams FROM sets
), classes AS (SELECT k, min(doc_id) AS rep, count(*) AS size, any_value(n) AS n, any_value(grams) AS grams FROM keyed WHERE n > 0 GROUP BY k
), each AS (SELECT rep, n, unnest(grams) AS gram FROM classes
), common AS (SELECT x.rep AS a, y.rep AS b, any_value(x.n) + any_value(y.n) AS total, count(*) AS met FROM each x JOIN each y ON x.gram = y.gram AND x.rep <> y.rep GROUP BY 1, 2
), links AS (SELECT a, b FROM common WHERE 100 * met >= {PERCENT} * (total - met)
), reach AS (SELECT rep AS a, rep AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a
), counted AS (SELECT l.a, sum(c.size) AS others FROM links l JOIN classes c ON c.rep = l.b GROUP BY l.a)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, coalesce(c.rep, d.doc_id) AS class_id, coalesce(r.root, d.doc_id) AS component_id,
       CAST(coalesce(c.size - 1 + coalesce(o.others, 0), 0) AS BIGINT) AS n_links
FROM keyed d LEFT JOIN classes c ON d.n > 0 AND c.k = d.k LEFT JOIN roots r ON r.a = c.rep LEFT JOIN counted o ON o.a = c.rep
"""

"""Packing token sequences by best-fit decreasing.

Each document is tokenized and closed by one separator id.  A document longer than a window is first cut
into full windows, which are sequences of their own; what is left of it goes, longest first, into the open window with the least
capacity that still holds it.  That window is found by a segment tree indexed by remaining capacity: a
leaf counts the open windows with that capacity, and the search goes up from the wanted length to the first subtree with any.

Packing runs where documents are read: each task packs its own rows in blocks of about ``block`` remainders, so memory is bounded by the block
and a lost task is simply run again.  Windows that are less than ``full_enough`` filled stay open for the next block.  What is in those that are
still open when a task ends is packed again, together with that of the other tasks, in a second step: one small shuffle of rows without text, dealt over
tasks of about ``block`` pieces.  So padding does not depend on how the input happens to be split.  Sequence ids are the task's number in the upper
bits and a counter below; those of the second step have a bit of their own.

Results for unusual rows: a null or empty text is one piece of one separator; repeated ids are rows of
their own; an empty table gives no rows; other columns are ignored.  Sequences are shorter than the window where
nothing fits any more; padding is left to the reader (none where the length is a power of two).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oxidara.llm.bpe import ids_of, vocabulary
from oxidara.llm.rows import own_columns, stored

WINDOW = 1024
#: Pieces packed together in one task.
BLOCK = 50_000
#: Texts tokenized at a time.
STEP = 256
#: Bits of a sequence id below the task's number, and the bit of the second step.
TASK_SHIFT, SECOND_STEP = 36, 1 << 62


class CapacityTree:
    """Counts of open windows by remaining capacity 0..top, with a search for the smallest capacity >= n."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.tree = [0] * (2 * self.leaves)

    def add(self, capacity: int, change: int) -> None:
        node = capacity + self.leaves
        while node:
            self.tree[node] += change
            node >>= 1

    def tightest(self, n: int) -> int:
        """The smallest capacity of an open window that is at least n, or -1."""
        tree, node = self.tree, n + self.leaves
        if tree[node]:
            return n
        while node > 1:
            if not node & 1 and tree[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return -1
        while node < self.leaves:
            node = 2 * node if tree[2 * node] else 2 * node + 1
        return node - self.leaves


class Packer:
    """Windows of one task: they stay open over blocks while they are poorly filled."""

    def __init__(self, window: int, first: int, full_enough: float = 0.97):
        self.window, self.next, self.least = window, first, int(window * (1 - full_enough))
        self.tree = CapacityTree(window)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def take(self) -> int:
        """The id of a new sequence."""
        self.next += 1
        return self.next - 1

    def still_open(self) -> set[int]:
        """The sequences that may get more."""
        return {own for stack in self.open for own in stack}

    def place(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each length (all of them at most the window), longest first."""
        sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        tree, stacks, window = self.tree, self.open, self.window
        for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
            room = tree.tightest(n)
            if room < 0:
                own, room = self.take(), window
            else:
                own = stacks[room].pop()
                tree.add(room, -1)
            sequence[i], offset[i] = own, window - room
            if room > n:
                stacks[room - n].append(own)
                tree.add(room - n, 1)
        for room in range(1, self.least + 1):  # full enough: closed
            if stacks[room]:
                tree.add(room, -len(stacks[room]))
                stacks[room] = []
        return sequence, offset


def pack(docs: DataFrame, path: str, window: int = WINDOW, separator: int = 0, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset [, ids].

    path: the vocabulary; ids_crc32: of the piece's ids as little-endian unsigned 32-bit integers."""
    rows = own_columns(docs, {"doc_id": id_col, "text": text_col})
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    if with_ids:
        schema += ", ids array<int>"

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        context = TaskContext.get()
        packer = Packer(window, (context.partitionId() if context else 0) << TASK_SHIFT)
        pieces: list[list] = []  # rows in the order of names
        waiting: list[int] = []
        id_type = None

        def give(some: list[list], loose: bool) -> pa.RecordBatch:
            columns = list(zip(*some, strict=True)) or [()] * len(names)
            kinds = [id_type, *[pa.int64()] * 6, *([pa.list_(pa.int32())] if with_ids else [])]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(some), loose))], names=[*names, "loose"])

        def place() -> pa.RecordBatch:
            """Give what lies in windows that are closed; the rest goes on."""
            own, at = packer.place(np.array([pieces[i][2] for i in waiting], dtype=np.int64))
            for i, s, o in zip(waiting, own.tolist(), at.tolist(), strict=True):
                pieces[i][5:7] = s, o
            waiting.clear()
            unfinished = packer.still_open()
            done = [x for x in pieces if x[5] not in unfinished]
            pieces[:] = [x for x in pieces if x[5] in unfinished]
            return give(done, False)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for first in range(0, batch.num_rows, STEP):
                part = batch.slice(first, STEP)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), ids_of(v, part.column("text").to_pylist()), strict=True):
                    whole = np.append(ids, separator).astype("<u4")
                    n = len(whole)
                    for at in range(0, n, window):
                        piece = whole[at : at + window]
                        full = len(piece) == window
                        if not full:
                            waiting.append(len(pieces))
                        pieces.append([doc_id, at, len(piece), zlib.crc32(piece), n, packer.take() if full else -1, 0, *([piece.astype(np.int32)] if with_ids else [])])
                if len(pieces) >= block:
                    yield place()
        if pieces:
            yield place()
            if pieces:
                yield give(pieces, True)

    first = stored(rows.mapInArrow(run, f"{schema}, loose boolean"))
    left = first.where("loose").count()
    if not left:
        return first.drop("loose")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = Packer(window, SECOND_STEP | ((context.partitionId() if context else 0) << TASK_SHIFT))
        held: list[pa.RecordBatch] = []

        def place() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            own, at = packer.place(table.column("length").to_numpy())
            columns = {c: table.column(c) for c in names} | {"sequence_id": pa.array(own), "offset": pa.array(at)}
            return pa.table(columns).combine_chunks().to_batches()[0]

        rows_held = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows_held += batch.num_rows
            if rows_held >= 2 * block:
                rows_held = 0
                yield place()
        if held:
            yield place()

    # by content, so that a lost task finds the same rows in the same order again
    dealt = first.where("loose").drop("loose").repartition(-(-left // block), F.xxhash64("doc_id", "start", "ids_crc32"))
    ordered = dealt.sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids_crc32")
    return first.where("NOT loose").drop("loose").unionByName(ordered.mapInArrow(again, schema))

"""Benchmark decontamination: exact occurrences of benchmark passages in documents, by a prefix-filtered set join.

A window is WINDOW consecutive words of an item; an item of fewer words is one window.  A window is held as its set of shingles of up to SHINGLE words with
their places.  To contain a window, a document must contain all of its shingles, so the prefix that must be met has a length of one: the rarest shingle.

1. The benchmark gives its distinct windows and shingles (64-bit numbers of the words).  A bit table of bounded size, made of the shingles, is sent to the tasks.
2. One pass over the documents counts the shingles that are in the table; Spark adds the counts up.  Windows with a shingle that never occurs end here.  Of
   each other one the shingle with the smallest count is its prefix.
3. A second pass sends, for every place of a prefix shingle in a document, the words around it (as many as a window can reach).  Windows and places are joined by shingle; frequent shingles
   are dealt over salts, as many as their counts ask for.  The positional bound (the window begins at or after the first word) and the length bound (and ends by the last one) go first, then the
   words themselves are compared: exact, over the document's window of the size of the item's.
4. Hit words are the union of what the found windows cover, by a running maximum over their beginnings; items are gathered for each document.

Every document row has a number of its own, written with its places as one table in the shared folder, so repeated ids are rows of their own and nothing is read twice with different numbers.
Tables of bits and of salts have a bounded size (MOST_BITS, SALT_PLACES); more benchmark than bits makes more places that find no window, and no other result.

Results for unusual rows: a null text has no words; rows that repeat an id, or have none, are documents of their own; items that repeat an id are one item with all their windows; windows of
an item without an id hit words and are not counted or named as items; without benchmark words nothing is contaminated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oxidara.llm.rows import own_columns, stored
from oxidara.llm.words import Run, ascii_lower, letters_and_digits, mix, runs, words

WINDOW, SHINGLE = 10, 3
#: Bits of the table of shingles: so many for each shingle, as far as that is within these bounds (32 MB at most).
BITS_EACH, LEAST_BITS, MOST_BITS = 1024, 16, 28
#: Places of a prefix shingle that go to one salt; shingles of one place of the table share its salts.
HOT, SALT_BITS = 20_000, 16
#: Rows of one Arrow batch of places.
BATCH_ROWS = 20_000


def _word_numbers(run: Run) -> tuple[Run, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The run in lower case (A-Z only), and its words: begin, end, number, first word of each row (and the end of the last row)."""
    low = Run(run.first, ascii_lower()[run.data], run.offsets)
    found = words(low, letters_and_digits())
    starts = np.concatenate(([0], np.cumsum(found.counts(low.rows)))) if low.rows else np.zeros(1, dtype=np.int64)
    return low, found.begin, found.end, found.value, starts.astype(np.int64)


def _shingles(value: np.ndarray, width: int) -> np.ndarray:
    """The number of the ``width`` words from each word on (over the ends of rows as well; those are left out by place)."""
    weights = mix(np.arange(1, width + 2, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)
    out = np.full(max(len(value) - width + 1, 0), width, dtype=np.uint64)
    for j in range(width):
        out += value[j : j + len(out)] * weights[j]
    return mix(out)


def _windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """item_id, words, shingle, at (its place in the window), width of all windows of all items, each window of an item once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column("item_id").to_pylist(), []
            for piece in runs(batch.column("text")):
                low, begin, end, value, starts = _word_numbers(piece)
                data = low.data.tobytes()
                for r in range(low.rows):
                    a, b = int(starts[r]), int(starts[r + 1])
                    text = [data[begin[i] : end[i]].decode() for i in range(a, b)]
                    size = min(window, b - a)
                    width = min(shingle, size)
                    if size:
                        numbers = _shingles(value[a:b], width).view(np.int64).tolist()
                        out += [(ids[piece.first + r], text[i : i + size], numbers[i : i + size - width + 1], width) for i in range(b - a - size + 1)]
            if out:
                kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=["item_id", "words", "shingles", "width"])

    return items.mapInArrow(run, "item_id bigint, words array<string>, shingles array<bigint>, width int").distinct()


def _bits(shingles: DataFrame, bits: int) -> np.ndarray:
    """A bit for the leading bits of each shingle: 2**(bits-5) rows at most come to the driver."""
    place = F.shiftrightunsigned("shingle", 64 - bits)
    words32 = shingles.select(F.shiftright(place, 5).alias("word"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(shingle, {64 - bits}) & 31 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    table = np.zeros(1 << (bits - 5), dtype=np.uint32)
    found = words32.toPandas()
    table[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    return table


class Known:
    """Which shingles the benchmark may have, by width."""

    def __init__(self, shingles: DataFrame):
        """shingles: distinct shingle and width."""
        n = shingles.count()
        self.bits = min(max(LEAST_BITS, (BITS_EACH * n).bit_length()), MOST_BITS)
        self.table = _bits(shingles, self.bits)
        self.widths = sorted(row["width"] for row in shingles.select("width").distinct().collect())  # at most SHINGLE

    def places(self, value: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Where words of known shingles of a width begin, and the shingles."""
        numbers = _shingles(value, width)
        place = numbers >> np.uint64(64 - self.bits)
        hit = np.flatnonzero((self.table[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1))
        row = np.searchsorted(starts, hit, side="right") - 1
        hit = hit[hit + width <= starts[row + 1]]  # a shingle never goes on from one row to the next
        return hit, numbers[hit]


def _counts(docs: DataFrame, known: Known) -> DataFrame:
    """shingle, n: how often the shingles of the table are in the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [np.empty(0, dtype=np.uint64)]
            for piece in runs(batch.column("text")):
                value, starts = _word_numbers(piece)[3:]
                seen += [shared.value.places(value, starts, width)[1] for width in shared.value.widths]
            numbers, n = np.unique(np.concatenate(seen), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(numbers.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    return docs.select("text").mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))


def _places(docs: DataFrame, known: Known | None, salts: np.ndarray, window: int) -> DataFrame:
    """A row for each document (row, doc_id, n_words; no shingle), and for each place of a prefix shingle in it: row, n_words, shingle, salt, at (first word), from (of the context), context."""
    shared = docs.sparkSession.sparkContext.broadcast((known, salts))
    names = ["row", "doc_id", "n_words", "shingle", "salt", "at", "first", "context"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId() << 40, 0
        prefix, dealt = shared.value
        for batch in batches:
            sizes, rows = [], []
            for piece in runs(batch.column("text")):
                low, begin, end, value, starts = _word_numbers(piece)
                size = np.diff(starts)
                sizes.append(size)
                data = low.data.tobytes()
                for width in prefix.widths if prefix is not None else ():
                    hit, numbers = prefix.places(value, starts, width)
                    owner = np.searchsorted(starts, hit, side="right") - 1
                    reach = window - width if width == min(SHINGLE, window) else 0  # narrower shingles are whole windows
                    first = np.maximum(hit - reach, starts[owner])
                    last = np.minimum(hit + width + reach, starts[owner + 1])
                    over = dealt[(numbers >> np.uint64(64 - SALT_BITS)).astype(np.int64)]
                    for i, j, a, b, number, salt in zip(hit.tolist(), owner.tolist(), first.tolist(), last.tolist(), numbers.view(np.int64).tolist(), over.tolist(), strict=True):
                        row = part + count + piece.first + j
                        s = int(starts[j])
                        rows.append((row, int(size[j]), number, row % salt, i - s, a - s, [data[begin[w] : end[w]].decode() for w in range(a, b)]))
            n = batch.num_rows
            if n:
                number = pa.array(part + count + np.arange(n, dtype=np.int64))
                nulls = [pa.nulls(n, kind) for kind in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([number, batch.column("doc_id"), pa.array(np.concatenate(sizes).astype(np.int64)), *nulls], names=names)
            for at in range(0, len(rows), BATCH_ROWS):
                row, n_words, number, salt, place, first, context = zip(*rows[at : at + BATCH_ROWS], strict=True)
                columns = [pa.array(row, pa.int64()), pa.nulls(len(row), pa.int64()), *(pa.array(c, kind) for c, kind in ((n_words, pa.int64()), (number, pa.int64()), (salt, pa.int32()), (place, pa.int64()), (first, pa.int64()), (context, pa.list_(pa.string()))))]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            count += n

    return docs.mapInArrow(run, "row bigint, doc_id bigint, n_words bigint, shingle bigint, salt int, at bigint, first bigint, context array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", spans: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document; with spans also spans, the begin and end words of what is hit."""
    rows = own_columns(docs, {"doc_id": id_col, "text": text_col}).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    items = own_columns(benchmark, {"item_id": item_col, "text": item_text_col}).select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    windows = stored(_windows(items, window, SHINGLE))
    shingles = windows.select("width", F.explode("shingles").alias("shingle")).distinct()
    salts = np.ones(1 << SALT_BITS, dtype=np.int32)
    prefix = None
    if not windows.isEmpty():
        counts = stored(_counts(rows, Known(shingles)))
        each = windows.select("words", "width", F.posexplode("shingles").alias("offset", "shingle")).distinct()
        # a window all of whose shingles occur, with the rarest of them
        chosen = each.join(counts, "shingle", "left").groupBy("words", "width").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "shingle")).alias("rarest")).where("rarest.n > 0")
        chosen = stored(chosen.select("words", "width", "rarest.n", "rarest.offset", "rarest.shingle"))
        place = F.shiftrightunsigned("shingle", 64 - SALT_BITS).cast("int")
        dealt = chosen.groupBy(place.alias("place")).agg((1 + F.max("n") / HOT).cast("int").alias("salts"))
        for row in dealt.collect():  # 2**SALT_BITS rows at most
            salts[row["place"]] = row["salts"]
        if not chosen.isEmpty():
            prefix = Known(chosen.select("shingle", "width").distinct())
    found = stored(_places(rows, prefix, salts, window))
    documents = found.where("shingle IS NULL").select("row", "doc_id", "n_words")
    if prefix is None:
        empty = documents.select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_hit"), F.lit(0).cast("bigint").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))
        return empty.withColumn("spans", F.array().cast("array<struct<begin:bigint,end:bigint>>")) if spans else empty
    ways = chosen.join(dealt, place == dealt["place"]).select("words", "shingle", "offset", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    met = found.where("shingle IS NOT NULL").select("row", "n_words", "shingle", "salt", "at", "first", "context").join(ways, ["shingle", "salt"])
    begin, size = F.col("at") - F.col("offset"), F.size("words")
    inside = (begin >= 0) & (begin + size <= F.col("n_words"))  # positional and length bound
    same = F.slice("context", (begin - F.col("first") + 1).cast("int"), size) == F.col("words")
    # a place outside the document is never looked at in the context
    hits = stored(met.where(F.when(inside, same).otherwise(False)).select("row", begin.alias("begin"), (begin + size).alias("end"), "words"))
    by = Window.partitionBy("row").orderBy("begin", "end")
    reached = F.coalesce(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = hits.select("row", "begin", "end").distinct().withColumn("reached", reached).where("end > reached")
    words_hit = covered.groupBy("row").agg(F.sum(F.col("end") - F.greatest("begin", "reached")).alias("n_hit"), *([F.sort_array(F.collect_list(F.struct(F.greatest("begin", "reached").alias("begin"), "end"))).alias("spans")] if spans else []))
    named = windows.where("item_id IS NOT NULL").select("words", "item_id")
    of_items = hits.select("row", "words").distinct().join(named, "words").select("row", "item_id").distinct()
    items_hit = of_items.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.col("item_id").cast("string"))), ","), 256).alias("items_sha256"))
    out = documents.join(words_hit, "row", "left").join(items_hit, "row", "left")
    more = [F.coalesce("spans", F.array()).alias("spans")] if spans else []
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"), *more)


#: The same in DuckDB SQL: all sequences of words of the sizes that windows have, joined with the windows.
ORACLE = rf"""
WITH item_words AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS gram
    FROM item_words, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i) WHERE len(w) > 0
), docs AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), grams AS (
    SELECT row, size, i, array_to_string(w[i : i + size - 1], ' ') AS gram
    FROM docs, (SELECT DISTINCT size FROM windows), LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i)
), hits AS (SELECT g.row, g.i, g.size, n.item_id FROM grams g JOIN windows n USING (size, gram)
), covered AS (SELECT row, count(*) AS n_hit FROM (SELECT DISTINCT row, unnest(range(i, i + size)) AS hit_word FROM hits) GROUP BY row
), named AS (
    SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (row) LEFT JOIN named USING (row)
"""

"""Exact deduplication by skew-safe combining.

Texts are equal when they are identical after deleting every white-space character of
``[\\x20\\x09-\\x0D]``.  Of equal texts, the row with the most code points in the original text, then
the smallest id, stays.

Three stages combine equal texts, and each compares full content, as the whole normalised text is
part of the grouping key:

1. locally: every task combines the equal texts that it reads, before anything is shuffled
   (the partial aggregation below the first exchange);
2. salted: the local winners of one digest meet in one of SALTS groups, by the salt of their row;
3. globally: the at most SALTS salt winners of one text meet.

So of any group, however large, a task receives at most one row per upstream task in stage 2 and
SALTS rows in stage 3.  The winner is the largest of one sortable number, so the aggregation
holds a fixed-size value for each text and never a list of members.  At the end rows find
their winner by the digest (with a second digest and a length, as texts of equal SHA-256 but
different content would still be told apart); that join carries no text, and Spark's adaptive
execution splits a hot digest on the row side.

Results for unusual rows: a null text counts as empty; a null id is the last choice among equal
texts, and ``keep_id`` is null only if every row of the group has a null id; rows that repeat both id and
text are members like any other (all of them show ``kept`` if theirs is the kept id); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oxidara.llm.rows import own_columns

#: Groups that the winners of one digest are spread over before the last stage.
SALTS = 16
#: The white space that does not count.
BLANK = r"[\x20\x09-\x0D]+"

_SPAN = "20000000000000000000"  # more than the 2**64 values of an id
_TOP = "9223372036854775808"  # one more than the largest id


def _decimal(number: str) -> Column:
    return F.lit(number).cast("decimal(20,0)")


def _preference(n_chars: Column, doc_id: Column) -> Column:
    """A number that is larger for the row that should stay."""
    by_id = F.coalesce(_decimal(_TOP) - doc_id.cast("decimal(20,0)"), _decimal("0"))
    return (n_chars.cast("decimal(10,0)") * _decimal(_SPAN) + by_id).cast("decimal(38,0)")


def _preferred_id(preference: Column) -> Column:
    rest = (preference % _decimal(_SPAN)).cast("decimal(20,0)")
    return F.when(rest > 0, (_decimal(_TOP) - rest).cast("bigint"))


_DIGESTS = ("sha", "second", "norm_chars")


def _digests() -> list[Column]:
    return [F.unhex(F.sha2(F.col("norm"), 256)).alias("sha"), F.xxhash64("norm").alias("second"), F.length("norm").alias("norm_chars")]


def _rows(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of names with the normalised text (norm) and the code points of the original (n_chars) for text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    others = [F.col("doc_id").cast("bigint").alias("doc_id"), *[c for c in names if c not in ("doc_id", "text")]]
    return own_columns(docs, names).select(*others, F.length(text).alias("n_chars"), F.regexp_replace(text, BLANK, "").alias("norm"))


def _winners(rows: DataFrame, salts: int) -> DataFrame:
    """Per text its digests, group_size and the largest preference of its rows (best)."""
    return (
        rows.select(
            "norm",
            F.pmod(F.xxhash64("doc_id", "n_chars"), F.lit(salts)).cast("int").alias("salt"),
            _preference(F.col("n_chars"), F.col("doc_id")).alias("best"),
        )
        .groupBy("norm", "salt")
        .agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("n"))
        .groupBy("norm")
        .agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
        .select(*_digests(), "group_size", "best")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _rows(docs, {"doc_id": id_col, "text": text_col})
    winners = _winners(rows, salts).select(*_DIGESTS, "group_size", _preferred_id(F.col("best")).alias("keep_id"))
    members = rows.select("doc_id", *_digests())
    return members.join(winners, list(_DIGESTS)).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def survivors(docs: DataFrame, key_col: str, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per group of equal texts: the key of the row that stays (key_col), of rows with equal preference the smallest key."""
    rows = _rows(docs, {"doc_id": id_col, "text": text_col, "key": key_col})
    first = rows.select("key", *_digests(), _preference(F.col("n_chars"), F.col("doc_id")).alias("best")).groupBy(*_DIGESTS, "best").agg(F.min("key").alias("key"))
    return first.join(_winners(rows, salts), [*_DIGESTS, "best"]).select(F.col("key").alias(key_col))


ORACLE = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

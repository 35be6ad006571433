"""Comparison of two text reports: the same structure, whole numbers equal, other numbers close.

Lines are numbered without one task: a file's splits are numbered on their own, a row for each split says how many lines come before it.  Every line becomes its skeleton
(numbers replaced) and its numbers; the two reports are joined on the line's number by a full outer join, so what only one of them has is found as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What counts as a number, how a section begins, and the section (run identity) that differs between runs by design.
NUMBER = r"-?(?:\d[\d,]*\.\d+(?:[eE][+-]?\d+)?|\d[\d,]*|\.\d+)"
SECTION, IDENTITY = "== ", "== 0."
PLACEHOLDER = "<n>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1), text: the comparable lines of a text file or a folder of them, in order; the run identity is left out.

    A split belongs to one task and its rows come in order; splits are ordered by file and offset."""
    split = ["_file", "_from"]
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", "\r$", "").alias("text"))
    # the last section that begins at or before a line, in its split
    upto = Window.partitionBy(*split).orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = F.when(F.col("text").startswith(SECTION), F.col("text").startswith(IDENTITY))
    rows = rows.withColumn("_identity", F.last(begins, ignorenulls=True).over(upto))
    # a row for each split: the section that is open at its end, and by that the one open at the beginning of the next
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*split).agg(F.max_by("_identity", "_id").alias("_end"))
    carried = ends.select(*split, F.coalesce(F.last("_end", ignorenulls=True).over(before), F.lit(False)).alias("_open"))
    kept = rows.join(carried, split).where(~F.coalesce("_identity", "_open"))
    counts = kept.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(*split, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*split).orderBy("_id"))
    return kept.withColumn("_place", place).join(starts, split).select((F.col("_start") + F.col("_place")).alias("line"), "text")


def skeleton(text: Column) -> Column:
    return F.regexp_replace(text, NUMBER, PLACEHOLDER)


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), lambda x: F.replace(x, F.lit(",")))


def agree(x: Column, y: Column, rtol: float) -> Column:
    """If two numbers without commas agree: the same text, or equal whole numbers of any length, or values within 1e-9 + rtol of the larger one."""
    whole = ~x.rlike("[.eE]") & ~y.rlike("[.eE]")
    plain = lambda v: F.regexp_replace(F.regexp_replace(v, r"^(-?)0+(?=\d)", "$1"), "^-0$", "0")
    a, b = x.cast("double"), y.cast("double")
    near = F.abs(a - b) <= 1e-9 + rtol * F.greatest(F.abs(a), F.abs(b))
    return (x == y) | F.when(whole, plain(x) == plain(y)).otherwise(near)


def compare(before: DataFrame, after: DataFrame, rtol: float = 1e-6) -> DataFrame:
    """line, kind, before, after of the lines that do not agree: only in one report (added, missing), of another structure (structure), with other numbers (numbers).

    before, after: line and text, as ``numbered_lines`` gives them."""
    one = before.select("line", F.col("text").alias("before"))
    two = after.select("line", F.col("text").alias("after"))
    both = one.join(two, "line", "full")
    pairs = F.zip_with(numbers(F.col("before")), numbers(F.col("after")), lambda x, y: F.coalesce(agree(x, y, rtol), F.lit(False)))
    kind = (
        F.when(F.col("before").isNull(), "added")
        .when(F.col("after").isNull(), "missing")
        .when(skeleton(F.col("before")) != skeleton(F.col("after")), "structure")
        .when(F.exists(pairs, lambda same: ~same), "numbers")
    )
    return both.select("line", kind.alias("kind"), "before", "after").where("kind IS NOT NULL")


def files(spark: SparkSession, before: str, after: str, rtol: float = 1e-6) -> DataFrame:
    return compare(numbered_lines(spark, before), numbered_lines(spark, after), rtol)

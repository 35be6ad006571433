"""Validation of inspection records: every row collects all reason codes that apply, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The columns of a record; the reason codes below and their bounds are fixed values as well.
REQUIRED = ("tail", "component", "serial", "month", "usage_hours", "reading")
NUMERIC = ("serial", "month", "usage_hours", "reading")
#: A fraction in these is no number of a part or of a month: TYPE, never cut off.
WHOLE = ("serial", "month")
MOST_HOURS = 24 * 31
REASONS = ("TYPE", "UNKNOWN_TAIL", "UNKNOWN_COMP", "MONTH_RANGE", "USAGE_NEGATIVE", "USAGE_NONFINITE", "USAGE_FENCE", "DUPLICATE", "READING_NEGATIVE", "READING_FENCE", "POINT_OUTLIER")
_NUMBER = r"^[+-]?((\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?|inf|infinity)$"


class Refused(RuntimeError):
    """The source as a whole is not trustworthy."""


def number(column: str) -> Column:
    """A text or numeric column as double; null where it is no number, NaN included."""
    value = F.expr(f"CASE WHEN lower(trim(CAST(`{column}` AS STRING))) RLIKE '{_NUMBER}' THEN try_cast(trim(CAST(`{column}` AS STRING)) AS DOUBLE) END")
    return F.when(~F.isnan(value), value)


def _when(condition: Column, code: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(code))


#: A key is frequent if it is one of the MOST_FREQUENT commonest keys and has at least LEAST_FREQUENT rows: any other key has fewer than a MOST_FREQUENT-th of all rows.
LEAST_FREQUENT, MOST_FREQUENT = 1000, 50_000
KEYS = ("tail", "component", "serial", "month")


def frequent_keys(rows: DataFrame, order: Column) -> DataFrame:
    """The frequent keys, at most MOST_FREQUENT of them, each with the smallest order of its rows (_first).

    Tasks combine their rows of a key before anything is shuffled, so a key that half of all rows have is a row for each task."""
    found = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_times"), F.min(order).alias("_first"))
    return found.where(F.col("_times") >= LEAST_FREQUENT).orderBy(F.desc("_times")).limit(MOST_FREQUENT).drop("_times")


def screen(rows: DataFrame, roster: DataFrame, components: list[str], n_months: int, order: list[str], neg_fence: float = 1.0, upper_fence: float = 30.0, jump: float = 5.0) -> DataFrame:
    """The rows with numeric columns coerced and an array column ``reasons``; clean rows have none.

    order: columns that give the file's order and tell rows apart, by which the first of duplicates is kept; missing keys are equal keys.

    One shuffle by (tail, component, serial) serves both windows.  Dirty feeds put many rows on one key, so two kinds of rows are dealt over all tasks instead.  Rows whose key
    alone condemns them (unknown or missing parts of it) go by their whole key, as they meet no neighbours.  Of the frequent keys, the first row is known from an
    aggregation and stays with its neighbours; the others are duplicates wherever they are, and go by their order.  The table of frequent keys is broadcast: MOST_FREQUENT rows at most."""
    missing = [c for c in REQUIRED if c not in rows.columns]
    if missing:
        raise Refused(f"SCHEMA_COLUMNS: the source lacks {', '.join(missing)}")
    for c in NUMERIC:
        rows = rows.withColumn(c, number(c))
    for c in WHOLE:
        rows = rows.withColumn(c, F.when((F.col(c) == F.floor(c)) & (F.abs(c) < 2.0**53), F.col(c)))
    place = F.struct(*order)
    hot = frequent_keys(rows, place).select(*[F.col(c).alias(f"_{c}_2") for c in KEYS], "_first", F.lit(True).alias("_hot"))
    same = [rows[c].eqNullSafe(hot[f"_{c}_2"]) for c in KEYS]
    rows = rows.join(F.broadcast(hot), same[0] & same[1] & same[2] & same[3], "left").drop(*[f"_{c}_2" for c in KEYS])
    known = roster.select(F.col("tail").alias("_tail")).distinct()
    rows = rows.join(known, rows["tail"] == known["_tail"], "left")
    usage, month, reading = F.col("usage_hours"), F.col("month"), F.col("reading")
    foreign, unknown = F.col("_tail").isNull(), ~F.coalesce(F.col("component").isin(components), F.lit(False))
    beyond = F.coalesce((month < 0) | (month >= n_months), F.lit(False))
    condemned = foreign | unknown | F.col("serial").isNull() | month.isNull() | beyond
    later = F.coalesce(F.col("_hot") & (place > F.col("_first")), F.lit(False))
    rows = rows.withColumn("_later", later).withColumn("_spread", F.when(F.col("_later"), F.xxhash64(*order)).when(condemned, F.xxhash64(*KEYS)))
    rows = rows.repartition("tail", "component", "serial", "_spread")
    copy = F.row_number().over(Window.partitionBy("tail", "component", "serial", "_spread", "month").orderBy(*order))
    reasons = [
        *[_when(F.col(c).isNull(), "TYPE") for c in NUMERIC],
        _when(foreign, "UNKNOWN_TAIL"),
        _when(unknown, "UNKNOWN_COMP"),
        _when(beyond, "MONTH_RANGE"),
        _when(usage < 0, "USAGE_NEGATIVE"),
        _when(usage.isNull() | (F.abs(usage) == float("inf")), "USAGE_NONFINITE"),
        _when(usage > MOST_HOURS, "USAGE_FENCE"),
        _when(F.col("_later") | (F.col("_copy") > 1), "DUPLICATE"),
        _when(reading < -neg_fence, "READING_NEGATIVE"),
        _when(reading > upper_fence, "READING_FENCE"),
    ]
    rows = rows.withColumn("_copy", copy).withColumn("reasons", F.array_compact(F.array(*reasons))).withColumn("_fine", F.size("reasons") == 0)
    beside = Window.partitionBy("tail", "component", "serial", "_spread", "_fine").orderBy("month")
    before, after = F.lag("reading").over(beside), F.lead("reading").over(beside)
    point = (F.abs(reading - before) > jump) & (F.abs(reading - after) > jump) & (F.abs(after - before) < jump / 2)
    rows = rows.withColumn("_point", F.col("_fine") & F.coalesce(point, F.lit(False)))
    rows = rows.withColumn("reasons", F.when(F.col("_point"), F.array(F.lit("POINT_OUTLIER"))).otherwise(F.col("reasons")))
    return rows.drop("_fine", "_point", "_copy", "_tail", "_first", "_hot", "_later", "_spread")


def clean(screened: DataFrame) -> DataFrame:
    rows = screened.where(F.size("reasons") == 0).drop("reasons")
    return rows.withColumn("serial", F.col("serial").cast("bigint")).withColumn("month", F.col("month").cast("int"))


def quarantine(screened: DataFrame) -> DataFrame:
    return screened.where(F.size("reasons") > 0).withColumn("reason", F.array_join("reasons", ";")).drop("reasons")


def reason_counts(screened: DataFrame) -> DataFrame:
    return screened.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))


def screen_metrics() -> list[Column]:
    """Aggregates of a screened table: rows in, clean, quarantined, and how often each reason was given."""
    n = F.size("reasons")
    counts = [F.count(F.lit(1)).alias("rows_in"), F.count_if(n == 0).alias("rows_clean"), F.count_if(n > 0).alias("rows_quarantined")]
    return counts + [F.expr(f"coalesce(sum(size(filter(reasons, x -> x = '{code}'))), 0)").alias(code) for code in REASONS]


def summary(seen: dict) -> dict:
    """The counts of ``screen_metrics`` with the share set aside; reasons that were given, by code."""
    rows = {k: seen[k] for k in ("rows_in", "rows_clean", "rows_quarantined")}
    return rows | {"quarantine_frac": round(rows["rows_quarantined"] / max(rows["rows_in"], 1), 5), "reason_counts": {code: seen[code] for code in REASONS if seen[code]}}


def reconcile(screened: DataFrame) -> DataFrame:
    """One row: rows_in, rows_clean, rows_quarantined, quarantine_frac."""
    return screened.agg(*screen_metrics()[:3]).withColumn("quarantine_frac", F.round(F.col("rows_quarantined") / F.greatest(F.col("rows_in"), F.lit(1)), 5))


def stop_quarantined(row: dict, most: float = 0.05) -> None:
    """Stop if too large a share is quarantined."""
    if row["rows_quarantined"] > most * max(row["rows_in"], 1):
        raise Refused(f"{row['rows_quarantined']} of {row['rows_in']} records were set aside; at most a share of {most} may be")


def refuse(summary: DataFrame, most: float = 0.05) -> None:
    stop_quarantined(summary.first().asDict(), most)

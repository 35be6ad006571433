"""Exact ranks and quantiles of groups of any size.

Equal values are counted before anything is shuffled, the counts are range-partitioned by group and value, and a row for each
partition and group says how many values lie before it.  No task sees a group as a whole."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oxidara.sources.store import settle


def placed(frame: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, times, upto (values that are not larger), n (of the group), of the values that are not null."""
    counted = frame.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("times"))
    # kept, as the same rows must lie in the same partitions when they are counted and when they are numbered
    parts = settle(counted.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy(*by, "_part").agg(F.sum("times").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = sums.select(*by, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"), F.sum("_sum").over(Window.partitionBy(*by)).alias("n"))
    inside = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return parts.withColumn("_upto", F.sum("times").over(inside)).join(starts, [*by, "_part"]).select(*by, value, "times", (F.col("_upto") + F.col("_start")).alias("upto"), "n")


#: Counts of a round of ``order_statistics``, and distinct values that come to the driver at its end.
BUCKETS, FEW_VALUES = 1024, 4096


def _magnitude(x: Column) -> Column:
    """Grows with x like its logarithm to either side of zero."""
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.ln(F.abs(x)) + F.lit(_LIFT)))


#: Makes the logarithm of every positive double positive.
_LIFT, _LARGEST = 746.0, sys.float_info.max


def _buckets(low: float, high: float) -> Column:
    """Which of BUCKETS equal parts of low..high a value x lies in: parts of its magnitude, or of itself where both ends are alike in size."""
    low, high = max(low, -_LARGEST), min(high, _LARGEST)
    x = F.least(F.greatest(F.col("x"), F.lit(low)), F.lit(high))
    alike = low > 0 and high < 8 * low or high < 0 and low > 8 * high
    ends = [low, high] if alike else [math.copysign(math.log(abs(e)) + _LIFT, e) if e else 0.0 for e in (low, high)]
    width = (ends[1] / BUCKETS - ends[0] / BUCKETS) or math.ulp(0.0)
    return F.least(F.greatest(F.floor((x if alike else _magnitude(x)) / width - ends[0] / width), F.lit(0)), F.lit(BUCKETS - 1))


def order_statistics(frame: DataFrame, value: str, ranks: Callable[[int], list[int]]) -> list[float]:
    """The values of some ranks (from 1) of a whole table, exactly, where ``ranks`` gives them for the number of values; nulls and NaN are no values.

    A range that holds a rank is divided into BUCKETS parts, rows are counted by part, and the part that holds the rank is the next range, until it holds
    one value or FEW_VALUES rows: a few rounds for any doubles.  No task sees more of the table than its own rows; a round brings BUCKETS counts to the driver."""
    x = frame.select(F.col(value).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    total = x.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    if not total["n"]:
        return []
    found: dict[int, float] = {}
    for rank in sorted(set(ranks(total["n"]))):
        low, high, n, before = total["low"], total["high"], total["n"], 0  # values in low..high, and how many lie below low
        while low < high and n > FEW_VALUES:
            inside = x.where(F.col("x").between(low, high))
            counts = inside.groupBy(_buckets(low, high).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("low").collect()
            if len(counts) == 1:  # rounding has put all into one part: what is left are neighbouring values
                break
            for row in counts:
                if before + row["n"] >= rank:
                    low, high, n = row["low"], row["high"], row["n"]
                    break
                before += row["n"]
        if low < high:
            for row in x.where(F.col("x").between(low, high)).groupBy("x").count().orderBy("x").collect():
                low = row["x"]
                before += row["count"]
                if before >= rank:
                    break
        found[rank] = low
    return [found[rank] for rank in ranks(total["n"])]


def whole_median(frame: DataFrame, value: str) -> float | None:
    """The median of a whole table, without a task that gets all of it; null without values."""
    middle = order_statistics(frame, value, lambda n: [(n + 1) // 2, n // 2 + 1])
    return None if not middle else middle[0] + (middle[1] - middle[0]) / 2


def _at(rank: Column, value: str) -> Column:
    """The value of that rank (from 1) of rows from ``placed``."""
    return F.max(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("times") < rank), F.col(value)))


def nearest_rank(frame: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Means and nearest-rank quantiles (one of the values, never interpolated)."""
    rows = placed(frame, by, value)
    ranks = {k: F.greatest(F.lit(1), F.least(F.col("n"), F.round(F.lit(p) * F.col("n")).cast("bigint"))) for k, p in probs.items()}
    mean = (F.sum(F.col(value) * F.col("times")) / F.sum("times")).alias("mean")
    return rows.groupBy(*by).agg(mean, *[_at(r, value).alias(k) for k, r in ranks.items()])


def interpolated(frame: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """by, value (the p-quantile by linear interpolation between the two values around it), n."""
    rows = placed(frame, by, value).withColumn("_at", F.lit(p) * (F.col("n") - 1))
    low = F.floor("_at") + 1
    found = rows.groupBy(*by).agg(F.first("n").alias("n"), (F.first("_at") - F.floor(F.first("_at"))).alias("_share"), _at(low, value).alias("_low"), _at(F.least(low + 1, F.col("n")), value).alias("_high"))
    return found.select(*by, (F.col("_low") + F.col("_share") * (F.col("_high") - F.col("_low"))).alias(value), "n")

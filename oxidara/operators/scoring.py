"""Scores of forecasts and flags against what is known to have happened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def brier(frame: DataFrame, p: str, y: str, by: list[str]) -> DataFrame:
    """Per group: n, mean squared error of the probability, and that of the group's own share (its variance)."""
    outcome = F.col(y).cast("double")
    return frame.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col(p) - outcome, F.lit(2))).alias("brier"), F.var_pop(outcome).alias("base"))


def confusion(frame: DataFrame, true: str, predicted: str) -> DataFrame:
    """Counts of each pair of true and predicted class."""
    return frame.groupBy(F.col(true).alias("true_class"), F.col(predicted).alias("predicted_class")).agg(F.count(F.lit(1)).alias("n"))


def conditional_coverage(frame: DataFrame, cdf_at_horizon: str) -> DataFrame:
    """What share of failures within the horizon a 90 % interval should cover, as only failures are seen."""
    f = F.col(cdf_at_horizon)
    share = F.when(f <= 0.05, 0.0).when(f >= 0.95, 0.9 / f).otherwise((f - 0.05) / f)
    found = frame.agg(F.count(F.lit(1)).alias("n"), F.avg(share).alias("benchmark"))
    return found.withColumn("se", F.sqrt(F.col("benchmark") * (1 - F.col("benchmark")) / F.greatest("n", F.lit(1))))


def matched_recall(found: DataFrame, planted: DataFrame, keys: list[str]) -> DataFrame:
    """Planted keys and how many of them were found."""
    keys_found = found.select(*keys).distinct().withColumn("_hit", F.lit(1))
    return planted.select(*keys).distinct().join(keys_found, keys, "left").agg(F.count(F.lit(1)).alias("planted"), F.count("_hit").alias("found"))


def coverage(frame: DataFrame, value: str, low: str, high: str, by: list[str]) -> DataFrame:
    """Share of values inside their interval."""
    inside = (F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high))
    return frame.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(inside.cast("int")).alias("share"))

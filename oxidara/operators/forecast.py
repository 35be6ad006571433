"""Thresholds, current damage, remaining life and fleet availability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oxidara.functions.special import FORECAST_INPUTS, forecast_udf, life_udf, months_udf
from oxidara.operators.ranks import interpolated, whole_median
from oxidara.sources.store import settle

STALE_MONTHS, LEAST_FAILURES = 3, 20


def thresholds(rows: DataFrame, failures: DataFrame, comps: DataFrame) -> DataFrame:
    """comp, threshold: the 0.97 quantile of the largest readings of failed parts, less sensor noise; null if fewer than 20."""
    most = rows.join(failures.select("serial").distinct(), "serial", "left_semi").groupBy("comp", "serial").agg(F.max("reading").alias("most"))
    q = interpolated(most, ["comp"], "most", 0.97).withColumnRenamed("most", "q")
    return comps.join(q, "comp", "left").select("comp", F.when(F.col("n") >= LEAST_FAILURES, F.col("q") - 1.88 * F.col("sigma")).alias("threshold"))


def usage_by_tail(rows: DataFrame) -> DataFrame:
    """tail, usage, log_sd: mean monthly usage and standard deviation of its logarithm; null for a single row."""
    return rows.groupBy("tail").agg(F.avg("usage_hours").alias("usage"), F.stddev_samp(F.when(F.col("usage_hours") > 0, F.log("usage_hours"))).alias("log_sd"))


def dense_usage(rows: DataFrame) -> DataFrame:
    """usage_by_tail for every tail from 1 to the largest; gaps get the fleet's mean and median."""
    own = settle(usage_by_tail(rows))
    fleet = own.agg(F.avg("usage").alias("usage"), F.max("tail").alias("top")).first()
    median = whole_median(own, "log_sd") or 0.0
    spine = rows.sparkSession.range(1, int(fleet["top"] or 0) + 1).select(F.col("id").cast("int").alias("tail"))
    usage, log_sd = F.coalesce("usage", F.lit(fleet["usage"]).cast("double")), F.coalesce("log_sd", F.lit(median))
    return spine.join(own, "tail", "left").select("tail", usage.alias("usage"), log_sd.alias("log_sd"))


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each channel."""
    return rows.groupBy("chan").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "chan"]), F.struct("month", "serial")).alias("r")).select("chan", "r.*")


def last_row() -> dict[str, Column]:
    """Aggregates of a channel's rows in faults.isolate: its latest row, and when the part of that row was first seen."""
    last = {c: F.max(F.when(F.expr("rn = n_rows"), F.col(c))) for c in ("tail", "comp", "serial", "month", "reading")}
    return last | {"installed": F.min(F.when(F.col("serial").eqNullSafe(F.col("last_serial")), F.col("month")))}


def damage_state(rows: DataFrame, posterior: DataFrame, flags: DataFrame, params: DataFrame, usage: DataFrame, n_months: int) -> DataFrame:
    """``state_of`` of the channels' latest rows."""
    installed = rows.groupBy("chan", "serial").agg(F.min("month").alias("installed"))
    now = latest(rows).select("chan", "tail", "comp", "serial", "month", "reading").join(installed, ["chan", "serial"])
    return state_of(now, posterior, flags, params, usage, n_months)


def state_of(now: DataFrame, posterior: DataFrame, flags: DataFrame, params: DataFrame, usage: DataFrame, n_months: int) -> DataFrame:
    """Per channel the forecast's inputs: x0 and how it was got (basis), la_mu, la_var, beta, threshold, usage.

    now: chan, tail, comp, serial, month, reading, installed.
    params: comp, beta, mu, tau, threshold (a row per component; components without them get no forecast)."""
    now = now.join(F.broadcast(params.where("beta IS NOT NULL AND threshold IS NOT NULL")), "comp").join(usage, "tail")
    now = now.join(posterior.select("chan", "la_mu", "la_var", "shrink", "n_incr"), "chan", "left").join(flags.select("chan", F.col("class").alias("fault")), "chan", "left")
    now = now.withColumn("la_mu", F.coalesce("la_mu", "mu")).withColumn("la_var", F.coalesce("la_var", F.col("tau") * F.col("tau")))
    now = now.withColumn("shrink", F.coalesce("shrink", F.lit(1.0))).withColumn("n_incr", F.coalesce("n_incr", F.lit(0))).withColumn("fault", F.coalesce("fault", F.lit(0)))
    step = F.exp(F.col("la_mu") + F.col("la_var") / 2) * F.col("beta") * F.col("usage")
    age = n_months - 1 - F.col("month")
    model, stale = F.col("fault").isin(1, 2, 3), age > STALE_MONTHS
    x0 = F.when(model, step * (n_months - F.col("installed"))).when(stale, F.col("reading") + step * age).otherwise(F.col("reading"))
    basis = F.when(model, "usage_model").when(stale, "stale_reading_projected").otherwise("reading")
    now = now.withColumn("basis", basis).withColumn("x0", F.least(F.greatest(x0, F.lit(0.0)), 0.995 * F.col("threshold")))
    return now.select("chan", "tail", "comp", "serial", "basis", "x0", "la_mu", "la_var", "shrink", "n_incr", "beta", "threshold", "usage", "fault", "installed", age.alias("age"))


def _dealt(state: DataFrame) -> DataFrame:
    """The special functions cost far more than a shuffle of a row per channel: channels are dealt evenly over all cores.  The hash keeps the shuffle:
    one by chan itself would be left out where rows lie by chan already, if only in the few partitions that their bytes are worth."""
    return state.repartition(state.sparkSession.sparkContext.defaultParallelism, F.xxhash64("chan"))


def forecast(state: DataFrame, horizon: int) -> DataFrame:
    """state with p05, p50, p95 (infinite beyond four horizons), pfail and the monthly cdf."""
    return _dealt(state).withColumn("f", forecast_udf(horizon)(*FORECAST_INPUTS)).select(*state.columns, "f.*")


def remaining_life(state: DataFrame, horizon: int) -> DataFrame:
    """``forecast`` without the monthly cdf, which costs as much as the quantiles."""
    return _dealt(state).withColumn("f", life_udf(horizon)(*FORECAST_INPUTS)).select(*state.columns, "f.*")


def failure_by(state: DataFrame, months: list[int]) -> DataFrame:
    """state with cdf, the probabilities of ``forecast`` for these months alone: no quantile is sought."""
    return _dealt(state).withColumn("cdf", months_udf(months)(*FORECAST_INPUTS))


def expected_by_month(forecasts: DataFrame) -> DataFrame:
    """month, expected, variance of first failures."""
    steps = F.expr("zip_with(cdf, slice(concat(array(0D), cdf), 1, size(cdf)), (a, b) -> a - b)")
    each = forecasts.select(F.posexplode(steps).alias("month", "p"))
    return each.groupBy((F.col("month") + 1).alias("month")).agg(F.sum("p").alias("expected"), F.sum(F.col("p") * (1 - F.col("p"))).alias("variance"))


#: Units whose lives are simulated side by side.
UNITS_A_STEP = 64


def unit_lives(pdf: pd.DataFrame, horizon: int, replicates: int, seed: int, repair: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """down and failed (unit x replicate x month).  Each unit's draws depend on (seed, chan) only."""
    mu, sigma, p_spare, backorder = repair
    columns = [pdf[c].to_numpy(dtype=np.float64) for c in ("x0", "la_mu", "la_var", "beta", "threshold", "usage", "log_sd")]
    fine = np.isfinite(np.stack(columns)).all(axis=0) & (columns[6] >= 0) & (columns[6] <= 2) & (columns[2] >= 0)
    if not fine.all():
        raise ValueError(f"channel {pdf['chan'].iloc[int(np.flatnonzero(~fine)[0])]}: inputs out of range")
    x0, la_mu, la_var, beta, threshold, usage, log_sd = columns
    size = (len(pdf), replicates, horizon)
    grown, wait = np.empty(size), np.empty(size)
    for i, chan in enumerate(pdf["chan"].tolist()):
        r = np.random.default_rng([seed, int(chan)])
        alpha = np.exp(la_mu[i] + np.sqrt(la_var[i]) * r.standard_normal(replicates))
        shape = alpha[:, None] * usage[i] * np.exp(log_sd[i] * r.standard_normal(size[1:]))
        if not (np.isfinite(shape) & (shape > 0)).all():  # such a unit would never fail
            raise ValueError(f"channel {chan}: the shape of its wear is not a positive number")
        grown[i] = beta[i] * r.gamma(shape)
        wait[i] = r.lognormal(mu, sigma, size[1:]) + backorder * (r.random(size[1:]) > p_spare)
    months = np.ceil(wait).astype(np.int64)
    x, until = np.broadcast_to(x0[:, None], size[:2]).copy(), np.zeros(size[:2], dtype=np.int64)
    down, failed = np.empty(size, dtype=bool), np.empty(size, dtype=bool)
    for m in range(1, horizon + 1):
        works = until < m
        x += np.where(works, grown[:, :, m - 1], 0.0)
        hit = works & (x >= threshold[:, None])
        until = np.where(hit, m + months[:, :, m - 1], until)
        x[hit] = 0.0
        down[:, :, m - 1], failed[:, :, m - 1] = until >= m, hit
    return down, failed


def lives(units: DataFrame, horizon: int, replicates: int, seed: int, repair: tuple[float, float, float, float]) -> DataFrame:
    """rep, month, comp, n: failures of each component (comp from 1), and aircraft that are down (comp 0).

    units: chan, tail, comp, x0, la_mu, la_var, beta, threshold, usage, log_sd.  The units of an aircraft, a row for each component, meet in one task,
    which adds up what it simulates: (components + 1) x replicates x months rows leave it, whatever the number of its units."""

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        last_tail, last_down = None, None  # an aircraft's units may go on in the next batch

        def count(comp: int, what: np.ndarray) -> None:
            total[comp] = total.get(comp, 0) + what.astype(np.int64)

        for pdf in batches:
            for at in range(0, len(pdf), UNITS_A_STEP):
                part = pdf.iloc[at : at + UNITS_A_STEP]
                down, failed = unit_lives(part, horizon, replicates, seed, repair)
                comp, tail = part["comp"].to_numpy(), part["tail"].to_numpy()
                for k in np.unique(comp).tolist():
                    count(int(k), failed[comp == k].sum(axis=0))
                begins = np.flatnonzero(np.append(True, tail[1:] != tail[:-1]))
                by_tail = np.logical_or.reduceat(down, begins, axis=0)
                if last_down is not None:
                    if tail[0] == last_tail:
                        by_tail[0] |= last_down
                    else:
                        count(0, last_down)
                count(0, by_tail[:-1].sum(axis=0))
                last_tail, last_down = tail[-1], by_tail[-1]
        if last_down is not None:
            count(0, last_down)
        rep, month = (x.ravel() for x in np.indices((replicates, horizon)))
        for comp, n in total.items():
            yield pd.DataFrame({"rep": rep.astype(np.int32), "month": (month + 1).astype(np.int32), "comp": np.int32(comp), "n": n.ravel()})

    columns = units.select("chan", "tail", "comp", "x0", "la_mu", "la_var", "beta", "threshold", "usage", "log_sd")
    dealt = columns.repartition(units.sparkSession.sparkContext.defaultParallelism, F.xxhash64("tail")).sortWithinPartitions("tail", "chan")
    return dealt.mapInPandas(simulate, "rep int, month int, comp int, n bigint").groupBy("rep", "month", "comp").agg(F.sum("n").alias("n"))


def availability(lived: DataFrame, n_tails: int) -> DataFrame:
    """rep, month, available (share of n_tails aircraft), failures of all components.  lived: from ``lives``."""
    rows = lived.groupBy("rep", "month").agg(F.sum(F.when(F.col("comp") == 0, F.col("n")).otherwise(0)).alias("down"), F.sum(F.when(F.col("comp") > 0, F.col("n")).otherwise(0)).alias("failures"))
    return rows.select("rep", "month", (1 - F.col("down") / F.lit(n_tails)).alias("available"), "failures")


def replicate_quantiles(runs: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Means and nearest-rank quantiles over the replicates, of which a group has one row each."""
    found = runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.sort_array(F.collect_list(value)).alias("_v"))
    at = {k: F.greatest(F.lit(1), F.least(F.size("_v"), F.round(F.lit(p) * F.size("_v")).cast("int"))) for k, p in probs.items()}
    return found.select(*by, "mean", *[F.element_at("_v", x).alias(k) for k, x in at.items()])


def calibration(frame: DataFrame, p: str, y: str) -> DataFrame:
    """Ten bins, closed on the right, the lowest end included: n, mean prediction, observed share."""
    edges = F.greatest(F.lit(1), F.ceil(F.round(F.col(p) * 10, 9))).cast("int")
    return frame.groupBy(edges.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("observed"))

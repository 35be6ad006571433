"""Residuals and isolation of sensor faults over whole channel histories."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oxidara.functions.special import gammaincc, ln_gamma

NONE, BIAS, SCALE, STUCK, DROPOUT, ACCELERATED = range(6)
EXCLUDED = (BIAS, SCALE, STUCK)
SPIKE_P, PERSIST_P, WATCH_P = 2e-5, 1e-3, 1e-2


def _matched() -> tuple[Column, Column]:
    """Shape of the gamma law that an increment is held against (matched by mean and variance), and the increment in its scale."""
    mean = F.col("alpha") * F.col("beta") * F.col("du")
    var = F.col("alpha") * F.col("beta") * F.col("beta") * F.col("du") + 2 * F.col("sigma") * F.col("sigma")
    return F.try_divide(mean * mean, var), F.try_divide(F.greatest(F.col("d"), F.lit(0.0)) * mean, var)


def spikes(rows: DataFrame) -> DataFrame:
    """p of each increment and spike.  rows: d, du, alpha, beta, sigma."""
    return rows.withColumn("p_spike", gammaincc(*_matched())).withColumn("spike", (F.col("p_spike") < SPIKE_P) & (F.col("d") > 4 * F.col("sigma")))


def only_spikes(rows: DataFrame) -> DataFrame:
    """The rows of ``spikes`` that are spikes."""
    return _marked_spikes(rows).where("spike").drop("spike")


def _marked_spikes(rows: DataFrame) -> DataFrame:
    """Adds spike alone.

    For a >= 1, Q(a, x) is at least x**(a - 1) * exp(-x) / gamma(a).  Where that is not below SPIKE_P there is no spike, and Q is not computed."""
    large = F.col("d") > 4 * F.col("sigma")
    a, x = (F.when(large, c) for c in _matched())
    least = (F.col("_a") - 1) * F.log("_x") - F.col("_x") - ln_gamma(F.col("_a"))
    possible = large & ((F.col("_a") < 1) | F.coalesce(least < math.log(SPIKE_P) + 1e-6, F.lit(True)))
    q = F.when(possible, gammaincc(F.col("_a"), F.col("_x")))
    return rows.withColumns({"_a": a, "_x": x}).withColumn("spike", F.coalesce(q < SPIKE_P, F.lit(False))).drop("_a", "_x")


def install_offsets(sequenced: DataFrame) -> DataFrame:
    """First readings of a new part, not first in the channel, far from zero.  sequenced: with sigma."""
    return sequenced.where(_install_offset())


def _install_offset() -> Column:
    return F.col("install") & (F.abs("reading") > 5 * F.col("sigma"))


def _repeats() -> Column:
    return F.coalesce(F.abs("rd") < 1e-9, F.lit(False))


def stuck_runs(sequenced: DataFrame) -> DataFrame:
    """Per row: rep (no change against the row before in the channel) and run (consecutive repeats up to here)."""
    by = Window.partitionBy("chan").orderBy("month", "serial")
    rows = sequenced.withColumn("rep", _repeats())
    rows = rows.withColumn("island", F.sum((~F.col("rep")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("chan", "island").orderBy("month", "serial").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("run", F.sum(F.col("rep").cast("int")).over(inside)).drop("island")


def dropouts(rows: DataFrame, n_months: int) -> DataFrame:
    """Per channel: first_seen, n_obs, missing of the last twelve months, dropout."""
    return _with_dropout(rows.groupBy("chan").agg(*_seen(n_months)), n_months)


def _seen(n_months: int) -> list[Column]:
    return [F.min("month").alias("first_seen"), F.count(F.lit(1)).alias("n_obs"), F.count_if(F.col("month") > n_months - 13).alias("recent")]


def _with_dropout(found: DataFrame, n_months: int) -> DataFrame:
    found = found.withColumn("span", F.least(F.lit(12), n_months - F.col("first_seen"))).withColumn("missing", F.col("span") - F.col("recent"))
    return found.withColumn("dropout", (F.col("missing") >= 5) & (F.col("missing") >= 0.4 * F.col("span")))


def prefix_sums(sequenced: DataFrame, **also: Column) -> DataFrame:
    """Sums of d, du and count over the increments strictly before each row of its channel, and over the whole channel; also: windows of the same order."""
    by = Window.partitionBy("chan").orderBy("month", "serial")
    before, whole = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inc = F.coalesce(F.col("same_serial") & (F.col("du") > 0), F.lit(False))
    found = dict(also)  # all of one order, so that one pass over a channel serves them
    for name, value in (("d", F.col("d")), ("u", F.col("du")), ("n", F.lit(1))):
        x = F.when(inc, value).otherwise(F.lit(0))
        found |= {f"pre_{name}": F.coalesce(F.sum(x).over(before), F.lit(0)), f"all_{name}": F.sum(x).over(whole)}
    found |= {"seg_first": F.min("seg").over(whole), "seg_last": F.max("seg").over(whole), "seg_before": F.coalesce(F.lag("seg").over(by), F.col("seg"))}
    return sequenced.withColumns(found)


def change_points(sequenced: DataFrame) -> DataFrame:
    """Per candidate row: p that what follows is no faster than what came before predicts; null where no p is to be had.

    sequenced: with beta, sigma, mu, tau.  Candidates are every third row from the first one, which has nothing before it and is held against the
    prior alone."""
    return _scanned(prefix_sums(sequenced).where(_CANDIDATE))


_CANDIDATE = "n_rows >= 13 AND (rn - 1) % 3 = 0 AND rn <= n_rows - 6"


def _scanned(rows: DataFrame) -> DataFrame:
    """Adds p of ``change_points`` to rows of prefix_sums, null where a row is no candidate.

    Prefix sums make every candidate O(1); the special function sees candidates only, and no row leaves the JVM.  Each value that is used
    more than once is a column, and no filter stands above it: a filter would be moved below and repeat the whole chain of expressions in one huge method."""
    eps, beta, s2 = F.lit(2.220446049250313e-16), F.col("beta"), F.col("sigma") * F.col("sigma")
    u, r, t2 = F.col("_u"), F.col("r_pre"), F.col("tau") * F.col("tau")
    rows = rows.withColumn("_u", F.greatest(F.col("pre_u").cast("double"), eps))
    rows = rows.withColumn("r_pre", F.greatest(F.col("pre_d") / u, F.lit(1e-6)))
    v = F.greatest((r * beta * F.col("pre_u") + 2 * s2 * (F.col("seg_before") - F.col("seg_first") + 1)) / (u * u) / (r * r), F.lit(1e-4))
    rows = rows.withColumn("v_pre", F.when(F.col("pre_n") < 3, F.lit(1e6)).otherwise(v))
    rows = rows.withColumn("pv", 1 / (1 / t2 + 1 / F.col("v_pre")))
    pm = F.col("pv") * (F.col("mu") / t2 + F.log(r / beta) / F.col("v_pre"))
    rows = rows.withColumns({"_a": F.exp(pm + F.col("pv") / 2), "s_post": F.col("all_d") - F.col("pre_d"), "u_post": F.col("all_u") - F.col("pre_u")})
    rows = rows.withColumn("m", F.col("_a") * beta * F.col("u_post"))
    rows = rows.withColumn("var", F.col("_a") * beta * beta * F.col("u_post") + F.col("m") * F.col("m") * (F.exp("pv") - 1) + 2 * s2 * (F.col("seg_last") - F.col("seg") + 1))
    rows = rows.withColumns({"_k": F.try_divide(F.col("m") * F.col("m"), F.col("var")), "_x": F.try_divide(F.greatest(F.col("s_post"), F.lit(0.0)) * F.col("m"), F.col("var"))})
    p = F.when(F.expr(f"{_CANDIDATE} AND m > 0 AND var > 0 AND u_post > 0"), gammaincc(F.col("_k"), F.col("_x")))
    return rows.withColumn("p", p).drop("_u", "_a", "_k", "_x")


def persistence(candidates: DataFrame) -> DataFrame:
    """Per channel: p_min, its month (the first of equal ones), corrected p, persistent, watch; candidates without a p do not count.

    Values that differ below 1e-12 are equal: so small a difference is rounding, whichever way the probability is computed."""
    best = _settled(candidates).groupBy("chan").agg(*_best()).where("n_valid > 0")
    return _with_persistence(best).select("chan", "p_min", "onset", "p_corrected", "persistent", "watch")


def _settled(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("p", F.when(F.col("p").isNotNull(), F.round(F.greatest("p", F.lit(0.0)), 12)))


def _best() -> list[Column]:
    return [F.min(F.when(F.col("p").isNotNull(), F.struct("p", "rn", "month"))).alias("best"), F.count("p").alias("n_valid")]


def _with_persistence(best: DataFrame) -> DataFrame:
    """Without a valid candidate p_min and onset are null, and p_corrected is 1."""
    rows = best.withColumns({"p_min": F.col("best.p"), "onset": F.col("best.month"), "p_corrected": F.least(F.lit(1.0), F.col("best.p") * F.col("n_valid"))})
    return rows.withColumn("persistent", F.col("p_corrected") < PERSIST_P).withColumn("watch", F.col("p_min") < WATCH_P)


def isolate(rows: DataFrame, channels: DataFrame | None, n_months: int, also: dict[str, Column] | None = None) -> DataFrame:
    """One row per channel of ``channels`` (chan; None: those of the rows): class, onset, confidence, evidence bits, n_obs, watch.
    also: more aggregates of a channel's rows, which have the columns of prefix_sums, last_serial and all_parts (serials with increments) here.

    rows: sequenced, with alpha, beta, sigma, mu, tau.  Precedence: dropout, stuck, persistent, spike or install.
    All evidence is gathered in one pass over the rows of a channel: one shuffle, windows of one order, one aggregation."""
    by = Window.partitionBy("chan").orderBy("month", "serial")
    whole, also = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), also or {}
    parts = F.size(F.collect_set(F.when(F.expr("same_serial AND du > 0"), F.col("serial"))).over(whole)).cast("bigint")
    seen = prefix_sums(rows.withColumn("_rep", _repeats()), _rep_before=F.lag("_rep").over(by), last_serial=F.last("serial").over(whole), all_parts=parts)
    seen = seen.withColumn("_stuck", F.expr("_rep AND coalesce(_rep_before, false)"))  # the second of two repeats: there a run of stuck_runs reaches 2
    marked = _marked_spikes(_settled(_scanned(seen)))
    spike = F.expr("same_serial AND du > 0 AND alpha IS NOT NULL") & F.col("spike")
    first = {"t_spike": spike, "t_install": _install_offset(), "t_stuck": F.col("_stuck")}
    found = marked.groupBy("chan").agg(*[F.min(F.when(c, F.col("month"))).alias(k) for k, c in first.items()], *_best(), *_seen(n_months), *[c.alias(k) for k, c in also.items()])
    found = _with_dropout(_with_persistence(found), n_months)
    if channels is not None:
        found = channels.select("chan").distinct().join(found, "chan", "left")
    persistent, dropout = F.coalesce("persistent", F.lit(False)), F.coalesce("dropout", F.lit(False))
    e1, e5, e3 = F.col("t_spike").isNotNull(), F.col("t_install").isNotNull(), F.col("t_stuck").isNotNull()
    scale = persistent & e1 & (F.col("t_spike") <= F.col("onset"))
    kind = F.when(dropout, DROPOUT).when(e3, STUCK).when(scale, SCALE).when(persistent, ACCELERATED).when(e1 | e5, BIAS).otherwise(NONE)
    found = found.withColumn("class", kind)
    start = F.when(dropout, F.lit(n_months - 12)).when(e3, F.col("t_stuck") - 2).when(scale, F.col("t_spike")).when(persistent, F.col("onset")).when(e1 | e5, F.least("t_spike", "t_install"))
    sure = F.when(dropout, F.least(F.lit(1.0), F.col("missing") / 12)).when(e3, 1.0).when(persistent, F.least(F.lit(1.0), -F.log10(F.greatest("p_corrected", F.lit(1e-12))) / 6)).when(e1 | e5, 0.7 + 0.3 * (e1 & e5).cast("int"))
    bits = e1.cast("int") + 2 * persistent.cast("int") + 4 * e3.cast("int") + 8 * dropout.cast("int") + 16 * e5.cast("int")
    return found.select("chan", "class", start.alias("onset_month"), F.coalesce(sure, F.lit(0.0)).alias("confidence"), bits.alias("bits"), F.coalesce("n_obs", F.lit(0)).alias("n_obs"), (F.coalesce("watch", F.lit(False)) & (F.col("class") == NONE)).alias("watch"), F.coalesce("p_corrected", F.lit(1.0)).alias("persist_p"), *also)

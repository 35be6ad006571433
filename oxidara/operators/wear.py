"""Wear of a fleet: channels, increments, the hierarchical gamma-process fit.

A channel is one component position of one aircraft; parts with their own serial are installed on it one after
another.  All windows are partitioned by channel, so one shuffle serves increments, prefix sums and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oxidara.operators.ranks import interpolated
from oxidara.sources.store import settle


def encode(rows: DataFrame, components: list[str]) -> DataFrame:
    """tail as a number from 1 (text after its first letter, plus 1), comp from 1 in catalogue order, chan."""
    code = F.create_map(*[x for i, c in enumerate(components, 1) for x in (F.lit(c), F.lit(i))])
    rows = rows.withColumn("tail", F.expr("CAST(substring(tail, 2) AS INT)") + 1).withColumn("comp", code[F.col("component")])
    return with_channel(rows, len(components))


def with_channel(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("chan", (F.col("tail").cast("bigint") - 1) * k + F.col("comp"))


def decode_channel(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("tail", F.expr(f"CAST(floor((chan - 1) / {k}) + 1 AS BIGINT)")).withColumn("comp", F.expr(f"CAST(pmod(chan - 1, {k}) + 1 AS INT)"))


def sequence_columns(rows: DataFrame) -> DataFrame:
    """Adds, by channel in order of month: rn, n_rows, same_serial, install, d, gap, du, seg (part number), rd (change of reading)."""
    by = Window.partitionBy("chan").orderBy("month", "serial")
    before = {c: F.lag(c).over(by) for c in ("serial", "month", "reading")}
    rows = rows.select("*", *[x.alias(f"_{c}") for c, x in before.items()], F.row_number().over(by).alias("rn"), F.count(F.lit(1)).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_rows"))
    same = F.coalesce(F.col("serial") == F.col("_serial"), F.lit(False))
    rows = rows.withColumn("same_serial", same).withColumn("rd", F.col("reading") - F.col("_reading"))
    rows = rows.withColumn("gap", F.when(F.col("same_serial"), F.col("month") - F.col("_month"))).withColumn("d", F.when(F.col("same_serial"), F.col("rd")))
    rows = rows.withColumn("du", F.col("usage_hours") * F.col("gap")).withColumn("install", ~F.col("same_serial") & (F.col("rn") > 1))
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("seg", F.sum((~F.col("same_serial")).cast("int")).over(upto)).drop("_serial", "_month", "_reading")


def increments(sequenced: DataFrame) -> DataFrame:
    """Rows that differ from an earlier reading of the same part over positive exposure."""
    return sequenced.where("same_serial AND du > 0")


def unit_stats(kept: DataFrame) -> DataFrame:
    """Per channel: n_incr, n_seg, sdu, sd, rate, ve (residual sum of squares, by the second pass over a window)."""
    whole = Window.partitionBy("chan")
    rate = F.greatest(F.sum("d").over(whole) / F.greatest(F.sum("du").over(whole), F.lit(2.220446049250313e-16)), F.lit(1e-6))
    rows = kept.withColumn("rate", rate)
    return rows.groupBy("chan", "comp", "tail", "rate").agg(
        F.count(F.lit(1)).alias("n_incr"), F.count_distinct("serial").alias("n_seg"), F.sum("du").alias("sdu"), F.sum("d").alias("sd"), F.sum(F.pow(F.col("d") - F.col("rate") * F.col("du"), F.lit(2))).alias("ve")
    )


def unit_rates(kept: DataFrame) -> DataFrame:
    """unit_stats without ve, which alone needs a second pass: sums that are added up before anything is shuffled."""
    return with_rate(kept.groupBy("chan", "comp", "tail").agg(F.count(F.lit(1)).alias("n_incr"), F.count_distinct("serial").alias("n_seg"), F.sum("du").alias("sdu"), F.sum("d").alias("sd")))


def with_rate(sums: DataFrame) -> DataFrame:
    return sums.withColumn("rate", F.greatest(F.col("sd") / F.greatest(F.col("sdu"), F.lit(2.220446049250313e-16)), F.lit(1e-6)))


def increment_sums() -> dict[str, Column]:
    """The sums of unit_rates as aggregates of a channel's rows in faults.isolate; n_incr is 0 where there is no increment."""
    return {"n_incr": F.max("all_n"), "n_seg": F.max("all_parts"), "sdu": F.max("all_u"), "sd": F.max("all_d")}


LEAST_UNITS = 10
PASSES = 3


def moment_regression(units: DataFrame) -> DataFrame:
    """Per component: beta, sigma and the units that the robust passes rejected.

    Two regressors without intercept, solved by the normal equations; each pass is one aggregation to a row per component, which
    is broadcast (its size is the number of components)."""
    base = units.where("n_incr >= 3").select("chan", "comp", (F.col("rate") * F.col("sdu")).alias("a1"), F.col("n_incr").cast("double").alias("a2"), (F.col("ve") * F.col("n_incr") / (F.col("n_incr") - 1)).alias("y"))
    rows = settle(base.withColumn("use", F.lit(True)))
    for _ in range(PASSES):
        used = rows.where("use").groupBy("comp").agg(*[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in (("a1", "a1"), ("a1", "a2"), ("a2", "a2"), ("a1", "y"), ("a2", "y"))])
        det = F.col("a1a1") * F.col("a2a2") - F.col("a1a2") * F.col("a1a2")
        solved = used.select("comp", F.try_divide(F.col("a2a2") * F.col("a1y") - F.col("a1a2") * F.col("a2y"), det).alias("c1"), F.try_divide(F.col("a1a1") * F.col("a2y") - F.col("a1a2") * F.col("a1y"), det).alias("c2"))
        fit = F.col("a1") * F.col("c1") + F.col("a2") * F.col("c2")
        res = rows.join(F.broadcast(solved), "comp").withColumn("res", (F.col("y") - fit) / F.greatest(F.sqrt(F.greatest(fit, F.lit(2.220446049250313e-16))), F.lit(2.220446049250313e-16)))
        scale = interpolated(res.where("use").select("comp", F.abs("res").alias("size")), ["comp"], "size", 0.5).select("comp", (1.4826 * F.col("size")).alias("scale"))
        rows = settle(res.join(F.broadcast(scale), "comp").withColumn("use", F.coalesce(F.abs(F.try_divide(F.col("res"), F.col("scale"))) < 4, F.lit(False))).select("chan", "comp", "a1", "a2", "y", "use", "c1", "c2"))
        last = rows
        rows = rows.drop("c1", "c2")
    return last.select("chan", "comp", F.col("use").alias("accepted"), F.greatest("c1", F.lit(1e-4)).alias("beta"), F.sqrt(F.greatest(F.col("c2") / 2, F.lit(1e-6))).alias("sigma"))


def log_rates(units: DataFrame) -> DataFrame:
    """Adds la, the logarithm of each unit's rate over beta, and its variance v.  units: unit_stats with beta and sigma."""
    var_r = (F.col("rate") * F.col("beta") * F.col("sdu") + 2 * F.col("sigma") * F.col("sigma") * F.col("n_seg")) / (F.col("sdu") * F.col("sdu"))
    return units.withColumn("la", F.log(F.col("rate") / F.col("beta"))).withColumn("v", F.greatest(var_r / (F.col("rate") * F.col("rate")), F.lit(1e-4)))


def fit(sequenced: DataFrame, exclude: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(components, units): beta, sigma, mu, tau per component, and each channel's posterior of its log-rate.

    Components with fewer than LEAST_UNITS channels have null parameters."""
    kept = increments(sequenced)
    if exclude is not None:
        kept = kept.join(exclude.select("chan"), "chan", "left_anti")
    units = settle(unit_stats(kept))
    found = moment_regression(units)
    enough = units.groupBy("comp").agg(F.count(F.lit(1)).alias("n_units"), F.sum("n_incr").alias("n_incr"))
    noise = found.groupBy("comp").agg(F.first("beta").alias("beta"), F.first("sigma").alias("sigma"), F.count_if(~F.col("accepted")).alias("rejected_units"))
    noise = enough.join(noise, "comp", "left").withColumn("beta", F.when(F.col("n_units") >= LEAST_UNITS, F.col("beta"))).withColumn("sigma", F.when(F.col("n_units") >= LEAST_UNITS, F.col("sigma")))
    rates = units.join(F.broadcast(noise.select("comp", "beta", "sigma")), "comp").join(found.select("chan", "accepted"), "chan", "left")
    rates = log_rates(rates)
    prior = eb_prior(rates.where("n_incr >= 5 AND rate > 1e-5 AND coalesce(accepted, false) AND la IS NOT NULL"))
    comps = noise.join(prior, "comp", "left").select("comp", "beta", "sigma", "mu", F.sqrt("tau2").alias("tau"), "n_units", "n_incr", "rejected_units")
    return comps, posterior(rates.join(F.broadcast(prior), "comp"))


def tau_grid() -> list[float]:
    return [10 ** (-3 + 3.5 * i / 119) for i in range(120)]


def eb_prior(units: DataFrame) -> DataFrame:
    """Per component: mu, tau2 by the largest marginal likelihood on a grid; the first of equal ones.

    units: comp, la, v.  Each unit meets the 120 points inside its own row; partial sums leave the task.  Sums are taken around each component's mean of la: then
    the weighted sum of squares around the weighted mean is no difference of large numbers, wherever la lies and however many units there are."""
    middle = units.groupBy("comp").agg(F.avg("la").alias("_middle"))  # a row per component
    near = units.join(F.broadcast(middle), "comp").withColumn("_off", F.col("la") - F.col("_middle"))
    rows = near.select("comp", "_middle", "_off", "v", F.explode(F.array(*[F.lit(t) for t in tau_grid()])).alias("tau2"))
    w = 1 / (F.col("tau2") + F.col("v"))
    sums = rows.groupBy("comp", "tau2").agg(
        F.first("_middle").alias("middle"), F.sum(w).alias("w"), F.sum(w * F.col("_off")).alias("wl"), F.sum(w * F.col("_off") * F.col("_off")).alias("wll"), F.sum(F.log(F.col("tau2") + F.col("v"))).alias("logs")
    )
    off = F.col("wl") / F.col("w")
    like = -0.5 * F.col("logs") - 0.5 * (F.col("wll") - off * F.col("wl"))
    best = sums.select("comp", "tau2", (F.col("middle") + off).alias("mu"), like.alias("ll")).groupBy("comp").agg(F.max(F.struct("ll", (-F.col("tau2")).alias("less"), "mu", "tau2")).alias("best"))
    return best.select("comp", "best.mu", "best.tau2")


def posterior(rates: DataFrame) -> DataFrame:
    """chan, comp, tail, la_mu, la_var, shrink, n_incr, alpha.  rates: la, v, mu, tau2 beside the keys."""
    var = 1 / (1 / F.col("tau2") + 1 / F.col("v"))
    few = F.col("n_incr") < 2
    rows = rates.withColumn("la_var", F.when(few, F.col("tau2")).otherwise(var))
    rows = rows.withColumn("la_mu", F.when(few, F.col("mu")).otherwise(var * (F.col("mu") / F.col("tau2") + F.col("la") / F.col("v"))))
    rows = rows.withColumn("shrink", F.when(few, F.lit(1.0)).otherwise((1 / F.col("tau2")) * var))
    return rows.select("chan", "comp", "tail", F.exp(F.col("la_mu") + F.col("la_var") / 2).alias("alpha"), "la_mu", "la_var", "shrink", "n_incr")

"""Queries over the driver's tables: a fleet read out of lineitem, screened, fitted, searched for faults and forecast.

A supplier is an aircraft, a return flag a component, the running quantity the damage of the part that is installed.  ``_FLEET`` and
``_DIRTY`` are plain SQL that Spark and DuckDB understand alike; everything behind them is built from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oxidara.functions.rounding import half_even, half_even_sql
from oxidara.functions.special import hermite, register
from oxidara.operators import faults, forecast, ingest, ranks, report, scoring, wear
from oxidara.plans import scorecard
from oxidara.sources.store import examples, settle

K, N_MONTHS, HORIZON, REPLICATES, TOP = 3, 83, 18, 200, 25
BETA, SIGMA, MU, TAU, LIMIT = 0.05, 0.2, -0.7985076962177716, 0.2, 7.9

_FLEET = """
WITH m AS (SELECT l_suppkey + 1 AS tail, l_returnflag AS component, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS month,
    CAST(count(*) * 10 AS DOUBLE) AS usage_hours, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q FROM lineitem GROUP BY 1, 2, 3),
c AS (SELECT *, CAST(sum(q) OVER (PARTITION BY tail, component ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cq FROM m),
s AS (SELECT tail, component, CASE component WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS comp, CAST(floor(cq / 800.0) AS BIGINT) AS ep, month, usage_hours, cq FROM c),
fleet AS (SELECT tail, component, comp, (tail - 1) * 3 + comp AS chan, (tail * 3 + comp) * 1000 + ep AS serial, month, usage_hours, (cq - 800.0 * ep) / 100.0 AS reading FROM s)
"""
_DIRTY = """
SELECT CASE WHEN l_orderkey % 97 = 0 THEN 'T9999999' ELSE concat('T', CAST(l_suppkey AS STRING)) END AS tail,
    CASE WHEN l_orderkey % 89 = 0 THEN 'ZZZ' ELSE l_returnflag END AS component,
    CAST(l_orderkey AS STRING) AS serial, CAST(l_linenumber + CASE WHEN l_orderkey % 83 = 0 THEN 100 ELSE 0 END AS STRING) AS month,
    CASE WHEN l_orderkey % 101 = 0 THEN 'n/a' WHEN l_orderkey % 103 = 0 THEN 'inf' ELSE CAST(CAST(l_quantity * CASE WHEN l_orderkey % 79 = 0 THEN -1 WHEN l_orderkey % 71 = 0 THEN 100 ELSE 1 END AS INT) AS STRING) END AS usage_hours,
    CASE WHEN l_orderkey % 107 = 0 THEN '3d' ELSE CAST(CAST(l_quantity * CASE WHEN l_orderkey % 73 = 0 THEN -1 ELSE 1 END AS INT) % 36 AS STRING) END AS reading,
    l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate FROM lineitem
"""


def _view(spark: SparkSession, sf_dir: str, name: str = "lineitem") -> None:
    spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    _view(spark, sf_dir)
    return spark.sql(_FLEET + "SELECT * FROM fleet")


def sequenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wear.sequence_columns(fleet(spark, sf_dir))


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    _view(spark, sf_dir)
    roster = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("tail"))
    return ingest.screen(spark.sql(_DIRTY), roster, ["A", "N", "R"], 8, ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"], jump=12.0)


def _with_params(rows: DataFrame) -> DataFrame:
    for name, value in (("beta", BETA), ("sigma", SIGMA), ("mu", MU), ("tau", TAU)):
        rows = rows.withColumn(name, F.lit(value))
    return rows.withColumn("alpha", F.exp(F.col("mu") + F.col("tau") * F.col("tau") / 2))


def q_ingest_reason_counts(spark, d):
    return ingest.reason_counts(screened(spark, d))


def q_ingest_row_reasons(spark, d):
    return ingest.quarantine(screened(spark, d)).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "reason")


def q_ingest_reconcile(spark, d):
    return ingest.reconcile(screened(spark, d))


def q_encode_channels(spark, d):
    rows = wear.encode(ingest.clean(screened(spark, d)), ["A", "N", "R"])
    return rows.groupBy("chan", "comp").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("reading"), 3).alias("total"))


def q_increments_by_serial(spark, d):
    return wear.increments(sequenced(spark, d)).select("chan", "serial", "month", F.round("d", 6).alias("d"), "gap", "du")


def q_channel_increment_stats(spark, d):
    rows = wear.unit_stats(wear.increments(sequenced(spark, d)))
    return rows.select("chan", "n_incr", "n_seg", F.round("sdu", 3).alias("sdu"), F.round("sd", 4).alias("sd"), F.round("rate", 6).alias("rate"), F.round("ve", 4).alias("ve"))


def q_segments_per_channel(spark, d):
    return sequenced(spark, d).groupBy("chan").agg(F.max("seg").alias("n_parts"), F.count_if("install").alias("n_installs"))


def q_prefix_suffix_sums(spark, d):
    rows = faults.prefix_sums(sequenced(spark, d))
    return rows.select("chan", "month", F.round("pre_d", 4).alias("pre_d"), F.round("pre_u", 2).alias("pre_u"), F.col("pre_n").cast("bigint").alias("pre_n"), (F.round(F.col("all_d") - F.col("pre_d"), 4) + 0.0).alias("post_d"))


def q_install_offset(spark, d):
    return faults.install_offsets(_with_params(sequenced(spark, d))).select("chan", "serial", "month", F.round("reading", 4).alias("reading"))


def q_stuck_runs(spark, d):
    return faults.stuck_runs(sequenced(spark, d)).groupBy("run").agg(F.count(F.lit(1)).alias("n_rows"))


def q_dropout_trailing(spark, d):
    return faults.dropouts(fleet(spark, d), N_MONTHS).select("chan", "first_seen", "n_obs", "missing", "dropout")


def q_usage_mean_logsd(spark, d):
    return forecast.usage_by_tail(fleet(spark, d)).select("tail", F.round("usage", 6).alias("usage"), F.round("log_sd", 6).alias("log_sd"))


def q_latest_reading(spark, d):
    return forecast.latest(fleet(spark, d)).select("chan", "serial", "month", F.round("reading", 4).alias("reading"))


def _failures(rows: DataFrame) -> DataFrame:
    """The parts that another one followed on their channel."""
    last = rows.groupBy("chan").agg(F.max("serial").alias("last"))
    return rows.join(last, "chan").where("serial < last").select("serial").distinct()


def _comps(spark: SparkSession) -> DataFrame:
    return spark.range(1, K + 1).select(F.col("id").cast("int").alias("comp"), F.lit(SIGMA).alias("sigma"))


def q_threshold_quantile(spark, d):
    rows = fleet(spark, d)
    return forecast.thresholds(rows, _failures(rows), _comps(spark)).select("comp", F.round("threshold", 6).alias("threshold"))


def q_fit_components(spark, d):
    comps, _ = wear.fit(sequenced(spark, d))
    return comps.select("comp", *[F.round(c, 5).alias(c) for c in ("beta", "sigma", "mu", "tau")], "n_units", "n_incr", "rejected_units")


def q_spike_pvalue(spark, d):
    rows = faults.spikes(_with_params(wear.increments(sequenced(spark, d))))
    return rows.select("chan", "serial", "month", F.round("p_spike", 6).alias("p"))


def q_changepoint_scan(spark, d):
    found = faults.persistence(faults.change_points(_with_params(sequenced(spark, d))))
    return found.select("chan", F.round("p_min", 6).alias("p_min"), "onset", F.round("p_corrected", 6).alias("p_corrected"), "persistent", "watch")


def _flags(spark, d, also: dict | None = None) -> DataFrame:
    return faults.isolate(_with_params(sequenced(spark, d)), None, N_MONTHS, also)


def q_fault_isolation(spark, d):
    return _flags(spark, d).withColumns({c: F.round(c, 6) for c in ("confidence", "persist_p")})


def q_flag_histogram(spark, d):
    return _flags(spark, d).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def _state(spark, d) -> DataFrame:
    rows = fleet(spark, d)
    none = rows.select("chan").limit(0)
    posterior = none.select("chan", *[F.lit(0.0).alias(c) for c in ("la_mu", "la_var", "shrink")], F.lit(0).alias("n_incr"))
    params = _comps(spark).select("comp", F.lit(BETA).alias("beta"), F.lit(MU).alias("mu"), F.lit(TAU).alias("tau"), F.lit(LIMIT).alias("threshold"))
    usage = forecast.usage_by_tail(rows).select("tail", "usage")
    return forecast.damage_state(rows, posterior, none.select("chan", F.lit(0).alias("class")), params, usage, N_MONTHS)


def _posterior(rates: DataFrame) -> DataFrame:
    """Each channel's posterior of its log-rate under the fixed parameters.  rates: unit_rates."""
    rates = wear.log_rates(_with_params(rates)).withColumn("tau2", F.lit(TAU * TAU))
    return wear.posterior(rates.drop("alpha"))


def _channels(spark, d) -> DataFrame:
    """A row per channel, kept, from one pass over the fleet: fault class and its evidence, latest row, sums of increments and of usage."""
    hours = {"hours": F.sum("usage_hours"), "n_hours": F.count("usage_hours")}
    return settle(_flags(spark, d, forecast.last_row() | wear.increment_sums() | hours))


def _whole_state(spark, d, found: DataFrame | None = None) -> DataFrame:
    """_state with the channels' own posteriors and fault classes; channels with false readings keep the prior, as in the chain."""
    found = _channels(spark, d) if found is None else found
    own = wear.with_rate(found.where(~F.col("class").isin(*faults.EXCLUDED)).where("n_incr > 0").select("chan", "comp", "tail", *wear.increment_sums()))
    params = _comps(spark).select("comp", F.lit(BETA).alias("beta"), F.lit(MU).alias("mu"), F.lit(TAU).alias("tau"), F.lit(LIMIT).alias("threshold"))
    usage = found.groupBy("tail").agg(F.try_divide(F.sum("hours"), F.sum("n_hours")).alias("usage"))
    now = found.select("chan", *forecast.last_row())
    return forecast.state_of(now, _posterior(own), found, params, usage, N_MONTHS)


def q_posterior(spark, d):
    return _posterior(wear.unit_rates(wear.increments(sequenced(spark, d)))).select("chan", "n_incr", *[F.round(c, 6).alias(c) for c in ("la_mu", "la_var", "shrink", "alpha")])


def q_unit_state(spark, d):
    """Beside damage_state, whose SQL knows no posterior and no faults: the state that all forecasts start from."""
    return _whole_state(spark, d).select("chan", "basis", "fault", "n_incr", F.round("shrink", 5).alias("shrink"), F.round("x0", 5).alias("x0"), F.round("usage", 5).alias("usage"))


def q_damage_state(spark, d):
    return _state(spark, d).select("chan", "basis", F.round("x0", 5).alias("x0"), F.round("usage", 5).alias("usage"))


def q_rul(spark, d):
    found = forecast.remaining_life(_whole_state(spark, d), HORIZON)
    return found.select("chan", *[report.finite(F.col(c), 3).alias(c) for c in ("p05", "p50", "p95")], F.round("pfail", 6).alias("pfail"))


def _monthly(spark, d) -> DataFrame:
    return forecast.failure_by(_whole_state(spark, d), list(range(1, HORIZON + 1)))


def _within_horizon(state: DataFrame) -> DataFrame:
    return forecast.failure_by(state, [HORIZON]).withColumn("pfail", F.col("cdf")[0]).drop("cdf")


def q_rul_cdf_monthly(spark, d):
    found = _monthly(spark, d)
    return found.select("chan", F.posexplode("cdf").alias("month", "p")).select("chan", (F.col("month") + 1).alias("month"), F.round("p", 6).alias("p"))


def q_failure_cdf_sql(spark, d):
    """Failures within the horizon by the SQL function rul_cdf: no row leaves the JVM."""
    register(spark)
    inputs = "x0, la_mu, la_var, beta, threshold, usage"
    return _whole_state(spark, d).selectExpr("chan", f"round(rul_cdf({inputs}, {HORIZON}), 6) AS pfail", f"round(rul_cdf({inputs}, 1), 6) AS p_first_month")


def q_expected_failures(spark, d):
    found = forecast.expected_by_month(_monthly(spark, d))
    return found.select("month", F.round("expected", 4).alias("expected"), F.round("variance", 4).alias("variance"))


def q_mc_availability(spark, d):
    state = _whole_state(spark, d).withColumn("log_sd", F.lit(0.2))
    tails = state.agg(F.max("tail")).first()[0]
    lived = forecast.lives(state, HORIZON, REPLICATES, 11, (0.3, 0.4, 0.9, 2.0))
    return forecast.replicate_quantiles(forecast.availability(lived, tails), ["month"], "available", {"p05": 0.05, "p95": 0.95})


def q_mc_failures(spark, d):
    """Failures by component and month over the replicates."""
    lived = forecast.lives(_whole_state(spark, d).withColumn("log_sd", F.lit(0.2)), HORIZON, REPLICATES, 11, (0.3, 0.4, 0.9, 2.0))
    return forecast.replicate_quantiles(lived.where("comp > 0"), ["comp", "month"], "n", {"p05": 0.05, "p95": 0.95})


def q_nearest_rank(spark, d):
    return ranks.nearest_rank(fleet(spark, d).withColumn("x", F.round("reading", 4)), ["comp"], "x", {"p05": 0.05, "p50": 0.5, "p95": 0.95}).withColumn("mean", F.round("mean", 6))


def q_calibration_bins(spark, d):
    rows = fleet(spark, d).select((F.col("reading") / 8).alias("p"), (F.col("month") % 2).alias("y"))
    return forecast.calibration(rows, "p", "y").select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("observed", 6).alias("observed"))


def _outcomes(spark, d) -> DataFrame:
    return fleet(spark, d).select("comp", "chan", "month", (F.col("reading") / 8).alias("p"), (F.col("month") % 2).alias("y"), (F.col("serial") % 4).alias("predicted"))


def q_brier_by_group(spark, d):
    found = scoring.brier(_outcomes(spark, d), "p", "y", ["comp"])
    return found.select("comp", "n", F.round("brier", 6).alias("brier"), F.round("base", 6).alias("base"))


def q_confusion_matrix(spark, d):
    return scoring.confusion(_outcomes(spark, d), "y", "predicted")


def q_conditional_coverage(spark, d):
    return scoring.conditional_coverage(_outcomes(spark, d), "p").withColumns({c: F.round(c, 6) for c in ("benchmark", "se")})


def q_row_matched_recall(spark, d):
    rows = _outcomes(spark, d)
    return scoring.matched_recall(rows.where("p > 0.25"), rows.where("y = 1"), ["chan", "month"])


def q_excluded_channels_anti(spark, d):
    rows = fleet(spark, d)
    return rows.join(rows.where("reading > 7.9").select("chan").distinct(), "chan", "left_anti").groupBy("chan").agg(F.count(F.lit(1)).alias("n_rows"))


def q_failed_serial_max(spark, d):
    rows = fleet(spark, d)
    return rows.join(_failures(rows), "serial", "left_semi").groupBy("comp", "serial").agg(F.round(F.max("reading"), 4).alias("most"))


def q_tail_spine_usage_fallback(spark, d):
    rows = forecast.dense_usage(fleet(spark, d).where("tail % 7 <> 3"))
    return rows.select("tail", F.round("usage", 6).alias("usage"), F.round("log_sd", 6).alias("log_sd"))


def q_examples_by_basis(spark, d):
    return examples(_whole_state(spark, d).select("basis", "comp", "chan"), ["basis", "comp"])


def q_channel_decode(spark, d):
    return wear.decode_channel(fleet(spark, d).select("chan").distinct(), K)


def q_onset_error_describe(spark, d):
    """Onsets that the scan finds against a made-up truth: every fifth channel, from month 40."""
    flags = fleet(spark, d).groupBy("chan").agg((F.max("month") - F.col("chan") % 7).alias("onset_month")).withColumn("class", F.lit(1))
    truth = fleet(spark, d).select("chan", F.when(F.col("chan") % 5 == 0, F.col("comp")).otherwise(0).alias("fault"), F.lit(40).alias("onset")).distinct()
    found = scorecard.onset_errors(flags, truth)
    return found.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("mean", "median", "largest")})


def q_coverage_by_class(spark, d):
    rows = _outcomes(spark, d).select("predicted", "p", (F.col("p") - 0.2).alias("low"), (F.col("month") / 82).alias("high"))
    return scoring.coverage(rows, "p", "low", "high", ["predicted"]).withColumn("share", F.round("share", 6))


def q_fleet_totals(spark, d):
    """Expected failures and channels likelier than even to fail, of the ledger's rounded probabilities."""
    p = half_even(F.col("pfail"), 4)
    return _within_horizon(_whole_state(spark, d)).agg(F.count(F.lit(1)).alias("n_channels"), F.round(F.sum(p), 1).alias("expected"), F.count_if(p > 0.5).alias("n_high_risk"))


def q_ledger(spark, d):
    found = _channels(spark, d)
    flags = found.drop(*forecast.last_row(), *wear.increment_sums(), "hours", "n_hours")
    rows = report.ledger(forecast.forecast(_whole_state(spark, d, found), HORIZON), flags, ["A", "N", "R"], HORIZON)
    return rows.select("chan", "tail", "component", "damage_basis", "damage_est", "sensor_status", "watch", "p_fail_within_horizon", "explanation")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channels most likely to fail within the horizon: found by that probability, which all have; months of remaining life are sought for them alone."""
    state = _whole_state(spark, sf_dir)
    likeliest = settle(_within_horizon(state).orderBy(F.desc(F.round("pfail", 5)), "chan").limit(TOP))
    found = forecast.forecast(likeliest.drop("pfail"), HORIZON)
    numbers = [F.round(c, 5).alias(c) for c in ("x0", "pfail")] + [report.finite(F.col(c), 3).alias(c) for c in ("p05", "p50", "p95")]
    return found.select("chan", "tail", "comp", "basis", *numbers).orderBy(F.desc("pfail"), "chan").limit(TOP)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name[2:]: f for name, f in globals().items() if name.startswith("q_")}
    return found | {"top_risk": flagship}


_TAGGED = f"""
WITH raw AS ({_DIRTY}), t AS (SELECT *, CAST(serial AS DOUBLE) AS s, CAST(month AS DOUBLE) AS m, TRY_CAST(usage_hours AS DOUBLE) AS u, TRY_CAST(reading AS DOUBLE) AS r,
    row_number() OVER (PARTITION BY tail, component, serial, month ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS copy FROM raw),
g AS (SELECT *, list_filter([CASE WHEN u IS NULL THEN 'TYPE' END, CASE WHEN r IS NULL THEN 'TYPE' END,
    CASE WHEN tail NOT IN (SELECT concat('T', CAST(s_suppkey AS STRING)) FROM supplier) THEN 'UNKNOWN_TAIL' END,
    CASE WHEN component NOT IN ('A', 'N', 'R') THEN 'UNKNOWN_COMP' END, CASE WHEN m < 0 OR m >= 8 THEN 'MONTH_RANGE' END,
    CASE WHEN u < 0 THEN 'USAGE_NEGATIVE' END, CASE WHEN u IS NULL OR isinf(u) THEN 'USAGE_NONFINITE' END, CASE WHEN u > 744 THEN 'USAGE_FENCE' END,
    CASE WHEN copy > 1 THEN 'DUPLICATE' END, CASE WHEN r < -1 THEN 'READING_NEGATIVE' END, CASE WHEN r > 30 THEN 'READING_FENCE' END], lambda x: x IS NOT NULL) AS first_tags FROM t),
p AS (SELECT *, lag(r) OVER w AS b, lead(r) OVER w AS a FROM g WINDOW w AS (PARTITION BY tail, component, s, len(first_tags) = 0 ORDER BY m)),
tagged AS (SELECT *, CASE WHEN len(first_tags) = 0 AND abs(r - b) > 12 AND abs(r - a) > 12 AND abs(a - b) < 6 THEN ['POINT_OUTLIER'] ELSE first_tags END AS tags FROM p)
"""
_SEQ = (
    _FLEET
    + """, w1 AS (SELECT *, lag(serial) OVER w AS ps, lag(month) OVER w AS pm, lag(reading) OVER w AS pr, row_number() OVER w AS rn FROM fleet WINDOW w AS (PARTITION BY chan ORDER BY month, serial)),
q AS (SELECT *, coalesce(serial = ps, false) AS same, CASE WHEN serial = ps THEN reading - pr END AS d, CASE WHEN serial = ps THEN month - pm END AS gap, CASE WHEN serial = ps THEN usage_hours * (month - pm) END AS du FROM w1)
"""
)
_UNITS = _SEQ + ", i AS (SELECT *, greatest(sum(d) OVER (PARTITION BY chan) / greatest(sum(du) OVER (PARTITION BY chan), 2.220446049250313e-16), 1e-6) AS rate FROM q WHERE same AND du > 0)\n"


def _series(k: str, x: str) -> str:
    """P(k, x) in SQL: the terms of the series around the largest one."""
    return f"CASE WHEN {x} = 0 THEN 0.0 ELSE coalesce(list_sum(list_transform(range(CAST(greatest(0, {x} - {k} - 8 * sqrt({x}) - 12) AS BIGINT), CAST(greatest(0, {x} - {k}) + 8 * sqrt({x}) AS BIGINT) + 40), lambda n: exp(({k} + n) * ln({x}) - {x} - lgamma({k} + n + 1)))), 0.0) END"


_PRIOR = f"exp({MU} + {TAU} * {TAU} / 2)"
_SCAN = (
    _SEQ
    + """, e1 AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY chan ORDER BY month, serial ROWS UNBOUNDED PRECEDING) AS seg, count(*) OVER (PARTITION BY chan) AS n_rows,
    CASE WHEN same AND du > 0 THEN d ELSE 0 END AS xd, CASE WHEN same AND du > 0 THEN du ELSE 0 END AS xu, CASE WHEN same AND du > 0 THEN 1 ELSE 0 END AS xn FROM q),
e2 AS (SELECT *, coalesce(sum(xd) OVER w, 0) AS pd, coalesce(sum(xu) OVER w, 0) AS pu, coalesce(sum(xn) OVER w, 0) AS pn, sum(xd) OVER c AS ad, sum(xu) OVER c AS au, min(seg) OVER c AS s0, max(seg) OVER c AS s1, coalesce(lag(seg) OVER o, seg) AS sb
    FROM e1 WINDOW w AS (PARTITION BY chan ORDER BY month, serial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), o AS (PARTITION BY chan ORDER BY month, serial), c AS (PARTITION BY chan)),
e3 AS (SELECT *, greatest(pd / greatest(pu, 2.220446049250313e-16), 1e-6) AS r FROM e2 WHERE n_rows >= 13 AND (rn - 1) % 3 = 0 AND rn <= n_rows - 6),
"""
    + f"""e4 AS (SELECT *, CASE WHEN pn < 3 THEN 1e6 ELSE greatest((r * {BETA} * pu + 2 * {SIGMA} * {SIGMA} * (sb - s0 + 1)) / pow(greatest(pu, 2.220446049250313e-16), 2) / (r * r), 1e-4) END AS vp FROM e3),
e5 AS (SELECT *, 1 / (1 / ({TAU} * {TAU}) + 1 / vp) AS pv FROM e4),
e6 AS (SELECT *, exp(pv * ({MU} / ({TAU} * {TAU}) + ln(r / {BETA}) / vp) + pv / 2) * {BETA} * (au - pu) AS m FROM e5 WHERE au - pu > 0),
e7 AS (SELECT *, m * {BETA} + m * m * (exp(pv) - 1) + 2 * {SIGMA} * {SIGMA} * (s1 - seg + 1) AS var FROM e6),
e8 AS (SELECT chan, rn, month, m * m / var AS k, greatest(ad - pd, 0) * m / var AS x FROM e7 WHERE m > 0 AND var > 0),
e9 AS (SELECT chan, rn, month, round(greatest(1 - {_series("k", "x")}, 0), 12) AS p FROM e8),
scan AS (SELECT chan, min(p) AS p_min, arg_min(month, struct_pack(p := p, rn := rn)) AS onset, least(1.0, min(p) * count(*)) AS p_corrected FROM e9 GROUP BY chan)
"""
)
_ISOLATED = (
    _SCAN
    + f""", sp AS (SELECT chan, month, d, {_PRIOR} * {BETA} * du AS mean, {_PRIOR} * {BETA} * {BETA} * du + 2 * {SIGMA} * {SIGMA} AS var FROM q WHERE same AND du > 0),
sk AS (SELECT chan, month, d, mean * mean / var AS k, greatest(d, 0) * mean / var AS x FROM sp WHERE d > 4 * {SIGMA}),
t1 AS (SELECT chan, min(month) AS t_spike FROM sk WHERE 1 - {_series("k", "x")} < 2e-5 GROUP BY chan),
t5 AS (SELECT chan, min(month) AS t_install FROM q WHERE NOT same AND rn > 1 AND abs(reading) > 5 * {SIGMA} GROUP BY chan),
rp AS (SELECT chan, month, serial, coalesce(abs(reading - pr) < 1e-9, false) AS rep FROM q),
ri AS (SELECT *, sum(CASE WHEN rep THEN 0 ELSE 1 END) OVER (PARTITION BY chan ORDER BY month, serial ROWS UNBOUNDED PRECEDING) AS island FROM rp),
rr AS (SELECT chan, month, sum(CASE WHEN rep THEN 1 ELSE 0 END) OVER (PARTITION BY chan, island ORDER BY month, serial ROWS UNBOUNDED PRECEDING) AS run FROM ri),
t3 AS (SELECT chan, min(month) AS t_stuck FROM rr WHERE run >= 2 GROUP BY chan),
dr AS (SELECT chan, count(*) AS n_obs, least(12, {N_MONTHS} - min(month)) - count(*) FILTER (month > {N_MONTHS} - 13) AS missing FROM fleet GROUP BY chan),
ev AS (SELECT dr.chan, n_obs, missing, missing >= 5 AS e4, t_stuck IS NOT NULL AS e3, coalesce(p_corrected < 1e-3, false) AS e2, t_spike IS NOT NULL AS e1, t_install IS NOT NULL AS e5, t_spike, t_install, t_stuck, onset, coalesce(p_corrected, 1.0) AS pc, coalesce(p_min < 1e-2, false) AS weak
    FROM dr LEFT JOIN t1 USING (chan) LEFT JOIN t5 USING (chan) LEFT JOIN t3 USING (chan) LEFT JOIN scan USING (chan)),
isolated AS (SELECT chan, CASE WHEN e4 THEN 4 WHEN e3 THEN 3 WHEN e2 AND e1 AND t_spike <= onset THEN 2 WHEN e2 THEN 5 WHEN e1 OR e5 THEN 1 ELSE 0 END AS class,
    CASE WHEN e4 THEN {N_MONTHS} - 12 WHEN e3 THEN t_stuck - 2 WHEN e2 AND e1 AND t_spike <= onset THEN t_spike WHEN e2 THEN onset WHEN e1 OR e5 THEN least(t_spike, t_install) END AS onset_month,
    CASE WHEN e4 THEN least(1.0, missing / 12) WHEN e3 THEN 1.0 WHEN e2 THEN least(1.0, -log10(greatest(pc, 1e-12)) / 6) WHEN e1 OR e5 THEN CASE WHEN e1 AND e5 THEN 1.0 ELSE 0.7 END ELSE 0.0 END AS confidence,
    CAST(e1 AS INT) + 2 * CAST(e2 AS INT) + 4 * CAST(e3 AS INT) + 8 * CAST(e4 AS INT) + 16 * CAST(e5 AS INT) AS bits, n_obs, weak AND NOT (e4 OR e3 OR e2 OR e1 OR e5) AS watch, pc AS persist_p FROM ev)
"""
)
_POSTERIOR = f""", i AS (SELECT *, greatest(sum(d) OVER (PARTITION BY chan) / greatest(sum(du) OVER (PARTITION BY chan), 2.220446049250313e-16), 1e-6) AS rate FROM q WHERE same AND du > 0),
k AS (SELECT chan, count(*) AS n_incr, any_value(rate) AS rate, greatest((any_value(rate) * {BETA} * sum(du) + 2 * {SIGMA} * {SIGMA} * count(DISTINCT serial)) / pow(sum(du), 2) / pow(any_value(rate), 2), 1e-4) AS v FROM i GROUP BY chan),
po AS (SELECT chan, n_incr, CASE WHEN n_incr < 2 THEN {TAU} * {TAU} ELSE 1 / (1 / ({TAU} * {TAU}) + 1 / v) END AS la_var, CASE WHEN n_incr < 2 THEN {MU} ELSE ({MU} / ({TAU} * {TAU}) + ln(rate / {BETA}) / v) / (1 / ({TAU} * {TAU}) + 1 / v) END AS la_mu FROM k)
"""
_STATE = (
    _ISOLATED
    + _POSTERIOR
    + f""", la AS (SELECT chan, tail, comp, serial, month, reading FROM (SELECT *, row_number() OVER (PARTITION BY chan ORDER BY month DESC, serial DESC) AS last FROM fleet) WHERE last = 1),
us AS (SELECT tail, avg(usage_hours) AS usage FROM fleet GROUP BY tail),
fi AS (SELECT chan, serial, min(month) AS installed FROM fleet GROUP BY chan, serial),
st AS (SELECT la.*, usage, installed, class AS fault, class IN (1, 2, 3) AS wrong, {N_MONTHS - 1} - month AS age, n_incr AS own_incr, po.la_mu AS own_mu, po.la_var AS own_var
    FROM la JOIN us USING (tail) JOIN fi USING (chan, serial) JOIN isolated USING (chan) LEFT JOIN po USING (chan)),
su AS (SELECT *, CASE WHEN wrong OR own_incr IS NULL THEN {MU} ELSE own_mu END AS la_mu, CASE WHEN wrong OR own_incr IS NULL THEN {TAU} * {TAU} ELSE own_var END AS la_var, CASE WHEN wrong THEN 0 ELSE coalesce(own_incr, 0) END AS n_incr FROM st),
sv AS (SELECT *, exp(la_mu + la_var / 2) * {BETA} * usage AS step, CASE WHEN n_incr < 2 THEN 1.0 ELSE la_var / ({TAU} * {TAU}) END AS shrink FROM su),
state AS (SELECT *, CASE WHEN wrong THEN 'usage_model' WHEN age > 3 THEN 'stale_reading_projected' ELSE 'reading' END AS basis,
    least(greatest(CASE WHEN wrong THEN step * ({N_MONTHS} - installed) WHEN age > 3 THEN reading + step * age ELSE reading END, 0), 0.995 * {LIMIT}) AS x0 FROM sv)
"""
)


def _cdf(name: str, points: str, keys: str, t: str) -> str:
    """CTEs up to ``name`` (keys, p): probability that a row of ``points`` (keys, x0, la_mu, la_var, usage, month t) has failed by t."""
    x, w = hermite()
    nodes = ", ".join(f"({a!r}, {b!r})" for a, b in zip(x.tolist(), w.tolist(), strict=True))
    return f"""{name}_n AS (SELECT {keys}, w, greatest({LIMIT} - x0, 1e-9) / {BETA} AS x, exp(la_mu + sqrt(2 * la_var) * node) * usage * {t} AS k FROM {points}, (VALUES {nodes}) AS nodes(node, w)),
{name} AS (SELECT {keys}, least(greatest(1 - sum(w * {_series("k", "x")}), 0), 1) AS p FROM {name}_n GROUP BY {keys})
"""


_MONTHLY = _STATE + f", mo AS (SELECT state.*, t FROM state, (SELECT unnest(range(1, {HORIZON + 1})) AS t)), " + _cdf("cdf", "mo", "chan, t", "t")


def _quantiles() -> str:
    """CTEs up to ``quantiles`` (chan, prob, month): false position (Illinois) between the months that the probabilities say."""
    rounds = 14
    found = _MONTHLY + f""", far_in AS (SELECT state.*, {4.0 * HORIZON} AS t FROM state), """ + _cdf("far", "far_in", "chan, t", "t")
    found += f""", grid AS (SELECT chan, CAST(t AS DOUBLE) AS t, p FROM cdf UNION ALL SELECT chan, t, p FROM far UNION ALL SELECT chan, 0.0, 0.0 FROM state),
pr AS (SELECT unnest([0.05, 0.5, 0.95]) AS prob),
z0 AS (SELECT chan, prob, max(t) FILTER (p < prob) AS lo, max(p) FILTER (p < prob) - prob AS flo, min(t) FILTER (p >= prob) AS hi, min(p) FILTER (p >= prob) - prob AS fhi, 0 AS stayed FROM grid, pr GROUP BY chan, prob)"""
    for i in range(rounds):
        found += f""", m{i} AS (SELECT z.*{" EXCLUDE (mid)" if i else ""}, CASE WHEN fhi = 0 OR fhi = flo THEN hi ELSE hi - fhi * (hi - lo) / (fhi - flo) END AS mid, x0, la_mu, la_var, usage FROM z{i} z JOIN state USING (chan) WHERE hi IS NOT NULL), """ + _cdf(f"c{i}", f"m{i}", "chan, prob", "mid")
        found += f""", z{i + 1} AS (SELECT chan, prob, CASE WHEN p < prob THEN mid ELSE lo END AS lo, CASE WHEN p < prob THEN p - prob WHEN stayed < 0 THEN flo / 2 ELSE flo END AS flo, CASE WHEN p < prob THEN hi ELSE mid END AS hi, CASE WHEN p >= prob THEN p - prob WHEN stayed > 0 THEN fhi / 2 ELSE fhi END AS fhi, CASE WHEN p < prob THEN 1 ELSE -1 END AS stayed, mid FROM m{i} JOIN c{i} USING (chan, prob))"""
    return found + f""", quantiles AS (SELECT z0.chan, z0.prob, z{rounds}.mid AS month FROM z0 LEFT JOIN z{rounds} USING (chan, prob))
"""


def _ledger() -> str:
    """The ledger with its sentences."""

    def plain(value: str, digits: int) -> str:
        return f"regexp_replace(CAST(CAST({half_even_sql(value, digits)} AS DECIMAL(24,{digits})) AS VARCHAR), '(\\.\\d+?)0+$', '\\1')"

    basis = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in report.BASIS_TEXT.items())
    status = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(report.FAULT_NAMES))
    q = {c: f"max(month) FILTER (prob = {p}) AS {c}" for c, p in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))}
    far = "'past the search'"
    return (
        _quantiles()
        + f""", r0 AS (SELECT chan, {", ".join(q.values())} FROM quantiles GROUP BY chan), r AS (SELECT chan, {", ".join(f"{half_even_sql(c, 2)} AS {c}" for c in q)} FROM r0),
l AS (SELECT s.chan, format('T{{:04d}}', s.tail - 1) AS tail, CASE s.comp WHEN 1 THEN 'A' WHEN 2 THEN 'N' ELSE 'R' END AS component, basis AS damage_basis, {half_even_sql('x0', 4)} AS damage_est, CASE fault {status} END AS sensor_status, i.watch, {half_even_sql('c.p', 4)} AS pf, p05, p50, p95, {half_even_sql('shrink', 3)} AS shrinkage, s.n_incr
    FROM state s JOIN isolated i USING (chan) JOIN r USING (chan) JOIN cdf c USING (chan) WHERE c.t = {HORIZON})
SELECT chan, tail, component, damage_basis, damage_est, sensor_status, watch, pf AS p_fail_within_horizon,
    concat_ws(' ', concat('Part ', component, ' of ', tail, ' stands at ', {plain("damage_est", 4)}, ' out of ', {plain(f"CAST({LIMIT} AS DOUBLE)", 3)}, ', ', CASE damage_basis {basis} END, '.'),
    concat('It fails within {HORIZON} months with probability ', {plain("pf", 4)}, '; half of such parts last ', coalesce({plain("p50", 2)} || ' months', {far})),
    concat('(one in twenty ', coalesce({plain("p05", 2)} || ' or less', {far}), ', one in twenty ', coalesce({plain("p95", 2)} || ' or more', {far}), ').'),
    concat('Its own record counts for ', CAST(100 - {half_even_sql('(100 * shrinkage)', 0)} AS INT), '% of the wear rate (', n_incr, ' increments), the fleet for the rest.'),
    CASE WHEN sensor_status <> 'none' THEN concat('Sensor fault: ', sensor_status, '.') END, CASE WHEN watch THEN 'Watched: it may wear faster than before, which is not established.' END) AS explanation FROM l"""
    )


def _fitted() -> str:
    """CTEs up to ``comps``: three robust passes of the regression, then the prior on its grid."""
    found = (
        _UNITS
        + """, un AS (SELECT chan, comp, any_value(rate) AS rate, count(*) AS n, count(DISTINCT serial) AS n_seg, sum(du) AS sdu, sum((d - rate * du) * (d - rate * du)) AS ve FROM i GROUP BY chan, comp),
b0 AS (SELECT chan, comp, rate * sdu AS a1, CAST(n AS DOUBLE) AS a2, ve * n / (n - 1) AS y, true AS use FROM un WHERE n >= 3)"""
    )
    for i in range(wear.PASSES):
        found += f""", s{i} AS (SELECT comp, sum(a1 * a1) AS p, sum(a1 * a2) AS q, sum(a2 * a2) AS r, sum(a1 * y) AS s, sum(a2 * y) AS t FROM b{i} WHERE use GROUP BY comp),
f{i} AS (SELECT comp, (r * s - q * t) / (p * r - q * q) AS c1, (p * t - q * s) / (p * r - q * q) AS c2 FROM s{i}),
r{i} AS (SELECT b{i}.*, c1, c2, (y - a1 * c1 - a2 * c2) / greatest(sqrt(greatest(a1 * c1 + a2 * c2, 2.220446049250313e-16)), 2.220446049250313e-16) AS res FROM b{i} JOIN f{i} USING (comp)),
d{i} AS (SELECT comp, 1.4826 * quantile_cont(abs(res), 0.5) AS scale FROM r{i} WHERE use GROUP BY comp),
b{i + 1} AS (SELECT chan, comp, a1, a2, y, coalesce(abs(res / scale) < 4, false) AS use, c1, c2 FROM r{i} JOIN d{i} USING (comp))"""
        if i < wear.PASSES - 1:
            found = found.replace(f"b{i + 1} AS (SELECT chan, comp, a1, a2, y, coalesce(abs(res / scale) < 4, false) AS use, c1, c2 FROM", f"b{i + 1} AS (SELECT chan, comp, a1, a2, y, coalesce(abs(res / scale) < 4, false) AS use FROM")
    last = f"b{wear.PASSES}"
    return (
        found
        + f""", no AS (SELECT comp, greatest(any_value(c1), 1e-4) AS beta, sqrt(greatest(any_value(c2) / 2, 1e-6)) AS sigma, count(*) FILTER (NOT use) AS rejected_units FROM {last} GROUP BY comp),
en AS (SELECT comp, count(*) AS n_units, sum(n) AS n_incr FROM un GROUP BY comp HAVING count(*) >= {wear.LEAST_UNITS}),
ra AS (SELECT un.comp, ln(rate / beta) AS la, greatest((rate * beta * sdu + 2 * sigma * sigma * n_seg) / (sdu * sdu) / (rate * rate), 1e-4) AS v FROM un JOIN no USING (comp) JOIN en USING (comp) JOIN {last} USING (chan) WHERE n >= 5 AND rate > 1e-5 AND use),
gr AS (SELECT pow(10, -3 + 3.5 * g / 119) AS t2 FROM (SELECT unnest(range(0, 120)) AS g)),
ws AS (SELECT comp, t2, sum(1 / (t2 + v)) AS w, sum(la / (t2 + v)) AS wl, sum(la * la / (t2 + v)) AS wll, sum(ln(t2 + v)) AS logs FROM ra, gr GROUP BY comp, t2),
be AS (SELECT comp, arg_max(struct_pack(mu := wl / w, t2 := t2), -0.5 * logs - 0.5 * (wll - wl * wl / w)) AS b FROM ws GROUP BY comp),
comps AS (SELECT comp, beta, sigma, b.mu AS mu, sqrt(b.t2) AS tau, n_units, n_incr, rejected_units FROM no JOIN en USING (comp) JOIN be USING (comp))
"""
    )


def oracle_sql() -> dict[str, str]:
    return {
        "channel_decode": _FLEET + f"SELECT DISTINCT chan, CAST(floor((chan - 1) / {K}) + 1 AS BIGINT) AS tail, CAST((chan - 1) % {K} + 1 AS INT) AS comp FROM fleet",
        "onset_error_describe": _FLEET + "SELECT comp AS fault, count(*) AS n, round(avg(e), 6) AS mean, round(median(e), 6) AS median, round(CAST(max(e) AS DOUBLE), 6) AS largest FROM (SELECT chan, comp, max(month) - chan % 7 - 40 AS e FROM fleet WHERE chan % 5 = 0 GROUP BY chan, comp) GROUP BY comp",
        "coverage_by_class": _FLEET + "SELECT serial % 4 AS predicted, count(*) AS n, round(avg(CASE WHEN reading / 8 <= month / 82 THEN 1 ELSE 0 END), 6) AS share FROM fleet GROUP BY 1",
        "fleet_totals": _MONTHLY + f"SELECT count(*) AS n_channels, round(sum({half_even_sql('p', 4)}), 1) AS expected, count(*) FILTER ({half_even_sql('p', 4)} > 0.5) AS n_high_risk FROM cdf WHERE t = {HORIZON}",
        "ledger": _ledger(),
        "fit_components": _fitted() + "SELECT comp, round(beta, 5) AS beta, round(sigma, 5) AS sigma, round(mu, 5) AS mu, round(tau, 5) AS tau, n_units, n_incr, rejected_units FROM comps",
        "changepoint_scan": _SCAN + "SELECT chan, round(p_min, 6) AS p_min, onset, round(p_corrected, 6) AS p_corrected, p_corrected < 1e-3 AS persistent, p_min < 1e-2 AS watch FROM scan",
        "fault_isolation": _ISOLATED + "SELECT chan, class, onset_month, round(confidence, 6) AS confidence, bits, n_obs, watch, round(persist_p, 6) AS persist_p FROM isolated",
        "flag_histogram": _ISOLATED + "SELECT class, count(*) AS n FROM isolated GROUP BY class",
        "unit_state": _STATE + "SELECT chan, basis, fault, n_incr, round(shrink, 5) AS shrink, round(x0, 5) AS x0, round(usage, 5) AS usage FROM state",
        "examples_by_basis": _STATE + "SELECT basis, comp, min(chan) AS chan FROM state GROUP BY basis, comp",
        "rul_cdf_monthly": _MONTHLY + "SELECT chan, CAST(t AS INT) AS month, round(p, 6) AS p FROM cdf",
        "failure_cdf_sql": _MONTHLY + f"SELECT chan, max(round(p, 6)) FILTER (t = {HORIZON}) AS pfail, max(round(p, 6)) FILTER (t = 1) AS p_first_month FROM cdf GROUP BY chan",
        "rul": _quantiles() + "SELECT chan, round(max(month) FILTER (prob = 0.05), 3) AS p05, round(max(month) FILTER (prob = 0.5), 3) AS p50, round(max(month) FILTER (prob = 0.95), 3) AS p95, any_value(round(p, 6)) AS pfail FROM quantiles JOIN cdf USING (chan) WHERE t = " + str(HORIZON) + " GROUP BY chan",
        "expected_failures": _MONTHLY
        + "SELECT CAST(t AS INT) AS month, round(sum(f), 4) AS expected, round(sum(f * (1 - f)), 4) AS variance FROM (SELECT t, p - coalesce(lag(p) OVER (PARTITION BY chan ORDER BY t), 0) AS f FROM cdf) GROUP BY t",
        "top_risk": _quantiles()
        + f"""SELECT s.chan, s.tail, s.comp, s.basis, round(s.x0, 5) AS x0, round(any_value(cdf.p), 5) AS pfail, round(max(q.month) FILTER (prob = 0.05), 3) AS p05, round(max(q.month) FILTER (prob = 0.5), 3) AS p50, round(max(q.month) FILTER (prob = 0.95), 3) AS p95
FROM state s JOIN quantiles q USING (chan) JOIN cdf USING (chan) WHERE t = {HORIZON} GROUP BY 1, 2, 3, 4, s.x0 ORDER BY pfail DESC, s.chan LIMIT 25""",
        "ingest_reason_counts": _TAGGED + "SELECT reason, count(*) AS n_rows FROM (SELECT unnest(tags) AS reason FROM tagged) GROUP BY 1",
        "ingest_row_reasons": _TAGGED + "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, array_to_string(tags, ';') AS reason FROM tagged WHERE len(tags) > 0",
        "ingest_reconcile": _TAGGED + "SELECT count(*) AS rows_in, count(*) FILTER (len(tags) = 0) AS rows_clean, count(*) FILTER (len(tags) > 0) AS rows_quarantined, round(count(*) FILTER (len(tags) > 0) / count(*), 5) AS quarantine_frac FROM tagged",
        "encode_channels": _TAGGED
        + "SELECT l_suppkey * 3 + CASE component WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS chan, CASE component WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS comp, count(*) AS n_rows, round(sum(r), 3) AS total FROM tagged WHERE len(tags) = 0 GROUP BY 1, 2",
        "increments_by_serial": _SEQ + "SELECT chan, serial, month, round(d, 6) AS d, gap, du FROM q WHERE same AND du > 0",
        "channel_increment_stats": _UNITS
        + "SELECT chan, count(*) AS n_incr, count(DISTINCT serial) AS n_seg, round(sum(du), 3) AS sdu, round(sum(d), 4) AS sd, round(any_value(rate), 6) AS rate, round(sum((d - rate * du) * (d - rate * du)), 4) AS ve FROM i GROUP BY chan",
        "posterior": _UNITS
        + f""", k AS (SELECT chan, count(*) AS n_incr, any_value(rate) AS rate, greatest((any_value(rate) * {BETA} * sum(du) + 2 * {SIGMA} * {SIGMA} * count(DISTINCT serial)) / pow(sum(du), 2) / pow(any_value(rate), 2), 1e-4) AS v FROM i GROUP BY chan),
x AS (SELECT chan, n_incr, CASE WHEN n_incr < 2 THEN {TAU} * {TAU} ELSE 1 / (1 / ({TAU} * {TAU}) + 1 / v) END AS la_var, CASE WHEN n_incr < 2 THEN {MU} ELSE ({MU} / ({TAU} * {TAU}) + ln(rate / {BETA}) / v) / (1 / ({TAU} * {TAU}) + 1 / v) END AS la_mu FROM k)
SELECT chan, n_incr, round(la_mu, 6) AS la_mu, round(la_var, 6) AS la_var, round(CASE WHEN n_incr < 2 THEN 1 ELSE la_var / ({TAU} * {TAU}) END, 6) AS shrink, round(exp(la_mu + la_var / 2), 6) AS alpha FROM x""",
        "segments_per_channel": _SEQ + "SELECT chan, count(*) FILTER (NOT same) AS n_parts, count(*) FILTER (NOT same AND rn > 1) AS n_installs FROM q GROUP BY chan",
        "prefix_suffix_sums": _SEQ
        + """, x AS (SELECT *, CASE WHEN same AND du > 0 THEN d ELSE 0 END AS xd, CASE WHEN same AND du > 0 THEN du ELSE 0 END AS xu, CASE WHEN same AND du > 0 THEN 1 ELSE 0 END AS xn FROM q)
SELECT chan, month, round(coalesce(sum(xd) OVER w, 0), 4) AS pre_d, round(coalesce(sum(xu) OVER w, 0), 2) AS pre_u, CAST(coalesce(sum(xn) OVER w, 0) AS BIGINT) AS pre_n, round(sum(xd) OVER (PARTITION BY chan) - coalesce(sum(xd) OVER w, 0), 4) + 0.0 AS post_d
FROM x WINDOW w AS (PARTITION BY chan ORDER BY month, serial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
        "install_offset": _SEQ + f"SELECT chan, serial, month, round(reading, 4) AS reading FROM q WHERE NOT same AND rn > 1 AND abs(reading) > 5 * {SIGMA}",
        "stuck_runs": _SEQ
        + """, r AS (SELECT *, coalesce(abs(reading - pr) < 1e-9, false) AS rep FROM q), n AS (SELECT *, sum(CASE WHEN rep THEN 0 ELSE 1 END) OVER (PARTITION BY chan ORDER BY month, serial ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT run, count(*) AS n_rows FROM (SELECT CAST(sum(CASE WHEN rep THEN 1 ELSE 0 END) OVER (PARTITION BY chan, island ORDER BY month, serial ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM n) GROUP BY run""",
        "dropout_trailing": _FLEET
        + ", g AS (SELECT chan, min(month) AS first_seen, count(*) AS n_obs, least(12, 82 - min(month) + 1) AS span, count(*) FILTER (month > 70) AS recent FROM fleet GROUP BY chan) SELECT chan, first_seen, n_obs, span - recent AS missing, span - recent >= 5 AND span - recent >= 0.4 * span AS dropout FROM g",
        "usage_mean_logsd": _FLEET + "SELECT tail, round(avg(usage_hours), 6) AS usage, round(stddev_samp(ln(usage_hours)), 6) AS log_sd FROM fleet GROUP BY tail",
        "latest_reading": _FLEET + "SELECT chan, serial, month, round(reading, 4) AS reading FROM (SELECT *, row_number() OVER (PARTITION BY chan ORDER BY month DESC, serial DESC) AS k FROM fleet) WHERE k = 1",
        "threshold_quantile": _FLEET
        + f", f AS (SELECT serial, comp, max(reading) AS most FROM fleet WHERE serial < (SELECT max(serial) FROM fleet AS o WHERE o.chan = fleet.chan) GROUP BY 1, 2) SELECT comp, round(CASE WHEN count(*) >= 20 THEN quantile_cont(most, 0.97) - 1.88 * {SIGMA} END, 6) AS threshold FROM f GROUP BY comp",
        "spike_pvalue": _SEQ
        + f""", a AS (SELECT chan, serial, month, exp({MU} + {TAU} * {TAU} / 2) * {BETA} * du AS mean, exp({MU} + {TAU} * {TAU} / 2) * {BETA} * {BETA} * du + 2 * {SIGMA} * {SIGMA} AS var, d FROM q WHERE same AND du > 0),
b AS (SELECT chan, serial, month, mean * mean / var AS k, greatest(d, 0) * mean / var AS x FROM a)
SELECT chan, serial, month, round(1 - CASE WHEN x = 0 THEN 0 ELSE list_sum(list_transform(range(0, CAST(x + 10 * sqrt(x) AS BIGINT) + 60), lambda n: exp((k + n) * ln(x) - x - lgamma(k + n + 1)))) END, 6) AS p FROM b""",
        "damage_state": _FLEET
        + f""", l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chan ORDER BY month DESC, serial DESC) AS k FROM fleet) WHERE k = 1), us AS (SELECT tail, avg(usage_hours) AS usage FROM fleet GROUP BY tail),
j AS (SELECT l.*, usage, 82 - month AS age FROM l JOIN us USING (tail))
SELECT chan, CASE WHEN age > 3 THEN 'stale_reading_projected' ELSE 'reading' END AS basis, round(least(greatest(CASE WHEN age > 3 THEN reading + exp({MU} + {TAU} * {TAU} / 2) * {BETA} * usage * age ELSE reading END, 0), 0.995 * {LIMIT}), 5) AS x0, round(usage, 5) AS usage FROM j""",
        "nearest_rank": _FLEET
        + """, o AS (SELECT comp, round(reading, 4) AS x, row_number() OVER (PARTITION BY comp ORDER BY round(reading, 4)) AS r, count(*) OVER (PARTITION BY comp) AS n FROM fleet)
SELECT comp, round(avg(x), 6) AS mean, max(x) FILTER (r = greatest(1, least(n, round(0.05 * n)))) AS p05, max(x) FILTER (r = greatest(1, least(n, round(0.5 * n)))) AS p50, max(x) FILTER (r = greatest(1, least(n, round(0.95 * n)))) AS p95 FROM o GROUP BY comp""",
        "brier_by_group": _FLEET + "SELECT comp, count(*) AS n, round(avg(pow(reading / 8 - month % 2, 2)), 6) AS brier, round(var_pop(CAST(month % 2 AS DOUBLE)), 6) AS base FROM fleet GROUP BY comp",
        "confusion_matrix": _FLEET + "SELECT month % 2 AS true_class, serial % 4 AS predicted_class, count(*) AS n FROM fleet GROUP BY 1, 2",
        "conditional_coverage": _FLEET
        + ", cc AS (SELECT count(*) AS n, avg(CASE WHEN reading / 8 <= 0.05 THEN 0 WHEN reading / 8 >= 0.95 THEN 0.9 / (reading / 8) ELSE (reading / 8 - 0.05) / (reading / 8) END) AS b FROM fleet) SELECT n, round(b, 6) AS benchmark, round(sqrt(b * (1 - b) / greatest(n, 1)), 6) AS se FROM cc",
        "row_matched_recall": _FLEET + "SELECT count(*) AS planted, count(*) FILTER (hit) AS found FROM (SELECT chan, month, bool_or(reading / 8 > 0.25) AS hit FROM fleet WHERE month % 2 = 1 GROUP BY 1, 2)",
        "excluded_channels_anti": _FLEET + "SELECT chan, count(*) AS n_rows FROM fleet WHERE chan NOT IN (SELECT chan FROM fleet WHERE reading > 7.9) GROUP BY chan",
        "failed_serial_max": _FLEET + ", l AS (SELECT chan, max(serial) AS last FROM fleet GROUP BY chan) SELECT comp, serial, round(max(reading), 4) AS most FROM fleet JOIN l USING (chan) WHERE serial < last GROUP BY 1, 2",
        "tail_spine_usage_fallback": _FLEET
        + """, o AS (SELECT tail, avg(usage_hours) AS usage, stddev_samp(ln(usage_hours)) AS sd FROM fleet WHERE tail % 7 <> 3 GROUP BY tail), f AS (SELECT avg(usage) AS mu, median(sd) AS md, max(tail) AS top FROM o)
SELECT t.tail, round(coalesce(usage, mu), 6) AS usage, round(coalesce(sd, md, 0), 6) AS log_sd FROM (SELECT unnest(range(1, top + 1)) AS tail, mu, md FROM f) t LEFT JOIN o ON o.tail = t.tail""",
        "calibration_bins": _FLEET
        + "SELECT CAST(greatest(1, ceil(round(reading / 8 * 10, 9))) AS INT) AS bin, count(*) AS n, round(avg(reading / 8), 6) AS mean_p, round(avg(CAST(month % 2 AS DOUBLE)), 6) AS observed FROM fleet GROUP BY 1",
    }

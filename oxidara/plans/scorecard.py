"""A run over a fleet whose truth is known, scored against it: a row per check with its value and its bound, and tables behind them.

truth: chan, comp, alpha, fault, onset, ttf (months to failure after the last inspection, -1 beyond the horizon); corrupted: kind, tail, component, month."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oxidara.operators import forecast, scoring
from oxidara.plans.run import Result
from oxidara.operators.report import FAULT_NAMES

# Bounds of the checks, and the reason code by which each kind of corruption is found.
BETA_RATIO, SEVERITY, COVERAGE_GAP, SURVIVORS, MONTHS_INSIDE, TOTAL_SE, FALSE_ALARMS = 1.3, (0.85, 0.95), 0.06, 0.95, 13 / 18, 3.5, 0.01
RECALL, RECALL_SCALED = 0.95, 0.80
CODES = {"bad_tail": "UNKNOWN_TAIL", "bad_component": "UNKNOWN_COMP", "month_oob": "MONTH_RANGE", "usage_neg": "USAGE_NEGATIVE", "neg_reading": "READING_NEGATIVE", "dup": "DUPLICATE", "units_x10": "READING_FENCE|POINT_OUTLIER"}
#: These kinds destroy a row's identity, so they are counted by code only.
COUNTED = ("bad_tail", "bad_component", "month_oob")
Z90 = 1.645


def monthly(joined: DataFrame, horizon: int) -> DataFrame:
    """month, expected, variance, actual, inside (the 90 % band)."""
    actual = joined.where("ttf > 0").groupBy(F.col("ttf").alias("month")).agg(F.count(F.lit(1)).alias("actual"))
    rows = forecast.expected_by_month(joined).join(actual, "month", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return rows.where(F.col("month") <= horizon).withColumn("inside", F.abs(F.col("actual") - F.col("expected")) <= Z90 * F.sqrt("variance"))


def onset_errors(flags: DataFrame, truth: DataFrame) -> DataFrame:
    """Per true fault among the flagged channels: n, mean, median and largest error of the onset."""
    found = flags.where("class > 0").join(truth.where("fault > 0"), "chan").withColumn("error", F.col("onset_month") - F.col("onset"))
    return found.groupBy("fault").agg(F.count("error").alias("n"), F.avg("error").alias("mean"), F.median("error").alias("median"), F.max("error").alias("largest"))


def watch_yield(flags: DataFrame, truth: DataFrame) -> DataFrame:
    """Watched channels, those of them with a fault, and the fleet's share of faults."""
    rows = flags.join(truth, "chan").withColumn("bad", F.col("fault") > 0)
    return rows.agg(F.count_if("watch").alias("watched"), F.count_if(F.col("watch") & F.col("bad")).alias("faulty"), F.avg(F.col("bad").cast("int")).alias("base"))


def detection_power(flags: DataFrame, truth: DataFrame) -> DataFrame:
    """Per fault and component: channels, and how many of them were flagged with any class."""
    rows = truth.where("fault > 0").join(flags.select("chan", "class"), "chan", "left")
    return rows.groupBy("fault", "comp").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("class") > 0).alias("flagged"))


def recall(screened: DataFrame, corrupted: DataFrame) -> DataFrame:
    """kind, planted, found: rows that keep their identity are matched by it, the others counted by their code."""
    tagged = screened.where(F.size("reasons") > 0).select("tail", "component", F.col("month").cast("int").alias("month"), F.array_join("reasons", ";").alias("reason"))
    out = None
    for kind, code in CODES.items():
        hit, planted = tagged.where(F.col("reason").rlike(code)), corrupted.where(F.col("kind") == kind)
        if kind in COUNTED:
            row = planted.agg(F.count(F.lit(1)).alias("planted")).crossJoin(hit.agg(F.count(F.lit(1)).alias("found")))  # one row each
        else:
            row = scoring.matched_recall(hit, planted, ["tail", "component", "month"])
        row = row.select(F.lit(kind).alias("kind"), "planted", "found")
        out = row if out is None else out.unionByName(row)
    return out


def details(truth: DataFrame, result: Result, limits: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables that the checks rest on, each of a few rows.  limits: comp, threshold as they truly are."""
    t = result.tables
    joined = t["forecasts"].join(truth.select("chan", "ttf", F.col("fault").alias("true_fault")), "chan").withColumn("y", (F.col("ttf") > 0).cast("int"))
    severity = t["units"].join(truth.select("chan", "fault", F.col("alpha").alias("true_alpha")), "chan").withColumn("miss", F.abs(F.log("true_alpha") - F.col("la_mu")) / F.sqrt("la_var"))
    out = {
        "severity_coverage": severity.groupBy("fault").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("miss") < Z90).cast("int")).alias("share")),
        "calibration": forecast.calibration(joined, "pfail", "y"),
        "brier_by_basis": scoring.brier(joined, "pfail", "y", ["basis"]),
        "confusion": scoring.confusion(t["flags"].join(truth.select("chan", "fault"), "chan"), "fault", "class"),
        "onset_errors": onset_errors(t["flags"], truth),
        "power": detection_power(t["flags"], truth),
        "watch": watch_yield(t["flags"], truth),
    }
    if limits is not None:
        out["thresholds"] = t["thresholds"].join(limits.select("comp", F.col("threshold").alias("true_threshold")), "comp")
    return out


def drift(before: DataFrame, after: DataFrame, rtol: float = 1e-6) -> DataFrame:
    """Rows of two scorecards (name, value) that do not agree: a name that only one has, whole numbers that differ, or other values further apart than rtol."""
    both = before.select("name", F.col("value").alias("before"), F.lit(True).alias("_b")).join(after.select("name", F.col("value").alias("after"), F.lit(True).alias("_a")), "name", "full")
    whole = (F.col("before") == F.floor("before")) & (F.col("after") == F.floor("after"))
    same = F.col("before").eqNullSafe(F.col("after")) | ~whole & (F.abs(F.col("before") - F.col("after")) <= 1e-9 + rtol * F.greatest(F.abs("before"), F.abs("after")))
    return both.where(F.col("_a").isNull() | F.col("_b").isNull() | ~F.coalesce(same, F.lit(False))).drop("_a", "_b")


def score(truth: DataFrame, corrupted: DataFrame, result: Result, betas: dict[str, float], horizon: int) -> DataFrame:
    """name, value, least, most, passed.  betas: true scale of each component, in catalogue order.  Every aggregate is one row, or one for each
    component, month or kind."""
    t, found = result.tables, []
    spark = t["ledger"].sparkSession

    def check(name: str, value: float | None, least: float = -math.inf, most: float = math.inf) -> None:
        value = math.nan if value is None else float(value)
        found.append((name, value, float(least), float(most), least <= value <= most))

    for row in t["comps"].orderBy("comp").collect():
        code, beta = list(betas.items())[row["comp"] - 1]
        check(f"beta of {code} over truth", (row["beta"] or math.nan) / beta, 1 / BETA_RATIO, BETA_RATIO)
    healthy = t["units"].join(truth.where("fault = 0").select("chan", F.col("alpha").alias("true_alpha")), "chan")
    inside = F.abs(F.log("true_alpha") - F.col("la_mu")) < Z90 * F.sqrt("la_var")
    check("severity coverage, healthy channels", healthy.agg(F.avg(inside.cast("int"))).first()[0], *SEVERITY)
    joined = t["forecasts"].join(truth.select("chan", "ttf", F.col("fault").alias("true_fault")), "chan").withColumn("y", (F.col("ttf") > 0).cast("int"))
    bad = [F.col(c).isNull() | F.isnan(c) for c in ("p05", "p50", "p95", "pfail")]
    check("NaN in forecasts", joined.agg(F.count_if(bad[0] | bad[1] | bad[2] | bad[3])).first()[0], most=0)
    row = scoring.brier(joined, "pfail", "y", []).first()
    check("brier less that of the base rate", row["brier"] - row["base"], most=0)
    failed = joined.where("ttf > 0")
    covered = scoring.coverage(failed, "ttf", "p05", "p95", []).first()["share"]
    benchmark = scoring.conditional_coverage(failed, "pfail").first()["benchmark"]
    check("coverage of failures less its benchmark", (covered or 0) - (benchmark or 0), -COVERAGE_GAP)
    # the truth counts whole months, and a quantile of the month that a moment lies in is the month of the moment's quantile
    whole = failed.withColumns({c: F.when(F.col(c) < math.inf, F.ceil(c)).otherwise(F.lit(math.inf)) for c in ("p05", "p95")})
    covered = scoring.coverage(whole, "ttf", "p05", "p95", []).first()["share"]
    check("coverage of failures in whole months less its benchmark", (covered or 0) - (benchmark or 0), -COVERAGE_GAP)
    check("survivors whose p95 lies beyond", joined.where("ttf < 0").agg(F.avg((F.col("p95") > horizon).cast("int"))).first()[0], SURVIVORS)
    months = monthly(joined, horizon)
    row = months.agg(F.avg(F.col("inside").cast("int")).alias("inside"), (F.abs(F.sum("expected") - F.sum("actual")) / F.sqrt(F.sum("variance"))).alias("se")).first()
    check("share of months inside the band", row["inside"], MONTHS_INSIDE)
    check("standard errors of all failures", row["se"], most=TOTAL_SE)
    flagged = t["flags"].join(truth.select("chan", F.col("fault").alias("true_fault")), "chan")
    check("false alarms on healthy channels", flagged.where("true_fault = 0").agg(F.avg((F.col("class") > 0).cast("int"))).first()[0], most=FALSE_ALARMS)
    caught = joined.join(t["flags"].select("chan", (F.col("class") > 0).alias("caught")), "chan").where("true_fault > 0")
    scores = {(r["true_fault"], r["caught"]): (r["brier"], r["n"]) for r in scoring.brier(caught, "pfail", "y", ["true_fault", "caught"]).collect()}
    for name in ("accelerated", "dropout"):
        yes, no = (scores.get((FAULT_NAMES.index(name), c)) for c in (True, False))
        if yes and no and min(yes[1], no[1]) >= 5:
            check(f"brier of caught {name} less that of missed", yes[0] - no[0], most=0)
    row = result.header["ingest"]
    check("rows lost by ingest", row["rows_in"] - row["rows_clean"] - row["rows_quarantined"], 0, 0)
    for row in recall(t["screened"], corrupted).collect():
        if row["planted"]:
            check(f"recall of {row['kind']}", row["found"] / row["planted"], RECALL_SCALED if row["kind"] == "units_x10" else RECALL)
    return spark.createDataFrame(found, "name string, value double, least double, most double, passed boolean")


def text(card: DataFrame, tables: dict[str, DataFrame], head: dict) -> str:
    """The scorecard as a report: run identity (section 0, which comparisons leave out), the checks, and the tables behind them; a few rows each."""
    lines = ["== 0. Identity of the run ==", *[f"  {k}: {v}" for k, v in sorted(head.get("identity", {}).items())], "", "== 1. Checks =="]
    rows = card.orderBy("name").collect()
    lines += [f"  {'ok  ' if r['passed'] else 'FAIL'} {r['name']}: {_said(r['value'])} (from {_said(r['least'])} to {_said(r['most'])})" for r in rows]
    for i, (name, frame) in enumerate(sorted(tables.items()), 2):
        lines += ["", f"== {i}. {name.replace('_', ' ')} ==", "  " + " ".join(frame.columns)]
        lines += ["  " + " ".join(_said(x) for x in r) for r in frame.orderBy(*frame.columns).collect()]
    passed = sum(r["passed"] for r in rows)
    return "\n".join([*lines, "", f"== {len(tables) + 2}. Result ==", f"  {passed} of {len(rows)} checks passed", ""])


def _said(value) -> str:
    return f"{value:.6f}" if isinstance(value, float) and math.isfinite(value) and value != int(value) else f"{int(value)}" if isinstance(value, float) and math.isfinite(value) else str(value)

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from oxidara.functions import special
from oxidara.operators import faults, forecast, ingest, wear
from oxidara.plans import catalog

DATA = "/root/testdata/sf0.001"


def frame(spark, change=None):
    rows = []
    for t in range(2):
        for k, c in enumerate(("A1", "B2")):
            for m in range(40):
                rows.append({"tail": f"T000{t}", "component": c, "serial": str(10 * t + k), "month": str(m), "usage_hours": "40.0", "reading": str(round(0.1 * (m + 1), 3)), "row": len(rows)})
    rows = change(rows) if change else rows
    roster = spark.createDataFrame([("T0000",), ("T0001",)], "tail string")
    made = spark.createDataFrame([tuple(r.values()) for r in rows], "tail string, component string, serial string, month string, usage_hours string, reading string, row int")
    return ingest.screen(made, roster, ["A1", "B2"], 40, ["row"])


def set_at(i, **values):
    return lambda rows: [r | values if r["row"] == i else r for r in rows]


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        (None, []),
        (set_at(5, tail="T9999"), ["UNKNOWN_TAIL"]),
        (set_at(5, component="ZZ"), ["UNKNOWN_COMP"]),
        (set_at(5, month="99"), ["MONTH_RANGE"]),
        (set_at(5, usage_hours="-1"), ["USAGE_NEGATIVE"]),
        (set_at(5, usage_hours="inf"), ["USAGE_NONFINITE;USAGE_FENCE"]),
        (set_at(5, usage_hours="x"), ["TYPE;USAGE_NONFINITE"]),
        (set_at(5, usage_hours="745"), ["USAGE_FENCE"]),
        (set_at(5, reading="-5"), ["READING_NEGATIVE"]),
        (set_at(5, reading="3d"), ["TYPE"]),
        (set_at(5, reading="NaN"), ["TYPE"]),
        (set_at(5, reading="n/a", month="?"), ["TYPE;TYPE"]),
        (set_at(5, month="3.7"), ["TYPE"]),
        (set_at(20, reading="21"), ["POINT_OUTLIER"]),
        (set_at(0, reading="21"), []),
        (lambda rows: [*rows, rows[3] | {"row": 999}], ["DUPLICATE"]),
    ],
)
def test_reasons(spark, change, expected):
    screened = frame(spark, change)
    assert [r["reason"] for r in ingest.quarantine(screened).collect()] == expected
    row = ingest.reconcile(screened).first()
    assert row["rows_in"] == row["rows_clean"] + row["rows_quarantined"] and row["rows_quarantined"] == len(expected)


def test_refusal(spark):
    bad = frame(spark, lambda rows: [r | {"tail": "T9"} if r["row"] < 40 else r for r in rows])
    with pytest.raises(ingest.Refused):
        ingest.refuse(ingest.reconcile(bad))
    with pytest.raises(ingest.Refused):
        ingest.screen(spark.range(3).select(F.col("id").alias("tail")), spark.range(1).select(F.col("id").alias("tail")), [], 1, ["tail"])


def test_gamma_p():
    a, x = np.array([1.0, 2.0, 0.5]), np.array([1.0, 3.0, 0.25])
    assert np.allclose(special.gamma_p(a, x), [1 - math.exp(-1), 1 - 4 * math.exp(-3), math.erf(0.5)], atol=1e-13)


@pytest.mark.parametrize(
    ("x0", "limit", "alpha", "tau", "beta", "usage", "pfail", "quantiles"),
    [(6.7365, 8.481, 0.00562489, 0.444, 0.8577, 23.27, 0.4681, (3.9, 19.13, 57.97)), (2.5981, 6.943, 0.04513668, 0.475, 0.0987, 38.88, 0.1860, (12.36, 28.1, 63.65))],
)
def test_published_forecasts(x0, limit, alpha, tau, beta, usage, pfail, quantiles):
    args = ([x0], [math.log(alpha) - tau * tau / 2], [tau * tau], [beta], [limit], [usage])
    assert abs(special.failure_cdf(*args, [18.0])[0, 0] - pfail) < 1e-3
    assert np.allclose(special.failure_quantiles(*args)[0], quantiles, atol=0.05)
    with pytest.raises(ValueError):
        special.failure_cdf([float("nan")], *args[1:], [18.0])


def test_fit_recovers_known_parameters(spark):
    r = np.random.default_rng(3)
    rows = []
    for tail in range(1, 201):
        alpha, usage, x = math.exp(math.log(0.02) + 0.4 * r.standard_normal()), 40 * math.exp(0.35 * r.standard_normal()), 0.0
        for m in range(48):
            u = usage * math.exp(0.15 * r.standard_normal())
            x += 0.3 * r.gamma(alpha * u)
            rows.append((tail, 1, tail, m, u, x + 0.2 * r.standard_normal()))
    made = spark.createDataFrame(rows, "tail int, comp int, serial bigint, month int, usage_hours double, reading double")
    comps, units = wear.fit(wear.sequence_columns(wear.with_channel(made, 1)))
    row = comps.first()
    assert abs(row["beta"] - 0.3) < 0.06 and abs(row["sigma"] - 0.2) < 0.05 and abs(row["tau"] - 0.4) < 0.1 and abs(row["mu"] - math.log(0.02)) < 0.15
    assert units.count() == 200


def test_availability(spark):
    units = spark.range(1, 51).select("id", F.col("id").alias("chan"), F.col("id").alias("tail"), F.lit(1).alias("comp"), *[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("la_mu", math.log(0.02)), ("la_var", 0.01), ("beta", 0.3), ("threshold", 5.0), ("usage", 40.0), ("log_sd", 0.2))])
    repair = (0.3, 0.4, 0.9, 2.0)
    lived = forecast.lives(units, 12, 20, 1, repair).cache()
    rows = {r["month"]: r for r in forecast.replicate_quantiles(forecast.availability(lived, 50), ["month"], "available", {"p05": 0.05, "p95": 0.95}).collect()}
    assert len(rows) == 12 and rows[1]["mean"] == 1.0 and all(r["p05"] <= r["mean"] <= r["p95"] for r in rows.values())
    again = forecast.lives(units.repartition(7), 12, 20, 1, repair)  # draws don't depend on where a unit is
    assert lived.exceptAll(again).isEmpty() and again.exceptAll(lived).isEmpty()
    with pytest.raises(Exception, match="wear is not a positive number"):
        forecast.lives(units.withColumn("usage", F.lit(0.0)), 12, 20, 1, repair).count()


def test_lives_by_hand():
    """The vectorised months against a loop over one unit's replicates."""
    import pandas as pd

    pdf = pd.DataFrame({"chan": [5, 9], "x0": [0.5, 3.0], "la_mu": [math.log(0.02)] * 2, "la_var": [0.1, 0.0], "beta": [0.3, 0.5], "threshold": [4.0, 5.0], "usage": [40.0, 60.0], "log_sd": [0.2, 0.0]})
    down, failed = forecast.unit_lives(pdf, 12, 6, 1, (0.3, 0.4, 0.5, 2.0))
    for i, row in enumerate(pdf.itertuples()):
        r = np.random.default_rng([1, row.chan])
        alpha = np.exp(row.la_mu + np.sqrt(row.la_var) * r.standard_normal(6))
        grown = row.beta * r.gamma(alpha[:, None] * row.usage * np.exp(row.log_sd * r.standard_normal((6, 12))))
        wait = r.lognormal(0.3, 0.4, (6, 12)) + 2.0 * (r.random((6, 12)) > 0.5)
        for k in range(6):
            x, until = row.x0, 0
            for m in range(1, 13):
                hit = False
                if until < m:
                    x += grown[k, m - 1]
                    hit = x >= row.threshold
                    if hit:
                        until, x = m + math.ceil(wait[k, m - 1]), 0.0
                assert failed[i, k, m - 1] == hit and down[i, k, m - 1] == (until >= m)


def test_quantiles_by_bisection():
    r = np.random.default_rng(4)
    args = [r.uniform(0, 7.8, 40), r.normal(-1, 1, 40), r.uniform(0, 0.5, 40), r.uniform(0.05, 1, 40), np.full(40, 7.9), r.uniform(1, 60, 40)]
    found = special.failure_quantiles(*args)
    for j, p in enumerate((0.05, 0.5, 0.95)):
        low, high = np.zeros(40), np.full(40, 72.0)
        for _ in range(40):
            middle = (low + high) / 2
            below = special.failure_cdf(*args, middle[:, None])[:, 0] < p
            low, high = np.where(below, middle, low), np.where(below, high, middle)
        beyond = special.failure_cdf(*args, [72.0])[:, 0] < p
        assert (np.isinf(found[:, j]) == beyond).all() and np.abs(found[:, j] - low)[~beyond].max() < 1e-5


def test_ranks(spark):
    from oxidara.operators import ranks

    r = np.random.default_rng(5)
    values = {g: np.round(r.normal(size=n), 1) for g, n in (("a", 1), ("b", 2), ("c", 997))}
    rows = spark.createDataFrame([(g, float(x)) for g, v in values.items() for x in v], "g string, x double").repartition(5)
    for row in ranks.interpolated(rows, ["g"], "x", 0.97).collect():
        assert row["n"] == len(values[row["g"]]) and abs(row["x"] - np.quantile(values[row["g"]], 0.97)) < 1e-9
    for row in ranks.nearest_rank(rows, ["g"], "x", {"lo": 0.05, "hi": 0.95}).collect():
        v = np.sort(values[row["g"]])
        assert [row["lo"], row["hi"]] == [v[int(min(max(math.floor(p * len(v) + 0.5), 1), len(v))) - 1] for p in (0.05, 0.95)] and abs(row["mean"] - v.mean()) < 1e-9


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_catalog_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    con.execute(catalog.oracle_sql()[name])
    columns = [x[0] for x in con.description]
    expected = sorted(map(str, con.fetchall()))
    assert sorted(str(tuple(row)) for row in catalog.queries()[name](spark, DATA).select(*columns).collect()) == expected


def test_isolation_of_planted_faults(spark):
    """One channel of each class, with its onset; the first row is a candidate as well."""
    r = np.random.default_rng(6)
    beta, sigma, rate, hours = 0.05, 0.05, 0.45, 10.0
    rows = []
    for chan in range(1, 8):
        steps = beta * r.gamma(rate * hours, size=60)
        if chan == 2:
            steps[31:] *= 2.2  # wears faster
        seen = np.cumsum(steps)
        if chan == 3:
            seen[30:] *= 1.3  # a scale error: a jump, then faster
        if chan == 4:
            seen[40:] = seen[40]
        if chan == 5:
            seen[30:] += 1.2  # a step
        if chan == 7:
            seen = np.cumsum(steps * 4)  # fast from the first row on
        for m in range(60):
            if chan != 6 or m < 45 or m % 4 == 0:
                rows.append((chan, 1, chan, chan, m, hours, float(seen[m])))
    made = spark.createDataFrame(rows, "chan bigint, comp int, tail int, serial bigint, month int, usage_hours double, reading double")
    rows = wear.sequence_columns(made)
    for name, value in (("alpha", rate), ("beta", beta), ("sigma", sigma), ("mu", math.log(rate)), ("tau", 0.1)):
        rows = rows.withColumn(name, F.lit(value))
    found = {x["chan"]: x for x in faults.isolate(rows, spark.range(1, 9).select(F.col("id").alias("chan")), 60).collect()}
    assert [found[c]["class"] for c in range(1, 9)] == [0, 5, 2, 3, 1, 4, 5, 0]
    assert found[3]["onset_month"] == 30 and found[4]["onset_month"] == 40 and found[5]["onset_month"] == 30 and found[6]["onset_month"] == 48
    assert abs(found[2]["onset_month"] - 31) <= 3 and found[7]["onset_month"] <= 3 and found[8]["n_obs"] == 0
    assert {x["month"] for x in faults.change_points(rows).where("chan = 1").collect()} == set(range(0, 54, 3))

"""Sums and ranks that must hold for many rows and for values far from zero."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from oxidara.operators import forecast, ranks, wear


@pytest.mark.parametrize("far", [-10.0, -1e6])
def test_prior_likelihood_without_cancellation(spark, far):
    """A million units around a far la: tau2 and mu as by sums in two passes of the same rows."""
    n = 1_000_000 if far == -10.0 else 20_000
    spread = 0.3
    # two halves of units around far: their exact spread is known, the values themselves are made in Spark
    units = spark.range(n, numPartitions=8).select(F.lit(1).alias("comp"), (F.lit(far) + spread * F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0) + 0.1 * (F.col("id") % 7 - 3)).alias("la"), (0.01 + 0.002 * (F.col("id") % 5)).alias("v"))
    got = wear.eb_prior(units).first()
    k = np.arange(70)  # all combinations of the remainders, in equal numbers but for the last n % 70
    la, v = spread * np.where(k % 2 == 0, 1.0, -1.0) + 0.1 * (k % 7 - 3), 0.01 + 0.002 * (k % 5)
    times = np.full(70, n // 70) + (k < n % 70)
    best = None
    for tau2 in wear.tau_grid():
        w = times / (tau2 + v)
        mu = (w * la).sum() / w.sum()
        ll = -0.5 * (times * np.log(tau2 + v)).sum() - 0.5 * (w * (la - mu) ** 2).sum()
        if best is None or ll > best[0]:
            best = (ll, tau2, mu)
    assert got["tau2"] == best[1] and got["mu"] - far == pytest.approx(best[2], abs=1e-9)


@pytest.mark.parametrize("few", [4096, 1])
def test_order_statistics(spark, monkeypatch, few):
    """Spread out, heaped, equal, huge and infinite values: as sorting gives them."""
    monkeypatch.setattr(ranks, "FEW_VALUES", few)
    r = np.random.default_rng(2)
    for values in (r.normal(size=3000), np.concatenate([np.full(2500, 1.5), r.normal(size=300), [1e300, -1e300]]), np.full(50, 7.0), 10 ** r.uniform(-300, 300, 500), np.array([math.inf, -math.inf, 1.0, 2.0, 1.7e308, -1.7e308, 5e-324, 0.0]), np.array([3.0]), np.array([1.0, np.nextafter(1.0, 2), np.nextafter(1.0, 2), 2.0])):
        frame = spark.createDataFrame([(float(x),) for x in values] + [(None,), (math.nan,)], "x double").repartition(3)
        wanted = lambda n: [1, max(1, n // 3), n]
        assert ranks.order_statistics(frame, "x", wanted) == [float(np.sort(values)[k - 1]) for k in wanted(len(values))]
    assert ranks.whole_median(spark.createDataFrame([(x,) for x in (4.0, 1.0, 3.0, 10.0)], "x double"), "x") == 3.5
    assert ranks.whole_median(spark.createDataFrame([(None,)], "x double"), "x") is None


def test_dense_usage_reads_all_aircraft_in_no_task(spark):
    """Gaps get the mean and the median; the plan has no exchange to a single partition."""
    rows = spark.createDataFrame([(t, 40.0 + t * (1 + i)) for t in (1, 2, 5, 6) for i in range(3)] + [(8, 10.0)], "tail int, usage_hours double")
    found = forecast.dense_usage(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "BroadcastNestedLoopJoin" not in plan and "percentile" not in plan
    got = {r["tail"]: (r["usage"], r["log_sd"]) for r in found.collect()}
    own = {t: ([40.0 + t * (1 + i) for i in range(3)] if t != 8 else [10.0]) for t in (1, 2, 5, 6, 8)}
    sd = {t: float(np.std(np.log(u), ddof=1)) for t, u in own.items() if len(u) > 1}
    mean, median = float(np.mean([np.mean(u) for u in own.values()])), float(np.median(list(sd.values())))
    assert set(got) == set(range(1, 9))
    for t, (usage, log_sd) in got.items():
        assert usage == pytest.approx(np.mean(own[t]) if t in own else mean) and log_sd == pytest.approx(sd.get(t, median))

"""The incomplete gamma function as columns against its version for arrays, and against itself."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from oxidara.functions import special
from oxidara.operators import faults
from oxidara.plans import catalog


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(4)
    a = np.concatenate([10 ** r.uniform(-6, 5, 1500), [0.5, 1.0, 2.0, 1e-6, 1e5]])
    x = a * 10 ** r.uniform(-1, 1, len(a)) + r.choice([0, 1, 5], len(a))
    near = r.random(len(a)) < 0.5  # where both expansions are slowest
    x[near] = (a + 1 + np.sqrt(a) * r.normal(size=len(a)) * 0.5)[near].clip(1e-9)
    return spark.createDataFrame([(float(p), float(q)) for p, q in zip(a, x, strict=True)], "a double, x double")


def test_columns_equal_arrays(points):
    got = points.select("a", "x", special.gammainc(F.col("a"), F.col("x")).alias("p"), special.gammaincc(F.col("a"), F.col("x")).alias("q"), F.expr("ln_gamma(a)").alias("g")).toPandas()
    a, x = got["a"].to_numpy(), got["x"].to_numpy()
    known = special.gamma_p(a, x)
    # a * log(x) is rounded before it goes into an exponential
    assert (np.abs(got["p"] - known) < 1e-13 + 3e-15 * a).all() and np.abs(got["p"] + got["q"] - 1).max() < 1e-13
    assert np.allclose(got["g"], [math.lgamma(v) for v in a], rtol=1e-12, atol=1e-12)
    small = got["q"].between(1e-290, 1e-3) & (a < 100) & (x >= a + 1)  # the upper tail keeps its digits
    assert small.sum() > 20
    for i in np.flatnonzero(small)[:200]:
        assert got["q"][i] == pytest.approx(float(special._fraction(a[i : i + 1], x[i : i + 1])[0]), rel=1e-9)


def test_exponential_and_normal_cases(spark):
    """Q(1, x) is exp(-x), P(1/2, x) is erf(sqrt(x)), Q(n, x) a Poisson sum."""
    rows = spark.createDataFrame([(x,) for x in (1e-8, 0.1, 0.9999, 1.5, 2.0, 3.0, 30.0, 200.0)], "x double")
    special.register(spark)
    for r in rows.selectExpr("x", "gammaincc(1D, x) AS e", "gammainc(0.5D, x) AS n", "gammaincc(5D, x) AS p").collect():
        x = r["x"]
        assert r["e"] == pytest.approx(math.exp(-x), rel=1e-13)
        assert r["n"] == pytest.approx(math.erf(math.sqrt(x)), rel=1e-13)
        assert r["p"] == pytest.approx(math.exp(-x) * sum(x**k / math.factorial(k) for k in range(5)), rel=1e-12)


def test_odd_arguments(spark):
    inf, nan = float("inf"), float("nan")
    cases = [(1.0, 0.0, 0.0), (1.0, inf, 1.0), (0.0, 1.0, nan), (-1.0, 1.0, nan), (nan, 1.0, nan), (1.0, nan, nan), (1.0, -1.0, nan), (None, 1.0, None), (1.0, None, None), (inf, 1.0, nan)]
    special.register(spark)
    for a, x, want in cases:
        got = spark.createDataFrame([(a, x)], "a double, x double").selectExpr("gammainc(a, x) AS p").first()["p"]
        assert got == want or (want is not None and math.isnan(want) and math.isnan(got)), (a, x)


def test_failure_cdf(spark):
    r = np.random.default_rng(6)
    rows = [(float(r.uniform(0, 7)), float(r.normal(-3, 0.5)), float(r.uniform(0, 0.4)), float(r.uniform(0.05, 0.5)), 8.0, float(r.uniform(20, 80)), float(t)) for t in (0, 1, 6, 18, 72) for _ in range(30)]
    special.register(spark)
    names = ("x0", "la_mu", "la_var", "beta", "threshold", "usage", "t")
    got = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).selectExpr("*", f"rul_cdf({', '.join(names)}) AS p").toPandas()
    known = special.failure_cdf(*(got[c].to_numpy() for c in names[:-1]), got["t"].to_numpy()[:, None])[:, 0]
    assert np.abs(got["p"] - known).max() < 1e-10
    bad = spark.createDataFrame([(float("nan"), 1.0, 0.1, 0.1, 8.0, 50.0, 1.0)], ", ".join(f"{c} double" for c in names))
    with pytest.raises(Exception, match="non-finite forecast input"):
        bad.selectExpr(f"rul_cdf({', '.join(names)})").collect()


@pytest.mark.parametrize("name", ["spike_pvalue", "changepoint_scan", "fault_isolation", "flag_histogram"])
def test_no_python_in_the_plan(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "Python" not in plan and "InArrow" not in plan


def test_spikes_keep_small_probabilities(spark):
    rows = spark.createDataFrame([(30.0, 10.0, 0.5, 0.05, 0.2)], "d double, du double, alpha double, beta double, sigma double")
    p = faults.spikes(rows).first()["p_spike"]
    assert 0 < p < 1e-30

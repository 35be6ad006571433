"""Work of the forecast queries: each step once, quantiles only where they are asked for, probabilities to rounding."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oxidara.functions import special
from oxidara.operators import faults, forecast, wear
from oxidara.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_ledger_isolates_faults_once(spark, monkeypatch):
    calls = []
    read, isolate = catalog.sequenced, faults.isolate
    monkeypatch.setattr(catalog, "sequenced", lambda *a: calls.append("read") or read(*a))
    monkeypatch.setattr(faults, "isolate", lambda *a: calls.append("isolate") or isolate(*a))
    plan = catalog.q_ledger(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(calls) == ["isolate", "read"]
    assert "seg_before" not in plan  # the scan is in no plan that is still to run


def _never(*_):
    raise AssertionError("quantiles are sought")


@pytest.mark.parametrize("name", ["rul_cdf_monthly", "expected_failures", "fleet_totals"])
def test_monthly_probabilities_seek_no_quantile(spark, monkeypatch, name):
    monkeypatch.setattr(forecast, "forecast", _never)
    assert catalog.queries()[name](spark, DATA).count()


def test_rul_computes_no_other_month(spark, monkeypatch):
    monkeypatch.setattr(forecast, "forecast", _never)
    assert catalog.q_rul(spark, DATA).count()


def test_state_keeps_a_row_per_channel_only(spark, monkeypatch):
    kept, settle = [], catalog.settle
    monkeypatch.setattr(catalog, "settle", lambda frame: kept.append(frame) or settle(frame))
    state = catalog._whole_state(spark, DATA)
    assert [f.count() for f in kept] == [state.count()]
    assert "lineitem" not in state._jdf.queryExecution().optimizedPlan().toString()


def test_fused_state_is_that_of_its_steps(spark):
    """A serial that comes back later, and a channel without increments."""
    seen = [(1, "a", 0), (1, "a", 1), (1, "b", 2), (1, "b", 3), (1, "a", 4), (1, "a", 6), (2, "c", 5), (3, "d", 0), (3, "d", 9)]
    rows = wear.sequence_columns(spark.createDataFrame([(c, c, 1, s, m, 10.0 + m, float(m)) for c, s, m in seen], "chan bigint, tail int, comp int, serial string, month int, usage_hours double, reading double"))
    also = forecast.last_row() | wear.increment_sums()
    found = {r["chan"]: r for r in faults.isolate(catalog._with_params(rows), None, 10, also).select("chan", *also).collect()}
    assert {c: (r["serial"], r["month"], r["installed"]) for c, r in found.items()} == {1: ("a", 6, 0), 2: ("c", 5, 5), 3: ("d", 9, 0)}
    sums = {r["chan"]: r for r in wear.unit_stats(wear.increments(rows)).collect()}
    assert {c for c, r in found.items() if r["n_incr"]} == set(sums) == {1, 3} and found[2]["n_incr"] == 0
    assert all(found[c][k] == sums[c][k] for c in sums for k in ("n_incr", "n_seg", "sdu", "sd")) and found[1]["n_seg"] == 2


def test_top_risk_seeks_quantiles_of_its_rows_only(spark, monkeypatch):
    whole, seen = forecast.forecast, []
    wanted = whole(catalog._whole_state(spark, DATA), catalog.HORIZON).orderBy(F.desc(F.round("pfail", 5)), "chan").limit(catalog.TOP).select("chan", F.round("pfail", 5)).collect()
    monkeypatch.setattr(forecast, "forecast", lambda state, horizon: seen.append(state.count()) or whole(state, horizon))
    found = catalog.flagship(spark, DATA).select("chan", "pfail").collect()
    assert [tuple(r) for r in found] == [tuple(r) for r in wanted] and seen == [len(wanted)]


def _units(n):
    r = np.random.default_rng(3)
    return r.uniform(0, 7.9, n), r.normal(-0.8, 0.3, n), r.choice([0.0, 0.001, 0.04, 0.5], n), r.uniform(0.01, 0.9, n), np.full(n, 7.9), r.choice([0.0, 5.0, 27.0, 300.0], n)


def test_probabilities_are_the_whole_mixture(monkeypatch):
    units = _units(300)
    t = np.array([0.0, 1.0, 9.0, 18.0, 72.0])
    x0, la_mu, la_var, beta, limit, usage = units
    nodes, weights = special.hermite()
    shape = (np.exp(la_mu[:, None] + np.sqrt(2 * la_var)[:, None] * nodes) * usage[:, None])[:, None, :] * t[:, None]
    margin = np.broadcast_to((np.maximum(limit - x0, 1e-9) / beta)[:, None, None], shape.shape)
    p = np.where(shape > 0, special.gamma_p(np.where(shape > 0, shape, 1.0), margin), 1.0)
    computed, expand = [], special._tails
    monkeypatch.setattr(special, "_tails", lambda a, *rest: computed.append(len(a)) or expand(a, *rest))
    found = special.failure_cdf(*units, t)
    assert np.abs(found - np.clip(1 - p @ weights, 0, 1)).max() < 1e-11
    assert sum(computed) < p.size / 2  # most are zero or one to rounding
    few = special.failure_cdf(*(c[7:10] for c in units), t)
    assert (few == found[7:10]).all()  # equal units get equal bits in any batch


def test_quantiles_are_those_of_the_probabilities(monkeypatch):
    units, probs = _units(400), np.array([0.05, 0.5, 0.95])
    computed, expand = [], special._tails
    monkeypatch.setattr(special, "_tails", lambda a, *rest: computed.append(len(a)) or expand(a, *rest))
    found = special.failure_quantiles(*units)
    assert sum(computed) < 450 * len(found)  # 700 by false position, and 210 for the months
    for j, p in enumerate(probs):
        fine = np.isfinite(found[:, j])
        assert fine.any() and np.abs(special.failure_cdf(*(c[fine] for c in units), found[fine, j][:, None])[:, 0] - p).max() < 1e-9
        assert (special.failure_cdf(*(c[~fine] for c in units), [72.0]) < p).all()
    monthly = special.failure_cdf(*units, np.arange(1, 19))
    for known in (monthly, monthly[:, -1:]):
        again = special.failure_quantiles(*units, monthly=known)
        fine = np.isfinite(found)
        assert (np.isfinite(again) == fine).all() and np.abs(again[fine] - found[fine]).max() < 1e-8
    odd = [np.array(c) for c in ([7.9, 0.0, 0.0], [-0.8, -0.8, -60.0], [0.0, 0.0, 0.1], [0.05] * 3, [7.9] * 3, [27.0, 0.0, 27.0])]  # at its limit, unused, hardly worn
    edge = special.failure_quantiles(*odd)
    assert np.isinf(edge[1:]).all() and np.abs(special.failure_cdf(*(c[:1] for c in odd), edge[:1])[0] - probs).max() < 1e-6


@pytest.mark.parametrize("a", [1e-4, 0.3, 1.0, 15.0, 25.0, 300.0])
def test_absolute_probabilities(a):
    x = a * np.geomspace(1e-3, 30, 500)
    assert np.abs(special._gamma_p_absolute(np.full(500, a), x) - special.gamma_p(np.full(500, a), x)).max() < 1e-12


def test_only_spikes_are_the_spikes(spark):
    r = np.random.default_rng(4)
    rows = [(i, float(r.choice([0.5, 0.9, 1.2, 1.6, 2.0, 3.0, 8.0])), float(r.choice([0.1, 5.0, 30.0, 90.0])), 0.46, 0.05, 0.2) for i in range(400)]
    frame = spark.createDataFrame([*rows, (400, 9.0, 30.0, None, 0.05, 0.2)], "i int, d double, du double, alpha double, beta double, sigma double")
    wanted = {r["i"] for r in faults.spikes(frame).where("spike").collect()}
    assert 0 < len(wanted) < 400 and {r["i"] for r in faults.only_spikes(frame).collect()} == wanted


def test_candidates_without_p_do_not_count(spark):
    rows = spark.createDataFrame([(1, 1, 0, 0.2), (1, 4, 3, None), (2, 1, 0, None)], "chan int, rn int, month int, p double")
    assert [(r["chan"], r["p_min"], r["onset"], r["p_corrected"]) for r in faults.persistence(rows).collect()] == [(1, 0.2, 0, 0.2)]

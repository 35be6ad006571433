"""The regularised incomplete gamma function and what is built on it: for Arrow batches, and as SQL functions that stay in the JVM."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

# Lanczos approximation of the gamma function, g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(a: np.ndarray) -> np.ndarray:
    """log of the gamma function for a > 0."""
    a = np.asarray(a, dtype=np.float64)
    small = a < 0.5
    z = np.where(small, 1 - a, a) - 1
    total = _LANCZOS[0] + sum(c / (z + i) for i, c in enumerate(_LANCZOS[1:], 1))
    t = z + 7.5
    out = 0.5 * np.log(2 * np.pi) + (z + 0.5) * np.log(t) - t + np.log(total)
    return np.where(small, np.log(np.pi / np.sin(np.pi * np.where(small, a, 0.5))) - out, out)


def gamma_p(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function P(a, x); NaN where a <= 0 or an argument is NaN."""
    a, x = np.broadcast_arrays(np.asarray(a, dtype=np.float64), np.asarray(x, dtype=np.float64))
    out = np.full(a.shape, np.nan)
    fine = (a > 0) & (x >= 0)
    out[fine & (x == 0)] = 0.0
    out[fine & np.isinf(x)] = 1.0
    fine &= (x > 0) & np.isfinite(x) & np.isfinite(a)
    low = fine & (x < a + 1)
    if low.any():
        out[low] = _series(a[low], x[low])
    high = fine & ~low
    if high.any():
        out[high] = 1 - _fraction(a[high], x[high])
    return out


def _front(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(a * np.log(x) - x - log_gamma(a), -745, 709))


def _series(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    term = 1 / a
    total, n, active = term.copy(), a.copy(), np.arange(len(a))
    for _ in range(10_000):
        n[active] += 1
        term[active] *= x[active] / n[active]
        total[active] += term[active]
        active = active[term[active] > total[active] * 1e-16]
        if not len(active):
            break
    return total * _front(a, x)


def _fraction(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The upper tail by a continued fraction (modified Lentz)."""
    tiny = 1e-300
    b = x + 1 - a
    c, d = np.full(len(a), 1 / tiny), 1 / np.where(b == 0, tiny, b)
    h, active = d.copy(), np.arange(len(a))
    for i in range(1, 10_000):
        an = -i * (i - a[active])
        b[active] += 2
        d[active] = an * d[active] + b[active]
        d[active] = 1 / np.where(np.abs(d[active]) < tiny, tiny, d[active])
        c[active] = b[active] + an / c[active]
        c[active] = np.where(np.abs(c[active]) < tiny, tiny, c[active])
        step = c[active] * d[active]
        h[active] *= step
        active = active[np.abs(step - 1) > 1e-15]
        if not len(active):
            break
    return _front(a, x) * h


#: Values that are computed side by side: few enough to stay in a core's cache; and pairs of unit and month that are laid out at once.
CHUNK, ELEMENTS_A_STEP = 4096, 1 << 18
#: exp(-FAR) is below the rounding of one.
FAR = 42.0


def _gamma_p_absolute(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(a, x) as ``gamma_p``, but to an absolute error of rounding, for sums of probabilities.

    Chernoff's bound, exp(-away), holds for P below x = a and for 1 - P above it: beyond FAR they are zero."""
    fine = (a > 0) & (a < np.inf) & (x > 0) & (x < np.inf)
    if not fine.all():
        out = gamma_p(a, x)
        out[fine] = _gamma_p_absolute(a[fine], x[fine])
        return out
    out = (x > a).astype(np.float64)
    away = x - a + a * np.log(a / x)
    near = np.flatnonzero(~(away > FAR))
    tail, upper = _tails(a[near], x[near], away[near])
    out[near] = np.where(upper, 1 - tail, tail)
    return out


def _tails(a: np.ndarray, x: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tail that is computed without cancellation, and whether it is the upper one, Q(a, x): P(a, x) where x < a + 1.  a and x are positive and finite.

    Both expansions run backwards over a number of terms that depends on a and x alone (see _SERIES_TERMS), and all values with the same number go together."""
    upper = x >= a + 1
    lean = np.maximum(np.log(a / x), 0.0)
    half, most = lean * a - FAR, 8.7 * np.sqrt(a + 1) + 13
    # the product of x / (a + k) up to n is below exp(-FAR) where n * lean + n * n / (2 * (a + n)) >= FAR
    fewest = (np.sqrt(half * half + 2 * FAR * a * (1 + 2 * lean)) - half) / (1 + 2 * lean) + 1
    root = np.sqrt(a)
    terms = np.where(upper, 95 / x + np.minimum(4 * root, 1.4 * root + 60) + 6, np.minimum(fewest, most))
    group = (np.ceil(terms / 4) * 4).astype(np.int64) * 2 + upper
    order = np.argsort(group, kind="stable")
    ends = np.flatnonzero(np.diff(group[order])) + 1
    out = np.empty(len(a))
    for piece in np.split(order, ends):
        for at in range(0, len(piece), CHUNK):
            rows = piece[at : at + CHUNK]
            n, kind = divmod(int(group[rows[0]]), 2)
            out[rows] = (_fraction_of if kind else _series_of)(a[rows], x[rows], n) * _front_near(a[rows], x[rows], away[rows])
    return out, upper


def _series_of(a: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    total, below = np.ones(len(a)), np.empty(len(a))
    for k in range(n, 0, -1):
        np.add(a, k, out=below)
        total *= x
        total /= below
        total += 1
    return total / a


def _fraction_of(a: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    over, term = x - a, np.empty(len(a))
    f = over + (2 * n + 1)
    for k in range(n, 0, -1):
        np.subtract(a, k, out=term)
        term *= k
        term /= f
        np.add(over, 2 * k - 1, out=f)
        f += term
    return 1 / f


def _front_near(a: np.ndarray, x: np.ndarray, away: np.ndarray) -> np.ndarray:
    """x**a * exp(-x) / gamma(a), where a is large by Stirling's series, whose main part is exp(-away)."""
    b = np.maximum(a, 1.0)
    out = np.sqrt(b / (2 * np.pi)) * np.exp(-away - (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / (1188 * b * b)) / (b * b)) / (b * b)) / (b * b)) / b)
    small = a < 20
    if small.any():
        out[small] = _front(a[small], x[small])
    return out


# The same as SQL functions, for columns: no row leaves the JVM.
#
# Both expansions run backwards over a number of terms that is known before: from the last term to the first, a single double is carried, so
# ``aggregate`` needs no state to stop by.  How many terms leave an error below rounding was measured over a from 1e-6 to 1e5 (tests/test_special.py).

_SERIES_TERMS = "CAST(ceil(8.7D * sqrt({a} + 1) + 13) AS INT)"
_FRACTION_TERMS = "CAST(ceil(95 / {x} + least(4 * sqrt({a}), 1.4D * sqrt({a}) + 60) + 6) AS INT)"


def _ln_gamma_sql(a: str) -> str:
    """log of the gamma function of a > 0; below 0.5 by reflection."""

    def lanczos(z: str) -> str:
        total = " + ".join([f"{_LANCZOS[0]!r}D", *(f"{c!r}D / ({z} + {i})" for i, c in enumerate(_LANCZOS[1:], 1))])
        return f"({0.5 * math.log(2 * math.pi)!r}D + ({z} + 0.5D) * ln({z} + 7.5D) - ({z} + 7.5D) + ln({total}))"

    return f"CASE WHEN {a} < 0.5D THEN ln(pi() / sin(pi() * {a})) - {lanczos(f'(0D - {a})')} ELSE {lanczos(f'({a} - 1D)')} END"


def _incomplete_sql(a: str, x: str, upper: bool) -> str:
    """P(a, x), or Q(a, x) = 1 - P(a, x): the series gives P where x is below a + 1, the fraction gives Q elsewhere, so an upper tail keeps its digits."""
    front = f"exp({a} * ln({x}) - {x} - ({_ln_gamma_sql(a)}))"
    series = f"{front} / {a} * aggregate(sequence({_SERIES_TERMS.format(a=a)}, 1, -1), 1D, (s, k) -> 1D + s * {x} / ({a} + k))"
    terms = _FRACTION_TERMS.format(a=a, x=x)
    fraction = f"{front} / aggregate(sequence({terms}, 1, -1), {x} + 2 * ({terms}) + 1 - {a}, (f, k) -> {x} + 2 * k - 1 - {a} - k * (k - {a}) / f)"
    infinite, nan = "double('Infinity')", "double('NaN')"
    low, high = (f"1D - ({series})", fraction) if upper else (series, f"1D - ({fraction})")
    return (
        f"CASE WHEN isnan({a}) OR isnan({x}) OR {a} <= 0 OR {a} = {infinite} OR {x} < 0 THEN {nan} WHEN {x} = 0 THEN {'1D' if upper else '0D'} WHEN {x} = {infinite} THEN {'0D' if upper else '1D'}"
        f" WHEN {x} < {a} + 1 THEN {low} ELSE {high} END"
    )


def _failure_cdf_sql() -> str:
    nodes, weights = hermite()
    table = ", ".join(f"named_struct('z', {z!r}D, 'w', {w!r}D)" for z, w in zip(nodes.tolist(), weights.tolist(), strict=True))
    finite = " AND ".join(f"abs({c}) < double('Infinity')" for c in ("x0", "la_mu", "la_var", "beta", "threshold", "usage"))
    shapes = f"transform(array({table}), n -> named_struct('w', n.w, 'a', exp(la_mu + sqrt(2 * la_var) * n.z) * usage * t, 'x', greatest(threshold - x0, 1e-9D) / beta))"
    mixed = f"1D - aggregate({shapes}, 0D, (s, p) -> s + p.w * CASE WHEN p.a > 0 THEN {_incomplete_sql('p.a', 'p.x', False)} ELSE 1D END)"
    return f"CASE WHEN NOT ({finite}) THEN CAST(raise_error('non-finite forecast input') AS DOUBLE) ELSE least(greatest({mixed}, 0D), 1D) END"


#: Name: (arguments, body) of the SQL functions.  A null argument gives null; NaN, a <= 0 and x < 0 give NaN; non-finite inputs of a forecast are an error.
SQL_FUNCTIONS = {
    "ln_gamma": (("a",), lambda: _ln_gamma_sql("a")),
    "gammainc": (("a", "x"), lambda: _incomplete_sql("a", "x", False)),
    "gammaincc": (("a", "x"), lambda: _incomplete_sql("a", "x", True)),
    "rul_cdf": ((*("x0", "la_mu", "la_var", "beta", "threshold", "usage"), "t"), _failure_cdf_sql),
}


def register(spark: SparkSession) -> None:
    """Make SQL_FUNCTIONS known to a session as temporary functions."""
    for name, (arguments, body) in SQL_FUNCTIONS.items():
        known = " OR ".join(f"{c} IS NULL" for c in arguments)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{c} DOUBLE' for c in arguments)}) RETURNS DOUBLE RETURN CASE WHEN {known} THEN NULL ELSE {body()} END")


def _called(name: str, *columns: Column) -> Column:
    register(SparkSession.active())
    return F.call_function(name, *columns)


def gammainc(a: Column, x: Column) -> Column:
    """P(a, x) as a column, in the JVM."""
    return _called("gammainc", a, x)


def gammaincc(a: Column, x: Column) -> Column:
    """Q(a, x) = 1 - P(a, x) as a column, in the JVM, without cancellation where it is small."""
    return _called("gammaincc", a, x)


def ln_gamma(a: Column) -> Column:
    """log of the gamma function of a > 0 as a column, in the JVM."""
    return _called("ln_gamma", a)


@lru_cache(maxsize=4)
def hermite(nodes: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Hermite nodes, and weights that add up to one."""
    x, w = np.polynomial.hermite.hermgauss(nodes)
    return x, w / np.sqrt(np.pi)


#: Weights that add up to less leave no trace in a sum of probabilities: a quarter of the rounding of one.
_NO_WEIGHT = 2.0**-55


@lru_cache(maxsize=1)
def _heavy_nodes() -> tuple[np.ndarray, np.ndarray]:
    """The nodes of ``hermite`` without those whose weights together are below _NO_WEIGHT."""
    nodes, weights = hermite()
    order = np.argsort(weights)
    heavy = np.sort(order[np.cumsum(weights[order]) >= _NO_WEIGHT])
    return nodes[heavy], weights[heavy]


def failure_cdf(x0, la_mu, la_var, beta, limit, usage, t) -> np.ndarray:
    """Probability that damage has passed its limit by month t (units x months).

    Damage grows as a gamma process of log-normal rate; any non-finite input is an error, never a guess."""
    columns = [np.asarray(c, dtype=np.float64) for c in (x0, la_mu, la_var, beta, limit, usage)]
    if any(not np.isfinite(c).all() for c in columns):
        raise ValueError("non-finite forecast input")
    x0, la_mu, la_var, beta, limit, usage = columns
    nodes, weights = _heavy_nodes()
    t = np.atleast_1d(np.asarray(t, dtype=np.float64))
    t = np.broadcast_to(t, (len(x0), t.shape[-1]))
    out = np.empty(t.shape)
    step = max(1, ELEMENTS_A_STEP // (t.shape[1] * len(nodes) or 1))
    for at in range(0, len(x0), step):
        part = slice(at, at + step)
        margin = np.maximum(limit[part] - x0[part], 1e-9) / beta[part]
        rate = np.exp(la_mu[part, None] + np.sqrt(2 * la_var[part, None]) * nodes)
        shape = rate.T[:, :, None] * (usage[part, None] * t[part])  # nodes x units x months
        p = np.ones_like(shape)
        some = ~(shape <= 0)
        p[some] = _gamma_p_absolute(shape[some], np.broadcast_to(margin[:, None], shape.shape)[some])
        survives = np.zeros(shape.shape[1:])
        for w, q in zip(weights.tolist(), p, strict=True):  # in a fixed order: equal units get equal bits, whatever lies beside them
            survives += w * q
        out[part] = 1 - survives
    return np.clip(out, 0.0, 1.0)


def failure_quantiles(x0, la_mu, la_var, beta, limit, usage, probs=(0.05, 0.5, 0.95), horizon: int = 18, monthly: np.ndarray | None = None, rounds: int = 60) -> np.ndarray:
    """Months until failure (units x probs); infinity beyond four horizons.

    The probabilities within one horizon and four say between which months a quantile lies, closer where monthly ones are given (a column for each of the
    last months up to the horizon: all of them, or the horizon alone).  Inside, the search starts where a log-normal time of failure would have it, and follows secants of log-odds over the logarithm of time, which are nearly straight;
    what would leave the range is halved instead."""
    args = [np.asarray(c, dtype=np.float64) for c in (x0, la_mu, la_var, beta, limit, usage)]
    near = failure_cdf(*args, [float(horizon)]) if monthly is None else monthly
    known = np.arange(horizon - near.shape[1], horizon) + 1.0
    far = np.ones((len(near), 1))  # computed where a quantile lies beyond the horizon
    late = np.flatnonzero(near[:, -1] < max(probs))
    far[late] = failure_cdf(*(c[late] for c in args), [4.0 * horizon])
    grid = np.concatenate((np.zeros((len(near), 1)), near, far), axis=1)
    months = np.concatenate(([0.0], known, [4.0 * horizon]))
    wanted = np.asarray(probs, dtype=np.float64)
    above = np.stack([(grid >= p).argmax(axis=1) for p in wanted], axis=1)
    out = np.where(grid[:, -1:] < wanted, np.inf, months[above])
    unit, column = np.nonzero((grid[:, -1:] >= wanted) & (above > 0))
    p, low, high = wanted[column], months[above[unit, column] - 1], months[above[unit, column]]
    own = [c[unit] for c in args]
    t, slope = _first_guess(own, p)
    t = np.where((t > low) & (t < high), t, _halfway(low, high))
    log_odds = np.log(p / (1 - p))
    before, y_before = np.full(len(t), np.nan), np.full(len(t), np.nan)
    for i in range(rounds):
        if not len(t):
            break
        f = failure_cdf(*own, t[:, None])[:, 0]
        y, u = np.log(np.maximum(f, 1e-300) / np.maximum(1 - f, 2.0**-53)) - log_odds, np.log(t)
        low, high = np.where(f < p, t, low), np.where(f < p, high, t)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            steep = (y - y_before) / (u - before) if i else slope
            ahead = np.exp(u - y / steep)
            alike = (steep < 2 * slope) & (slope < 2 * steep) & bool(i)
        inside = (ahead > low) & (ahead < high) & (i < 12 or i % 2 == 0)
        ahead = np.where(inside, ahead, _halfway(low, high))
        exact = np.abs(f - p) <= 1e-12
        out[unit, column] = np.where(exact, t, ahead)
        go = ~exact & (high - low > QUANTILE_TOLERANCE) & ~(inside & alike & (np.abs(ahead - t) <= QUANTILE_TOLERANCE))
        unit, column, p, log_odds, low, high, own = unit[go], column[go], p[go], log_odds[go], low[go], high[go], [c[go] for c in own]
        before, y_before, slope, t = u[go], y[go], steep[go], ahead[go]
    return out


def _halfway(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.where(low > 0, np.sqrt(low * high), high / 2)


def _first_guess(args: list[np.ndarray], p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Months until failure with probability p, and the slope of log-odds over their logarithm, if that were normal: with the variance of the rate, and of the
    wear's, whose share falls with the damage that is left."""
    x0, la_mu, la_var, beta, limit, usage = args
    left = np.maximum(limit - x0, 1e-9) / beta
    z = np.array([NormalDist().inv_cdf(v) for v in p.tolist()])
    spread = np.sqrt(la_var + 1 / left)
    with np.errstate(divide="ignore", over="ignore"):
        return left / usage * np.exp(z * spread - la_mu), np.exp(-z * z / 2) / np.sqrt(2 * np.pi) / (p * (1 - p)) / spread


#: Months by which a quantile may be off.
QUANTILE_TOLERANCE = 1e-7

FORECAST_INPUTS = ("x0", "la_mu", "la_var", "beta", "threshold", "usage")


def forecast_udf(horizon: int):
    """Column function of FORECAST_INPUTS: struct of p05, p50, p95, pfail and the monthly CDF."""

    @pandas_udf("p05 double, p50 double, p95 double, pfail double, cdf array<double>")
    def forecast(x0: pd.Series, la_mu: pd.Series, la_var: pd.Series, beta: pd.Series, threshold: pd.Series, usage: pd.Series) -> pd.DataFrame:
        args = [c.to_numpy(dtype=np.float64) for c in (x0, la_mu, la_var, beta, threshold, usage)]
        cdf = failure_cdf(*args, np.arange(1, horizon + 1))
        q = failure_quantiles(*args, horizon=horizon, monthly=cdf)
        return pd.DataFrame({"p05": q[:, 0], "p50": q[:, 1], "p95": q[:, 2], "pfail": cdf[:, -1], "cdf": list(cdf)}, index=x0.index)

    return forecast


def life_udf(horizon: int):
    """Column function of FORECAST_INPUTS: struct of p05, p50, p95 and pfail, the probability within the horizon; no other month is computed."""

    @pandas_udf("p05 double, p50 double, p95 double, pfail double")
    def life(x0: pd.Series, la_mu: pd.Series, la_var: pd.Series, beta: pd.Series, threshold: pd.Series, usage: pd.Series) -> pd.DataFrame:
        args = [c.to_numpy(dtype=np.float64) for c in (x0, la_mu, la_var, beta, threshold, usage)]
        within = failure_cdf(*args, [float(horizon)])
        q = failure_quantiles(*args, horizon=horizon, monthly=within)
        return pd.DataFrame({"p05": q[:, 0], "p50": q[:, 1], "p95": q[:, 2], "pfail": within[:, 0]}, index=x0.index)

    return life


def months_udf(months: list[int]):
    """Column function of FORECAST_INPUTS: the probabilities of failure by these months, which cost a fraction of the quantiles."""

    @pandas_udf("array<double>")
    def cdf(x0: pd.Series, la_mu: pd.Series, la_var: pd.Series, beta: pd.Series, threshold: pd.Series, usage: pd.Series) -> pd.Series:
        args = [c.to_numpy(dtype=np.float64) for c in (x0, la_mu, la_var, beta, threshold, usage)]
        return pd.Series(list(failure_cdf(*args, months)), index=x0.index)

    return cdf


__all__ = ["FORECAST_INPUTS", "failure_cdf", "failure_quantiles", "forecast_udf", "gamma_p", "gammainc", "gammaincc", "hermite", "life_udf", "ln_gamma", "log_gamma", "months_udf", "register"]

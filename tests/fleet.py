"""A small fleet with known truth for the tests of the whole chain.

Wear of a channel is a gamma process; a part that reaches its threshold fails in that month, and the one that takes its place begins at zero, as the model has it."""

import numpy as np
import pandas as pd

#: code: (wear per hour, scale, threshold, sensor noise)
PARTS = {"P1": (0.04, 0.10, 6.0, 0.10), "P2": (0.012, 0.36, 7.5, 0.14), "P3": (0.005, 0.90, 8.5, 0.16)}
MONTHS, HORIZON = 60, 18
KINDS = ["dup", "neg_reading", "bad_tail", "units_x10", "usage_neg", "bad_component", "month_oob"]


def make(spark, tails=80, seed=3, dirty=0.01):
    """inspections (texts, with _row), roster, events, truth, corrupted."""
    r = np.random.default_rng(seed)
    k, total = len(PARTS), MONTHS + HORIZON
    nominal, scale, limit, noise = (np.tile(c, tails)[:, None] for c in zip(*PARTS.values(), strict=True))
    hours = np.repeat(r.lognormal(np.log(45), 0.3, (tails, 1)) * r.lognormal(0, 0.15, (tails, total)), k, axis=0)
    alpha = nominal * r.lognormal(0, 0.45, (tails * k, 1))
    n = tails * k
    grown = scale * r.gamma(alpha * hours)
    damage, part = np.empty((n, total)), np.zeros((n, total), dtype=np.int64)
    now, worn = r.uniform(0, 0.5, n) * limit[:, 0], np.zeros(n, dtype=np.int64)
    for m in range(total):
        now = now + grown[:, m]
        worn += now >= limit[:, 0]
        now = np.where(now >= limit[:, 0], 0.0, now)
        damage[:, m], part[:, m] = now, worn
    fault = np.where(r.random(n) < 0.06, r.integers(1, 5, n), 0)
    onset = r.integers(10, MONTHS - 12, n)
    seen = damage + noise * r.standard_normal(damage.shape)
    month = np.arange(total)
    for i in np.flatnonzero(fault == 1):
        seen[i, onset[i] :] += 2.0
    for i in np.flatnonzero(fault == 2):
        seen[i, onset[i] :] *= 2.0
    for i in np.flatnonzero(fault == 3):
        seen[i, onset[i] :] = seen[i, onset[i]]
    there = np.broadcast_to(month < MONTHS, seen.shape).copy()
    for i in np.flatnonzero(fault == 4):
        there[i, onset[i] :] &= r.random(total - onset[i]) > 0.8
    c, m = np.nonzero(there)
    chan = np.arange(1, n + 1)
    codes, names = np.array(list(PARTS))[(chan - 1) % k], np.array([f"T{(x - 1) // k:04d}" for x in chan])
    rows = pd.DataFrame({"tail": names[c], "component": codes[c], "serial": chan[c] * 1000 + part[c, m], "month": m, "usage_hours": hours[c, m].round(3), "reading": seen[c, m].round(4)})
    kind = np.where(r.random(len(rows)) < dirty, r.integers(0, len(KINDS), len(rows)), -1)
    corrupted = rows.loc[kind >= 0, ["tail", "component", "month"]].assign(kind=[KINDS[x] for x in kind[kind >= 0]])
    bad = {x: kind == i for i, x in enumerate(KINDS)}
    again = rows[bad["dup"]]
    rows.loc[bad["bad_tail"], "tail"] = "T9999"
    rows.loc[bad["bad_component"], "component"] = "ZZZ"
    rows.loc[bad["month_oob"], "month"] += MONTHS + 40
    rows.loc[bad["usage_neg"], "usage_hours"] *= -1
    rows.loc[bad["neg_reading"], "reading"] = -rows["reading"].abs() - 1.5
    rows.loc[bad["units_x10"], "reading"] *= 10
    rows = pd.concat([rows, again], ignore_index=True)
    rows["_row"] = np.arange(len(rows))
    texts = rows.astype({x: str for x in ("serial", "month", "usage_hours", "reading")})
    failed = [(int(chan[i]) * 1000 + int(p)) for i in range(n) for p in range(int(part[i, MONTHS - 1]))]
    last = part[:, MONTHS - 1 : MONTHS]
    later = part[:, MONTHS:] > last
    ttf = np.where(later.any(axis=1), later.argmax(axis=1) + 1, -1)
    truth = pd.DataFrame({"chan": chan, "comp": (chan - 1) % k + 1, "alpha": alpha[:, 0], "fault": fault, "onset": onset, "ttf": ttf})
    return {
        "inspections": spark.createDataFrame(texts).repartition(4),
        "roster": spark.createDataFrame([(x,) for x in sorted(set(names))], "tail string"),
        "events": spark.createDataFrame([(x,) for x in failed], "serial bigint"),
        "truth": spark.createDataFrame(truth),
        "corrupted": spark.createDataFrame(corrupted),
    }

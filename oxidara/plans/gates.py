"""Gates between the steps: a run stops rather than emit a number that was not verified."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Stopped(RuntimeError):
    """A gate was not passed."""


#: A sensor noise at or below this sits on its floor.
NOISE_FLOOR = 0.0011


def fit_degradations(components: DataFrame, which: str = "fit") -> list[str]:
    """What is wrong with the fit, a sentence for each component (a row per component comes to the driver)."""
    out = []
    for row in components.orderBy("comp").collect():
        if row["beta"] is None:
            out.append(f"{which}: component {row['comp']} could not be fitted")
        elif row["sigma"] is not None and row["sigma"] <= NOISE_FLOOR:
            out.append(f"{which}: sensor noise of component {row['comp']} hit its floor")
    return out


# What the gates ask of a table is a list of aggregates, so that the pass that writes the table can observe them; ``stop_*`` decides by the numbers.


def flag_metrics() -> list[Column]:
    return [F.count(F.lit(1)).alias("channels"), F.count_if(F.col("class") > 0).alias("flagged")]


def stop_flagged(seen: dict, most: float = 0.10) -> float:
    """Stop if more than ``most`` of the channels are flagged.  seen: flag_metrics."""
    share = seen["flagged"] / max(seen["channels"], 1)
    if share > most:
        raise Stopped(f"{share:.1%} of the channels are flagged")
    return share


def flagged_share(flags: DataFrame, most: float = 0.10) -> float:
    return stop_flagged(flags.agg(*flag_metrics()).first().asDict(), most)


def forecast_metrics() -> list[Column]:
    """Channels whose probability is none, that have a NaN, whose quantiles are out of order."""
    bad_p = F.col("pfail").isNull() | F.isnan("pfail") | (F.col("pfail") < 0) | (F.col("pfail") > 1)
    nan = F.lit(False)
    for c in ("p05", "p50", "p95"):
        nan = nan | F.col(c).isNull() | F.isnan(c)
    order = (F.col("p05") > F.col("p50")) | (F.col("p50") > F.col("p95"))
    return [F.count_if(bad_p).alias("p"), F.count_if(nan).alias("nan"), F.count_if(order).alias("order")]


def stop_forecasts(seen: dict) -> None:
    """Stop if quantiles are NaN or out of order, or a probability is not one.  seen: forecast_metrics."""
    for name in ("p", "nan", "order"):
        if seen[name]:
            raise Stopped(f"forecast gate {name}: {seen[name]} channels")


def forecasts(rows: DataFrame) -> None:
    stop_forecasts(rows.agg(*forecast_metrics()).first().asDict())


def availability_metrics() -> list[Column]:
    """Availabilities that are none."""
    return [F.count_if(F.col("available").isNull() | F.isnan("available") | (F.col("available") < 0) | (F.col("available") > 1)).alias("bad")]


def stop_availability(seen: dict) -> None:
    """Stop if an availability is not within 0 and 1.  seen: availability_metrics."""
    if seen["bad"]:
        raise Stopped(f"availability gate: {seen['bad']} values")


def availability(rows: DataFrame) -> None:
    stop_availability(rows.agg(*availability_metrics()).first().asDict())


def audit(prose: str, facts: dict, degradations: list[str], ids: str = r"T\d{4}") -> None:
    """Stop unless every number of the prose is a fact and every degradation is quoted in it."""
    known = {f"{value:g}" for value in facts.values() if isinstance(value, (int, float))} | {str(value) for value in facts.values()}
    rest = re.sub(ids, "", prose)
    for sentence in degradations:
        if sentence not in prose:
            raise Stopped(f"not quoted: {sentence}")
        rest = rest.replace(sentence, "")
    for found in re.findall(r"(?<![\w.])-?\d[\d,]*(?:\.\d+)?", rest):
        plain = found.replace(",", "")
        if plain not in known and f"{float(plain):g}" not in known:
            raise Stopped(f"number without a fact: {found}")

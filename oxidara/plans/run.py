"""The whole chain from inspection records to the ledger; each step's tables are kept by content in one folder."""

from __future__ import annotations

import json
import platform
from dataclasses import dataclass
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oxidara.operators import faults, forecast, ingest, report, wear
from oxidara.plans import gates
from oxidara.plans.stages import Store, code_digest, files_digest
from oxidara.sources.store import write_ledger


@dataclass(frozen=True)
class Config:
    """components in catalogue order; months observed; what the gates allow; repair times (mu, sigma, chance of a spare, backorder)."""

    components: tuple[str, ...]
    n_months: int = 60
    horizon: int = 18
    most_quarantined: float = 0.05
    most_flagged: float = 0.10
    high_risk: float = 0.5
    replicates: int = 200
    seed: int = 11
    repair: tuple[float, float, float, float] = (0.3, 0.4, 0.85, 2.0)


@dataclass(frozen=True)
class Result:
    tables: dict[str, DataFrame]
    header: dict
    summary: str


def screen_step(inspections: DataFrame, roster: DataFrame, components: list[str], n_months: int, order: str) -> dict[str, DataFrame]:
    rows = ingest.screen(inspections, roster, components, n_months, [order])
    return {"screened": rows.select(*ingest.REQUIRED, "reasons")}


def encode_step(screened: DataFrame, components: list[str]) -> dict[str, DataFrame]:
    rows = wear.encode(ingest.clean(screened), components)
    return {"sequenced": wear.sequence_columns(rows.select("chan", "tail", "comp", "serial", "month", "usage_hours", "reading"))}


def fit_step(sequenced: DataFrame) -> dict[str, DataFrame]:
    comps, units = wear.fit(sequenced)
    return {"comps": comps, "units": units}


def detect_step(sequenced: DataFrame, roster: DataFrame, comps: DataFrame, units: DataFrame, k: int, n_months: int) -> dict[str, DataFrame]:
    """Flags of every channel of the roster, seen or not."""
    rows = sequenced.join(units.select("chan", "alpha"), "chan", "left").join(F.broadcast(comps.select("comp", "beta", "sigma", "mu", "tau")), "comp", "left")
    tails = roster.select((F.expr("CAST(substring(tail, 2) AS INT)") + 1).alias("tail")).distinct()
    channels = wear.with_channel(tails.select("tail", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("comp")), k)
    return {"flags": faults.isolate(rows, channels.select("chan"), n_months)}


def refit_step(sequenced: DataFrame, flags: DataFrame) -> dict[str, DataFrame]:
    """The fit without the channels whose readings are false."""
    comps, units = wear.fit(sequenced, flags.where(F.col("class").isin(*faults.EXCLUDED)))
    return {"comps": comps, "units": units}


def state_step(sequenced: DataFrame, comps: DataFrame, units: DataFrame, flags: DataFrame, events: DataFrame, n_months: int) -> dict[str, DataFrame]:
    rows = sequenced.select("chan", "tail", "comp", "serial", "month", "usage_hours", "reading")
    limits = forecast.thresholds(rows, events, comps.select("comp", "sigma"))
    usage = forecast.dense_usage(rows)
    params = comps.join(limits, "comp").select("comp", "beta", "mu", "tau", "threshold")
    state = forecast.damage_state(rows, units, flags, params, usage.select("tail", "usage"), n_months)
    return {"state": state.join(usage.select("tail", "log_sd"), "tail"), "thresholds": limits}


def forecast_step(state: DataFrame, horizon: int) -> dict[str, DataFrame]:
    return {"forecasts": forecast.forecast(state, horizon)}


def lives_step(state: DataFrame, horizon: int, replicates: int, seed: int, repair: list[float]) -> dict[str, DataFrame]:
    return {"lived": forecast.lives(state, horizon, replicates, seed, tuple(repair))}


def availability_step(lived: DataFrame, roster: DataFrame) -> dict[str, DataFrame]:
    return {"runs": forecast.availability(lived, roster.distinct().count())}


def versions(spark: SparkSession) -> dict[str, str]:
    """What the numbers were made with."""
    return {"python": platform.python_version(), "spark": spark.version} | {name: metadata.version(name) for name in ("pyspark", "numpy", "pandas", "pyarrow")}


def run(spark: SparkSession, folder: str, inspections: DataFrame, roster: DataFrame, events: DataFrame, config: Config, order: str = "_row", sources: dict[str, str] | None = None) -> Result:
    """All steps in a row.  folder: shared by all executors.  order: column that gives the file's order.  sources: paths of the files read, by name; their bytes are part of the run's identity.

    Raises Refused or Stopped where a gate is not passed; what is merely worse than it should be becomes a degradation."""
    store, codes = Store(spark, folder), list(config.components)
    roster, events = roster.select("tail"), events.select("serial")
    screened = store.run("screen", screen_step, {"inspections": inspections, "roster": roster}, ["screened"], {"components": codes, "n_months": config.n_months, "order": order}, {"screened": ingest.screen_metrics()})["screened"]
    counts = ingest.summary(store.metrics["screen"]["screened"])
    ingest.stop_quarantined(counts, config.most_quarantined)
    sequenced = store.run("encode", encode_step, {"screened": screened}, ["sequenced"], {"components": codes})["sequenced"]
    first = store.run("fit", fit_step, {"sequenced": sequenced}, ["comps", "units"])
    degradations = gates.fit_degradations(first["comps"], "first fit")
    flags = store.run("detect", detect_step, {"sequenced": sequenced, "roster": roster, **first}, ["flags"], {"k": len(codes), "n_months": config.n_months}, {"flags": gates.flag_metrics()})["flags"]
    gates.stop_flagged(store.metrics["detect"]["flags"], config.most_flagged)
    second = store.run("refit", refit_step, {"sequenced": sequenced, "flags": flags}, ["comps", "units"])
    degradations += gates.fit_degradations(second["comps"], "refit")
    made = store.run("state", state_step, {"sequenced": sequenced, "flags": flags, "events": events, **second}, ["state", "thresholds"], {"n_months": config.n_months})
    for row in made["thresholds"].where("threshold IS NULL").orderBy("comp").collect():  # at most a row per component
        degradations.append(f"component {row['comp']} has too few failures for a threshold")
    forecasts = store.run("forecast", forecast_step, {"state": made["state"]}, ["forecasts"], {"horizon": config.horizon}, {"forecasts": gates.forecast_metrics()})["forecasts"]
    gates.stop_forecasts(store.metrics["forecast"]["forecasts"])
    params = {"horizon": config.horizon, "replicates": config.replicates, "seed": config.seed, "repair": list(config.repair)}
    lived = store.run("lives", lives_step, {"state": made["state"]}, ["lived"], params)["lived"]
    runs = store.run("availability", availability_step, {"lived": lived, "roster": roster}, ["runs"], observe={"runs": gates.availability_metrics()})["runs"]
    gates.stop_availability(store.metrics["availability"]["runs"])
    band = {"p05": 0.05, "p95": 0.95}
    months = forecast.replicate_quantiles(runs, ["month"], "available", band)
    failures = forecast.replicate_quantiles(lived.where("comp > 0"), ["comp", "month"], "n", band)
    ledger = report.ledger(forecasts, flags, codes, config.horizon)
    report.complete(ledger, made["state"])
    head = report.header(ledger, flags, counts, months, failures, made["thresholds"], second["comps"], codes, config.horizon, config.high_risk, degradations)
    files = {name: files_digest(spark, path)[:12] for name, path in sorted((sources or {}).items())}
    head["identity"] = {"versions": versions(spark), "files": files, "code": code_digest()[:12], "seed": config.seed, "inspections": store.read["screen.inspections"][:12], "roster": store.read["screen.roster"][:12]}
    text, facts = report.summary(head)
    gates.audit(text, facts | {f"code_{c}": c for c in codes}, degradations, "|".join([r"T\d{4,}", *codes]))
    tables = {"screened": screened, "flags": flags, "comps": second["comps"], "units": second["units"], "state": made["state"], "thresholds": made["thresholds"], "forecasts": forecasts, "availability": months, "failures": failures, "ledger": ledger}
    return Result(tables, head, text)


def publish(result: Result, folder: str) -> None:
    """The ledger as one JSON document per channel, its header as JSON and the summary as text, through Spark's file system."""
    spark = result.tables["ledger"].sparkSession
    write_ledger(result.tables["ledger"], f"{folder}/ledger")
    for name, text in (("header", json.dumps(result.header)), ("summary", result.summary)):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")

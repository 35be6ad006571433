import json
import math

import pytest
from fleet import HORIZON, PARTS, make
from pyspark.sql import functions as F

from oxidara import __main__ as command
from oxidara.__main__ import main
from oxidara.operators import report
from oxidara.plans import run, scorecard
from oxidara.sources import store

#: With fewer aircraft a scale is off by some 5 %, and with it all severities of its component.
TAILS = 600
LEDGER = "tail string, component string, damage_basis string, damage_est double, threshold double, shrinkage double, n_increments int, sensor_status string, watch boolean, p_fail_within_horizon double, rul_months struct<p05:double,p50:double,p95:double>"


def test_explanation(spark):
    rows = spark.createDataFrame(
        [
            ("T0000", "64E", "reading", 0.0, 5.958, 0.034, 57, "none", False, 0.0, (52.16, 63.61, None)),
            ("T0008", "52C", "usage_model", 2.5981, 6.943, 1.0, 0, "bias_step", True, 0.186, (None, None, None)),
        ],
        LEDGER,
    )
    first, second = (r["text"] for r in rows.select("tail", report.explanation(18).alias("text")).orderBy("tail").collect())
    assert first == (
        "Part 64E of T0000 stands at 0.0 out of 5.958, as its last inspection found it. It fails within 18 months with probability 0.0; half of such parts last 63.61 months "
        "(one in twenty 52.16 or less, one in twenty past the search). Its own record counts for 97% of the wear rate (57 increments), the fleet for the rest."
    )
    assert "half of such parts last past the search (one in twenty past the search, one in twenty past the search)" in second and "probability 0.186;" in second and "counts for 0%" in second
    assert second.endswith("Sensor fault: bias_step. Watched: it may wear faster than before, which is not established.")


def test_plain(spark):
    rows = spark.createDataFrame([(0.0,), (0.0005,), (12.3,), (1e6,), (-2.50004,)], "x double")
    assert [r[0] for r in rows.select(report.plain(F.col("x"), 4)).collect()] == ["0.0", "0.0005", "12.3", "1000000.0", "-2.5"]


@pytest.fixture(scope="module")
def fleet(spark):
    return {name: frame.cache() for name, frame in make(spark, TAILS).items()}


@pytest.fixture(scope="module")
def source(fleet, tmp_path_factory):
    """The fleet as files, with what a verification must know."""
    at = tmp_path_factory.mktemp("in")
    for name, frame in fleet.items():
        (frame.drop("_row") if name == "inspections" else frame).write.parquet(f"{at}/{name}.parquet")
    meta = {"n_months": 60, "forecast_months": HORIZON, "components": list(PARTS), "betas": {c: p[1] for c, p in PARTS.items()}, "thresholds": {c: p[2] for c, p in PARTS.items()}}
    (at / "meta.json").write_text(json.dumps(meta))
    return at


@pytest.fixture(scope="module")
def arguments(source, tmp_path_factory):
    return [str(source), str(tmp_path_factory.mktemp("out")), "--replicates", "20"]


@pytest.fixture(scope="module")
def result(spark, arguments):
    return command._run(spark, command._chain_parser("oxidara").parse_args(arguments))[0]


def test_chain(spark, fleet, result, tmp_path):
    ledger = result.tables["ledger"]
    n = TAILS * len(PARTS)
    assert result.header["n_channels_forecast"] == ledger.count() == ledger.select("chan").distinct().count() == n
    assert result.header["ingest"]["rows_in"] == fleet["inspections"].count()
    assert ledger.where("explanation IS NULL OR size(failure_cdf_by_month) <> 18").isEmpty()
    assert sum(result.header["detect"]["by_class"].values()) == n
    assert set(map(len, [result.header["identity"]["code"], *result.header["identity"]["files"].values()])) == {12} and "numpy" in result.header["identity"]["versions"]
    assert set(result.header["failures_by_component"]) == set(result.header["fit"]) == set(PARTS)
    run.publish(result, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "ledger")).count() == n


def test_planted_faults_and_scores(spark, fleet, result):
    betas = {code: p[1] for code, p in PARTS.items()}
    card = scorecard.score(fleet["truth"], fleet["corrupted"], result, betas, HORIZON).cache()
    rows = {r["name"]: r for r in card.collect()}
    assert len(rows) >= 19 and not [r for r in rows.values() if not r["passed"]]  # every check, at its own bound
    tables = scorecard.details(fleet["truth"], result, spark.createDataFrame([(i + 1, p[2]) for i, p in enumerate(PARTS.values())], "comp int, threshold double"))
    found = {(r["true_class"], r["predicted_class"]): r["n"] for r in tables["confusion"].collect()}
    stuck = {k: n for k, n in found.items() if k[0] == 3}
    assert stuck and stuck.get((3, 3), 0) >= 0.9 * sum(stuck.values())  # a frozen sensor is always seen
    dropped = {k: n for k, n in found.items() if k[0] == 4}
    assert dropped and dropped.get((4, 4), 0) >= 0.7 * sum(dropped.values())
    assert sum(n for (t, p), n in found.items() if t == 0 and p) <= scorecard.FALSE_ALARMS * sum(n for (t, _), n in found.items() if t == 0)
    assert sum(r["n"] for r in tables["calibration"].collect()) == sum(r["n"] for r in tables["brier_by_basis"].collect()) == TAILS * len(PARTS)
    for r in tables["thresholds"].where("threshold IS NOT NULL").collect():
        assert abs(r["threshold"] - r["true_threshold"]) < 0.1 * r["true_threshold"]
    onset = {r["fault"]: r["median"] for r in tables["onset_errors"].collect()}
    assert abs(onset[3]) <= 2
    assert tables["watch"].first()["base"] > 0 and tables["power"].count() > 0
    assert scorecard.drift(card, card).isEmpty()
    moved = card.withColumn("value", F.when(F.col("name") == "rows lost by ingest", F.lit(1.0)).otherwise(F.col("value"))).where("name <> 'recall of dup'")
    assert sorted(r["name"] for r in scorecard.drift(card, moved).collect()) == ["recall of dup", "rows lost by ingest"]


def test_command_line_on_csv(spark, fleet, tmp_path):
    at = str(tmp_path / "in")
    fleet["inspections"].drop("_row").coalesce(1).write.option("header", True).csv(f"{at}/inspections.csv")
    for name in ("roster", "events"):
        fleet[name].write.option("header", True).csv(f"{at}/{name}.csv")
    bad = str(tmp_path / "bad")
    for name in ("roster", "events"):
        fleet[name].write.parquet(f"{bad}/{name}.parquet")
    fleet["inspections"].withColumn("reading", F.lit("n/a")).drop("_row").write.parquet(f"{bad}/inspections.parquet")
    (tmp_path / "bad" / "meta.json").write_text(json.dumps({"n_months": 60, "forecast_months": HORIZON, "components": list(PARTS)}, indent=1))
    assert main([bad, str(tmp_path / "out")], spark) == 2
    assert store.read_meta(spark, f"{bad}/meta.json") == {"n_months": 60, "forecast_months": HORIZON, "components": list(PARTS)}
    rows = store.read_inspections(spark, f"{at}/inspections.csv")
    assert rows.count() == fleet["inspections"].count() and rows.select("_row").distinct().count() == rows.count()


def test_csv_sink_and_matrix(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "a"), (2, 0.5, None), (3, float("nan"), "c"), (4, float("inf"), "d")], "k int, x double, s string")
    store.write_csv(rows, str(tmp_path / "x.csv"))
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "x.csv")).distinct().collect())
    assert lines[:2] == ["1,NaN,a", '2,0.5,""'] and "3,NaN,c" in lines and "4,Infinity,d" in lines
    spark.createDataFrame([("1,2.5",), ("3,NaN",)], "value string").coalesce(1).write.text(str(tmp_path / "m.csv"))
    got = store.read_matrix(spark, str(tmp_path / "m.csv"), ["a", "b"]).orderBy("a").collect()
    assert got[0]["b"] == 2.5 and math.isnan(got[1]["b"])


def test_verify_command(spark, source, arguments, result, tmp_path, capsys):
    """The report of a verification, exit code 0 where all checks pass and 1 where one fails; the steps of the run before are kept."""
    assert main(["verify", *arguments], spark) == 0
    said = capsys.readouterr().out
    assert "== 0. Identity of the run ==" in said and "FAIL" not in said and "20 of 20 checks passed" in said
    (tmp_path / "first.txt").write_text(said)
    meta = json.loads((source / "meta.json").read_text())
    meta["betas"]["P2"] *= 2  # a truth that the fit cannot meet
    (source / "meta.json").write_text(json.dumps(meta))
    assert main(["verify", *arguments], spark) == 1
    said = capsys.readouterr().out
    assert "FAIL beta of P2 over truth" in said
    (tmp_path / "second.txt").write_text(said)
    assert main(["compare", str(tmp_path / "first.txt"), str(tmp_path / "first.txt")], spark) == 0
    assert main(["compare", str(tmp_path / "first.txt"), str(tmp_path / "second.txt")], spark) == 1
    assert "beta of P2" in capsys.readouterr().out

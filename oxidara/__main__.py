"""The whole chain over a folder, its verification against a known truth, and the comparison of two reports.

    python -m oxidara FOLDER OUT                    the chain over inspections, roster and events, as Parquet or CSV
    python -m oxidara verify FOLDER OUT             the chain, scored against FOLDER/truth and FOLDER/corrupted; the report goes to OUT/verification
    python -m oxidara compare BEFORE AFTER [--rtol] two reports, line by line

Components (in catalogue order), months and horizon come from the options, else from FOLDER/meta.json; a verification takes the true scales (betas, by component) and, where
they are there, the true thresholds from FOLDER/meta.json.

Exit codes: 0; 1 if a check of the verification fails or two reports differ; 2 if a source is refused or a gate stops the run."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from oxidara.operators.ingest import Refused
from oxidara.plans import compare, run, scorecard
from oxidara.plans.gates import Stopped
from oxidara.sources.store import examples, read_inspections, read_meta, write_csv

#: Lines of differences that are printed.
SHOWN = 25


def _chain_parser(name: str) -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog=name)
    parser.add_argument("folder")
    parser.add_argument("out", help="folder that all executors share")
    parser.add_argument("--components", help="codes in catalogue order, with commas between them")
    parser.add_argument("--months", type=int)
    parser.add_argument("--horizon", type=int)
    parser.add_argument("--replicates", type=int, default=run.Config.replicates)
    parser.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    return parser


def _read(spark: SparkSession, args: argparse.Namespace, name: str) -> DataFrame:
    at = f"{args.folder}/{name}.{args.format}"
    return spark.read.parquet(at) if args.format == "parquet" else spark.read.option("header", True).option("inferSchema", name in ("truth", "corrupted")).csv(at)


def _run(spark: SparkSession, args: argparse.Namespace) -> tuple[run.Result, run.Config]:
    given = (args.components, args.months, args.horizon)
    meta = {} if all(given) else read_meta(spark, f"{args.folder}/meta.json")
    components = args.components.split(",") if args.components else meta["components"]
    config = run.Config(tuple(components), args.months or meta["n_months"], args.horizon or meta["forecast_months"], replicates=args.replicates)
    inspections = read_inspections(spark, f"{args.folder}/inspections.{args.format}")
    sources = {name: f"{args.folder}/{name}.{args.format}" for name in ("inspections", "roster", "events")}
    return run.run(spark, f"{args.out}/steps", inspections, _read(spark, args, "roster"), _read(spark, args, "events").selectExpr("CAST(serial AS BIGINT) AS serial"), config, sources=sources), config


def chain(spark: SparkSession, argv: list[str]) -> int:
    args = _chain_parser("oxidara").parse_args(argv)
    result, _ = _run(spark, args)
    run.publish(result, args.out)
    examples(result.tables["ledger"], ["damage_basis", "sensor_status"]).write.mode("overwrite").json(f"{args.out}/examples")
    write_csv(result.tables["forecasts"].drop("cdf"), f"{args.out}/forecasts.csv")
    print(result.summary)
    return 0


def verify(spark: SparkSession, argv: list[str]) -> int:
    args = _chain_parser("oxidara verify").parse_args(argv)
    result, config = _run(spark, args)
    meta = read_meta(spark, f"{args.folder}/meta.json")
    truth, corrupted = _read(spark, args, "truth"), _read(spark, args, "corrupted")
    limits = spark.createDataFrame([(i, float(meta["thresholds"][c])) for i, c in enumerate(config.components, 1)], "comp int, threshold double") if "thresholds" in meta else None
    card = scorecard.score(truth, corrupted, result, {c: float(meta["betas"][c]) for c in config.components}, config.horizon)
    report = scorecard.text(card, scorecard.details(truth, result, limits), result.header)
    spark.createDataFrame([(report,)], "value string").coalesce(1).write.mode("overwrite").text(f"{args.out}/verification")
    print(report)
    return int(not all(row["passed"] for row in card.select("passed").collect()))


def comparison(spark: SparkSession, argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="oxidara compare")
    parser.add_argument("before")
    parser.add_argument("after")
    parser.add_argument("--rtol", type=float, default=1e-6)
    args = parser.parse_args(argv)
    found = compare.files(spark, args.before, args.after, args.rtol).orderBy("line").limit(SHOWN + 1).collect()
    for row in found[:SHOWN]:
        print(f"line {row['line']}, {row['kind']}\n  - {row['before']}\n  + {row['after']}")
    if len(found) > SHOWN:
        print("and more")
    return int(bool(found))


COMMANDS = {"verify": verify, "compare": comparison}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    command, rest = (COMMANDS[argv[0]], argv[1:]) if argv and argv[0] in COMMANDS else (chain, argv)
    spark = spark or SparkSession.builder.appName("oxidara").getOrCreate()
    try:
        return command(spark, rest)
    except (Refused, Stopped) as stop:
        print(f"stopped: {stop}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())

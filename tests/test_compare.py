"""Two reports, line by line: numbers, structure, sections and order of lines over many splits."""

import pytest
from pyspark.sql import functions as F

from oxidara.__main__ import main
from oxidara.plans import compare, scorecard

BASE = """== 0. Identity ==
  host 17
== 1. Fleet ==
  beta .038 rows 719,008
  error 1.0e-3 share -0.5
  plain text
== 2. More ==
  7 of 9
"""


def kinds(spark, tmp_path, before, after, rtol=1e-6):
    for name, text in (("before", before), ("after", after)):
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    return [(r["line"], r["kind"]) for r in compare.files(spark, str(tmp_path / "before.txt"), str(tmp_path / "after.txt"), rtol).orderBy("line").collect()]


@pytest.mark.parametrize(
    ("old", "new", "expected"),
    [
        ("host 17", "host 18 and\n  another line", []),  # the identity of the run may differ
        ("719,008", "719008", []),
        ("719,008", "719,009", [(2, "numbers")]),  # whole numbers are exact, however large
        ("719,008", "719,008.0", []),
        ("719,008", "719,008.5", []),  # 7e-7 of it
        ("719,008", "719,010.5", [(2, "numbers")]),
        (".038", ".03800000001", []),
        (".038", ".0381", [(2, "numbers")]),
        ("1.0e-3", "0.001", []),
        ("1.0e-3", "1.0e-4", [(3, "numbers")]),
        ("-0.5", "0.5", [(3, "numbers")]),
        ("7 of 9", "007 of 9", []),
        ("7 of 9", "7 of nine", [(6, "structure")]),
        ("plain text", "other text", [(4, "structure")]),
        ("  7 of 9\n", "  7 of 9\n  8 of 9\n", [(7, "added")]),
        ("  7 of 9\n", "", [(6, "missing")]),
        ("  plain text\n", "  plain text\r\n", []),
    ],
)
def test_two_reports(spark, tmp_path, old, new, expected):
    assert old in BASE and kinds(spark, tmp_path, BASE, BASE.replace(old, new)) == expected


def test_long_whole_numbers(spark, tmp_path):
    """Beyond the whole numbers of a double, and of 64 bits."""
    assert kinds(spark, tmp_path, "n 9007199254740993\n", "n 9007199254740992\n") == [(1, "numbers")]
    assert kinds(spark, tmp_path, "n 1" + "0" * 40 + "1\n", "n 1" + "0" * 41 + "\n", 0.5) == [(1, "numbers")]
    assert kinds(spark, tmp_path, "x 1.0\n", "x 1.4\n", 0.5) == []


def test_lines_over_many_splits(spark, tmp_path):
    """A file in many splits, whose first lines belong to a section that began in an earlier one: lines keep their numbers."""
    lines = ["== 1. a =="] + [f"row {i}" for i in range(3000)] + ["== 0. id =="] + [f"host {i}" for i in range(4000)] + ["== 2. b =="] + [f"end {i}" for i in range(1500)]
    path = tmp_path / "long.txt"
    path.write_text("\n".join(lines) + "\n")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = compare.numbered_lines(spark, str(path))
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 10
        got = [r["text"] for r in found.orderBy("line").collect()]
        assert got == lines[:3001] + lines[7002:]
        assert found.agg(F.min("line"), F.max("line"), F.count_distinct("line")).first() == (1, len(got), len(got))
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_command(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text(BASE)
    (tmp_path / "b.txt").write_text(BASE.replace("7 of 9", "8 of 9"))
    assert main(["compare", str(tmp_path / "a.txt"), str(tmp_path / "a.txt")], spark) == 0
    assert main(["compare", str(tmp_path / "a.txt"), str(tmp_path / "b.txt")], spark) == 1
    assert "line 6, numbers" in capsys.readouterr().out


def test_drift_of_counts(spark):
    card = lambda n, x: spark.createDataFrame([("count", float(n)), ("share", x)], "name string, value double")
    assert [r["name"] for r in scorecard.drift(card(7_000_000, 0.5), card(7_000_003, 0.5000001)).collect()] == ["count"]
    assert scorecard.drift(card(7_000_000, 0.5), card(7_000_000, 0.5000001)).isEmpty()

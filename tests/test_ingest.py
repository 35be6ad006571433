"""Duplicates and neighbours of dirty feeds: as by a plain loop, and without a task that gets a frequent key."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from oxidara.operators import ingest

SCHEMA = "tail string, component string, serial string, month string, usage_hours string, reading string, row bigint"


def feed(rows_of_a_kind=40, seed=5):
    """Clean histories, rows with missing or unknown keys, one valid key and one channel over and over, jumps inside histories."""
    r = np.random.default_rng(seed)
    rows = []
    for t in range(6):
        for m in range(30):
            reading = 0.1 * m + (12.0 if (t, m) == (2, 11) else 0.0)
            rows.append((f"T{t}", "A1", str(t), str(m), "40", f"{reading:.2f}"))
    for i in range(rows_of_a_kind):
        rows.append((None, None, None, None, "40", "1"))
        rows.append((None, None, None, str(i), "40", "1"))  # months that no history has
        rows.append(("T9", "A1", "7", str(i % 3), "40", "1"))
        rows.append(("T1", "A1", "1", "4", "40", str(i)))  # the key of a good row
        rows.append(("T1", "A1", "1", "x", "40", "1"))
        rows.append(("T2", "ZZ", str(i), "5", "-1", "1"))
    order = r.permutation(len(rows))
    return [(*rows[j], int(i)) for i, j in enumerate(order)]


def screened(spark, rows):
    made = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return ingest.screen(made, spark.createDataFrame([(f"T{t}",) for t in range(6)], "tail string"), ["A1"], 30, ["row"])


def plain(rows):
    """Reasons of each row: first in file order is kept, missing keys are equal, neighbours are rows without any reason."""
    seen, out = set(), {}
    for tail, comp, serial, month, usage, reading, row in sorted(rows, key=lambda x: x[-1]):
        numbers = []
        for x in (serial, month, usage, reading):
            try:
                numbers.append(float(x))
            except (TypeError, ValueError):
                numbers.append(None)
        s, m, u, v = numbers
        why = ["TYPE"] * numbers.count(None)
        why += ["UNKNOWN_TAIL"] if tail not in {f"T{t}" for t in range(6)} else []
        why += ["UNKNOWN_COMP"] if comp != "A1" else []
        why += ["MONTH_RANGE"] if m is not None and not 0 <= m < 30 else []
        why += ["USAGE_NEGATIVE"] if u < 0 else []
        why += ["DUPLICATE"] if (tail, comp, s, m) in seen else []
        why += ["READING_FENCE"] if v > 30 else []
        seen.add((tail, comp, s, m))
        out[row] = (why, (tail, comp, s), m, v)
    by = collections.defaultdict(list)
    for row, (why, part, m, v) in out.items():
        if not why:
            by[part].append((m, v, row))
    for group in by.values():
        group.sort()
        for (_, a, _), (_, b, row), (_, c, _) in zip(group, group[1:], group[2:], strict=False):
            if abs(b - a) > 5 and abs(b - c) > 5 and abs(c - a) < 2.5:
                out[row][0].append("POINT_OUTLIER")
    return {row: ";".join(why) for row, (why, *_) in out.items()}


@pytest.mark.parametrize("least", [1, 2, 30, 10_000])
def test_reasons_of_a_dirty_feed(spark, monkeypatch, least):
    """Whatever counts as frequent, the reasons are the same."""
    monkeypatch.setattr(ingest, "LEAST_FREQUENT", least)
    rows = feed()
    got = {r["row"]: ";".join(r["reasons"]) for r in screened(spark, rows).collect()}
    assert got == plain(rows) and "POINT_OUTLIER" in got.values() and "DUPLICATE" in got.values()


@pytest.mark.parametrize("kind", ["null keys", "one good key", "months of no history"])
def test_no_task_gets_a_frequent_key(spark, kind):
    """Half of a feed has one key (or one part of a key): the largest task stays below twice the median one."""
    n = 30_000
    good = spark.range(n).select((F.col("id") % 6).alias("t"), "id").select(F.concat(F.lit("T"), F.col("t")).alias("tail"), F.lit("A1").alias("component"), (F.col("id") * 7).cast("string").alias("serial"), F.lit("3").alias("month"), "id")
    null = F.lit(None).cast("string")
    bad = {
        "null keys": [null, null, null, null],
        "one good key": [F.lit("T1"), F.lit("A1"), F.lit("1"), F.lit("2")],
        "months of no history": [null, null, null, (F.col("id") + 100).cast("string")],
    }[kind]
    dirty = spark.range(n, 2 * n).select(*[c.alias(x) for c, x in zip(bad, ("tail", "component", "serial", "month"), strict=True)], "id")
    rows = good.unionByName(dirty).select("*", F.lit("40").alias("usage_hours"), F.lit("1").alias("reading")).repartition(6)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = ingest.screen(rows, spark.createDataFrame([(f"T{t}",) for t in range(6)], "tail string"), ["A1"], 30, ["id"])
        tasks = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(tasks) == 2 * n and len(tasks) == 24 and max(tasks) < 2 * np.median(tasks)
        again = out.where(F.array_contains("reasons", "DUPLICATE")).agg(F.count(F.lit(1)), F.min("id")).first()
        assert tuple(again) == {"months of no history": (0, None)}.get(kind, (n - 1, n + 1))  # the first in order is kept
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_order_of_rows_over_several_files(spark, tmp_path):
    """The order column of a folder of CSV files grows by file and, within a file, by row, over many splits; the first of duplicates is that of the first file."""
    from oxidara.sources.store import read_inspections

    header = "tail,component,serial,month,usage_hours,reading\n"
    folder = tmp_path / "feed.csv"
    folder.mkdir()
    number = 0
    for name in ("part-2.csv", "part-0.csv", "part-1.csv"):
        rows = [f"T{i % 6},A1,{i // 30},{i % 30},40,{number + i}\n" for i in range(1500)]
        (folder / name).write_text(header + "".join(rows))
        number += 10_000
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = read_inspections(spark, str(folder), "place")
        got = [float(r["reading"]) for r in rows.orderBy("place").collect()]
        assert rows.rdd.getNumPartitions() > 6
        assert got == [x + i for x in (10_000.0, 20_000.0, 0.0) for i in range(1500)]  # part-0, part-1, part-2
        screened = ingest.screen(rows, spark.createDataFrame([(f"T{t}",) for t in range(6)], "tail string"), ["A1"], 30, ["place"], upper_fence=1e9, jump=1e9)
        kept = sorted(r["reading"] for r in ingest.clean(screened).collect())
        assert kept == [10_000.0 + i for i in range(1500)]  # the other two files repeat its keys
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)

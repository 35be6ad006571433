"""Readers of inspection files, and the store that cuts lineage between iterative steps."""

from __future__ import annotations

import tempfile
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see: spark.checkpoint.dir.  Only on a single machine, where it may be unset, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        return _own_folder()
    return folder


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def settle(frame: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, by a checkpoint in the folder that all executors share."""
    context = frame.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()


def read_inspections(spark: SparkSession, path: str, file_order: str = "_row") -> DataFrame:
    """Inspection records as text columns, from Parquet, or from CSV with a header (a file or a folder of them).

    file_order: a column that grows with the place in the source, for rules that keep the first of copies: by file name, then by
    row.  Spark's ids of CSV rows grow within a file, as its splits are numbered in the order of their offsets."""
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        rows = spark.read.option("header", True).csv(path)
        return rows.withColumn(file_order, F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    frame = spark.read.parquet(path)
    return frame.withColumn(file_order, F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")))


def read_meta(spark: SparkSession, path: str) -> dict:
    """What a JSON document (one object) says of a source: n_months, forecast_months, components."""
    row = spark.read.option("multiLine", True).json(path).first()
    return row.asDict(recursive=True)


def read_matrix(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A numeric CSV file without a header, its columns named in order."""
    return spark.read.schema(", ".join(f"`{c}` double" for c in columns)).csv(path)


def write_csv(frame: DataFrame, path: str) -> None:
    """CSV with a header, in which unknown numbers are spelt NaN: an empty field reads as zero elsewhere."""
    kinds = dict(frame.dtypes)
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NaN") if kinds[c] in ("double", "float", "int", "bigint") or kinds[c].startswith("decimal") else F.lit("")).alias(c) for c in frame.columns]
    frame.select(*texts).write.mode("overwrite").option("header", True).csv(path)


def write_ledger(frame: DataFrame, path: str) -> None:
    """One JSON document per channel."""
    frame.select(F.to_json(F.struct(*frame.columns)).alias("value")).write.mode("overwrite").text(path)


def examples(frame: DataFrame, kinds: list[str], order: str = "chan") -> DataFrame:
    """For each combination of kinds, the row with the smallest order."""
    return frame.groupBy(*kinds).agg(F.min_by(F.struct(*frame.columns), order).alias("_r")).select("_r.*")

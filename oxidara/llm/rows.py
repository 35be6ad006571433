"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


#: Rows and bytes of one Arrow batch, so that a Python worker's memory is bounded by few texts.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def limit_batches(spark: SparkSession) -> SparkSession:
    """Limit the session's Arrow batches to BATCH_LIMITS where they may be larger.  Queries and pipeline stages do this; the operators leave a session as it is."""
    for key, most in BATCH_LIMITS.items():
        now = spark.conf.get(key, None)
        if now is None or not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    return spark


def own_columns(frame: DataFrame, names: dict[str, str]) -> DataFrame:
    """Only the columns that an operator works on, under the operator's own names.

    names: own name -> column of the frame.  Other columns, whatever their names, are left out, so they cannot clash."""
    return frame.select(*[F.col(f"`{column}`").alias(own) for own, column in names.items()])


def and_fields(field: StructField, ddl: str) -> StructType:
    """A schema of a carried field, whatever the names inside it, and the fields of ddl."""
    return StructType([field, *StructType.fromDDL(ddl).fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def cut(frame: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, by a checkpoint in the folder that the cluster shares."""
    context = frame.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()


def stored(frame: DataFrame) -> DataFrame:
    """The same rows read back from a Parquet table in the folder that the cluster shares: like cut, but smaller, and read by columns."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def fold(column: str, parts: int):
    """crc32 of a number as text, modulo parts."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(parts))

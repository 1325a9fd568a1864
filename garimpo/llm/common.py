"""Helpers shared by the corpus operators: shared scratch space and durable intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_LOCAL_SCRATCH: list[str] = []

#: Words are runs of anything but ASCII white space (a regular expression valid in Java, Python and RE2).
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Where that is unset, a local master
    (tests) gets one temporary folder per process and any other master gets the warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if not _LOCAL_SCRATCH:
        _LOCAL_SCRATCH.append(tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp"))
    return _LOCAL_SCRATCH[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage at files that outlive any executor, and makes several uses of ``df`` see
    the same rows.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a number of its own for each row in ``column``; written once, so that the numbers hold."""
    return materialise(df.withColumn(column, F.monotonically_increasing_id()), "numbered")


def crc32_of_id(col):
    """CRC-32 of an id written as decimal text (null id: null)."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

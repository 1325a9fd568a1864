"""Incremental jobs: pull what is new, skip what was seen, write by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_parquet(spark: SparkSession, folder: str, schema, files_per_batch: int = 16) -> DataFrame:
    """Files that appear in a folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def shared(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``, else the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch").rstrip("/")


def first_rows(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key the first row, by ``order`` among those that come together, in update mode with ``_new``: whether it came just now.

    The least row by (batch time, order, hash of the row) is an aggregate of its own, so keys are met on the JVM alone; later batches never undercut it. The state holds the first row of each key.
    """
    row = F.struct(*[F.col(c) for c in stream.columns])
    others = [c for c in stream.columns if "map<" not in stream.schema[c].dataType.simpleString()]
    first = F.min_by(row, F.struct("_now", *order, F.xxhash64(*others)))
    return stream.withColumn("_now", F.current_timestamp()).groupBy(F.col(key).alias("_key")).agg(first.alias("_first"), F.min("_now").alias("_met")).select("_first.*", (F.col("_met") == F.current_timestamp()).alias("_new"))


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """(value): lines of the bulk files that appear in a folder, decoded from latin-1; empty lines are left out."""
    read = spark.readStream.schema("value string").option("encoding", "ISO-8859-1").option("sep", "\x01").option("quote", "").option("maxFilesPerTrigger", files_per_batch)
    return read.csv(folder).filter("value is not null")


def process_unseen(stream: DataFrame, out_path: str, key: str, handle: Callable[[DataFrame], DataFrame], checkpoint: str, order: list[str]) -> StreamingQuery:
    """Run ``handle`` over the first row of each key; what it returns is written below ``out_path``.

    A key counts as met even if ``handle`` drops its row, and no batch reads what earlier ones wrote. A retried batch replaces
    its own folder, so nothing is written twice. Ends when all that is there was read.
    """

    def one(batch: DataFrame, number: int) -> None:
        handle(batch.filter("_new").drop("_new")).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return first_rows(stream, key, order).writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_stream(stream: DataFrame, key: str) -> DataFrame:
    """Each key once, ever; the state holds the keys."""
    return stream.dropDuplicates([key])

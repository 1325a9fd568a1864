"""Progress of running jobs: a row a batch, counted in the pass that writes the batch."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

PROGRESS = "batch long, read long, kept long, dropped map<string,long>"
NAME = "job_progress"


def counted(rows: DataFrame, reason: Column, reasons: list[str]) -> DataFrame:
    """The rows whose ``reason`` is null; all of them are counted as they pass, kept ones and dropped ones by reason.

    ``reasons`` names every value that ``reason`` can take; another one counts as ``other``. The counts ride on the tasks that read the
    batch: a task that is lost after it was counted and runs again counts its rows once more.
    """
    why = F.when(reason.isNotNull() & ~reason.isin(reasons), "other").otherwise(reason)
    several = [F.count_if(F.col("_reason") == r).alias(f"dropped_{r}") for r in [*reasons, "other"]]
    seen = rows.withColumn("_reason", why).observe(NAME, F.count(F.lit(1)).alias("read"), F.count_if(F.col("_reason").isNull()).alias("kept"), *several)
    return seen.filter("_reason is null").drop("_reason")


class ProgressRows(StreamingQueryListener):
    """Writes the counts of each batch of one query to a folder of the batch's number, as soon as the batch is done."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.name, self.query = f"counted-{uuid.uuid4().hex}", None
        self.ended, self.failed = threading.Event(), None

    def onQueryStarted(self, event) -> None:  # before start() returns
        if event.name == self.name:
            self.query = str(event.id)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(NAME)
        if str(event.progress.id) != self.query or found is None or event.progress.numInputRows == 0:
            return
        n = found.asDict()
        dropped = {k.removeprefix("dropped_"): v for k, v in n.items() if k.startswith("dropped_") and (v or k != "dropped_other")}
        row = self.spark.createDataFrame([(n["read"], n["kept"], dropped)], PROGRESS.split(", ", 1)[1])
        try:
            row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={event.progress.batchId}")  # one row
        except Exception as e:  # told by finish(); a report must not end the job
            self.failed = e

    def onQueryTerminated(self, event) -> None:
        if str(event.id) == self.query:
            self.ended.set()


def run_counted(stream: DataFrame, out_path: str, progress_path: str, checkpoint: str, once: bool = True) -> tuple[StreamingQuery, ProgressRows]:
    """Write a :func:`counted` stream below ``out_path``, and a row of counts for each batch below ``progress_path``.

    A batch that is tried again replaces its rows and its counts, so neither is doubled. Counts are a report, not a ledger: a driver that dies between a
    batch and its report leaves no row for it.
    """
    spark = stream.sparkSession
    rows = ProgressRows(spark, progress_path)

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    spark.streams.addListener(rows)
    query = stream.writeStream.queryName(rows.name).foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**({"availableNow": True} if once else {"processingTime": "1 second"})).start()
    return query, rows


def finish(query: StreamingQuery, rows: ProgressRows, patience: float = 60.0) -> None:
    """Wait for the query and for its last row of counts."""
    try:
        query.awaitTermination()
        if not rows.ended.wait(patience) or rows.failed:
            raise RuntimeError("the last counts didn't arrive") from rows.failed
    finally:
        rows.spark.streams.removeListener(rows)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """(batch, read, kept, dropped): one row a batch that ended."""
    return spark.read.schema(PROGRESS).parquet(path).select("batch", "read", "kept", "dropped")


def summary(progress: DataFrame) -> DataFrame:
    """One row: batches, rows read, kept and dropped so far."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return progress.agg(F.count("*").alias("batches"), total("read"), total("kept")).withColumn("dropped", F.col("read") - F.col("kept"))

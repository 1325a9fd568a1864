"""Stored tables laid out by their key: hash buckets as partitions, so that a change rewrites what it touches, and catalogue buckets, so that joins by key don't shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import store

BUCKETS = 64


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write(df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """``df`` as a new table of ``buckets`` folders by the hash of its ``keys``; large folders get several files."""
    laid = df.withColumns({"_of": F.lit(buckets), "_bucket": _bucket(keys, buckets)})
    laid.hint("rebalance", "_bucket").write.partitionBy("_of", "_bucket").option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_of", "_bucket")


def merge(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], how: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """Put ``rows`` into the table at ``path`` by ``how(stored, rows)``, which gives the new rows of the keys' buckets; returns the buckets rewritten.

    Only the buckets that ``rows`` fall into are read and replaced; their numbers, no more than buckets, are all that the driver sees. The new files
    wait beside the table until all of them are there, so a run that fails leaves every bucket as it was. One writer at a time.
    """
    stored = spark.read.parquet(path)
    of = stored.select("_of").first()
    if of is None:
        raise ValueError("an empty table has no layout; write it anew")
    placed = rows.withColumn("_bucket", _bucket(keys, of[0]))
    touched = sorted(r[0] for r in placed.select("_bucket").distinct().collect())
    if not touched:
        return 0
    old = stored.filter(F.col("_bucket").isin(touched)).drop("_of", "_bucket")
    new = how(old, placed.drop("_bucket")).withColumns({"_of": F.lit(of[0]), "_bucket": _bucket(keys, of[0])})
    out = new.hint("rebalance", "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    out.partitionBy("_of", "_bucket").parquet(path)
    return len(touched)


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], order: list[Column]) -> int:
    """:func:`store.upsert` on a stored table."""
    return merge(spark, path, rows, keys, lambda old, new: store.upsert(old, new, keys, order))


def insert_new(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], order: list[Column] | None = None) -> int:
    """:func:`store.insert_new` on a stored table."""
    return merge(spark, path, rows, keys, lambda old, new: store.insert_new(old, new, keys, order))


def add_counts(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], counter: str) -> int:
    """:func:`store.add_counts` on a stored table of keys and one counter."""
    return merge(spark, path, rows, keys, lambda old, new: store.add_counts(old, new, keys, counter))


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """``df`` as the catalogue's table ``name``, bucketed and sorted by ``key``: one file a bucket, and joins with other tables of as many buckets by that key need no shuffle."""
    out = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (out if path is None else out.option("path", path)).saveAsTable(name)
    return df.sparkSession.table(name)

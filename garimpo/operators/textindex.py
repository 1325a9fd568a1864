"""A posting table of trigrams, so that a search for a piece of text reads the companies that may hold it instead of all of them.

Texts are folded (lower case, no accents) and cut into their distinct runs of three characters. A text that holds the query holds all of its trigrams, so the
companies of the rarest few of these are candidates; the filter's own test then decides. Postings lie sorted by trigram, so few row groups are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import fold

GRAM = 3
#: Lists that are intersected at most: the rarest ones of a query.
LISTS = 4


def _folded(c: Column) -> Column:
    return F.lower(fold(F.lower(c)))


def _grams(c: Column) -> Column:
    """The distinct trigrams of a folded text; none for shorter ones."""
    starts = F.when(F.length(c) >= GRAM, F.sequence(F.lit(1), F.length(c) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, F.lit(GRAM))))


def write(companies: DataFrame, path: str, columns: list[str], key: str = "cnpj", row_group_bytes: int = 4 << 20) -> None:
    """The postings (gram, key) of the given text columns, and how many keys each trigram has. One trigram may be in a third of all rows: its list is
    cut into ranges by key, like any other."""
    texts = companies.select(F.col(key).alias("key"), F.explode(F.array(*[_folded(F.col(c)) for c in columns])).alias("text")).filter("text is not null")
    rows = texts.select("key", F.explode(_grams(F.col("text"))).alias("gram")).distinct()
    out = rows.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", row_group_bytes)
    out.parquet(f"{path}/postings")
    counts = companies.sparkSession.read.parquet(f"{path}/postings").groupBy("gram").count()
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, q: str) -> DataFrame | None:
    """(key): rows that may hold ``q``, each once; none at all if the query is shorter than a trigram."""
    told = spark.range(1).select(_grams(_folded(F.lit(q.strip()))).alias("g")).first()["g"]
    if not told:
        return None
    known = {r["gram"]: r["count"] for r in spark.read.parquet(f"{path}/counts").filter(F.col("gram").isin(told)).collect()}  # no more than the query has
    rows = spark.read.parquet(f"{path}/postings")
    if len(known) < len(told):  # a trigram that no text has
        return rows.select("key").limit(0)
    rare = sorted(told, key=lambda g: (known[g], g))[:LISTS]
    return rows.filter(F.col("gram").isin(rare)).groupBy("key").count().filter(F.col("count") == len(rare)).select("key")


def narrowed(companies: DataFrame, path: str, q: str | None, key: str = "cnpj") -> DataFrame:
    """``companies`` without those that can't hold ``q`` in the indexed columns. The filters that follow give the rows that they give without an index."""
    found = candidates(companies.sparkSession, path, q) if q and q.strip() else None
    return companies if found is None else companies.join(found.withColumnRenamed("key", key), key, "left_semi")

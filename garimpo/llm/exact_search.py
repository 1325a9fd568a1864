"""Exact top-k search by exhaustive term-at-a-time accumulation.

Candidates and queries are cut into blocks of bounded size; every block of queries meets every block
of candidates in one task. There a term's (dimension's) postings are scattered, weighted by the
query's own weight, into a dense array of scores, one term after the other; a partition selection
keeps each query's best of the block, and a merge over the blocks keeps the best of all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Queries of a task: every candidate is shuffled once for each block of them, so few large blocks.
QUERY_BLOCK = 16_384
CANDIDATE_BLOCK = 32_768
#: Queries whose score arrays are held at once: 64 x 32768 x 8 bytes are 16 MB.
QUERIES_AT_ONCE = 64
LONG = (-(2**63), 2**63 - 1)


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, weights): floor(scale * x) of each component, as long. Rows with a null id, a null
    vector or a null or non-finite component take no part."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("weights")
    )


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of weights; shorter vectors count as 0 in the terms they lack."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.diff(column.offsets.to_numpy()).astype(np.int64)
    out = np.zeros((len(n), int(n.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < n[:, None]] = flat
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores (queries x candidates), term at a time. Exact: beyond 62 bits in Python's integers."""
    terms = min(queries.shape[1], candidates.shape[1])
    peak = lambda m: max(abs(int(m.min(initial=0))), abs(int(m.max(initial=0))))
    small = peak(queries) * peak(candidates) * max(terms, 1) < 2**62
    if not small:
        queries, candidates = queries.astype(object), candidates.astype(object)
    scores = np.zeros((len(queries), len(candidates)), np.int64 if small else object)
    for t in range(terms):
        rows, postings = np.flatnonzero(queries[:, t]), np.flatnonzero(candidates[:, t])
        if not len(rows) or not len(postings):
            continue
        weight, held = queries[rows, t], candidates[postings, t]
        if len(postings) == len(candidates):
            for r, w in zip(rows, weight, strict=True):
                scores[r] += w * held
        else:
            for r, w in zip(rows, weight, strict=True):
                scores[r, postings] += w * held
    return scores if small else np.clip(scores, *LONG)


def best_of(row: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest values; among equals the first ones."""
    if len(row) <= k:
        return np.arange(len(row))
    edge = np.partition(row, len(row) - k)[len(row) - k]
    above = np.flatnonzero(row > edge)
    return np.concatenate([above, np.flatnonzero(row == edge)[: k - len(above)]])


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search_block(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(candidates) or not len(queries):
            return _FOUND.empty_table()
        candidates = candidates.combine_chunks().sort_by("vec_id")
        ids = candidates["vec_id"].to_numpy()
        held = np.asfortranarray(_matrix(candidates["weights"].combine_chunks()))
        asked, wanted = queries["vec_id"].to_numpy(), _matrix(queries["weights"].combine_chunks())
        out: list[tuple[int, int, int]] = []
        for at in range(0, len(asked), QUERIES_AT_ONCE):
            scores = accumulate(wanted[at : at + QUERIES_AT_ONCE], held)
            for q, row in zip(asked[at : at + QUERIES_AT_ONCE], scores, strict=True):
                own = ids == q
                kept = np.flatnonzero(~own) if own.any() else None
                best = best_of(row if kept is None else row[kept], k)
                best = best if kept is None else kept[best]
                out += [(int(q), int(ids[b]), int(row[b])) for b in best]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [[], [], []], schema=_FOUND)

    return run


def search(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 5,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """Each query's ``k`` best candidates (all, if fewer) by integer inner product.

    Returns (query_id long, rank int from 1, vec_id long, score long); ties go to the smaller vec_id.
    A query's own row, that is every row with its id, is no candidate of it. Null ids and vectors that
    are null or hold null or non-finite components take no part; vectors of other lengths score over the terms
    both have; an empty vector scores 0. A repeated id is asked once, with its least vector, while
    each of its rows stays a candidate for others. Scores beyond a long stop at its ends and rank as such. Empty tables
    give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    held = quantised(vectors, id_col, vec_col)
    asked = quantised(queries, id_col, vec_col).groupBy("vec_id").agg(F.min("weights").alias("weights"))
    # of equal rows, which would all meet in one block, no more than k can be among a query's best
    held = held.groupBy("vec_id", "weights").count().select("vec_id", "weights", F.explode(F.sequence(F.lit(1), F.least("count", F.lit(k)))).alias("_copy")).drop("_copy")
    n, m = held.count(), asked.count()
    cores = spark.sparkContext.defaultParallelism
    n_c = max(1, math.ceil(n / candidate_block), min(2 * cores, math.ceil(n / 1_024)))
    n_q = max(1, math.ceil(m / query_block))

    # every row goes to a block of its own kind and is copied to the blocks of the other kind
    key = lambda n_blocks: F.pmod(F.xxhash64("vec_id", "weights"), F.lit(n_blocks)).cast("int")
    every = lambda n_blocks: F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    held = held.select(key(n_c).alias("c"), every(n_q).alias("q"), "vec_id", "weights")
    asked = asked.select(every(n_c).alias("c"), key(n_q).alias("q"), "vec_id", "weights")
    found = held.groupBy("c", "q").cogroup(asked.groupBy("c", "q")).applyInArrow(_search_block(k), "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

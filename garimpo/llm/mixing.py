"""Mixing sources to target weights with DataFrame operations only.

Every document gets a hash-random key. A uniform hash cut into equal ranges is already range
partitioned, so the top bits of the key (the *range*) sort a source coarsely without sampling it;
totals per (source, range) give each range the words before it, and one running sum inside a range
completes the prefix sum. No source, however large, meets in one task: it has as many ranges as its
size asks for. The budget then cuts the prefix sum at an exact word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, materialise, numbered

#: Rows of all sources together that fall in one range of keys.
ROWS_PER_RANGE = 20_000
#: Bits of the hash-random key.
KEY_BITS = 60


def word_count(text: str | Column) -> Column:
    """Number of words; null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(*cols: str, seed: str = "mix") -> Column:
    """A uniform key of KEY_BITS bits from MD5, the same on every run and in every SQL engine."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, source: str, weights: list[float], max_epochs: int, share: float = 1.0) -> DataFrame:
    """Target words of each source.

    ``sizes`` has one row a source (``source``, ``source_size``). Sources in code point order, null
    last, take ``weights`` in turn and share ``share`` of all words. A target above ``max_epochs``
    times its source stops there and the excess goes to the others by weight until none is above:
    filling by water, closed in one sort. A source is full if its level ``max_epochs * size / weight``
    is at most the level at which everything before it in that order is full and the rest share.
    One row a source, some hundred bytes, is sorted in one task: meant for up to some ten million sources.
    """
    one = Window.partitionBy(F.lit(0))
    order = one.orderBy(F.col(source).isNull(), F.col(source))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_n") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = (
        sizes.withColumn("_n", F.row_number().over(order))
        .withColumn("_w", w)
        .withColumn("_cap", F.col("source_size") * F.lit(max_epochs))
        .withColumn("_level", F.col("_cap").cast("double") / F.col("_w"))
    )
    filling = one.orderBy("_level", "_n").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(one).cast("double") * F.lit(float(share))
    water = (
        ranked.withColumn("_before", F.coalesce(F.sum("_cap").over(filling), F.lit(0)).cast("double"))
        .withColumn("_left", F.sum("_w").over(one) - F.coalesce(F.sum("_w").over(filling), F.lit(0.0)))
        .withColumn("_water", (total - F.col("_before")) / F.col("_left"))
        .withColumn("_full", F.col("_level") <= F.col("_water"))
    )
    # the first source, by level, that isn't full sets the level of all others
    level = F.min(F.when(~F.col("_full"), F.struct("_level", "_n", "_water"))).over(one)["_water"]
    return water.withColumn("target", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_w") * level)).select(source, "source_size", "target")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: list[float] = (5.0, 2.0, 1.0),
    max_epochs: int = 3,
    seed: str = "mix",
    rows_per_range: int = ROWS_PER_RANGE,
    carried: tuple[str, ...] = (),
) -> DataFrame:
    """How many words of each document the mix takes.

    Returns (id_col, ``source``, ``size``, ``source_size``, ``target``, ``epochs``, ``part``, ``taken``),
    one row a document: ``epochs`` whole passes and the first ``part`` words of one more, so
    ``taken = epochs * size + part``. A source's taken words are its target rounded to a word: whole
    passes over the source first, then documents in the order of their hash-random keys up to the
    budget, which cuts the last of them.

    Null text has size 0 and is taken 0 times a word. Null sources form one source, ordered last.
    An empty table gives no rows. Repeated rows are documents of their own. Other columns, whatever
    their names, are not read. Rows of equal key (repeated ids) are ordered by size; those of one id in one source lie in one range. Texts of any length are counted whole. Columns named in ``carried``
    come along as they are and order what else is equal.
    """
    base = materialise(
        docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(text_col).alias("size"), hash_key(id_col, seed=seed).alias("_key"), *carried),
        "mix-sizes",
    )
    bits = max(8, math.ceil(math.log2(max(1.0, base.count() / rows_per_range))))
    base = base.withColumn("_range", F.shiftright("_key", KEY_BITS - bits))

    cells = base.groupBy("_source", "_range").agg(F.sum("size").alias("_cell"))
    # a source has at most n_ranges cells
    by_range = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.withColumn("_before", F.coalesce(F.sum("_cell").over(by_range), F.lit(0)))
    sizes = cells.groupBy(F.col("_source").alias("_s")).agg(F.sum("_cell").alias("source_size"))
    goal = targets(sizes, "_s", list(weights), max_epochs)
    before = before.join(goal, before["_source"].eqNullSafe(goal["_s"])).select("_source", "_range", "_before", "source_size", "target")

    inside = Window.partitionBy("_source", "_range").orderBy("_key", "size", "_id", *carried).rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    right = before.select(F.col("_source").alias("_s"), F.col("_range").alias("_r"), "_before", "source_size", "target")
    joined = placed.join(right, placed["_source"].eqNullSafe(right["_s"]) & (placed["_range"] == right["_r"]))

    return (
        joined.withColumn("_budget", F.floor(F.col("target") + 0.5).cast("long"))
        .withColumn("epochs", F.expr(f"least({int(max_epochs)}L, _budget div greatest(source_size, 1L))"))
        .withColumn("_rest", F.col("_budget") - F.col("epochs") * F.col("source_size") - F.col("_before") - F.col("_in"))
        .withColumn("part", F.when(F.col("epochs") >= max_epochs, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least("size", "_rest"))).cast("long"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
        .select(F.col("_id").alias(id_col), F.col("_source").alias("source"), "size", "source_size", "target", "epochs", "part", "taken", *carried)
    )


def take(docs: DataFrame, weights: list[float] = (5.0, 2.0, 1.0), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The mixed corpus itself: each document once for every whole pass, and once more, cut to
    ``part`` words, where the budget ends inside another pass. Columns are those of ``docs``
    (doc_id, text, source and n_chars are used); every row is taken as the plan says for that row.
    """
    pair = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text"))
    keyed = numbered(docs, "_mix_row")
    plan = mix(keyed.select(pair.alias("_mix_pair"), "text", "source", "_mix_row"), "_mix_pair", weights=weights, max_epochs=max_epochs, seed=seed, carried=("_mix_row",))
    plan = plan.filter("taken > 0").select("_mix_row", *[F.col(c).alias(f"_mix_{c}") for c in ("size", "epochs", "part")])
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("_mix_part").cast("int")), " ")
    rows = (
        keyed.join(plan, "_mix_row")
        .withColumn("_mix_copy", F.explode(F.expr("sequence(1L, _mix_epochs + if(_mix_part > 0, 1L, 0L))")))
        .withColumn("_mix_cut", (F.col("_mix_copy") > F.col("_mix_epochs")) & (F.col("_mix_part") < F.col("_mix_size")))
    )
    out = rows.withColumn("text", F.when(F.col("_mix_cut"), cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_mix_cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)

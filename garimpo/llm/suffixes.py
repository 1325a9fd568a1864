"""Repeated passages by sparse suffix arrays.

Only the suffixes that begin at content-selected positions are kept: in every stretch of ``w``
consecutive k-grams the one with the least hash (a minimiser). Any passage of ``least`` words
holds such a position among its first ``w``, so its suffix there shares at least ``least - w + 1``
words (the *core*) with the passage's other places. Suffixes are dealt by the hash of their core and sorted by it and what
follows. Each passage of ``least`` words is hashed at the one minimiser of its first window, and hashes are counted over all
places of that core: inside its partition, or by an aggregate for a core of very many places, whose rows a bounded
sample has told to deal at random. Longer passages hold further minimisers, whose matches join up, so nothing beyond those words has to be carried.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialise, numbered, partitions

LEAST_WORDS, GRAM, WINDOW = 50, 8, 20
BASE = 0x9E3779B97F4A7C15
WORDS_KEPT = 400_000
#: Suffixes, beside those of one document, that a worker holds before it sends them on.
ROWS_AT_ONCE = 20_000
#: Documents a partition from which the cores of very many places are told.
SAMPLED = 20


class _Words(dict):
    """Word -> 64-bit hash; forgotten when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _Words()
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i < n."""
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((BASE, _INVERSE)):
                _POWERS[k] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, np.uint64(base)), dtype=np.uint64)])
    return _POWERS[0][:n], _POWERS[1][:n]


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words: differences of a prefix sum, brought to a common power and mixed."""
    up, down = _powers(len(words) + 1)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(words * up[: len(words)], dtype=np.uint64)])
        h = (prefix[n:] - prefix[:-n]) * down[: len(words) - n + 1]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def minimisers(words: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the least k-gram (the last one among equals) of every ``window`` consecutive ones,
    and the first and last of the windows of each: they follow one another."""
    grams = window_hashes(words, gram)
    if len(grams) < window:
        return (np.empty(0, np.int64),) * 3
    out = []
    for at in range(0, len(grams) - window + 1, 1 << 16):
        part = np.lib.stride_tricks.sliding_window_view(grams[at : at + (1 << 16) + window - 1], window)
        out.append(at + np.arange(len(part)) + window - 1 - part[:, ::-1].argmin(axis=1))
    pos, first, n = np.unique(np.concatenate(out), return_index=True, return_counts=True)
    return pos, first, first + n - 1


def _suffixes(docs: DataFrame, id_col: str, text_col: str, least: int, gram: int, window: int, hot: np.ndarray) -> DataFrame:
    """(core, passages, doc, pos, low, high, deal): one row a kept suffix. The passages of ``least`` words that begin ``low`` to ``high`` words
    before it have it as their minimiser; each has one. ``passages`` are the 64-bit hashes of all of their words, the one that begins ``low`` before it first.
    Rows go by ``deal``: the core, or, for one of ``hot``, a hash of the place."""
    core = least - window + 1

    def rows(parts: list, docs_of: pa.Array) -> pa.RecordBatch:
        held = np.concatenate([p[2] for p in parts])
        ends = np.concatenate([[0], np.cumsum(np.concatenate([p[5] - p[4] + 1 for p in parts]))]).astype(np.int32)
        passages = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(8 * ends), pa.py_buffer(held)])
        of = np.repeat([p[0] for p in parts], [len(p[3]) for p in parts])
        cores, doc = np.concatenate([p[1] for p in parts]), docs_of.take(pa.array(of))
        deal, spread = cores.copy(), np.isin(cores, hot)
        if spread.any():
            at = np.concatenate([p[3] for p in parts])[spread]
            deal[spread] = (doc.to_numpy()[spread] << 20) ^ at
        return pa.RecordBatch.from_arrays(
            [pa.array(cores), passages, doc, *(pa.array(np.concatenate([p[k] for p in parts]).astype(np.int32)) for k in (3, 4, 5)), pa.array(deal)],
            names=[*_ROW, "deal"],
        )

    def run(batches):
        for batch in batches:
            parts, held = [], 0
            for i, text in enumerate(batch.column(1)):
                tokens = text.as_py().encode("utf-8", "surrogatepass").split() if text.is_valid else []
                if len(tokens) < least:
                    continue
                words = np.fromiter(map(_WORDS.__getitem__, tokens), np.uint64, len(tokens))
                pos, first, last = minimisers(words, gram, window)
                inside = first <= len(words) - least
                pos, first, last = pos[inside], first[inside], np.minimum(last[inside], len(words) - least)
                low, high = pos - last, pos - first
                # passage by passage, backwards from the one that begins ``low`` words before
                at = np.repeat(last, high - low + 1) - (np.arange(int((high - low + 1).sum())) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1))
                parts.append((i, window_hashes(words, core)[pos].view(np.int64), window_hashes(words, least)[at], pos, low, high))
                held += len(pos)
                if held >= ROWS_AT_ONCE:
                    yield rows(parts, batch.column(0))
                    parts, held = [], 0
            if parts:
                yield rows(parts, batch.column(0))

    return docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), text_col).mapInArrow(run, "core long, passages binary, doc long, pos int, low int, high int, deal long")


def _hot_cores(docs: DataFrame, id_col: str, text_col: str, least: int, gram: int, window: int, group_rows: int) -> np.ndarray:
    """Cores that hold more rows than ``group_rows`` and than a partition's mean, as a sample of about ``SAMPLED`` documents
    a partition tells; never more cores than partitions. A core that the sample misses costs time, not results."""
    n, parts = docs.count(), partitions(docs.sparkSession)
    share = min(1.0, SAMPLED * parts / max(1, n))
    held = _suffixes(docs.sample(share, 7), id_col, text_col, least, gram, window, np.empty(0, np.int64)).groupBy("core").count()
    rows, most = held.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    bound = max(group_rows * share, rows / parts)
    if most <= bound:
        return np.empty(0, np.int64)
    return np.sort(np.array([r[0] for r in held.filter(F.col("count") > bound).select("core").collect()], np.int64))


_ROW = ["core", "passages", "doc", "pos", "low", "high"]
_OUT = "open boolean, core long, passages binary, doc long, pos int, low int, high int, start_word int, end_word int, keep_start int, keep_end int, first_doc long"
#: Rows of one core that a task holds at once; larger groups meet by their keys instead.
GROUP_ROWS = 100_000


def _columns(table: pa.Table) -> dict:
    """Columns as arrays, with ``passages`` end to end and where each row's begin in ``at``."""
    t = {c: table[c].to_numpy() for c in table.column_names if c != "passages"}
    t["passages"] = np.frombuffer(b"".join(table["passages"].to_pylist()), np.int64)
    n = t["high"] - t["low"] + 1
    t["at"] = np.cumsum(n) - n
    return t


def _keys(t: dict, rows: np.ndarray, i: int) -> np.ndarray:
    """Hash of the passages that begin ``i`` words before the suffixes of ``rows``."""
    return t["passages"][t["at"][rows] + i - t["low"][rows]]


def _resolve(table: pa.Table, least: int, core: int):
    """Rows of whole groups: the words of each that repeated passages cover, and those that stand here first."""
    side = least - core
    cores = table["core"].to_numpy()
    same = cores[1:] == cores[:-1]
    table = table.filter(pa.array(np.append(same, False) | np.insert(same, 0, False)))
    n = len(table)
    if not n:
        return
    t = _columns(table)
    by_place = np.lexsort((t["pos"], t["doc"]))
    new = np.ones(n, bool)
    new[1:] = (np.diff(t["doc"][by_place]) != 0) | (np.diff(t["pos"][by_place]) != 0)
    place = np.empty(n, np.int64)
    place[by_place] = np.cumsum(new) - 1
    docs = t["doc"][by_place][new]
    # most and least words before the core: of all repeated passages, and of those whose first place this is
    most, fewest = np.full((2, n), -1, np.int32), np.full((2, n), side + 1, np.int32)
    first_place = np.full(n, n, np.int64)
    for i in range(side + 1):
        rows = np.flatnonzero((t["low"] <= i) & (i <= t["high"]))
        if not len(rows):
            continue
        key = _keys(t, rows, i)
        order = np.argsort(key)
        rows, key = rows[order], key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        lengths = np.diff(np.append(starts, len(rows)))
        first, last = (np.repeat(f.reduceat(place[rows], starts), lengths) for f in (np.minimum, np.maximum))
        again = first < last
        rows, first = rows[again], first[again]
        for k, held in enumerate((rows, rows[place[rows] == first])):
            most[k, held], fewest[k, held] = np.maximum(most[k, held], i), np.minimum(fewest[k, held], i)
        first_place[rows] = np.minimum(first_place[rows], first)
    found = np.flatnonzero(most[0] >= 0)
    if not len(found):
        return
    pos, kept = t["pos"][found], most[1, found] < 0
    blank = pa.array([b""] * len(found), pa.binary())
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.zeros(len(found), bool)), pa.array(t["core"][found]), blank, pa.array(t["doc"][found]), pa.array(pos), pa.array(t["low"][found]), pa.array(t["high"][found]),
            pa.array(pos - most[0, found]), pa.array(pos - fewest[0, found] + least), pa.array(pos - most[1, found], mask=kept), pa.array(pos - fewest[1, found] + least, mask=kept),
            pa.array(docs[first_place[found]]),
        ],
        names=re.findall(r"(\w+) \w+", _OUT),
    )


def _match(rows: DataFrame, least: int, window: int, group_rows: int, hot: np.ndarray) -> DataFrame:
    """Resolve the groups of equal core of a sorted partition. Rows of ``hot`` cores and of groups that
    grow beyond ``group_rows`` come out ``open``, as they are."""
    core = least - window + 1

    def as_open(table: pa.Table):
        for b in table.combine_chunks().to_batches():
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, bool)), *b.columns, *(pa.nulls(n, pa.int32()) for _ in range(4)), pa.nulls(n, pa.int64())], names=re.findall(r"(\w+) \w+", _OUT))

    def run(batches):
        large, held = None, []  # the core that goes out as it is, and the rows of a group that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).select(_ROW)
            spread = np.isin(table["core"].to_numpy(), hot)
            if spread.any():
                yield from as_open(table.filter(pa.array(spread)))
                table = table.filter(pa.array(~spread))
            if not len(table):
                continue
            cores = table["core"].to_numpy()
            n = int(np.searchsorted(cores, large, "right")) if large is not None and cores[0] == large else 0
            if n:
                yield from as_open(table.slice(0, n))
                table, cores = table.slice(n), cores[n:]
            if not len(cores):
                continue
            last = int(np.searchsorted(cores, cores[-1], "left"))
            if last or (held and held[0]["core"][0].as_py() != cores[0]):
                yield from _resolve(pa.concat_tables([*held, table.slice(0, last)]), least, core)
                held = []
            held.append(table.slice(last))
            if sum(map(len, held)) > group_rows:
                for x in held:
                    yield from as_open(x)
                large, held = cores[-1], []
        if held:
            yield from _resolve(pa.concat_tables(held), least, core)

    return rows.mapInArrow(run, _OUT)


def _across(found: DataFrame, least: int, window: int) -> DataFrame:
    """The open rows by the keys of their passages; rows of equal surroundings go as one."""
    side = window - 1
    rows = found.filter("open").select(*_ROW).withColumn("context", F.xxhash64("core", "passages", "low", "high"))
    place = F.struct("doc", "pos")
    contexts = rows.groupBy("core", "context", "passages", "low", "high").agg(F.min(place).alias("first"), F.max(place).alias("last"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            t = _columns(pa.Table.from_batches([batch]).select(["core", "passages", "low", "high"]))
            for i in range(side + 1):
                rows = np.flatnonzero((t["low"] <= i) & (i <= t["high"]))
                at = pa.array(rows)
                key = pa.array(_keys(t, rows, i))
                kept = [batch.column(batch.schema.get_field_index(c)).take(at) for c in ("core", "context", "first", "last")]
                yield pa.RecordBatch.from_arrays([*kept, key, pa.array(np.full(len(rows), i, np.int32))], names=["core", "context", "first", "last", "key", "i"])

    places = "first struct<doc:long,pos:int>, last struct<doc:long,pos:int>"
    keys = materialise(contexts.mapInArrow(run, f"core long, context long, {places}, key long, i int"), "suffix-keys")
    # written first, the two sides of a join are plain shuffles, which Spark can split
    firsts = materialise(keys.groupBy(F.col("core").alias("_core"), F.col("key").alias("_key")).agg(F.min("first").alias("place"), F.max("last").alias("_last")).filter("place < _last").drop("_last"), "suffix-firsts")
    again = keys.join(firsts, (keys["core"] == firsts["_core"]) & (keys["key"] == firsts["_key"])).groupBy(F.col("core").alias("_core"), F.col("context").alias("_context"))
    again = materialise(again.agg(F.max("i").alias("most"), F.min("i").alias("fewest"), F.min("place.doc").alias("first_doc"), F.collect_list(F.struct("i", "place")).alias("places")), "suffix-contexts")
    own = F.transform(F.filter("places", lambda p: (p["place"]["doc"] == F.col("doc")) & (p["place"]["pos"] == F.col("pos"))), lambda p: p["i"])
    joined = rows.join(again, (rows["core"] == again["_core"]) & (rows["context"] == again["_context"])).withColumn("own", own)
    return joined.select(
        "doc", (F.col("pos") - F.col("most")).alias("start_word"), (F.col("pos") - F.col("fewest") + least).alias("end_word"),
        (F.col("pos") - F.array_max("own")).alias("keep_start"), (F.col("pos") - F.array_min("own") + least).alias("keep_end"), "first_doc",
    )


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, gram: int = GRAM, window: int = WINDOW, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Passages of at least ``least`` words that occur at more than one place.

    Returns one row a maximal span of a document: (id_col, start_word, end_word, n_words, first_doc,
    duplicate, duplicate_runs). Words are runs without ASCII white space; ``end_word`` is exclusive. A span is a run of words
    covered by passages of ``least`` words that occur again; ``first_doc`` is the smallest id in which any of them occurs.
    ``duplicate_runs`` are the (start_word, end_word) of the span's words that no passage covers whose first place (by
    document and position) is here; ``duplicate`` tells that these are all of its words.

    Null and short texts have no span, nor do rows without an id. Copies of a document are spans from end to end. A
    repeated id counts as one more place only where its text has the passage elsewhere. Whole texts of any length are
    read; an empty table gives no rows; other columns are ignored. Passages are compared by 64 bits.
    """
    if window + gram - 1 > least:
        raise ValueError("a passage must hold a whole window of k-grams")
    hot = _hot_cores(docs, id_col, text_col, least, gram, window, group_rows)
    rows = _suffixes(docs, id_col, text_col, least, gram, window, hot)
    dealt = rows.repartition(partitions(docs.sparkSession), "deal").sortWithinPartitions("core", "doc", "pos")
    found = materialise(_match(dealt, least, window, group_rows, hot), "suffixes")
    columns = ["doc", "start_word", "end_word", "keep_start", "keep_end", "first_doc"]
    placed = found.filter("not open").select(*columns).union(_across(found, least, window).select(*columns)).distinct()
    # spans of a document that overlap or touch join up
    by_start = Window.partitionBy("doc").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    islands = placed.withColumn("_new", F.when(F.coalesce(reach, F.lit(-1)) < F.col("start_word"), 1).otherwise(0)).withColumn("_span", F.sum("_new").over(by_start))
    kept = F.array_sort(F.collect_set(F.when(F.col("keep_start").isNotNull(), F.struct(F.col("keep_start").alias("a"), F.col("keep_end").alias("b")))))
    spans = islands.groupBy("doc", "_span").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("first_doc").alias("first_doc"), kept.alias("kept"))
    # what lies between the kept words
    runs = F.expr("""aggregate(concat(kept, array(struct(end_word AS a, end_word AS b))),
      struct(start_word AS at, cast(array() AS array<struct<start_word:int,end_word:int>>) AS runs),
      (s, k) -> struct(greatest(s.at, k.b) AS at, if(k.a > s.at, concat(s.runs, array(struct(s.at AS start_word, k.a AS end_word))), s.runs) AS runs),
      s -> s.runs)""")
    return spans.select(F.col("doc").alias(id_col), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc", (F.size("kept") == 0).alias("duplicate"), runs.alias("duplicate_runs"))


def _without(text: str, runs: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``runs``; white space between kept words stays as it is."""
    data = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    out, at = [], 0
    for a, b in sorted(runs):
        if b < len(spans):
            out.append(data[at : spans[a][0]])
            at = spans[b][0]
        else:  # up to the end, with the white space before it
            out.append(data[at : spans[a - 1][1] if a else 0])
            at = len(data)
    out.append(data[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def drop_repeats(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the words of duplicate runs taken out; of the places of a passage the first one keeps it, by the order of the rows as they were
    read and by position. Columns are those of ``docs``.

    It goes by row: rows that share an id, or have none, are documents of their own, and of equal rows the first stays whole. White space
    between kept words stays as it is; that of a run goes with it. Texts without a duplicate run, null and short ones stay as they are; an empty table stays empty.
    """
    rows = numbered(docs, "_repeat_row")
    found = repeats(rows, id_col="_repeat_row", least=least).filter(F.size("duplicate_runs") > 0)
    # written first, the two sides of the join are plain shuffles, which Spark can split
    found = materialise(found.groupBy(F.col("_repeat_row").alias("_of")).agg(F.flatten(F.collect_list("duplicate_runs")).alias("_runs")), "suffix-drops")
    joined = rows.join(found, rows["_repeat_row"] == found["_of"], "left")

    def run(batches):
        for batch in batches:
            texts = [_without(t, [(r["start_word"], r["end_word"]) for r in runs]) if runs and t else t for t, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_row", "_text"])

    cut = joined.filter("_runs is not null").select("_repeat_row", "text", "_runs").mapInArrow(run, "_row long, _text string")
    cut = materialise(cut, "suffix-texts")
    out = rows.join(cut, rows["_repeat_row"] == cut["_row"], "left")
    changed = F.col("_row").isNotNull()
    out = out.withColumn("text", F.when(changed, F.col("_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)

"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Bulk-synchronous best-fit. Documents go from long to short in bands whose longest is twice the
shortest. A round range-sorts the documents of a band together with the open gaps, from large to small, and every
partition sweeps its range once: a gap is put on a stack, a document takes the gap on top, which is its
successor, the smallest that holds it. A gap that holds several documents of the band stands for as many slots. Documents that
find no gap in their partition, and slots that no document of theirs took, are matched across partitions by
rank: partition after partition, the documents left over take the slots left over last, so only two counts
a partition meet on the driver. Conflicts can't remain: a slot has one rank and so does a document. Then the gaps are
updated, and the documents without one go to the next round; where no gap holds any of them, the longest
open new sequences, as many to each as must fit.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Window, functions as F

from .common import materialise, numbered

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 2
CAPACITY = 1_024
#: Texts with runs of characters beyond this go to the tokenizers library, whose time is linear in them.
LONGEST_RUN = 2_000
#: From so many documents a sequence on, all documents that no gap holds open sequences at once.
ALL_FROM = 4
#: Documents shorter than this part of the capacity are one band.
SHORT = 64


# ---------------------------------------------------------------- tokens


class Encoder:
    """Ids of the vocabulary file, as the tokenizers library gives them with add_special_tokens=False.

    The same vocabulary is there as ranks for a faster library. Texts that hold a special token's string or extreme
    runs go to the tokenizers library itself; the tests hold the two against each other.
    """

    def __init__(self, vocabulary: str, ranks: str | None):
        import base64
        import json

        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(vocabulary), None
        with open(vocabulary, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        plain = self.fast and not any(t in text for t in self.special) and (len(text) < LONGEST_RUN or not self._runs(text))
        if plain:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    @staticmethod
    def _runs(text: str) -> bool:
        words = text.split()
        return not words or max(map(len, words)) > LONGEST_RUN or len(text) - sum(map(len, words)) - len(words) > LONGEST_RUN


@functools.lru_cache(maxsize=2)
def _encoder(vocabulary: str, ranks: str | None) -> Encoder:
    return Encoder(vocabulary, ranks)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first one of the rest."""
    first = n if n <= capacity else (n % capacity or capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32[, ids]): the pieces of every document, each closed by id 2."""
    if vocabulary is None:
        vocabulary, ranks = public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encode = _encoder(vocabulary, ranks)
        for batch in batches:
            rows, place = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(text), END_OF_DOCUMENT).astype("<u4")
                for i, (start, n) in enumerate(cut(len(ids), capacity)):
                    raw = ids[start : start + n].tobytes()
                    place.append(k)
                    rows.append((i, start, n, zlib.crc32(raw), raw if with_ids else None))
            cols = list(zip(*rows, strict=True)) or [[], [], [], [], []]
            out = [batch.column(0).take(pa.array(place, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4])]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out, names = [*out, pa.array(cols[4], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


# ---------------------------------------------------------------- the rounds

#: What a sweep makes of its rows: a document with its sequence, a document left over, a gap with slots left over.
PLACED, WAITING, OPEN = 0, 1, 2
_SWEPT = "kind int, row long, length long, sequence long, part int, rank long, slots long"


def _sweep(rows: DataFrame, longest: int) -> DataFrame:
    """One round inside the partitions of range-sorted ``rows`` (size, is_doc, id). ``rank`` counts the documents left over
    of a partition, and the slots left over from the bottom of its stack, ``slots`` of them from ``rank`` on."""

    def run(batches):
        part, waiting = TaskContext.get().partitionId(), 0
        ids, left, height = [], [], 0  # the stack: sequences and their free slots
        for batch in batches:
            out = []
            for size, is_doc, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not is_doc:
                    ids.append(i)
                    left.append(max(1, size // longest))
                elif ids:
                    out.append((PLACED, i, size, ids[-1], part, 0, 0))
                    left[-1] -= 1
                    if not left[-1]:
                        ids.pop(), left.pop()
                else:
                    out.append((WAITING, i, size, 0, part, waiting, 0))
                    waiting += 1
            yield _swept(out)
        out = []
        for i, n in zip(ids, left, strict=True):
            out.append((OPEN, 0, 0, i, part, height, n))
            height += n
        yield _swept(out)

    return rows.mapInArrow(run, _SWEPT)


def _swept(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _SWEPT.split(", ")])


def across(waiting: list[int], slots: list[int]) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Match what the partitions left over, given counts a partition from large sizes to small.

    Lines (part, from, to, at, slot): documents of ``part`` with ranks from ``from`` to ``to`` take the slots of partition ``at``
    downwards from ``slot``. Also how many documents of each partition found one: those of the first ranks.
    """
    stack, lines, found = [], [], []
    for part, (n, held) in enumerate(zip(waiting, slots, strict=True)):
        got = 0
        while got < n and stack:
            at, height = stack.pop()
            some = min(height, n - got)
            lines.append((part, got, got + some, at, height - 1))
            got += some
            if some < height:
                stack.append((at, height - some))
        found.append(got)
        if held:
            stack.append((part, held))
    return lines, found


def place(items: DataFrame, capacity: int) -> DataFrame:
    """(row, sequence) for every row of ``items`` (row long, length long, from 1 to ``capacity``; rows are distinct and not negative).

    The driver sees counts: one a length, two a partition and round. There are about two rounds a halving of the
    capacity, however many documents there are.
    """
    spark = items.sparkSession
    counts = {r[0]: r[1] for r in items.groupBy("length").count().collect()}  # at most ``capacity`` rows
    if not counts:
        return spark.createDataFrame([], "row long, sequence long")
    shortest, opened = min(counts), 0
    # no two of these share a sequence: each has its own, which bears its number; sequences opened later count down from -1
    long = items.filter(F.col("length") > capacity // 2).select("row", F.col("row").alias("sequence"), "length")
    placed = [long]
    gaps = materialise(long.select("sequence", (capacity - F.col("length")).alias("gap")).filter(F.col("gap") >= shortest), "pack-gaps")

    top = capacity // 2
    while top:
        low = top // 2 if top > capacity // SHORT else 0  # what is very short is one band
        band = [n for n in counts if low < n <= top]
        docs = items.filter((F.col("length") > low) & (F.col("length") <= top)).select("row", "length")
        least, most = min(band, default=0), max(band, default=0)
        top = low
        while least:
            rows = docs.select(F.col("length").alias("size"), F.lit(True).alias("is_doc"), F.col("row").alias("id"))
            rows = rows.union(gaps.filter(F.col("gap") >= least).select("gap", F.lit(False), "sequence"))
            order = [F.desc("size"), "is_doc", "id"]
            swept = materialise(_sweep(rows.repartitionByRange(*order).sortWithinPartitions(*order), most), "pack-swept")
            is_left = F.col("kind") == WAITING
            left = swept.groupBy("part").agg(F.count_if(is_left).alias("docs"), F.sum("slots").alias("slots"), F.min(F.when(is_left, F.col("length"))).alias("least"), F.max(F.when(is_left, F.col("length"))).alias("most"))
            left = {r["part"]: r for r in left.collect()}  # one row a partition
            parts = range(max(left) + 1)
            waiting, slots = ([left[p][k] if p in left else 0 for p in parts] for k in ("docs", "slots"))
            lines, found = across(waiting, slots)
            open_ = [left[p] for p in parts if waiting[p] > found[p]]
            # the last rank of a partition is its shortest document, so these are the shortest one left and a bound of the longest
            least, most = min((r["least"] for r in open_), default=0), max((r["most"] for r in open_), default=0)

            # read from the written sweep wherever they are used
            new = swept.filter(F.col("kind") == PLACED).select("row", "sequence", "length")
            new = new.union(_matched(swept, lines)) if lines else new
            placed.append(new)
            gaps, largest = _updated(gaps, new, shortest)
            if not least:
                break
            docs = _rest(swept, waiting, found)
            if largest >= least:
                continue
            # no gap holds any of them: the longest open sequences, those that go as many to one by rank
            per = F.expr(f"{capacity}L div length")
            first = {r["per"]: r["first"] for r in docs.groupBy(per.alias("per")).agg(F.min("rank").alias("first")).collect()}
            ends = [*sorted(first.values())[1:], sum(waiting) - sum(found)]
            group = F.lit(None).cast("long")
            for (k, begin), end in zip(sorted(first.items()), ends, strict=True):
                # all of the longest; of others, if many go to one, those that fill sequences to the count
                full = -(-(end - begin) // k) if k == min(first) else (end - begin) // k if min(first) >= ALL_FROM else 0
                if full:
                    group = F.when((per == k) & (F.col("rank") < begin + full * k), F.expr(f"{opened}L + (rank - {begin}L) div {k}L")).otherwise(group)
                    opened += full
            docs = materialise(docs.select("row", "length", (-1 - group).alias("sequence")), "pack-opened")
            new = docs.filter("sequence is not null").select("row", "sequence", "length")
            placed.append(new)
            fresh = new.groupBy("sequence").agg((capacity - F.sum("length")).alias("gap")).filter(F.col("gap") >= shortest)
            gaps = gaps.union(fresh)
            docs = docs.filter("sequence is null").select("row", "length")
            r = docs.agg(F.coalesce(F.min("length"), F.lit(0)), F.coalesce(F.max("length"), F.lit(0))).first()
            least, most = r

    out = placed[0].select("row", "sequence")
    for x in placed[1:]:
        out = out.union(x.select("row", "sequence"))
    return out


def _matched(swept: DataFrame, lines: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """(row, sequence, length) of the documents that ``lines`` (at most two a partition) give a slot of another partition."""
    spark = swept.sparkSession
    table = F.broadcast(spark.createDataFrame(lines, "_part int, _from long, _to long, _at int, _slot long"))
    docs = swept.filter(F.col("kind") == WAITING).join(table, (F.col("part") == F.col("_part")) & (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to")))
    docs = docs.select("row", "length", F.col("_at").alias("at"), (F.col("_slot") - F.col("rank") + F.col("_from")).alias("slot"))
    floor: dict[int, int] = {}
    for _, a, b, at, slot in lines:
        floor[at] = min(floor.get(at, slot), slot - (b - a) + 1)
    used = F.broadcast(spark.createDataFrame(list(floor.items()), "_at int, _floor long"))
    held = swept.filter(F.col("kind") == OPEN).join(used, F.col("part") == F.col("_at")).filter(F.col("rank") + F.col("slots") > F.col("_floor"))
    held = held.select("sequence", F.col("part").alias("at"), F.explode(F.expr("sequence(greatest(rank, _floor), rank + slots - 1)")).alias("slot"))
    return docs.join(held, ["at", "slot"]).select("row", "sequence", "length")


def _rest(swept: DataFrame, waiting: list[int], found: list[int]) -> DataFrame:
    """(row, length, rank) of the documents without a slot, ranked from long to short over all partitions."""
    before, table = 0, []
    for part, (n, got) in enumerate(zip(waiting, found, strict=True)):
        if n > got:
            table.append((part, got, before - got))
            before += n - got
    parts = F.broadcast(swept.sparkSession.createDataFrame(table, "_part int, _got long, _shift long"))
    docs = swept.filter(F.col("kind") == WAITING).join(parts, F.col("part") == F.col("_part")).filter(F.col("rank") >= F.col("_got"))
    return docs.select("row", "length", (F.col("rank") + F.col("_shift")).alias("rank"))


def _updated(gaps: DataFrame, new: DataFrame, shortest: int) -> tuple[DataFrame, int]:
    """``gaps`` less what was placed in them, without those that hold nothing any more, and the largest that is left."""
    both = gaps.union(new.select("sequence", -F.col("length")))
    seen = Observation()
    left = both.groupBy("sequence").agg(F.sum("gap").alias("gap")).filter(F.col("gap") >= shortest)
    return materialise(left.observe(seen, F.coalesce(F.max("gap"), F.lit(0)).alias("largest")), "pack-gaps"), seen.get["largest"]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns one row a piece: (id_col, piece, start, length, ids_crc32, sequence_id, offset[, ids]). A
    document is its ids and id 2; null text is empty, so one token. Only documents longer than
    ``capacity`` are cut; whole texts of any length are packed. Places in a sequence, which holds ``capacity`` rows at most,
    are gapless from 0. Pieces of equal length are interchangeable and go by the rows' numbers; repeated rows
    are packed each; an empty table gives no rows; other columns are ignored.
    """
    made = numbered(pieces(docs, id_col, text_col, capacity, vocabulary, ranks, with_ids), "_row")
    found = place(made.select(F.col("_row").alias("row"), "length"), capacity)
    inside = Window.partitionBy("sequence").orderBy(F.desc("length"), "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = made.join(found, made["_row"] == found["row"])
    return rows.select(
        F.col(id_col), "piece", "start", "length", "ids_crc32", F.col("sequence").alias("sequence_id"),
        F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )

"""Document fingerprints as invertible Bloom lookup sketches.

A text's paragraphs are hashed to digests; every digest is added to three cells of a small table.
The difference of two tables, cell by cell, cancels what both texts share, and peeling cells that hold a single
digest recovers the digests on either side. If a table is too small for the difference, both texts'
digests are sketched again four times larger until peeling succeeds.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import partitions

#: A paragraph ends at a line break, or inside a line after the end of a sentence; longer ones are cut after so many words.
PARAGRAPH = re.compile(r"(?<=[.!?])\s+|\n")
LONGEST_PARAGRAPH = 8
CELLS = 15
HASHES = 3
#: Documents, and characters of them, that are sketched side by side; a longer document is sketched alone.
AT_ONCE, CHARS_AT_ONCE = 512, 1_000_000
#: Sampled ids a bucket from which the cuts between buckets are chosen.
SAMPLED = 100
MIX = np.uint64(0x9E3779B97F4A7C15)


def digests(text: str | None) -> np.ndarray:
    """Sorted 64-bit digests of the paragraphs; the n-th repeat of a paragraph has a digest of its own."""
    seen: dict[str, int] = {}
    out = []
    for whole in PARAGRAPH.split(text or ""):
        words = whole.split(" ")
        for at in range(0, len(words), LONGEST_PARAGRAPH):
            p = " ".join(words[at : at + LONGEST_PARAGRAPH])
            if p:
                n = seen[p] = seen.get(p, -1) + 1
                out.append(xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass"), n))
    return np.unique(np.array(out, np.uint64))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt)) * MIX
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def places(keys: np.ndarray, cells: int) -> np.ndarray:
    """(HASHES x keys): one cell in each third of the table."""
    third = cells // HASHES
    return np.stack([(_mix(keys, 1 + i) % np.uint64(third)).astype(np.int64) + i * third for i in range(HASHES)])


def check(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 77) & np.uint64(0xFFFF)).astype(np.uint16)


class Tables:
    """One table for each of many sets of digests, side by side: (count, exclusive or of digests, exclusive or of their checks)."""

    def __init__(self, sets: int, cells: int):
        self.cells = cells
        self.count, self.key, self.check = np.zeros(sets * cells, np.int64), np.zeros(sets * cells, np.uint64), np.zeros(sets * cells, np.uint16)

    def add(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> Tables:
        """Add each key to three cells of its owner's table, ``sign`` times; what is added twice cancels but for its count."""
        at = (places(keys, self.cells) + owner * self.cells).ravel()
        np.add.at(self.count, at, np.tile(sign, HASHES))
        np.bitwise_xor.at(self.key, at, np.tile(keys, HASHES))
        np.bitwise_xor.at(self.check, at, np.tile(check(keys), HASHES))
        return self

    def texts(self) -> list[str]:
        """Each table as text: counts (modulo 2^16), digests and checks, in base 64."""
        parts = [x.reshape(-1, self.cells).astype(kind) for x, kind in ((self.count, "<u2"), (self.key, "<u8"), (self.check, "<u2"))]
        return [base64.b64encode(b"".join(p[i].tobytes() for p in parts)).decode() for i in range(len(parts[0]))]

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left, right, failed) for each table: how many digests only one side has, and whether the table was too small."""
        sets = len(self.count) // self.cells
        found: list[tuple] = []
        made = np.zeros(sets, np.int64)
        while True:
            pure = np.flatnonzero((np.abs(self.count) == 1) & (check(self.key) == self.check))
            pure = pure[made[pure // self.cells] <= 4 * self.cells]  # beyond that it goes in circles
            if not len(pure):
                break
            owner, keys, sign = pure // self.cells, self.key[pure], self.count[pure]
            order = np.lexsort((keys, owner))  # a digest may stand alone in several cells
            owner, keys, sign = owner[order], keys[order], sign[order]
            new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])])
            owner, keys, sign = owner[new], keys[new], sign[new]
            found.append((owner, keys, sign))
            made += np.bincount(owner, minlength=sets)
            self.add(owner, keys, -sign)
        failed = ((self.count != 0) | (self.key != 0) | (self.check != 0)).reshape(sets, -1).any(axis=1)
        if not found:
            return np.zeros(sets, np.int64), np.zeros(sets, np.int64), failed
        # a cell that only looked pure is undone later by the opposite sign
        owner, keys, sign = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((keys, owner))
        owner, keys, sign = owner[order], keys[order], sign[order]
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])]))
        net, owner = np.add.reduceat(sign, first), owner[first]
        failed |= np.bincount(owner, np.abs(net) > 1, sets) > 0
        return np.bincount(owner, net > 0, sets).astype(np.int64), np.bincount(owner, net < 0, sets).astype(np.int64), failed


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets) if sets else np.empty(0, np.uint64)


def fingerprints(sets: list[np.ndarray], cells: int = CELLS) -> list[str]:
    """The fingerprint of each set of digests."""
    owner, keys = _flat(sets)
    return Tables(len(sets), cells).add(owner, keys, np.ones(len(keys), np.int64)).texts()


def likenesses(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """For each pair: shared digests over all digests of both, 1 for two empty texts. Pairs whose
    difference a table can't hold are sketched again with tables four times as large."""
    left, right = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    while len(open_):
        tables = Tables(len(open_), cells)
        for some, sign in ((a, 1), (b, -1)):
            owner, keys = _flat([some[i] for i in open_])
            tables.add(owner, keys, np.full(len(keys), sign, np.int64))
        l, r, failed = tables.peel()
        left[open_], right[open_] = l, r
        open_, cells = open_[failed], 4 * cells
    shared = np.array([len(x) for x in a], np.int64) - left
    every = shared + left + right
    return np.where(every == 0, 1.0, shared / np.maximum(every, 1))


def edit(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by as many of the first of ``following`` (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses.

    Returns (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).
    The next document is the next one by ascending id (null ids first, equal ids by text); after the last comes the first,
    and a single document is its own next. Null text is empty; two empty texts are alike (1). Repeated rows
    follow each other. An empty table gives no rows; other columns are ignored.

    Documents go, by quantiles of a sample of their ids, which may be of any type with an order, to buckets that are sorted and streamed;
    each bucket also gets the first document of the following bucket, so texts are shuffled once. Whole texts are
    sketched; a task holds texts of ``CHARS_AT_ONCE`` characters, with their neighbours, or one longer text. Rows of one id meet in one bucket.
    """
    spark = docs.sparkSession
    buckets = buckets or partitions(spark)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = base.select("id").filter("id is not null")
    sample = [r[0] for r in known.sample(min(1.0, SAMPLED * buckets / max(1, known.count())), 7).orderBy("id").collect()]  # about SAMPLED a bucket
    cuts = sorted({sample[len(sample) * i // buckets] for i in range(1, buckets)}) if sample else []
    # the bucket of an id: a coarse search over every k-th cut, then a fine one between two of them
    k = max(1, int(len(cuts) ** 0.5))
    coarse = cuts[::k]
    fine = [[]] + [cuts[i : i + k] for i in range(0, len(cuts), k)]
    kind = docs.schema[id_col].dataType.simpleString()
    literal = lambda xs: F.array(*map(F.lit, xs)).cast(f"array<{kind}>")
    at = F.size(F.filter(literal(coarse), lambda c: c <= F.col("id")))
    part = F.element_at(F.array(*map(literal, fine)), at + 1)
    bucket = F.when(F.col("id").isNull() | F.lit(not cuts), F.lit(0)).otherwise(F.greatest(F.lit(0), at - 1) * k + F.size(F.filter(part, lambda c: c <= F.col("id"))))
    base = base.withColumn("bucket", bucket.cast("int"))

    # first row of each bucket: ids first, then their texts, for a handful of rows
    heads = base.groupBy("bucket").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), F.col("id").alias("id"))).alias("head")).orderBy("bucket").collect()  # one row a bucket
    if not heads:
        return spark.createDataFrame([], f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    before = {b["bucket"]: heads[i - 1]["bucket"] for i, b in enumerate(heads)}  # the first one's head goes to the last bucket
    list_ = spark.createDataFrame([(h["bucket"], h["head"]["id"], before[h["bucket"]]) for h in heads], f"b int, head {kind}, to int")
    halo = base.join(F.broadcast(list_), (base["bucket"] == F.col("b")) & base["id"].eqNullSafe(F.col("head")))
    halo = halo.groupBy("to").agg(F.min("text").alias("text")).select(F.col("to").alias("bucket"), F.lit(True).alias("halo"), F.lit(None).cast(kind).alias("id"), "text")
    rows = base.select("bucket", F.lit(False).alias("halo"), "id", "text").unionByName(halo)

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        """``rows``: (id, text, its digests, next text, its digests)."""
        ids, texts, keys, following, next_keys = map(list, zip(*rows, strict=True))
        edited = [edit(x, y) for x, y in zip(texts, following, strict=True)]
        edited_keys = [digests(x) for x in edited]
        hashed = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited]
        columns = [pa.array(ids, id_type), pa.array(list(map(len, texts)), pa.int64()), pa.array(hashed), pa.array(fingerprints(keys)), pa.array(fingerprints(edited_keys))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(likenesses(keys, edited_keys)), pa.array(likenesses(keys, next_keys))], names=names)

    def run(batches):
        last = None  # (bucket, id, text, digests) that waits for the next row of its bucket
        out: list[tuple] = []
        chars = 0
        for batch in batches:
            for b, is_halo, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = digests(text)
                if last is not None and last[0] == b:
                    out.append((*last[1:], text, keys))
                    chars += len(last[2])
                last = None if is_halo else (b, i, text, keys)
                if len(out) >= AT_ONCE or chars >= CHARS_AT_ONCE:
                    yield finish(out)
                    out, chars = [], 0
        if out:
            yield finish(out)

    dealt = rows.repartitionById(len(cuts) + 1, "bucket").sortWithinPartitions("bucket", "halo", F.col("id").asc_nulls_first(), "text")
    return dealt.select("bucket", "halo", "id", "text").mapInArrow(run, f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

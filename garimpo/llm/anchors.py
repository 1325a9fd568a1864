"""Repeated substrings by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ``block`` words, counted from its start; any passage of
``least`` >= 2 * block - 1 words holds a whole block wherever it lies. The blocks are indexed, every rolling window of ``block``
words of every document probes that index, and a hit is extended to both sides, to passages of ``least`` words and, as these
overlap, to maximal repeats.

Index and probes meet without a shuffle of all rolling windows one by one: a document goes out in fragments of consecutive
passages that share their least gram (of ``GRAM`` words), dealt by that gram, so that equal passages come to one bucket whatever surrounds
them, and each bucket indexes, probes and extends on its own. A fragment carries its words by number, so that they take a byte or two each.
Grams of very many fragments, which a bounded sample tells, are left out there: their passages meet by an aggregate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import materialise, partitions
from .words import WORDS_KEPT, Vocabulary, gram_hashes, mixed, pack, pack_bytes, sliding_least, unpack, unpack_bytes

LEAST_WORDS, BLOCK, GRAM = 35, 18, 4
#: Words that a worker cuts into fragments at once.
WORDS_AT_ONCE = 3_000_000
#: Buckets a shuffle partition.
BUCKETS = 2
#: Documents a partition from which grams of very many fragments are told, and the fragments from which one may be such.
SAMPLED, GROUP_ROWS = 20, 20_000


def fragments(words: np.ndarray, of: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First passage, end of passages and least gram of each run of passages of one document that share it; ``of`` numbers the words' documents."""
    n = len(words) - least + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    key = sliding_least(gram_hashes(words, gram), least - gram + 1)
    whole = of[:n] == of[least - 1 :]
    change = np.ones(n + 1, bool)
    change[1:n] = (key[1:] != key[:-1]) | ~whole[1:] | ~whole[:-1] | (of[1:n] != of[: n - 1])
    first = np.flatnonzero(whole & change[:-1])
    return first, np.flatnonzero(whole & change[1:]) + 1, key[first]


def _spread(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run, one run after the other."""
    return np.repeat(first - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))


def _chunks(batches, least: int):
    """(vocabulary, word numbers, document number of each word, offsets, the two hashes of each text); a text that the task has met is left out."""
    vocabulary, met = Vocabulary(), set()
    parts: list = []
    held = 0

    def chunk():
        lengths = np.array([len(p[2]) for p in parts])
        return vocabulary, np.concatenate([p[2] for p in parts]), np.repeat(np.arange(len(parts)), lengths), np.cumsum(lengths) - lengths, np.array([p[:2] for p in parts], np.int64)

    for batch in batches:
        for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (a, b) in met:
                continue
            tokens = text.as_py().encode("utf-8", "surrogatepass").split()
            if len(tokens) < least:
                continue
            met.add((a, b))
            parts.append((a, b, vocabulary.numbers(tokens)))
            held += len(tokens)
            if held >= WORDS_AT_ONCE:
                yield chunk()
                parts, held = [], 0
                if len(vocabulary) > WORDS_KEPT:
                    vocabulary = Vocabulary()
    if parts:
        yield chunk()


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.filter(F.col(text_col).isNotNull()).select(*_hashes(text_col), F.col(text_col).alias("text"))


def _hashes(text_col: str) -> list:
    """128 bits that stand for a text."""
    return [F.xxhash64(text_col).alias("text_a"), F.xxhash64(F.lit("anchors"), text_col).alias("text_b")]


_PAYLOAD = "bucket int, texts binary, spans binary, bytes int, words binary, codes binary"


def _payloads(texts: DataFrame, least: int, gram: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """A row for each bucket and chunk: its fragments, without those of ``hot`` grams."""

    def run(batches):
        for vocabulary, numbers, of, offsets, names in _chunks(batches, least):
            hashes = vocabulary.hashes()
            first, end, key = fragments(hashes[numbers], of, least, gram)
            if len(hot):
                cold = ~np.isin(key, hot)
                first, end, key = first[cold], end[cold], key[cold]
            bucket = (mixed(key) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            first, end, bucket = first[order], end[order], bucket[order]
            lengths = end - first + least - 1
            codes = numbers[_spread(first, lengths)]
            upto = np.concatenate([[0], np.cumsum(lengths)])
            local = np.zeros(len(hashes), np.uint32)
            begins = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
            for a, b in zip(begins, [*begins[1:], len(bucket)], strict=True):
                own = codes[upto[a] : upto[b]]
                used = np.flatnonzero(np.bincount(own, minlength=len(hashes)))
                local[used] = np.arange(len(used))
                doc = of[first[a:b]]
                spans = np.stack([first[a:b] - offsets[doc], end[a:b] - first[a:b]]).astype(np.int32)
                words = b"\n".join(map(vocabulary.words.__getitem__, used.tolist()))  # smaller, compressed, than their hashes
                row = (int(bucket[a]), names[doc].tobytes(), pack(spans), len(words), pack_bytes(words), pack(local[own].astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)))
                kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["bucket", "texts", "spans", "bytes", "words", "codes"])

    return texts.mapInArrow(run, _PAYLOAD)


def _keys(texts: DataFrame, least: int, gram: int) -> DataFrame:
    def run(batches):
        for vocabulary, numbers, of, _, _ in _chunks(batches, least):
            yield pa.RecordBatch.from_arrays([pa.array(fragments(vocabulary.hashes()[numbers], of, least, gram)[2].view(np.int64))], names=["key"])

    return texts.mapInArrow(run, "key long")


def hot_grams(texts: DataFrame, least: int, gram: int, group_rows: int) -> np.ndarray:
    """Grams that hold more fragments than ``group_rows`` and than a partition's mean, as a sample of about ``SAMPLED`` documents
    a partition tells; never more than partitions. One that the sample misses costs balance, not results."""
    n, parts = texts.count(), partitions(texts.sparkSession)
    share = min(1.0, SAMPLED * parts / max(1, n))
    held = _keys(texts.sample(share, 7), least, gram).groupBy("key").count()
    rows, most = held.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    bound = max(group_rows * share, rows / parts)
    if most <= bound:
        return np.empty(0, np.uint64)
    return np.array([r[0] for r in held.filter(F.col("count") > bound).select("key").collect()], np.int64).view(np.uint64)


_RUN = pa.schema([("text_a", pa.int64()), ("text_b", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def repeated_passages(words: np.ndarray, offsets: np.ndarray, windows: np.ndarray, starts: np.ndarray, least: int, block: int) -> np.ndarray:
    """Places (in ``words``) of the passages that occur again, in order. Fragment f takes the words from ``offsets[f]`` on, its passages begin at
    the first ``windows[f]`` of them, and it begins ``starts[f]`` words into its document."""
    lengths = windows + least - 1
    place = np.arange(len(words))
    inside = place - np.repeat(offsets, lengths)
    left = np.repeat(lengths, lengths) - inside  # words up to the fragment's end
    rolling = gram_hashes(words, block)
    n = len(rolling)
    fits = left[:n] >= block
    # the index: reference blocks, which begin at multiples of their length in the document
    index = np.sort(rolling[fits & ((inside[:n] + np.repeat(starts, lengths)[:n]) % block == 0)])
    # every rolling window probes it, by a bitmap first
    bits = max(16, int(len(index) * 16).bit_length())
    bitmap = np.zeros(1 << bits, bool)
    bitmap[(index & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
    hits = np.flatnonzero(fits & bitmap[(rolling & np.uint64((1 << bits) - 1)).astype(np.int64)])
    found = np.searchsorted(index, rolling[hits])
    hits = hits[index[np.minimum(found, len(index) - 1)] == rolling[hits]] if len(index) else hits[:0]
    order = np.argsort(rolling[hits], kind="stable")  # only blocks that stand at two places
    same = rolling[hits[order]][1:] == rolling[hits[order]][:-1]
    hits = np.sort(hits[order[np.append(same, False) | np.insert(same, 0, False)]]) if len(hits) else hits
    if not len(hits):
        return hits
    # a passage is extended from its first hit, which lies at the same place in all of its copies
    passages = place[inside < np.repeat(windows, lengths)]
    to = np.searchsorted(hits, passages)
    anchor = hits[np.minimum(to, len(hits) - 1)]
    held = (to < len(hits)) & (anchor - passages <= least - block)
    passages, anchor = passages[held], anchor[held]
    with np.errstate(over="ignore"):
        extended = gram_hashes(words, least)[passages] ^ mixed(rolling[anchor] + (anchor - passages).astype(np.uint64))
    order = np.argsort(extended)
    same = extended[order][1:] == extended[order][:-1]
    return np.sort(passages[order[np.append(same, False) | np.insert(same, 0, False)]]) if len(passages) else passages


def _resolve(least: int, block: int):
    def run(table: pa.Table) -> pa.Table:
        texts, words, spans = [], [], []
        for t, s, n, w, c in zip(*(table[k].to_pylist() for k in ("texts", "spans", "bytes", "words", "codes")), strict=True):
            names = np.frombuffer(t, np.int64).reshape(-1, 2)
            span = unpack(s, 2 * len(names), np.int32).reshape(2, -1).astype(np.int64)
            known = unpack_bytes(w, n).split(b"\n")
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
            texts.append(names)
            spans.append(span)
            words.append(hashes[unpack(c, int((span[1] + least - 1).sum()), np.uint16 if len(hashes) <= 1 << 16 else np.uint32)])
        if not texts:
            return _RUN.empty_table()
        texts, (starts, windows), words = np.concatenate(texts), np.concatenate(spans, axis=1), np.concatenate(words)
        lengths = windows + least - 1
        offsets = np.cumsum(lengths) - lengths
        again = repeated_passages(words, offsets, windows, starts, least, block)
        if not len(again):
            return _RUN.empty_table()
        # passages of a fragment that overlap or touch join up
        of = np.searchsorted(offsets, again, "right") - 1
        new = np.concatenate([[True], (of[1:] != of[:-1]) | (np.diff(again) > least)])
        last = np.append(np.flatnonzero(new)[1:] - 1, len(again) - 1)
        shift = starts[of[new]] - offsets[of[new]]
        return pa.table([texts[of[new], 0], texts[of[new], 1], (again[new] + shift).astype(np.int32), (again[last] + shift + least).astype(np.int32)], schema=_RUN)

    return run


def _hot_runs(texts: DataFrame, least: int, gram: int, hot: np.ndarray) -> DataFrame:
    """The passages of ``hot`` grams that occur again."""

    def run(batches):
        for vocabulary, numbers, of, offsets, names in _chunks(batches, least):
            words = vocabulary.hashes()[numbers]
            first, end, key = fragments(words, of, least, gram)
            held = np.isin(key, hot)
            at = _spread(first[held], (end - first)[held])
            doc = of[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (gram_hashes(words, least)[at].view(np.int64), names[doc, 0], names[doc, 1], (at - offsets[doc]).astype(np.int32))], names=["passage", "text_a", "text_b", "start"]
            )

    rows = materialise(texts.mapInArrow(run, "passage long, text_a long, text_b long, start int"), "anchor-hot")
    # written first, the two sides of the join are plain shuffles, which Spark can split
    again = materialise(rows.groupBy(F.col("passage").alias("_passage")).count().filter("count > 1").drop("count"), "anchor-again")
    return rows.join(again, rows["passage"] == again["_passage"]).select("text_a", "text_b", "start", (F.col("start") + least).alias("end"))


def _squeezed(batches):
    """Texts compressed, as a shuffle of plain ones writes the input once more."""
    for batch in batches:
        texts = [None if x is None else x.encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
        packed = [pa.array([None if x is None else f(x) for x in texts], t) for f, t in ((len, pa.int64()), (pack_bytes, pa.binary()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *packed, batch.column(2), batch.column(3)], names=["id", "bytes", "packed", "text_a", "text_b"])


def _cut(batches, of_copies: int):
    """Texts without their repeated words. A text of which there are copies repeats from end to end."""
    for batch in batches:
        kept, n_words, n_removed, removed = [], [], [], []
        for size, packed, copies, runs in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            tokens = [] if packed is None else unpack_bytes(packed, size).split()
            n = len(tokens)
            spans: list[list[int]] = []
            if (copies or 0) > 1 and n >= of_copies:
                spans = [[0, n]]
            else:
                for r in sorted((r["start"], r["end"]) for r in runs or ()):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1])
                    else:
                        spans.append(list(r))
            at, left = 0, []
            for a, b in spans:
                left += tokens[at:a]
                at = b
            left += tokens[at:]
            kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            n_words.append(n)
            n_removed.append(n - len(left))
            removed.append([{"start": a, "end": b} for a, b in spans])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, kind)], names=["id", "text", "n_words", "n_removed", "removed"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, block: int = BLOCK, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Every document without the words that lie in a passage of ``least`` words which also begins anywhere else.

    Returns one row a row of ``docs``: (id_col, text: the kept words joined by one space, n_words, n_removed, removed: the
    maximal (start, end) of removed words, end exclusive). Words are runs without ASCII white space. Passages are
    judged on the input: every copy goes, also the first, and a passage that repeats inside one document counts.

    Null texts have no words and an empty text; texts of fewer than ``least`` words stay whole. Rows may share an id or have
    none; equal rows are copies of each other. Texts may be of any length. An empty table gives no rows; other columns are
    ignored. Words are told apart by 64 bits, texts by 128.
    """
    if least < 2 * block - 1 or not 1 <= gram <= least:
        raise ValueError("a passage must hold a whole block and a gram")
    texts = _texts(docs, text_col)
    hot = hot_grams(texts, least, gram, group_rows)
    payloads = _payloads(texts, least, gram, BUCKETS * partitions(docs.sparkSession), hot)
    runs = payloads.groupBy("bucket").applyInArrow(_resolve(least, block), "text_a long, text_b long, start int, end int")
    if len(hot):
        runs = runs.union(_hot_runs(texts, least, gram, hot))
    span = F.struct("start", "end")
    known = docs.select(*_hashes(text_col), F.lit(1).alias("n"), F.lit(None).cast("struct<start:int,end:int>").alias("span")).union(runs.select("text_a", "text_b", F.lit(0), span))
    known = known.groupBy(F.col("text_a").alias("_a"), F.col("text_b").alias("_b")).agg(F.sum("n").alias("copies"), F.collect_set("span").alias("runs"))
    known = materialise(known.filter("copies > 1 or size(runs) > 0"), "anchor-runs")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *_hashes(text_col)).mapInArrow(_squeezed, f"id {kind}, bytes long, packed binary, text_a long, text_b long")
    joined = rows.join(known, (rows["text_a"] == known["_a"]) & (rows["text_b"] == known["_b"]), "left").select("id", "bytes", "packed", "copies", "runs")
    out = joined.mapInArrow(lambda b: _cut(b, least), f"id {kind}, text string, n_words long, n_removed long, removed array<struct<start:int,end:int>>")
    return out.withColumnRenamed("id", id_col)

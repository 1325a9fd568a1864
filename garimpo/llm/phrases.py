"""Phrase collocations by contiguous pattern growth, after PrefixSpan.

Words of a piece follow one another; the projection of a prefix is the list of pointers to its occurrences, each with the words to its right.
Occurrences are dealt by their first word, so that every prefix of one word is grown by one task, depth first: its pointers are split by the next
word, prefixes that are frequent are kept, and each is grown on its own pointers alone. Equal occurrences of a chunk go as one with a count.
Prefixes of very many occurrences, which a bounded sample tells, are dealt by one word more (and those of two words by three); what tasks then count
in parts is added up. Only frequent phrases leave the tasks; parts, cuts, containment and ranks are joins and aggregates of these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialise, partitions
from .words import WORDS_KEPT, Vocabulary, mixed, pack, pack_bytes, unpack, unpack_bytes

LEAST, WORDS, TOP = 10, 3, 2000
#: Words that a worker deals at once, and buckets a shuffle partition.
WORDS_AT_ONCE, BUCKETS = 3_000_000, 2
#: Documents a partition from which prefixes of very many occurrences are told.
SAMPLED = 20
#: Ends of pieces become a byte that UTF-8 never has.
BREAK = b"\xff"
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", BREAK * 10 + b" ")


def tokens(text: str) -> list[bytes]:
    """Words, A to Z lower-cased, with BREAK between pieces and after the last."""
    found = text.encode("utf-8", "surrogatepass").lower().translate(_ENDS).replace(BREAK, b" \xff ").split()
    found.append(BREAK)
    return found


def occurrences(numbers: np.ndarray, n_words: int, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct runs of ``n_words`` numbers that begin at a word (0, a break, ends a run and fills it up), sorted, and how often each occurs."""
    at = np.flatnonzero(numbers)
    padded = np.append(numbers, np.zeros(n_words, numbers.dtype))
    columns = [padded[at]]
    for j in range(1, n_words):
        columns.append(np.where(columns[-1] > 0, padded[at + j], 0))
    if size**n_words < 2**63:
        key = columns[0].astype(np.int64)
        for c in columns[1:]:
            key = key * size + c
        key, counts = np.unique(key, return_counts=True)
        columns = [(key // size ** (n_words - 1 - j) % size).astype(np.int32) for j in range(n_words)]
        return columns, counts
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.diff(np.append(first, len(order)))


def _chunks(batches, n_words: int):
    """(lang, vocabulary, columns, counts) of the occurrences of each language of a chunk."""
    vocabulary, parts, held = Vocabulary(), {}, 0
    vocabulary[BREAK]
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = vocabulary.numbers(tokens(text.as_py()))
            parts.setdefault(lang, []).append(found)
            held += len(found)
            if held >= WORDS_AT_ONCE:
                for key, own in parts.items():
                    yield key, vocabulary, *occurrences(np.concatenate(own), n_words, len(vocabulary))
                parts, held = {}, 0
                if len(vocabulary) > WORDS_KEPT:
                    vocabulary = Vocabulary()
                    vocabulary[BREAK]
    for key, own in parts.items():
        yield key, vocabulary, *occurrences(np.concatenate(own), n_words, len(vocabulary))


def prefix_keys(lang: str, hashes: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
    """A 64-bit key of each row's prefix of 1, 2, ... words."""
    odd, key, out = np.uint64(0x9E3779B97F4A7C15), np.uint64(int.from_bytes(lang.encode("utf-8", "surrogatepass")[:4], "little")), []
    with np.errstate(over="ignore"):
        for c in columns:
            key = mixed(key * odd + hashes[c])
            out.append(key)
    return out


def _dealt_by(keys: list[np.ndarray], hot: list[np.ndarray]) -> np.ndarray:
    """The key of the shortest prefix that isn't hot; the longest where all are."""
    by, open_ = keys[0].copy(), np.isin(keys[0], hot[0])
    for key, known in zip(keys[1:], [*hot[1:], None], strict=True):
        if not open_.any():
            break
        by[open_] = key[open_]
        if known is not None:
            open_ &= np.isin(key, known)
    return by


def _projected(texts: DataFrame, n_words: int, buckets: int, hot: list[np.ndarray]) -> DataFrame:
    """A row for each bucket, language and chunk: the occurrences of its prefixes."""

    def run(batches):
        for lang, vocabulary, columns, counts in _chunks(batches, n_words):
            bucket = (_dealt_by(prefix_keys(lang, vocabulary.hashes(), columns), hot) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, columns, counts = bucket[order], [c[order] for c in columns], counts[order]
            local = np.zeros(len(vocabulary), np.uint32)
            begins = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
            for a, b in zip(begins, [*begins[1:], len(bucket)], strict=True):
                own = np.concatenate([c[a:b] for c in columns])
                used = np.flatnonzero(np.bincount(own, minlength=len(vocabulary)))
                used = used[used > 0]
                local[used] = np.arange(1, len(used) + 1)
                words = b"\n".join(map(vocabulary.words.__getitem__, used.tolist()))
                times = counts[a:b].astype(np.uint8 if counts[a:b].max() < 256 else np.int64)
                row = (int(bucket[a]), lang, int(b - a), len(words), pack_bytes(words), pack(local[own].astype(np.uint16 if len(used) < 1 << 16 else np.uint32)), times.itemsize, pack(times))
                kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["bucket", "lang", "n", "bytes", "words", "codes", "width", "times"])

    return texts.mapInArrow(run, "bucket int, lang string, n int, bytes int, words binary, codes binary, width int, times binary")


def hot_prefixes(texts: DataFrame, n_words: int) -> list[np.ndarray]:
    """For 1, 2, ... words: keys of the prefixes that hold more occurrences than a partition's mean, as a sample of about ``SAMPLED``
    documents a partition tells; fewer than partitions for each length. One that the sample misses costs balance, not results."""
    n, parts = texts.count(), partitions(texts.sparkSession)

    def run(batches):
        for lang, vocabulary, columns, counts in _chunks(batches, n_words):
            for level, key in enumerate(prefix_keys(lang, vocabulary.hashes(), columns[:-1])):
                keys, of = np.unique(key, return_inverse=True)
                total = np.bincount(of, counts, len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), level, np.int32)), pa.array(keys.view(np.int64)), pa.array(total)], names=["level", "key", "n"])

    held = texts.sample(min(1.0, SAMPLED * parts / max(1, n)), 7).mapInArrow(run, "level int, key long, n long").groupBy("level", "key").agg(F.sum("n").alias("n"))
    held = materialise(held, "phrase-sample")
    total = held.filter("level = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = held.filter(F.col("n") > total / parts).select("level", "key").collect()
    return [np.array([r["key"] for r in found if r["level"] == i], np.int64).view(np.uint64) for i in range(n_words - 1)]


_GROWN = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def grow(columns: list[np.ndarray], counts: np.ndarray, hashes: np.ndarray, lang: str, least: int, hot: list[np.ndarray]):
    """(word numbers, occurrences) of each frequent prefix, depth first. Prefixes that are dealt by more words are
    counted in part here, and so are told whatever their count."""
    keys = prefix_keys(lang, hashes, columns[:-1]) if any(map(len, hot)) else None

    def extend(pointers: np.ndarray, prefix: tuple[int, ...], split: bool):
        depth = len(prefix)
        words = columns[depth][pointers]
        order = np.argsort(words, kind="stable")
        words, pointers = words[order], pointers[order]
        starts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        total = np.add.reduceat(counts[pointers], starts)
        ends = np.append(starts[1:], len(words))
        # a prefix of very many occurrences begins with one
        in_part = np.isin(keys[depth][pointers[starts]], hot[depth]) if split and depth < len(hot) and len(hot[depth]) else np.zeros(len(starts), bool)
        for i in np.flatnonzero((words[starts] > 0) & ((total >= least) | in_part)):
            longer = (*prefix, int(words[starts[i]]))
            yield longer, int(total[i])
            if depth + 1 < len(columns):
                yield from extend(pointers[starts[i] : ends[i]], longer, bool(in_part[i]))

    if len(counts):
        yield from extend(np.arange(len(counts)), (), keys is not None)


def _grown(least: int, n_words: int, hot: list[np.ndarray]):
    def run(table: pa.Table) -> pa.Table:
        out: list[tuple[str, str, int]] = []
        payloads = table.select(["lang", "n", "bytes", "words", "codes", "width", "times"]).to_pylist()
        for lang in sorted({p["lang"] for p in payloads}):
            vocabulary, columns, counts = Vocabulary(), [[] for _ in range(n_words)], []
            vocabulary[BREAK]
            for p in payloads:
                if p["lang"] == lang:
                    words = unpack_bytes(p["words"], p["bytes"]).split(b"\n")
                    codes = unpack(p["codes"], n_words * p["n"], np.uint16 if len(words) < 1 << 16 else np.uint32)
                    own = np.append(np.int32(0), vocabulary.numbers(words))[codes].reshape(n_words, -1)
                    for c, x in zip(columns, own, strict=True):
                        c.append(x)
                    counts.append(unpack(p["times"], p["n"], np.uint8 if p["width"] == 1 else np.int64).astype(np.int64))
            columns, counts = [np.concatenate(c) for c in columns], np.concatenate(counts)
            out.append((lang, "", int(counts.sum())))
            for prefix, f in grow(columns, counts, vocabulary.hashes(), lang, least, hot):
                out.append((lang, b" ".join(map(vocabulary.words.__getitem__, prefix)).decode("utf-8", "surrogatepass"), f))
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _GROWN, strict=True)], schema=_GROWN) if out else _GROWN.empty_table()

    return run


def frequent(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, n_words: int = WORDS) -> DataFrame:
    """(lang, phrase, f) of every run of up to ``n_words`` words that occurs ``least`` times in its language, and
    one row a language with an empty phrase and the number of all its words."""
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    hot = hot_prefixes(texts, n_words)
    payloads = _projected(texts, n_words, BUCKETS * partitions(docs.sparkSession), hot)
    found = payloads.groupBy("bucket").applyInArrow(_grown(least, n_words, hot), "lang string, phrase string, f long")
    found = found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return materialise(found.filter((F.col("f") >= least) | (F.col("phrase") == "")), "phrases")


def _first(rows: DataFrame, top: int, salts: int) -> DataFrame:
    """The ``top`` rows of each language, by rounds of fewer and fewer groups, so that no task sorts a language whole."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    while True:
        salt = F.pmod(F.xxhash64("phrase"), F.lit(salts))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
        if salts == 1:
            return rows
        salts = max(1, salts // 16)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, n_words: int = WORDS, top: int = TOP, share: int = 50) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``n_words`` words by the strength of their weakest cut.

    Returns (lang, rank long from 1, phrase, a, l, r, n, score): a, l and r are the occurrences of the phrase, of the words before the cut and of those
    after it, n is the number of words of the language, score = floor(1000000 * a * a / (l * r)). Candidates occur ``least`` times; of a
    candidate's cuts the one of least score counts, among equals the first. A candidate goes where a longer one that holds its words
    side by side has at least ``share`` percent of its occurrences. Ranks go by score and a, falling, then by phrase in byte order.

    A to Z are lower-cased; texts end pieces at ``.,;:!?`` and line breaks and split into words at blanks and tabs. A null language is ``und``, null and
    empty texts have no words, texts may be of any length, equal rows count each. Languages without a candidate have no row, nor has an
    empty table; other columns are ignored. Products are decimals of 38 digits: exact up to 10 ** 16 occurrences.
    """
    found = frequent(docs, lang_col, text_col, least, n_words)
    words = F.split("phrase", " ")
    part = lambda at, n: F.array_join(F.slice(words, at, n), " ")
    candidates = found.filter(F.col("phrase") != "").withColumn("size", F.size(words)).filter("size > 1").withColumnRenamed("f", "a")

    counts = found.filter(F.col("phrase") != "")
    cuts = candidates.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).withColumns({"left": part(F.lit(1), F.col("k")), "right": part(F.col("k") + 1, F.col("size") - F.col("k"))})
    for side in ("left", "right"):
        known = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("f").alias(side[0]))
        cuts = cuts.join(known, (cuts["lang"] == known["_lang"]) & (cuts[side] == known["_phrase"])).drop("_lang", "_phrase")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"_up": exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)"), "_down": exact("l") * exact("r")}).withColumn("score", F.expr("_up div _down"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    # what each candidate holds: shorter phrases of two words and more
    sizes = F.sequence(F.lit(2), F.col("size") - 1)
    inner = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda at: part(at, n))))
    longer = candidates.filter("size > 2").select(F.col("lang").alias("_lang"), F.explode(inner).alias("_phrase"), "a").groupBy("_lang", "_phrase").agg(F.max("a").alias("_most"))
    left = scored.join(longer, (scored["lang"] == longer["_lang"]) & (scored["phrase"] == longer["_phrase"]), "left").filter(F.col("_most").isNull() | (100 * F.col("_most") < share * F.col("a")))

    ranked = _first(left.select("lang", "phrase", "a", "l", "r", "score"), top, partitions(docs.sparkSession))
    totals = found.filter(F.col("phrase") == "").select(F.col("lang").alias("_lang"), F.col("f").alias("n"))
    return ranked.join(totals, ranked["lang"] == totals["_lang"]).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

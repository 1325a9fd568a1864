"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. Each language has a probability for every piece;
the probability of a word is the sum, over all ways to cut it into pieces, of the product of the
pieces' probabilities, which the forward algorithm gives in one pass. A text's log probability is
the sum over its words, and the language with the highest one is predicted.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from .common import crc32_of_id

VOCABULARY = "piece_bpe_32k.model"
#: Runs of letters, lower-cased, are the words; other characters, fractions and numerals such as Ⅷ among them, say nothing about a language.
LETTERS, ASCII_LETTERS = re.compile(r"[^\W\d_]+"), re.compile("[a-z]+")
SPACE = "▁"
#: Words whose scores a worker keeps.
CACHE = 400_000
#: Characters of texts scored at once, words of one length scored side by side, and the length from which a word is scored alone.
CHARS_AT_ONCE, WORDS_AT_ONCE, LONG_WORD = 4_000_000, 4_096, 64
UNKNOWN = "und"


@functools.lru_cache(maxsize=2)
def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    if text.isascii():
        return ASCII_LETTERS.findall(text)
    words = LETTERS.findall(text)
    if all(map(str.isalpha, words)):
        return words
    # some hold numerals, which end a word
    return [x for w in words for x in "".join(c if c.isalpha() else " " for c in w).split()]


def piece_counts(docs: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, n): how often the vocabulary's own segmentation uses a piece in a language."""

    def run(batches):
        model = _model(path)
        for batch in batches:
            found: dict[tuple[str, int], int] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for ids in model.encode(words_of(text), num_threads=1):
                    for i in ids:
                        found[lang, i] = found.get((lang, i), 0) + 1
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([found[k] for k in keys], pa.int64())], names=["lang", "piece", "n"])

    return docs.select(text_col, lang_col).mapInArrow(run, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Unigrams:
    """Piece probabilities by language, and the forward algorithm over them."""

    def __init__(self, langs: list[str], counts: dict[tuple[str, int], int], path: str, smoothing: float = 0.1):
        model = _model(path)
        self.langs = langs
        table = np.full((model.get_piece_size(), len(langs)), smoothing)
        at = {x: i for i, x in enumerate(langs)}
        for (lang, piece), n in counts.items():
            table[piece, at[lang]] += n
        table /= table.sum(axis=0)
        self.pieces: dict[str, tuple[float, ...]] = {}
        for i, row in enumerate(table.tolist()):
            piece = model.id_to_piece(i)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and piece == piece.lower():
                self.pieces[piece] = tuple(row)
        self.longest = max(map(len, self.pieces))
        # a character that the vocabulary lacks costs as much in every language
        self.other = tuple([float(table.min(initial=1.0))] * len(langs))
        self._grow()

    def _grow(self) -> None:
        """The pieces as a tree in arrays: children by (node, character), a row of probabilities by node."""
        letters = sorted(set("".join(self.pieces)))
        of = {c: i + 1 for i, c in enumerate(letters)}  # 0: a character of no piece
        self.letter = np.zeros(max(map(ord, letters)) + 2, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        child: dict[int, int] = {}
        ends, rows = [-1], []
        for piece, row in self.pieces.items():
            node = 0
            for c in piece:
                key = node * self.width + of[c]
                if key not in child:
                    child[key] = len(ends)
                    ends.append(-1)
                node = child[key]
            ends[node] = len(rows)
            rows.append(row)
        keys = np.array(list(child), np.int64)
        order = np.argsort(keys)
        self.edges, self.nodes = keys[order], np.array(list(child.values()), np.int32)[order]
        self.ends, self.rows = np.array(ends, np.int32), np.array(rows)

    @functools.cached_property
    def scorer(self) -> Scorer:
        """One for each Python worker, kept from task to task with the broadcast model."""
        return Scorer(self)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "scorer"}

    def log_probability(self, word: str) -> tuple[float, ...]:
        """log of the sum over all segmentations, for each language."""
        s, pieces, k = SPACE + word, self.pieces, len(self.langs)
        alpha: list[list[float] | None] = [[1.0] * k]
        logs, scale = range(k), 0.0
        for end in range(1, len(s) + 1):
            total = [0.0] * k
            for start in range(max(0, end - self.longest), end):
                p = pieces.get(s[start:end])
                if p is None:
                    if end - start > 1:
                        continue
                    p = self.other
                a = alpha[start]
                for j in logs:
                    total[j] += a[j] * p[j]
            if max(total) < 1e-150:
                low = max(0, end - self.longest)
                alpha[low:end] = [[x * 1e150 for x in a] for a in alpha[low:end]]
                total = [x * 1e150 for x in total]
                scale += 1
            alpha.append(total)
        return tuple(math.log(max(x, 1e-300)) - scale * math.log(1e150) for x in alpha[-1])

    def _side_by_side(self, words: list[str]) -> np.ndarray:
        """The forward algorithm over words of one length: every start's sums go on along the tree, all words at once."""
        n, k = len(words), len(self.langs)
        codes = np.frombuffer("".join(SPACE + w for w in words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, -1)
        letters = np.ascontiguousarray(self.letter[np.minimum(codes, len(self.letter) - 1)].T).astype(np.int64)
        size = len(letters)
        alpha = np.zeros((size + 1, n, k))
        alpha[0] = 1.0
        for start in range(size):
            here, alive, node = alpha[start], np.arange(n), np.zeros(n, np.int64)
            for end in range(start + 1, min(size, start + self.longest) + 1):
                key = node * self.width + letters[end - 1, alive]
                at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
                on = self.edges[at] == key
                to = self.nodes[at[on]]
                goes = alive[on]
                row = self.ends[to]
                ends = row >= 0
                who = goes[ends]
                alpha[end, who] += here[who] * self.rows[row[ends]]
                if end == start + 1 and len(who) < n:
                    lone = np.ones(n, bool)
                    lone[who] = False
                    alpha[end, lone] += here[lone] * np.array(self.other)
                alive, node = goes, to.astype(np.int64)
                if not len(alive):
                    break
        return alpha[size]

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """:meth:`log_probability` of many words, those of one length side by side."""
        out = np.empty((len(words), len(self.langs)))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        edges = np.flatnonzero(np.diff(sizes[order])) + 1
        for same in np.split(order, edges):
            for at in range(0, len(same), WORDS_AT_ONCE):
                part = same[at : at + WORDS_AT_ONCE]
                if len(part) and sizes[part[0]] < LONG_WORD:
                    found = self._side_by_side([words[i] for i in part])
                    out[part] = np.log(np.maximum(found, 1e-300))
                    part = part[(found < 1e-250).any(axis=1)]  # too small for plain sums
                for i in part:
                    out[i] = self.log_probability(words[i])
        return out


class Scorer:
    """Scores texts; words that were met before are looked up."""

    def __init__(self, model: Unigrams):
        self.model, self.at, self.rows = model, {}, np.empty((1024, len(model.langs)))

    def _learn(self, found: list[list[str]]) -> None:
        if len(self.at) > CACHE:
            self.at.clear()
        new = list({w for words in found for w in words if w not in self.at})
        n = len(self.at)
        if n + len(new) > len(self.rows):
            more = max(len(self.rows), n + len(new))
            self.rows = np.concatenate([self.rows, np.empty((more, self.rows.shape[1]))])
        self.rows[n : n + len(new)] = self.model.log_probabilities(new)
        self.at.update(zip(new, range(n, n + len(new)), strict=True))

    def score(self, text: str | None) -> tuple[str, float]:
        """(language, posterior under equal priors); ``und`` and 0 if there is no letter or no language."""
        return self.score_all([text])[0]

    def score_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """:meth:`score` of each text; new words of many texts are scored together."""
        out, at = [], 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end] or "") <= CHARS_AT_ONCE):
                chars += len(texts[end] or "")
                end += 1
            found = [words_of(t) for t in texts[at:end]]
            if self.model.langs:
                self._learn(found)
            for words in found:
                if not words or not self.model.langs:
                    out.append((UNKNOWN, 0.0))
                    continue
                ids = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
                total = self.rows[ids].sum(axis=0)
                best = int(total.argmax())
                out.append((self.model.langs[best], float(1 / np.exp(total - total[best]).sum())))
            at = end
        return out


def train(docs: DataFrame, path: str | None = None, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_lang: int = 2_000) -> Unigrams:
    """Learn from rows with a language. About ``docs_per_lang`` documents of each language, those with
    the smallest hashes of their ids, are read (all, where a language has fewer): piece
    probabilities settle long before that. What reaches the driver is bounded by pieces x languages."""
    path = path or public_tokenizers.path(VOCABULARY)
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    per_lang = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    langs = sorted(per_lang)
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col(lang_col) == lang, F.lit(docs_per_lang / per_lang[lang])).otherwise(share)
    picked = known.filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < share * 1_000_000)
    counts = {(r["lang"], r["piece"]): r["n"] for r in piece_counts(picked, path, text_col, lang_col).collect()}
    return Unigrams(langs, counts, path)


def predict(docs: DataFrame, model: Unigrams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``' id and every other column but the text, with lang_pred string and score double."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = sent.value.scorer
        for batch in batches:
            found = scorer.score_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2, path: str | None = None, docs_per_lang: int = 2_000) -> DataFrame:
    """(id_col, held_out, lang_pred, score) for every document.

    Learns from the text and non-null language of documents whose id's CRC-32 isn't ``held_out`` modulo
    ``folds``, and predicts every whole text from the text alone. ``und`` with score 0: null texts, texts
    without a letter (numerals and marks are none), and all texts if there is nothing to learn from. Languages of equal score: the
    first by code point. A null id is in neither fold (held_out false). Whole texts of any length are scored. Repeated rows are
    scored each, other columns ignored, an empty table gives no rows. The broadcast model holds one probability for each piece
    of the vocabulary and each distinct ``lang``, a few bytes times 24 thousand a language.
    """
    fold = crc32_of_id(id_col) % folds
    model = train(docs.filter(fold != held_out), path, text_col, lang_col, id_col, docs_per_lang)
    return predict(docs, model, id_col, text_col).select(id_col, F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """``docs`` without the documents whose language can't be told (``und``, or no language reaches
    ``least_score``). Columns are those of ``docs``."""
    model = train(docs.filter(crc32_of_id("doc_id") % 4 != 2))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")

    def run(batches):
        scorer = sent.value.scorer
        for batch in batches:
            found = scorer.score_all(batch.column(text_at).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

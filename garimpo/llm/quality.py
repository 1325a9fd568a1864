"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its byte pairs, folded to a fixed number of columns, the shapes of its words and
how much of it repeats. Log counts, weighted by inverse document frequency, are projected to a
latent-semantic space: the leading right singular vectors of a bounded sample of labelled
documents. The sample's vectors are broadcast; every document's cosines to all of them are computed exactly, block
by block, and the most similar neighbours vote with their similarity.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import crc32_of_id

#: Shares of repeated words or lines from which a step counts, and what a step weighs beside all other terms.
STEPS = np.array([0.05, 0.1, 0.2, 0.3, 0.5, 0.7])
STEP_WEIGHT = 0.5
PAIR_COLUMNS, SHAPE_COLUMNS = 1_536, 448
COLUMNS = PAIR_COLUMNS + SHAPE_COLUMNS + 2 * len(STEPS)
#: The bound on labelled documents that the vectors are fitted on and that vote.
SAMPLE = 4_000
RANK = 48
NEIGHBOURS = 25
BLOCK = 512

_PAIR = (np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(PAIR_COLUMNS)
_PAIR = _PAIR.astype(np.int64)
#: Letters, digits and white space become one character each; other bytes stay.
_SHAPE = bytes(ord("a") if chr(i).islower() or i >= 128 else ord("A") if chr(i).isupper() else ord("0") if chr(i).isdigit() else 32 if i in b" \t\r\v\f" else i for i in range(256))
_RUNS = re.compile(rb"([aA0])\1+")


def features(text: str | None) -> np.ndarray:
    """Log counts of the terms of a whole text; zero for an empty one."""
    out = np.zeros(COLUMNS, np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return out
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    pairs = np.bincount(b[:-1] * 256 + b[1:], minlength=65536)
    used = np.flatnonzero(pairs)
    np.add.at(out, _PAIR[used], pairs[used])
    words = raw.translate(_SHAPE).split()
    shapes: dict[bytes, int] = {}
    for w in words:
        shapes[w] = shapes.get(w, 0) + 1
    for w, n in shapes.items():
        out[PAIR_COLUMNS + zlib.crc32(_RUNS.sub(rb"\1+", w)) % SHAPE_COLUMNS] += n
    total = max(1, len(raw))
    out = np.log1p(out * (1000.0 / total)).astype(np.float32)
    # repetition: how large a share of words repeats the word before, and of lines any line before
    plain = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    again = sum(map(bytes.__eq__, plain, plain[1:])) / max(1, len(plain) - 1)
    copied = 1 - len(set(lines)) / max(1, len(lines))
    out[PAIR_COLUMNS + SHAPE_COLUMNS :] = np.concatenate([again > STEPS, copied > STEPS])
    return out


class Voters:
    """Labelled latent-semantic vectors and the projection to their space."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, rank: int = RANK, seed: int = 7):
        held = (x > 0).sum(axis=0)
        self.idf = np.log((1 + len(x)) / (1 + held)).astype(np.float32) + 0.1
        x = self._weighted(x)
        rng = np.random.default_rng(seed)
        rank = max(1, min(rank, *x.shape))
        q = np.linalg.qr(x.T @ rng.standard_normal((len(x), rank + 10)).astype(np.float32))[0]
        for _ in range(4):  # subspace iteration
            q = np.linalg.qr(x.T @ (x @ q))[0]
        _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
        self.basis = np.ascontiguousarray((q @ vt.T)[:, :rank])
        self.labels = labels.astype(np.float32)
        self.vectors = self._unit(x @ self.basis)

    def _weighted(self, x: np.ndarray) -> np.ndarray:
        terms = PAIR_COLUMNS + SHAPE_COLUMNS
        return self._unit(np.concatenate([self._unit((x * self.idf)[:, :terms]), STEP_WEIGHT * x[:, terms:]], axis=1))

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n == 0, 1, n)

    def score(self, x: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest voters, all that are as similar as the last of them
        included; the mean label where nothing is similar."""
        cosine = self._unit(self._weighted(x) @ self.basis) @ self.vectors.T
        k = min(neighbours, cosine.shape[1])
        edge = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k]
        weight = np.square(np.square(np.where(cosine >= np.maximum(edge, 0)[:, None], cosine, 0)))
        total = weight.sum(axis=1)
        share = weight @ self.labels / np.where(total == 0, 1, total)
        return np.where(total == 0, self.labels.mean(), share).clip(0, 1).astype(np.float64)


def _matrix(texts: list) -> np.ndarray:
    return np.stack([features(t) for t in texts]) if texts else np.empty((0, COLUMNS), np.float32)


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Voters | None:
    """Voters from about ``sample`` labelled documents at most, those with the smallest hashes of
    their ids; of an id with several labels the mean counts, of one with several rows a single text. None if there is no label."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.avg(label_col).alias("_label"))
    n = known.count()
    if not n:
        return None
    # the sample's ids are bounded, so they may be broadcast
    picked = known.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < F.lit(1_000_000 * min(1.0, sample / n)))

    def run(batches):
        for batch in batches:
            rows = [features(t).astype("<f2").tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], names=["x", "label"])

    sampled = docs.select(id_col, text_col).join(F.broadcast(picked), id_col).groupBy(id_col, F.col("_label").alias("label")).agg(F.min(F.struct(F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))).alias("one"))
    rows = sampled.select("one.text", "label").mapInArrow(run, "x binary, label double").collect()
    if not rows:
        return None
    rows = sorted(rows)
    return Voters(np.stack([np.frombuffer(r[0], "<f2") for r in rows]).astype(np.float32), np.array([r[1] for r in rows]))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 5,
    held_out: int = 0,
    threshold: float = 0.3,
    sample: int = SAMPLE,
) -> DataFrame:
    """(id_col, held_out, score, predicted) for every document.

    Learns only from labels of ids whose CRC-32 isn't ``held_out`` modulo ``folds``; a score comes from the whole
    text alone, whatever its length. All voters that tie for the last place vote, so no order decides. Null and empty texts are similar to nothing and get the mean label; without any usable label
    every score is 0.5. A null id is in neither fold (held_out false). Repeated rows are scored each, other
    columns are ignored, an empty table gives no rows.
    """
    fold = crc32_of_id(id_col) % folds
    voters = fit(docs, labels.filter(fold != held_out), label_col, id_col, text_col, sample)
    sent = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                texts = part.column(1).to_pylist()
                score = np.full(len(texts), 0.5) if sent.value is None else sent.value.score(_matrix(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64())], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return scored.select(id_col, F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

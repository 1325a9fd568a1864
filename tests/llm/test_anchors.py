"""Fixed-block anchors against every passage of every text."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from garimpo.llm import anchors, words as arrays


def slow_cut(texts: list, least: int) -> list:
    """(kept text, words, removed words) of each text, by counting all passages."""
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    places = Counter(tuple(w[k : k + least]) for w in split for k in range(len(w) - least + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for k in range(len(w) - least + 1):
            if places[tuple(w[k : k + least])] > 1:
                gone[k : k + least] = [True] * least
        out.append((b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode("utf-8", "surrogatepass"), len(w), sum(gone)))
    return out


def held_against_brute_force(docs, **how):
    """Rows by id and text; the multiset of results must agree."""
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(map(repr, [(i, *s) for (i, _), s in zip(rows, slow_cut([t for _, t in rows], how.get("least", 35)), strict=True)]))
    found = anchors.remove_repeats(docs, **how)
    got = found.collect()
    assert sorted(repr((r["doc_id"], r["text"], r["n_words"], r["n_removed"])) for r in got) == want
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]
        assert all(a["end"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:], strict=False))
    return got


def some_words(rng, n, of=10**9):
    return " ".join(f"w{x}" for x in rng.integers(0, of, n))


@pytest.mark.parametrize("group_rows", [anchors.GROUP_ROWS, 0])
def test_documents(spark, small, group_rows):
    got = held_against_brute_force(spark.read.parquet(f"{small}/documents.parquet"), group_rows=group_rows)
    assert sum(r["n_removed"] for r in got) > 0


def test_odd_rows(odd, empty):
    held_against_brute_force(odd)
    out = anchors.remove_repeats(empty)
    assert out.columns == ["doc_id", "text", "n_words", "n_removed", "removed"] and out.count() == 0


def test_passages_at_every_shift_and_length(spark):
    """Passages of 33 to 37 words at all distances from their texts' starts; those of 34 and fewer stay."""
    rng = np.random.default_rng(4)
    texts = []
    for n in range(33, 38):
        passage = some_words(rng, n)
        texts += [f"{some_words(rng, int(k))} {passage} {some_words(rng, 40)}" for k in range(0, 40, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["n_removed"] for r in held_against_brute_force(docs)}
    assert all((got[i] > 0) == (i >= 28) for i in got)


def test_templates_with_one_word_of_their_own(spark):
    """Texts that share all but the last of 35 words have no repeat."""
    rng = np.random.default_rng(5)
    same = some_words(rng, 34)
    docs = spark.createDataFrame([(i, f"{same} own{i}") for i in range(3000)], "doc_id long, text string")
    assert anchors.remove_repeats(docs).agg(F.sum("n_removed")).first()[0] == 0


@pytest.mark.parametrize("least,block,gram", [(5, 3, 2), (4, 2, 1), (3, 2, 3), (1, 1, 1)])
def test_few_words_many_repeats(spark, least, block, gram):
    rng = np.random.default_rng(6)
    texts = [some_words(rng, int(n), 4) for n in rng.integers(0, 30, 60)] + ["a " * 50, "a " * 51, "a a a", "b\tb\nb  b b"]
    held_against_brute_force(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), least=least, block=block, gram=gram)


def test_hot_grams_give_the_same_rows(spark, monkeypatch):
    """A common line in unlike texts, with its grams told as hot and not."""
    rng = np.random.default_rng(7)
    line = some_words(rng, 45)
    texts = [f"{some_words(rng, 8)} {line} {some_words(rng, 8)}" for _ in range(300)] + [some_words(rng, 60) for _ in range(20)]
    texts += texts[:3] + [texts[-1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    told = anchors.hot_grams(anchors._texts(docs, "text"), 35, 6, 10)
    assert len(told)
    held_against_brute_force(docs)
    monkeypatch.setattr(anchors, "hot_grams", lambda *_: told)
    held_against_brute_force(docs)


def test_arguments(spark, empty):
    with pytest.raises(ValueError):
        anchors.remove_repeats(empty, least=34)


@pytest.mark.parametrize("n", [1, 2, 3, 6, 18, 35])
def test_grams_and_least(n):
    rng = np.random.default_rng(n)
    words = rng.integers(0, 5, 200).astype(np.uint64)
    grams = arrays.gram_hashes(words, n)
    by = {}
    for i, g in enumerate(grams):
        assert by.setdefault(tuple(words[i : i + n]), g) == g
    assert len(set(by.values())) == len(by) and len(grams) == 201 - n
    assert arrays.sliding_least(words, n).tolist() == [min(words[i : i + n]) for i in range(201 - n)]
    assert len(arrays.gram_hashes(words[: n - 1], n)) == 0

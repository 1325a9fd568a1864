"""Phrase growth against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest

from garimpo.llm import phrases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_collocations(rows: list, least: int = 10, n_words: int = 3, top: int = 2000, share: int = 50) -> list:
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, n_words + 1):
                f.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    held = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    gone = set()
    for (lang, words), a in held.items():
        for size in range(2, len(words)):
            gone.update((lang, words[i : i + size]) for i in range(len(words) - size + 1) if 100 * a >= share * f[lang, words[i : i + size]])
    found: dict = {}
    for (lang, words), a in held.items():
        if (lang, words) not in gone:
            cuts = [(10**6 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in found.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


def fast_collocations(docs, **how) -> list:
    return sorted(map(tuple, phrases.collocations(docs, **how).collect()))


def pairs(docs) -> list:
    return [(r["lang"], r["text"]) for r in docs.collect()]


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = slow_collocations(pairs(docs))
    assert fast_collocations(docs) == want and len(want) > 100
    assert fast_collocations(docs, top=5, least=4, n_words=4, share=80) == slow_collocations(pairs(docs), 4, 4, 5, 80)


def test_odd_rows(spark, odd, empty):
    for least in (1, 3, 10):
        assert fast_collocations(odd, least=least) == slow_collocations(pairs(odd), least)
    assert fast_collocations(empty) == []


def test_pieces_and_letters(spark):
    texts = ["A b,A b;A B\ra b\x0ba b\x0ca  b\ta b. a b: a b! a b? a b", "É é É é", "É É", "x\ny", "\x1ca \x1ca", "\xffb \xffb"] * 6
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert fast_collocations(docs, least=5) == slow_collocations(pairs(docs), 5)


@pytest.mark.parametrize("chunk", [50, phrases.WORDS_AT_ONCE])
def test_hot_prefixes_give_the_same_rows(spark, monkeypatch, chunk):
    """A word, a pair and a triple that a third of all places share, told as hot or not, in small chunks."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"the very {'end' if rng.random() < 0.6 else 'w%d' % rng.integers(9)} x{rng.integers(40)}" for _ in range(12)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, ["en", "fr", None][i % 3]) for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(4)
    want = slow_collocations(pairs(docs), 5)
    monkeypatch.setattr(phrases, "WORDS_AT_ONCE", chunk)
    monkeypatch.setattr(phrases, "partitions", lambda _: 30)
    told = phrases.hot_prefixes(docs.select("lang", "text").na.fill("und"), 3)
    assert len(told[0]) >= 2 and len(told[1]) >= 2
    assert fast_collocations(docs, least=5) == want
    monkeypatch.setattr(phrases, "hot_prefixes", lambda *_: [np.empty(0, np.uint64)] * 2)
    assert fast_collocations(docs, least=5) == want


def test_occurrences_of_large_vocabularies():
    """Packed keys and sorted columns give the same runs."""
    rng = np.random.default_rng(9)
    numbers = rng.integers(0, 6, 500).astype(np.int32)
    small, large = phrases.occurrences(numbers, 3, 6), phrases.occurrences(numbers, 3, 1 << 22)
    assert [c.tolist() for c in small[0]] == [c.tolist() for c in large[0]] and small[1].tolist() == large[1].tolist()
    assert small[1].sum() == np.count_nonzero(numbers)

"""The pipeline against a brute-force version of its stages on the small documents."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

import corpus_pipeline
from garimpo.llm import langid, packing, secrets, simhash
from test_operators import base_spans, check_packed

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def mixed(docs: list[dict]) -> Counter:
    """(doc_id, text) of the mix."""
    sizes = Counter()
    for d in docs:
        sizes[d["source"]] += len(WORDS.findall(d["text"] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, full = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, set()
    while True:
        left, rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full), [s for s in order if s not in full]
        target = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    target |= {s: 3 * sizes[s] for s in full}
    out = Counter()
    for s in order:
        budget = math.floor(target[s] + 0.5)
        epochs, left = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        rows = []
        for d in (d for d in docs if d["source"] == s):
            pair = f"{d['doc_id']}:{d['hash']}"
            rows.append((int(hashlib.md5(f"mix:{pair}".encode()).hexdigest()[:15], 16), d))
        for _, d in sorted(rows, key=lambda r: r[0]):
            words = WORDS.findall(d["text"] or "")
            part = min(left, len(words))
            left -= part
            for k in range(epochs + (part > 0)):
                out[d["doc_id"], d["text"] if k < epochs or part == len(words) else " ".join(words[:part])] += 1
    return out


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, small).write.parquet(at)
        docs = spark.read.parquet(at)
        out.append(docs)
    return out


def pairs(df) -> Counter:
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_columns_stay_until_the_last_stage(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_language(stages):
    model = langid.train(stages[0].filter("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"))
    want = Counter({k: n for k, n in pairs(stages[0]).items() if (lambda s: s[0] != "und" and s[1] >= 0.5)(langid.Scorer(model).score(k[1]))})
    assert pairs(stages[1]) == want and sum(want.values()) > 0.95 * stages[0].count()


def shingles(text) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar(texts: list, least: float) -> list[tuple[int, int]]:
    """Brute force: all pairs of texts whose five-word shingles have a Jaccard similarity of ``least`` or more."""
    sets = [shingles(t) for t in texts]
    return [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= least * max(1, len(sets[i] | sets[j])) or sets[i] == sets[j]]


def test_near_duplicates(stages):
    """No link is further than the stage's radius, and of near copies a tenth at most stay."""
    docs = {r["doc_id"]: r["text"] for r in stages[1].collect()}
    kept = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    ids, width = sorted(docs), 64 * simhash.VIEWS
    prints = [[simhash.fingerprint(docs[i], 5, view=v) for v in range(simhash.VIEWS)] for i in ids]
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if sum((a ^ b).bit_count() for a, b in zip(prints[i], prints[j], strict=True)) <= int(simhash.APART * width):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    first = {ids[k]: ids[root(k)] for k in range(len(ids))}
    assert set(first.values()) <= set(kept) <= set(docs)  # the smallest id of each group by brute force stays
    assert len(kept) <= len(set(first.values())) + 0.1 * (len(docs) - len(set(first.values())))
    assert len(set(kept.values())) == len(kept)  # no exact copy
    assert all(kept[i] == docs[i] for i in kept)
    texts, left = [docs[i] for i in ids], set(kept)
    near = [(ids[i], ids[j]) for i, j in similar(texts, 0.8)]
    both = [p for p in near if p[0] in left and p[1] in left]
    assert near and len(both) <= 0.1 * len(near)


def test_no_unlike_document_goes(stages):
    """A document that went has a kept one of at least half its shingles, or is linked to it over others."""
    docs, kept = {r["doc_id"]: r["text"] for r in stages[1].collect()}, {r["doc_id"] for r in stages[2].collect()}
    ids = sorted(docs)
    like = Counter(i for a, b in similar([docs[i] for i in ids], 0.5) for i in (ids[a], ids[b]))
    assert all(like[i] for i in docs if i not in kept)


def test_stages_on_the_odd_table(spark, odd, small, tmp_path):
    """Null and repeated ids, clashing columns: no row goes that has no like among those that stay, until the mix."""
    docs = odd
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, columns = docs, docs.columns
        stage(spark, docs, small).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns and docs.dtypes == before.dtypes
        if k == 1:
            left = {shingles(r["text"]) for r in docs.collect()}
            assert all(any(len(shingles(r["text"]) & x) >= 0.5 * len(shingles(r["text"])) for x in left) for r in before.collect())
        if k == 2:
            assert docs.count() == before.count() and not any(base_spans(r["text"]) for r in docs.collect())
    assert check_packed(docs.collect(), 1024) > 0


def test_secrets_are_gone_and_nothing_else(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    for r in stages[3].collect():
        text = before.pop(r["doc_id"])
        if base_spans(text):
            assert not base_spans(r["text"]) and "<" in r["text"]
        elif not secrets.candidates(text):
            assert r["text"] == text
        assert r["n_chars"] == len(r["text"])
    assert not before


def test_mix(spark, stages):
    docs = [r.asDict() for r in stages[3].selectExpr("doc_id", "text", "source", "xxhash64(text) as hash").collect()]
    assert pairs(stages[4]) == mixed(docs)


def test_packing(spark, stages):
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = Counter()
    for r in stages[4].collect():
        ids = np.array([*tok.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        for k, (start, n) in enumerate(packing.cut(len(ids), 1024)):
            want[r["doc_id"], k, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
    found = stages[5].collect()
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in found) == want
    assert check_packed(found, 1024) <= math.ceil(sum(r["length"] for r in found) / 1024) * 1.05 + 1


def test_run(spark, small, stages):
    key = ["doc_id", "piece", "length", "ids_crc32"]
    run = corpus_pipeline.run(spark, small)
    assert run.columns == stages[5].columns
    assert Counter(map(tuple, run.select(key).collect())) == Counter(map(tuple, stages[5].select(key).collect()))


def test_empty(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() == 0

"""Kd-tree filtering against plain integer k-means."""

import hashlib
import math

import numpy as np
import pytest

from garimpo.llm import kdmeans

KINDS = "vec_id long, embedding array<double>, cluster string, distance int"


def slow_cluster(rows: list, dims: int, k: int, rounds: int, scale: int = 1024, seed: str = "3:") -> list:
    held = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            name = hashlib.sha256(f"{seed}{'null' if i is None else i}".encode()).hexdigest()
            held.append((name, v, i, [math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale for x in v]))
    held.sort(key=lambda h: h[:2])
    centroids = [h[3] for h in held[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p: min(range(len(centroids)), key=lambda c: (away(p, centroids[c]), c))
    for _ in range(rounds):
        groups: dict = {}
        for h in held:
            groups.setdefault(nearest(h[3]), []).append(h[3])
        centroids = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if c in groups else old for c, old in enumerate(centroids)]
    most = 2**63 - 1
    found = [(h[2], c := nearest(h[3]), min(away(h[3], centroids[c]), most)) for h in held]
    by: dict = {}
    for _, c, d in found:
        by[c] = by.get(c, 0) + d
    sha = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted((repr(i), c, d, min(by[c], most), min(sum(by.values()), most), sha(c)) for i, c, d in found)


def fast_cluster(vectors, **how) -> list:
    out = kdmeans.cluster(vectors, **how)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((repr(r[0]), *r[1:]) for r in map(tuple, out.collect()))


def blobs(rng, n, dims, spread=0.05):
    middles = rng.normal(size=(6, dims))
    return middles[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, dims))


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_clusters(spark, spread, monkeypatch):
    monkeypatch.setattr(kdmeans, "LEAF", 4)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v], "x", 1) for i, v in enumerate(blobs(rng, 400, 5, spread))]
    vectors = spark.createDataFrame(rows, KINDS).repartition(3)
    assert fast_cluster(vectors, dims=5, k=7, rounds=4, size=100) == slow_cluster([r[:2] for r in rows], 5, 7, 4)


def test_odd_vectors(spark):
    """Nulls, lengths, non-finite and enormous components, ties, repeated and missing ids, one vector on a third of the rows."""
    rng = np.random.default_rng(2)
    inf, nan = float("inf"), float("nan")
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-3, 4, (120, 3)) / 2)]
    rows += [(200 + i, [0.5, -0.5, 1.0]) for i in range(70)] + [(7, [1.0, 1.0, 1.0])] * 3 + [(None, [2.0, 0.0, -1.0])] * 2
    rows += [(300, None), (301, [1.0, 2.0]), (302, [1.0, 2.0, None]), (303, [nan, 0.0, 0.0]), (304, [0.0, inf, 0.0]), (305, []), (306, [1.0] * 4)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], KINDS).repartition(4)
    assert fast_cluster(docs, dims=3, rounds=5) == slow_cluster(rows, 3, 8, 5)
    large = [(400, [1e308, -1e308, 1e300]), (401, [-3e38, 3e38, 1e20]), (402, [1e9, 1e9, -1e9]), (403, [-1e-300, 1e-300, 0.0])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows + large], KINDS).repartition(2)
    assert fast_cluster(docs, dims=3, k=20, rounds=3) == slow_cluster(rows + large, 3, 20, 3)


def test_few_and_none(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25], "x", 1)], KINDS)
    assert fast_cluster(one, dims=2) == slow_cluster([(1, [0.5, 0.25])], 2, 8, 10)
    assert fast_cluster(one.limit(0), dims=2) == [] and fast_cluster(one, dims=3) == []


def test_embeddings(spark, small):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet").limit(150)
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    assert fast_cluster(vectors, rounds=3) == slow_cluster(rows, 64, 8, 3)


def test_whole_nodes_are_assigned(monkeypatch):
    """On distant blobs most points are never compared with a centroid, and nodes with a tie go on to the leaves."""
    rng = np.random.default_rng(3)
    points = kdmeans.integers(blobs(rng, 4096, 8, 0.001), 1024)
    order, nodes = kdmeans.build(points)
    points = points[order]
    assert sorted(order.tolist()) == list(range(4096))
    for level, (low, high, total) in enumerate(nodes):
        at = kdmeans.bounds(4096, level)
        for i in range(1 << level):
            own = points[at[i] : at[i + 1]]
            assert (low[i] == own.min(axis=0)).all() and (high[i] == own.max(axis=0)).all() and (total[i] == own.sum(axis=0)).all()
    centroids = points[[0, 500, 1000, 1500, 2500, 4000]]
    alone = sum(e - b for b, e, _, part in kdmeans.walk(points, nodes, centroids) if part is not None)
    assert alone > 3000
    want = kdmeans.squared(points, centroids).argmin(axis=1)
    assert (kdmeans.assigned(points, nodes, centroids)[0] == want).all()
    twice = np.concatenate([centroids[:1], centroids])  # equal centroids: the first owns all
    assert set(kdmeans.assigned(points, nodes, twice)[0].tolist()) == {0 if c == 0 else c + 1 for c in want.tolist()}


def test_limbs_add_up():
    values = [0, 1, -1, 2**40, -(2**40) - 5, 3**100, -(7**80)]
    digits = kdmeans.limbs(values)
    assert [sum(d[i] << (kdmeans.LIMB * k) for k, d in enumerate(digits)) for i in range(len(values))] == values
    assert all(abs(x) < 1 << kdmeans.LIMB for d in digits for x in d)

"""Centroid clustering by kd-tree filtering.

Each partition's vectors become kd-trees of bounded size, written once: points in the tree's order, and for every node its
count, the integer sum of its points and their box. A round walks the trees from the root with the centroids that may own a node: of these, the
one nearest to the middle of the box is held against the others, and those that are strictly farther at every point of the box are pruned. A node
with one centroid left is assigned whole, by its count and sum; leaves are resolved point by point. Trees send a row of sums for each cluster,
Spark adds them up, and the driver, which sees k rows of sums, moves the centroids. All of it is integer arithmetic.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise

#: Vectors of a tree at most, and of a leaf.
TREE, LEAF = 8_192, 48
#: Up to these magnitudes products are exact in doubles and in longs; beyond them Python's integers take over.
DOUBLES, LONGS = 1 << 22, 1 << 26
LIMB = 40
LONGEST = 2**63 - 1


def whole(x: float, scale: int) -> int:
    """floor(scale * x), also where that overflows a double."""
    return math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as long, or as Python's integers where some are large."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if np.abs(scaled).max(initial=0) < LONGS:
        return scaled.astype(np.int64)
    return np.array([whole(float(x), scale) for x in values.ravel()], object).reshape(values.shape)


def bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin, and the end of the last: halves of halves."""
    return (n * np.arange((1 << level) + 1)) >> level


def depth(n: int) -> int:
    return max(0, math.ceil(math.log2(n / LEAF))) if n > LEAF else 0


def build(points: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The order of the points in the tree, split at the median of the widest dimension, and (low, high, sum) of each level's nodes."""
    n = len(points)
    levels, order = depth(n), np.arange(n)
    for level in range(levels):
        at, halves = bounds(n, level), bounds(n, level + 1)
        for i in range(1 << level):
            own = order[at[i] : at[i + 1]]
            held = points[own]
            widest = int(np.argmax(held.max(axis=0) - held.min(axis=0)))
            order[at[i] : at[i + 1]] = own[np.argpartition(held[:, widest], halves[2 * i + 1] - at[i])] if held.dtype != object else own[np.argsort(held[:, widest])]
    placed, at = points[order], bounds(n, levels)[:-1]
    nodes = [tuple(f.reduceat(placed, at, axis=0) for f in (np.minimum, np.maximum, np.add))]
    for _ in range(levels):
        nodes.append(tuple(f(x[::2], x[1::2]) for f, x in zip((np.minimum, np.maximum, np.add), nodes[-1], strict=True)))
    return order, nodes[::-1]


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (points x centroids), exact."""
    peak = max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if peak < DOUBLES else np.int64 if peak < LONGS else object
    p, c = points.astype(kind), centroids.astype(kind)
    found = (p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)[None]
    return found.astype(np.int64) if kind is np.float64 else found


def walk(points: np.ndarray, nodes: list, centroids: np.ndarray):
    """(begin, end, cluster or an array of them, sum or None) of the parts of a tree that were assigned whole, or point by point."""
    if LONGS <= np.abs(centroids).max(initial=0) or points.dtype == object:
        points, centroids, nodes = points.astype(object), centroids.astype(object), [tuple(x.astype(object) for x in level) for level in nodes]
    norms = (centroids * centroids).sum(axis=1)
    active, may = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    for level, (low, high, total) in enumerate(nodes):
        lo, hi, at = low[active], high[active], bounds(len(points), level)
        from_middle = ((lo + hi)[:, None] - 2 * centroids[None]) ** 2
        from_middle = from_middle.sum(axis=2)
        best = np.where(may, from_middle, from_middle.max(initial=0) + 1).argmin(axis=1)
        # how much farther than the best a centroid is at least, at the corner that suits it most
        apart = centroids[None] - centroids[best][:, None]
        gap = norms[None] - norms[best][:, None] - 2 * (np.where(apart > 0, hi[:, None], lo[:, None]) * apart).sum(axis=2)
        may &= ~(gap > 0).astype(bool)
        one = may.sum(axis=1) == 1
        for i, c in zip(active[one], may[one].argmax(axis=1), strict=True):
            yield at[i], at[i + 1], int(c), total[i]
        active, may = active[~one], may[~one]
        if level + 1 < len(nodes):
            active, may = np.stack([2 * active, 2 * active + 1], axis=1).ravel(), np.repeat(may, 2, axis=0)
        else:
            for i, m in zip(active, may, strict=True):
                left = np.flatnonzero(m)
                yield at[i], at[i + 1], left[squared(points[at[i] : at[i + 1]], centroids[left]).argmin(axis=1)], None
        if not len(active):
            return


def sums(points: np.ndarray, nodes: list, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of each cluster."""
    counts, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), points.shape[1]), object if points.dtype == object else np.int64)
    for begin, end, cluster, part in walk(points, nodes, centroids):
        if part is not None:
            counts[cluster] += end - begin
            total[cluster] += part.astype(total.dtype)
        else:
            counts += np.bincount(cluster, minlength=len(centroids))
            np.add.at(total, cluster, points[begin:end])
    return counts, total


def assigned(points: np.ndarray, nodes: list, centroids: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Cluster and squared distance of each point."""
    clusters = np.zeros(len(points), np.int32)
    for begin, end, cluster, _ in walk(points, nodes, centroids):
        clusters[begin:end] = cluster
    away = np.zeros(len(points), object)
    for c in np.unique(clusters):
        away[clusters == c] = squared(points[clusters == c], centroids[c : c + 1])[:, 0]
    return clusters, [min(int(x), LONGEST) for x in away]


_TREE = "large boolean, ids array<long>, points binary, low binary, high binary, total binary"


def _store(x: np.ndarray, large: bool) -> bytes:
    return ",".join(map(str, x.ravel())).encode() if large else x.astype("<i8" if np.abs(x).max(initial=0) >= 2**31 else "<i4").tobytes()


def _load(data: bytes, n: int, dims: int, large: bool) -> np.ndarray:
    if large:
        return np.array([int(x) for x in data.split(b",")], object).reshape(n, dims)
    return np.frombuffer(data, "<i8" if len(data) == 8 * n * dims else "<i4").astype(np.int64).reshape(n, dims)


def trees(vectors: DataFrame, dims: int, scale: int, size: int = TREE) -> DataFrame:
    """Kd-trees of the (vec_id, vector) of each partition, at most ``size`` vectors a tree."""

    def row(ids: list, values: list) -> pa.RecordBatch:
        points = integers(np.concatenate(values), scale)
        order, nodes = build(points)
        large = points.dtype == object
        arrays = [_store(points[order], large), *(_store(np.concatenate([level[k] for level in nodes]), large) for k in range(3))]
        columns = [pa.array([large]), pa.array([pa.concat_arrays(ids).take(pa.array(order)).to_pylist()], pa.list_(pa.int64())), *(pa.array([a], pa.binary()) for a in arrays)]
        return pa.RecordBatch.from_arrays(columns, names=["large", "ids", "points", "low", "high", "total"])

    def run(batches):
        ids, values, held = [], [], 0
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            at = 0
            while at < len(flat):
                n = min(size - held, len(flat) - at)
                ids.append(batch.column(0).slice(at, n))
                values.append(flat[at : at + n])
                held, at = held + n, at + n
                if held == size:
                    yield row(ids, values)
                    ids, values, held = [], [], 0
        if held:
            yield row(ids, values)

    return vectors.mapInArrow(run, _TREE)


def _each_tree(batches, dims: int):
    for batch in batches:
        for large, ids, points, *boxes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = len(ids)
            levels = depth(n)
            boxes = [_load(b, (2 << levels) - 1, dims, large) for b in boxes]
            nodes = [tuple(b[(1 << i) - 1 : (2 << i) - 1] for b in boxes) for i in range(levels + 1)]
            yield ids, _load(points, n, dims, large), nodes


def limbs(values: list[int]) -> list[list[int]]:
    """Numbers by their digits to the base 2 ** LIMB, each with the number's sign: digits of many numbers add up without carrying."""
    out, sign, left = [], [-1 if v < 0 else 1 for v in values], [abs(v) for v in values]
    while not out or any(left):
        out.append([s * (v & ((1 << LIMB) - 1)) for s, v in zip(sign, left, strict=True)])
        left = [v >> LIMB for v in left]
    return out


def moved(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor(sum / count) of each cluster's vectors; those of empty clusters stay."""
    k, dims = centroids.shape

    def run(batches):
        for _, points, nodes in _each_tree(batches, dims):
            counts, total = sums(points, nodes, centroids)
            rows = [(c, i, digits) for c in range(k) if counts[c] for i, digits in enumerate(limbs([int(counts[c]), *map(int, total[c])]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["cluster", "limb", "digits"])

    digits = forest.mapInArrow(run, "cluster int, limb int, digits array<long>").select("cluster", "limb", F.posexplode("digits").alias("dim", "digit"))
    found = digits.groupBy("cluster", "limb", "dim").agg(F.sum(F.col("digit").cast("decimal(20,0)")).alias("digit"))
    total = np.zeros((k, dims + 1), object)
    for r in found.collect():
        total[r["cluster"], r["dim"]] += int(r["digit"]) << (LIMB * r["limb"])
    out = [[t // row[0] for t in row[1:]] if row[0] else list(c) for row, c in zip(total, centroids, strict=True)]
    return _array(out)


def _array(rows: list[list[int]]) -> np.ndarray:
    big = max((abs(int(x)) for r in rows for x in r), default=0) >= LONGS
    return np.array([[int(x) for x in r] for r in rows], object if big else np.int64).reshape(len(rows), -1)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3:", size: int = TREE) -> DataFrame:
    """K-means on integers, exact: centroids from the ``k`` vectors of least sha256(seed || id), ``rounds`` rounds, and a last assignment.

    Returns one row a vector: (vec_id long, cluster int, distance long: squared, cluster_inertia, inertia long: distances summed over its
    cluster and over all, centroid_sha256: of the final centroid's components in decimal, joined by commas). Ties of distance
    go to the smaller cluster number.

    Vectors that are null, are not of ``dims`` components, or hold a null or non-finite one take no part. Rows without an id take part, with
    ``null`` as their id's text; equal ids are ranked by their vectors, and equal rows may all be seeds. Fewer than ``k`` vectors are as many
    clusters; an empty table gives no rows; other columns are ignored. Distances and sums beyond a long stop at its end.
    """
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    held = vectors.filter(v.isNotNull() & (F.size(v) == dims) & finite).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"))
    named = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    first = held.orderBy(named, "vector").limit(k).collect()
    if not first:
        return held.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = _array([[whole(x, scale) for x in r["vector"]] for r in first])
    forest = materialise(trees(held, dims, scale, size), "kd-trees")
    for _ in range(rounds):
        centroids = moved(forest, centroids)

    def run(batches):
        for ids, points, nodes in _each_tree(batches, dims):
            clusters, away = assigned(points, nodes, centroids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(clusters, pa.int32()), pa.array(away, pa.int64())], names=["vec_id", "cluster", "distance"])

    placed = materialise(forest.mapInArrow(run, "vec_id long, cluster int, distance long"), "kd-assigned")
    inertia = {r["cluster"]: int(r["total"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    everything = min(sum(inertia.values()), LONGEST)
    facts = [(c, min(t, LONGEST), everything, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, t in sorted(inertia.items())]
    facts = placed.sparkSession.createDataFrame(facts, "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    return placed.join(F.broadcast(facts), placed["cluster"] == facts["_cluster"]).drop("_cluster")

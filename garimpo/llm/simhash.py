"""SimHash near-duplicates: a segment-popcount grid, then exact verification.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan
distance of two embeddings never exceeds the Hamming distance of the fingerprints. Counts are kept
in unary (0, 01, 11), so that the Manhattan distance is the bit count of an exclusive or.

Grid: the segments form g > r groups (r: the radius). Within Manhattan distance r at least g - r
groups agree in every count, so two fingerprints in range share a cell of at least one of the
C(g, r) grids, whose cells are the counts of g - r groups. Cells with many members are dealt out as
pairs of chunks. A task compares the members of a cell, keeps what passes the Manhattan bound
and the exact distance, and reports only a spanning forest of the links, never all pairs of a group.

Near copies that share four fifths of their shingles differ in some ten of 64 bits, which no grid of that radius can single out.
For these a document gets several fingerprints (views): the grids of each view bring candidates together, and the exact distance
over the bits of all views, a finer measure, decides. Such links are found with high probability, not always; with one view and
the grid's own radius none is lost.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise, numbered

LOW_BITS = 0x5555555555555555
#: Members of a cell beyond which it is dealt out as pairs of chunks.
CELL_CHUNK = 4_096


# ---------------------------------------------------------------- fingerprints


def _hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of the whole sequence if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        spans = [(0, len(joined))]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42, view: int = 0) -> int:
    """Unsigned 64 bits: a bit is 1 if set in over half of the hashes of all shingles. Views beyond 0 mix the hashes first."""
    return _view(_hashes(text, shingle, seed), view)


def _view(hashes: np.ndarray, view: int) -> int:
    if view:
        with np.errstate(over="ignore"):
            hashes = (hashes ^ np.uint64(view * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            hashes = hashes ^ (hashes >> np.uint64(29))
    return _majority(hashes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, views: int = 1) -> DataFrame:
    """(id_col, fp long[, fp1 long, ...]): the bits of each view as a signed long."""
    names = ["fp", *(f"fp{v}" for v in range(1, views))]

    def run(batches):
        for batch in batches:
            made = np.empty((views, batch.num_rows), np.uint64)
            for i, text in enumerate(batch.column(1).to_pylist()):
                hashes = _hashes(text, shingle, seed)
                made[:, i] = [_view(hashes, v) for v in range(views)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.view(np.int64)) for x in made)], names=[id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *(f"{n} long" for n in names)]))


# ---------------------------------------------------------------- links


def unary_counts(fp: Column) -> Column:
    """The embedding: in each two-bit segment the count of set bits in unary."""
    low, other = fp.bitwiseAND(F.lit(LOW_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS))
    return low.bitwiseOR(other).bitwiseOR(F.shiftleft(low.bitwiseAND(other), 1))


def _unary(fp: np.ndarray) -> np.ndarray:
    """:func:`unary_counts` of an array."""
    low, other = fp & np.uint64(LOW_BITS), (fp >> np.uint64(1)) & np.uint64(LOW_BITS)
    return low | other | ((low & other) << np.uint64(1))


def grid_masks(groups: int, radius: int) -> list[int]:
    """One mask (signed) for each choice of ``groups - radius`` of the groups of segments."""
    edges = [32 * i // groups for i in range(groups + 1)]
    of = [sum(3 << (2 * s) for s in range(a, b)) for a, b in itertools.pairwise(edges)]
    masks = [sum(of[i] for i in chosen) for chosen in itertools.combinations(range(groups), groups - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(group: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, root's row) that span what is within ``radius`` inside each run of equal ``group``; ``fps`` has a column a view."""
    n = len(fps)
    if not n:
        return (np.empty(0, np.int64),) * 2
    counts = _unary(fps)
    apart = lambda x, i, j: np.bitwise_count(x[i] ^ x[j]).sum(axis=1, dtype=np.int64)
    last = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, n)
    end = np.repeat(last, np.diff(np.concatenate([[0], last])))
    root, i, d = np.arange(n), np.arange(n), 0
    while True:
        d += 1
        i = i[i + d < end[i]]
        if not len(i):
            break
        a = i[apart(counts, i, i + d) <= radius]
        a = a[apart(fps, a, a + d) <= radius]
        a = a[root[a] != root[a + d]]
        if len(a):
            for x, y in zip(a.tolist(), (a + d).tolist(), strict=True):
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                if x != y:
                    root[max(x, y)] = min(x, y)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def links(prints: DataFrame, radius: int = 4, groups: int | None = None, cell_chunk: int = CELL_CHUNK, grid_radius: int | None = None) -> DataFrame:
    """(a, b): links that connect distinct fingerprints (columns ``fp``, ``fp1``, ...) within ``radius`` bits over all of them,
    by ``node``, or by ``fp`` if there is no such column. Each view has grids of ``grid_radius``, by default ``radius``."""
    grid_radius = radius if grid_radius is None else grid_radius
    views = [c for c in prints.columns if c.startswith("fp")]
    if groups is None:
        groups = grid_radius + 2
        if len(views) == 1:  # more groups: more grids of finer cells. Over several views finer cells would find fewer candidates, and so depend on the size
            n = prints.count()
            groups += (n > 2_000_000) + (n > 100_000_000)
    masks = grid_masks(groups, grid_radius)
    key = "node" if "node" in prints.columns else "fp"
    kept = list(dict.fromkeys([key, *views]))
    counts = prints.select(*kept, *[unary_counts(F.col(v)).alias(f"counts_{v}") for v in views])
    cell = F.posexplode(F.array(*[F.col(f"counts_{v}").bitwiseAND(F.lit(m)) for v in views for m in masks])).alias("grid", "cell")
    cells = counts.select(*kept, cell).withColumn("a", F.lit(0)).withColumn("b", F.lit(0))
    large = materialise(cells.groupBy("grid", "cell").count().filter(F.col("count") > cell_chunk), "simhash-large")
    if not large.isEmpty():
        large = large.select("grid", "cell", F.ceil(F.col("count") / cell_chunk).cast("int").alias("chunks"))
        dealt = cells.drop("a", "b").join(large, ["grid", "cell"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64(*views), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
        cells = dealt.select(*kept, "grid", "cell", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def run(batches):
        """Groups arrive whole and in order; the last one of a batch waits for the next batch."""
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                rows = pa.Table.from_batches([batch])
                rest = rows if rest is None else pa.concat_tables([rest, rows])
            if rest is None or not len(rest):
                continue
            parts = np.rec.fromarrays([rest[c].to_numpy() for c in ("grid", "cell", "a", "b")])
            new = np.concatenate([[True], parts[1:] != parts[:-1]])
            whole = len(rest) if batch is None else int(np.flatnonzero(new)[-1])
            fps = np.stack([rest[c].to_numpy()[:whole].view(np.uint64) for c in views], axis=1)
            x, y = forest(np.cumsum(new)[:whole], fps, radius)
            node = rest[key].to_numpy()
            rest = rest.slice(whole)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], names=["a", "b"])

    dealt = cells.repartition("grid", "cell", "a", "b").sortWithinPartitions("grid", "cell", "a", "b")
    return dealt.mapInArrow(run, "a long, b long").distinct()


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable over ``edges`` (a, b), for every node that has an edge.

    Large-star and small-star in turn until nothing moves. A star's centre is found by an aggregate, its neighbours are
    never collected; each round's tables are written to the shared folder, so that a join meets plain shuffles, which
    Spark can split at a node of very many links.
    """

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    edges = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    seen, now = None, state(edges)
    while now != seen:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = materialise(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("u", "m")), "components-least")
        # to every larger neighbour of u: the least node around u
        large = materialise(edges.join(least, edges["b"] == least["u"]).select(F.col("a"), F.col("m").alias("b")).distinct(), "components-large")
        below = materialise(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "components-below")
        # to every smaller neighbour of u, and to u: the least of them
        joined = large.join(below, large["a"] == below["u"])
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(below.select("u", "m")).distinct()
        edges = materialise(small, "components")
        seen, now = now, state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = 4,
    shingle: int = 4,
    seed: int = 42,
    groups: int | None = None,
    cell_chunk: int = CELL_CHUNK,
    views: int = 1,
    grid_radius: int | None = None,
) -> DataFrame:
    """(id_col, fingerprint, component_id): one row a document.

    ``fingerprint`` is 16 hexadecimal digits a view. Documents whose fingerprints differ in at most ``radius``
    bits are linked (see :func:`links`); ``component_id`` is the smallest id reachable over links, the document's own included. Equal
    fingerprints are one node, so copies cost nothing. Texts of fewer words than a shingle hash whole;
    null, empty and blank texts have fingerprint zero and link like any other. Whole texts of any length count. Null ids are kept and
    never are the smallest unless a component has no other (then null). Repeated rows stay, other
    columns are ignored, an empty table gives no rows.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle, seed, views).withColumnRenamed(id_col, "_id"), "simhash")
    fps = [c for c in prints.columns if c != "_id"]
    nodes = prints.groupBy(*fps).agg(F.min("_id").alias("first"))
    nodes = nodes.withColumn("node", F.col("fp")) if views == 1 else numbered(nodes, "node")
    star = materialise(components(links(nodes.select("node", *fps) if views > 1 else nodes.select("fp"), radius, groups, cell_chunk, grid_radius)), "simhash-stars")
    firsts = nodes.select(F.col("node").alias("_node"), "first")
    # one row a component, written, so that the join with the nodes of a very large one can be split or needs no shuffle
    least = materialise(star.join(firsts, star["node"] == firsts["_node"]).groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    moved = star.join(least, "root").select(F.col("node").alias("_moved"), "component_id")
    named = nodes.join(moved, nodes["node"] == moved["_moved"], "left").select(*[F.col(c).alias(f"_{c}") for c in fps], F.coalesce("component_id", "first").alias("component_id"))
    # written first, the last join is between plain shuffles, which Spark can split at a fingerprint of many copies
    named = materialise(named, "simhash-classes")
    same = [prints[c] == named[f"_{c}"] for c in fps]
    digits = F.concat(*[F.lower(F.lpad(F.hex(c), 16, "0")) for c in fps])
    return prints.join(named, same).select(F.col("_id").alias(id_col), digits.alias("fingerprint"), "component_id")


#: Views, and the share of all their bits in which near copies may differ: texts that share four fifths of
#: their shingles have a cosine of 0.89 and so differ in 0.15 of the bits, with a spread of 0.02 over 320 bits.
VIEWS, APART = 5, 0.165


def keep_first(docs: DataFrame, shingle: int = 5, views: int = VIEWS, apart: float = APART, grid_radius: int = 4) -> DataFrame:
    """``docs`` without near-duplicates: of each component one row stays, one with the smallest doc_id, or
    with none if no row has any. Other rows of that doc_id are judged by their own text. Columns are those of ``docs``."""
    rows = numbered(docs, "_row")
    key = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.col("_row").alias("row"))
    found = near_duplicates(rows.select(key.alias("_key"), "text"), "_key", radius=int(apart * 64 * views), shingle=shingle, views=views, grid_radius=grid_radius)
    kept = found.filter(F.col("_key.row") == F.col("component_id.row")).select(F.col("_key.row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*docs.columns)

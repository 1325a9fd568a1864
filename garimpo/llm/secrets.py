"""Secret scans with corpus-wide ownership frequency.

Every candidate is hashed; hashes are counted over distinct repositories and owners. A value that
many owners hold is a widely copied example; one that few hold looks like a live credential of theirs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import materialise, numbered

#: Base kinds in their order. Group 2 of an assignment is its value; the fixed lengths are least lengths of a value.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
LEAST_ASSIGNED = 8
#: A run that is too short fails whole, so these find what "match, then drop by length" finds.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Kinds that the ownership count adds, when few owners hold the value: private keys, signed
#: web tokens, vendors' prefixes and passwords in addresses.
ADDED = {
    "pem": re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}-----END [A-Z ]{0,20}PRIVATE KEY-----"),
    "jwt": re.compile(r"[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)*+"),  # whole runs; see signed_tokens
    "vendor": re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})"),
    "address": re.compile(r"://[^\s:/@]{1,64}:([^\s:/@]{6,128})@"),
}
BASE = ("assign", "access", "hex")
KINDS = (*BASE, *ADDED)
#: From so many owners on, a value is a widely copied example.
EXAMPLE_OWNERS = 3


def signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of ``eyJ`` and 8 characters or more, then two more parts of 8 or more, each after a dot. Time is linear in the text."""
    for run in ADDED["jwt"].finditer(text):
        parts, at = run[0].split("."), run.start()
        starts = [at, *(at := at + len(p) + 1 for p in parts)]
        k = 0
        while k + 2 < len(parts):
            head = parts[k].find("eyJ") if len(parts[k + 1]) >= 8 and len(parts[k + 2]) >= 8 else -1
            if head >= 0 and len(parts[k]) - head >= 11:
                yield starts[k] + head, starts[k + 2] + len(parts[k + 2])
                k += 2
            k += 1


def candidates(text: str | None) -> list[tuple[int, int, int, str]]:
    """(kind number, start, end, value) in code points; leftmost, non-overlapping within a kind."""
    if not text:
        return []
    found = [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    if "eyJ" in text:
        found += [(4, a, b, text[a:b]) for a, b in signed_tokens(text)]
    for k, needle in ((3, "PRIVATE KEY"), (5, "_"), (5, "xox"), (5, "AIza"), (6, "://")):
        if needle in text and not (k == 5 and any(x[0] == 5 for x in found)):
            found += [(k, m.start(), m.end(), m[0]) for m in ADDED[KINDS[k]].finditer(text)]
    return sorted(found, key=lambda x: (x[1], x[0]))


def digest(value: str) -> int:
    """The value's hash: 8 bytes of SHA-256, signed."""
    return int.from_bytes(hashlib.sha256(value.encode("utf-8", "surrogatepass")).digest()[:8], "big", signed=True)


_SPANS = "array<struct<kind:int,start:long,end:long,hash:long>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Secrets of every whole text.

    Returns (id_col, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, live_spans). Base spans
    always stay; a span of an added kind joins ``spans`` if fewer than ``example_owners`` distinct owners hold its value.
    ``n_live`` and ``n_example`` count a document's spans whose value few or many owners hold.
    Repositories are the values of ``repository_col``, by default each document its own.

    Null and empty texts have no span (empty strings, counts 0). Whole texts of any length are scanned, in time linear in
    their length. Null owners are one owner. Repeated
    rows are documents of their own. An empty table gives no rows; other columns are ignored.
    """
    repository = F.col(repository_col).cast("string") if repository_col else F.lit(None).cast("string")
    kind = docs.schema[id_col].dataType.simpleString()
    fields = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.int64())]))

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b, "hash": digest(v)} for k, a, b, v in candidates(t)] for t in batch.column(3).to_pylist()]
            rows = pa.array(range(row, row + len(found)), pa.int64())
            row += len(found)
            yield pa.RecordBatch.from_arrays([rows, *batch.columns[:3], pa.array(found, fields)], names=["row", "id", "owner", "repository", "spans"])

    held = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("\x00")).alias("owner"), repository.alias("repository"), F.col(text_col))
    # row numbers hold because they are written once and read from there
    found = materialise(held.mapInArrow(run, f"row long, id {kind}, owner string, repository string, spans {_SPANS}"), "secrets")

    # hashes by owner, then by owner and repository: counts, never lists
    each = found.filter(F.size("spans") > 0).select("row", "owner", "repository", F.explode(F.array_distinct(F.col("spans.hash"))).alias("hash"))
    if repository_col:
        per_owner = each.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("n")).groupBy("hash", "owner").agg(F.sum("n").alias("repositories"))
    else:
        per_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    held_by = per_owner.groupBy(F.col("hash").alias("_hash")).agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    # written first, the join is between plain shuffles, which Spark can split at the most copied value
    held_by = materialise(held_by, "secrets-held")

    judged = each.select("row", "hash").join(held_by, F.col("hash") == F.col("_hash")).withColumn("example", F.col("owners") >= example_owners)
    per_row = judged.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.when(F.col("example"), F.col("hash"))).alias("examples"), F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories"))
    rows = found.join(per_row, found["row"] == per_row["_row"], "left")

    examples = F.coalesce("examples", F.array().cast("array<bigint>"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    kept = F.filter("spans", lambda s: (s["kind"] < len(BASE)) | ~F.array_contains(examples, s["hash"]))
    live = F.filter("spans", lambda s: ~F.array_contains(examples, s["hash"]))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        F.col("id").alias(id_col),
        *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(named(base).cast("binary"), 256).alias("base_sha256"),
        named(kept).alias("spans"),
        F.size(live).cast("long").alias("n_live"),
        (F.size("spans") - F.size(live)).cast("long").alias("n_example"),
        named(live).alias("live_spans"),
        F.coalesce("most_owners", F.lit(0)).alias("most_owners"),
        F.coalesce("most_repositories", F.lit(0)).alias("most_repositories"),
    )


def mask(text: str | None, spans: str) -> str | None:
    """``text`` with each span, overlapping ones together, replaced by the first one's kind."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(","))), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret replaced by a mark of its kind; all documents stay. Columns are those
    of ``docs``. Rows without a span aren't touched; spans are joined by row, so ids may repeat or be null."""
    rows = numbered(docs, "_secret_row")
    spans = scan(rows, "_secret_row").filter("spans <> ''").select("_secret_row", F.col("spans").alias("_secret_spans"))
    n_chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    text_at, width = docs.columns.index("text"), len(docs.columns)

    def run(batches):
        for batch in batches:
            texts, sizes = [], []
            held_by, old = batch.column(width).to_pylist(), batch.column(text_at).to_pylist()
            counts = batch.column(n_chars).to_pylist() if n_chars is not None else [None] * len(old)
            for text, spans, n in zip(old, held_by, counts, strict=True):
                if spans and text:
                    text = mask(text, spans)
                    n = len(text)
                texts.append(text)
                sizes.append(n)
            columns = list(batch.columns[:width])
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if n_chars is not None:
                columns[n_chars] = pa.array(sizes, columns[n_chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width])

    return rows.join(spans, "_secret_row", "left").select(*docs.columns, "_secret_spans").mapInArrow(run, docs.schema)

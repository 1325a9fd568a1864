"""WARC records inside ZIP packages: writer, and a reader that works by byte ranges alone.

A package is a ZIP file whose members are *stored*: ``archive/data.warc.gz`` (one gzip member a
record) and ``indexes/index.cdxj`` (one JSON line a record with its place in the archive). Because members are
stored, a record's bytes are a range of the package. The reader fetches the end of the package,
follows the (ZIP64) end record to the central directory, locates both members, reads the index and
then only the ranges of the records asked for. Nothing is extracted.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import materialise, new_path

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A package is closed once its archive holds this much; records are written whole.
PACKAGE_BYTES = 512 << 20
#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT = 100
INDEX_LINES_AT_ONCE = 4_096
#: Bytes of a package that are dealt to readers as one stretch, and those that one reader task gets.
STRETCH_BYTES, TASK_BYTES = 16 << 20, 64 << 20


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system for a path or a URI (file:, hdfs:, s3:, gs:, ...)."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:"):
            return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


# ---------------------------------------------------------------- records


def record_bytes(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit that names the record it repeats."""
    clean = lambda s: "".join(c for c in s if c not in "\r\n")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {clean(url)}"] if url else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {size}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if payload is None else []),
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload or b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse_record(member: bytes) -> dict:
    """Headers (lower-case names) and payload of one gzip member; None as payload of a revisit."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2] if headers["warc-type"] == "response" else None
    return {"headers": headers, "payload": payload}


# ---------------------------------------------------------------- packages


class PackageWriter:
    """Streams records to one package; the index is the only thing held."""

    def __init__(self, path: str, force_zip64: bool = False):
        where, name = open_fs(path)
        where.create_dir(name.rpartition("/")[0], recursive=True)
        self.sink = where.open_output_stream(name)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.at, self.lines = 0, io.BytesIO()

    def add(self, key: str, member: bytes) -> None:
        self.member.write(member)
        self.lines.write(json.dumps({"key": key, "offset": self.at, "length": len(member)}).encode() + b"\n")
        self.at += len(member)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), self.lines.getvalue())
        self.zip.close()
        self.sink.close()


class PackageReader:
    """Random access to a ZIP package through ``read(offset, length)`` of an open file."""

    def __init__(self, path: str):
        where, name = open_fs(path)
        self.file = where.open_input_file(name)
        self.size = self.file.size()
        self.members = self._directory()

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        got = self.file.read(n)
        if len(got) != n:
            raise ValueError(f"package ends at {self.size}, before {at + n}")
        return got

    def _directory(self) -> dict[str, dict]:
        """Name -> {offset, size, csize, method} from the central directory, ZIP64 fields included."""
        tail_at = max(0, self.size - 65_557)
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        n, length, at = struct.unpack_from("<HII", tail, end + 10)
        locator = end - 20
        if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
            (where,) = struct.unpack_from("<Q", tail, locator + 8)
            record = self.read(where, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where the locator points")
            n, length, at = struct.unpack_from("<QQQ", record, 32)
        directory, members, p = self.read(at, length), {}, 0
        for _ in range(n):
            if directory[p : p + 4] != b"PK\x01\x02":
                raise ValueError("damaged central directory")
            (method,) = struct.unpack_from("<H", directory, p + 10)
            csize, size = struct.unpack_from("<II", directory, p + 20)
            n_name, n_extra, n_comment = struct.unpack_from("<HHH", directory, p + 28)
            (offset,) = struct.unpack_from("<I", directory, p + 42)
            name = directory[p + 46 : p + 46 + n_name].decode()
            extra = directory[p + 46 + n_name : p + 46 + n_name + n_extra]
            size, csize, offset = self._zip64(extra, size, csize, offset)
            members[name] = {"offset": offset, "size": size, "csize": csize, "method": method}
            p += 46 + n_name + n_extra + n_comment
        return members

    @staticmethod
    def _zip64(extra: bytes, size: int, csize: int, offset: int) -> tuple[int, int, int]:
        """The 64-bit fields stand, in this order, for those that are all ones."""
        p = 0
        while p + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, p)
            if tag == 1:
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, p + 4))
                size, csize, offset = (next(values) if x == 0xFFFFFFFF else x for x in (size, csize, offset))
            p += 4 + n
        return size, csize, offset

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin: the local header has lengths of its own."""
        m = self.members[name]
        if m["method"] != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        local = self.read(m["offset"], 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        return m["offset"] + 30 + sum(struct.unpack_from("<HH", local, 26))

    def index(self) -> Iterator[dict]:
        at, left, rest = self.start(INDEX), self.members[INDEX]["size"], b""
        while left:
            got = self.read(at, min(left, 1 << 20))
            at, left = at + len(got), left - len(got)
            *lines, rest = (rest + got).split(b"\n")
            yield from map(json.loads, lines)

    def close(self) -> None:
        self.file.close()


# ---------------------------------------------------------------- Spark


def roles(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to): refers_to is null for responses.

    Only digests that occur more than once are joined back; short payloads carry a key of their own
    each, so that they never meet in one task. The digests are written first: the join is then a broadcast where they are
    few, so that no payload moves, else a plain shuffle that Spark can split at the commonest payload.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        (F.col(url_col) if url_col else F.lit(None)).cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_digest"),
    )
    long = F.col("payload_bytes") >= LEAST_REVISIT
    first = base.filter(long).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("payload_digest").alias("_d"), "first")
    first = materialise(first, "warc-first")
    keyed = base.withColumn("_k", F.when(long, F.col("payload_digest")).otherwise(F.concat_ws("~", F.lit("short"), F.col("page_id").cast("string"))))
    return (
        keyed.join(first, keyed["_k"] == first["_d"], "left")
        .withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first")))
        .select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")
    )


_WRITTEN = "path string, records long, bytes long"


def write_packages(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write the records of :func:`roles` as packages below ``folder``; return (path, records, bytes).

    Each attempt of a task writes names of its own, and the list is itself written to the shared folder: what a lost
    or repeated attempt left is never read.
    """

    def run(batches):
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}" if context else "0-0"
        writer, n, made = None, 0, 0
        done = []

        def close():
            writer.close()
            done.append((path, n, writer.at))

        for batch in batches:
            for r in batch.to_pylist():
                if writer is None:
                    path = f"{folder}/{name}-{made:04d}.wacz"
                    writer, n, made = PackageWriter(path), 0, made + 1
                payload = None if r["refers_to"] is not None else r["payload"]
                key = "" if r["page_id"] is None else str(r["page_id"])
                writer.add(key, record_bytes(r["page_id"], r["url"], r["payload_digest"], r["payload_bytes"], payload, r["refers_to"]))
                n += 1
                if writer.at >= package_bytes:
                    close()
                    writer = None
        if writer is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "records", "bytes"])

    return materialise(records.mapInArrow(run, _WRITTEN), "warc-list")


def read_index(packages: DataFrame) -> DataFrame:
    """(path, start, length): the byte range of every record in every package."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                package = PackageReader(path)
                at, found = package.start(ARCHIVE), []
                for line in package.index():
                    found.append((path, at + line["offset"], line["length"]))
                    if len(found) >= INDEX_LINES_AT_ONCE:
                        yield _ranges(found)
                        found = []
                package.close()
                if found:
                    yield _ranges(found)

    # a number keeps Spark from merging these small rows into one task
    return packages.select("path").repartition(max(1, packages.count()), "path").mapInArrow(run, "path string, start long, length long")


def dealt(packages: DataFrame) -> DataFrame:
    """The ranges of :func:`read_index`, dealt to readers by stretches of a package; a task has them in their order."""
    size = packages.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum(F.ceil(F.col("bytes") / STRETCH_BYTES)), F.lit(0))).first()
    tasks = max(1, -(-size[0] // TASK_BYTES), min(size[1], packages.sparkSession.sparkContext.defaultParallelism))
    stretch = F.floor(F.col("start") / STRETCH_BYTES)
    return read_index(packages).repartition(int(tasks), F.col("path"), stretch).sortWithinPartitions("path", "start")


def _ranges(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["path", "start", "length"])


_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_records(ranges: DataFrame, with_payload: bool = False) -> DataFrame:
    """Fetch each record by its range and parse it. A response's digest and length are computed from the payload
    read and held against its headers; a revisit states those of the payload it repeats."""

    def run(batches):
        package, open_path = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["path"] != open_path:
                    if package:
                        package.close()
                    package, open_path = PackageReader(r["path"]), r["path"]
                record = parse_record(package.read(r["start"], r["length"]))
                h, payload = record["headers"], record["payload"]
                number = lambda k: int(h[k][len("<urn:page:") : -1]) if h.get(k, "<urn:page:>") != "<urn:page:>" else None  # noqa: B023, E731
                digest, size = h["warc-payload-digest"].removeprefix("sha256:"), int(h["warc-payload-length"])
                if payload is not None and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
                    raise ValueError(f"{open_path}: damaged record at {r['start']}")
                out.append((number("warc-record-id"), h.get("warc-target-uri"), h["warc-type"], number("warc-refers-to"), size, digest, payload if with_payload else None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()], strict=True)],
                names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"],
            ) if out else pa.RecordBatch.from_pylist([], schema=_EMPTY)
        if package:
            package.close()

    return ranges.mapInArrow(run, _RECORD)


_EMPTY = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def archive_pages(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", package_bytes: int = PACKAGE_BYTES, with_payload: bool = False) -> DataFrame:
    """Write every page as a WARC record in ZIP packages in the shared folder and read all back.

    Null payloads are empty ones. Of records with equal payloads of at least 100 bytes the one with the
    smallest page_id is a response and the others are revisits that refer to it; shorter payloads are
    all responses. Rows that share the smallest page_id (repeated rows) and rows without a page_id are responses. A record
    is held whole in memory once, as long as its page. An empty table gives no rows. Other columns, whatever their names, are not archived.
    """
    packages = write_packages(roles(pages, id_col, payload_col, url_col), new_path(pages.sparkSession, "warc"), package_bytes)
    return read_records(dealt(packages), with_payload)

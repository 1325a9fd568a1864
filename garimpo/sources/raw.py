"""Bulk files: latin-1 lines of ``;``-separated fields, plain or inside ZIP archives."""

from __future__ import annotations

import contextlib
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import let

#: Lines of a batch that leaves a ZIP archive.
LINES_AT_ONCE = 20_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of plain files, decoded from latin-1; empty lines are left out."""
    return spark.read.option("encoding", "ISO-8859-1").option("sep", "\x01").option("quote", "").schema("value string").csv(path).filter("value is not null")


def read_zip_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of every member of the ZIP archives below ``path``, streamed: one member is one task,
    which opens its archive where it lies and holds a batch of lines, however long the archive is.

    Members are read by their directories, so archives must lie where workers can open them (a shared folder, or any store that Arrow knows by its URI).
    """

    def members(batches):
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                with _archive(name) as z:
                    out += [(name, m) for m in z.namelist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], names=["path", "member"])

    def run(batches):
        for batch in batches:
            for name, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _archive(name) as z, z.open(part) as member:
                    held: list[str] = []
                    for raw in member:
                        line = raw.rstrip(b"\n").rstrip(b"\r").decode("latin-1")
                        if line:
                            held.append(line)
                        if len(held) >= LINES_AT_ONCE:
                            yield pa.RecordBatch.from_arrays([pa.array(held)], names=["value"])
                            held = []
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

    # the listing reads names alone: the content is never asked for
    listed = spark.read.format("binaryFile").load(path).select("path").mapInArrow(members, "path string, member string")
    return listed.repartition(max(1, listed.count())).mapInArrow(run, "value string")


@contextlib.contextmanager
def _archive(path: str) -> Iterator[zipfile.ZipFile]:
    """A ZIP archive opened at its place, read by seeking."""
    where, name = (pafs.LocalFileSystem(), "/" + unquote(path[5:]).lstrip("/")) if path.startswith("file:") else pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    with where.open_input_file(name) as f, zipfile.ZipFile(f) as z:
        yield z


def _tolerant(c: Column) -> Column:
    """Fields of any line: quotes toggle, a doubled quote inside them is one, semicolons with an even number of quotes before them separate."""
    escaped = F.replace(c, F.lit('""'), F.lit("\x00"))
    parts = F.split(escaped, '"')
    # between quotes, odd pieces: a semicolon there is text
    safe = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.replace(p, F.lit(";"), F.lit("\x01"))).otherwise(F.replace(p, F.lit("\x00"), F.lit(""))))
    back = lambda f: F.replace(F.replace(f, F.lit("\x01"), F.lit(";")), F.lit("\x00"), F.lit('"'))
    return F.transform(F.split(F.array_join(safe, ""), ";"), back)


def fields(line: Column | str) -> Column:
    """A line's fields, tolerantly: quotes toggle, a doubled quote inside them is one, nothing is ever rejected.

    Lines of which every field is quoted and holds no quote, nearly all of them, are just cut at ``";"``: they have two quotes a piece.
    """
    c = F.col(line) if isinstance(line, str) else line
    quotes = F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))
    plain = lambda parts: c.startswith('"') & c.endswith('"') & (F.length(c) >= 2) & (quotes == 2 * F.size(parts))
    return let(F.split(F.substring(c, F.lit(2), F.length(c) - 2), '";"'), lambda parts: F.when(plain(parts), parts).otherwise(_tolerant(c)))


def columns(lines: DataFrame, places: dict[str, int]) -> DataFrame:
    """The named fields of each line; a field that a short line lacks is empty text.

    A line's fields are generated as one row, so that a filter on them isn't pushed below, where each of its tests would parse anew.
    """
    split = lines.select(F.explode(F.array(fields("value"))).alias("_f"))
    return split.select(*[F.coalesce(F.get("_f", i), F.lit("")).alias(n) for n, i in places.items()])

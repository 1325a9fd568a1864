"""The continuous pull loop: each project takes its matches one after the other until something stops it.

A match without evidence costs nothing; any other costs one model call. The loop of a project stops when its
calls are spent, when the model says that the day's limit is reached, after too many waits for a passing limit, after hard failures in a row, or when no more
rows come. State is kept by project: counters, the matches taken, and when the silence means that there are no more rows. Projects meet by the bucket, so that a call serves many of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.pages import rate_limit_kind

MOST_WAITS, MOST_FAILURES = 8, 3
BUDGET, DAILY, WAITS, FAILURES, EXHAUSTED = "budget", "daily limit", "waits", "failures", "no more rows"
TAKEN = "project_id string, position long, cnpj string, outcome string, spent long, scored long, no_site long, done long, stopped string"
_RUN = "spent long, scored long, no_site long, done long, waits int, failures int, stopped string, parts int, held long, due long"
BUCKETS, PART = 4096, 256  # projects are met by buckets; what a project has taken lies in parts of about so many
STATE_STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def outcome(evidence: Column, error: Column) -> Column:
    """What became of a match: no_site without a call, scored, or the kind of failure (daily, transient, error)."""
    kind = rate_limit_kind(error)
    return F.when(~F.coalesce(evidence, F.lit(False)), "no_site").when(error.isNull(), "scored").when(kind != "none", kind).otherwise("error")


def _part(cnpj: str | None, parts: int) -> int:
    return zlib.crc32((cnpj or "").encode()) % parts


class PullLoop(StatefulProcessor):
    """The loops of a bucket of projects. State is read and written once a project and batch, not once a match: its counters, and the parts of what it has taken that its matches fall into."""

    def __init__(self, budget: int, idle_ms: int | None, keep_ms: int | None):
        self.budget, self.idle_ms, self.keep_ms = budget, idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getMapState("run", "project_id string", _RUN, self.keep_ms)
        self.taken = handle.getMapState("taken", "project_id string, part int", "cnpjs array<string>", self.keep_ms)
        self.due = handle.getMapState("due", "at long", "projects array<string>", self.keep_ms)

    def _row(self, project, position, cnpj, what, n) -> tuple:
        return (project, position, cnpj, what, n["spent"], n["scored"], n["no_site"], n["done"], n["stopped"])

    def _counters(self, project) -> dict:
        names = [x.split()[0] for x in _RUN.split(", ")]
        return dict(zip(names, self.run.getValue((project,)) or (0, 0, 0, 0, 0, 0, None, 1, 0, None), strict=True))

    def _held(self, project, part: int) -> set:
        found = self.taken.getValue((project, part))
        return set(found[0]) if found else set()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs, come, out, waiting = {}, {}, [], []
        for f in rows:
            for project, position, cnpj, what in zip(*(f[c].tolist() for c in ("project_id", "position", "cnpj", "outcome")), strict=True):
                if project not in runs:
                    runs[project], come[project] = self._counters(project), []
                if runs[project]["stopped"] is None:  # a stopped loop takes nothing
                    come[project].append((None if position is None else int(position), cnpj, what))
        at = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms if self.idle_ms else None
        for project, matches in come.items():
            if matches:
                n = runs[project]
                out += self._pull(project, n, sorted(matches, key=lambda m: (m[0] is None, m[0] or 0)))
                if n["stopped"] is None:
                    waiting.append(project)
                    n["due"] = at
                self.run.updateValue((project,), tuple(n.values()))
        if at is not None and waiting:  # one timer a bucket and batch; a project's last one counts
            there = self.due.getValue((at,))
            self.due.updateValue((at,), (list(there[0] if there else []) + waiting,))
            self.handle.registerTimer(at)
        if out:
            yield _frame(out)

    def _pull(self, project, n: dict, matches: list[tuple]) -> list[tuple]:
        """What the loop takes of a batch's matches, in their order."""
        held, more, out, before = {}, set(), [], n["held"]
        for position, cnpj, what in matches:
            if n["spent"] >= self.budget:
                n["stopped"] = BUDGET
                out.append(self._row(project, None, None, None, n))
                break
            part = _part(cnpj, n["parts"])
            if part not in held:
                held[part] = self._held(project, part) if before else set()
            if cnpj in held[part]:
                continue
            if what != "transient":  # its turn comes again
                held[part].add(cnpj)
                more.add(part)
                n["held"] += 1
            if what == "no_site":
                n["no_site"] += 1
            else:
                n["spent"] += 1
            if what == "scored":
                n["scored"] += 1
                n["waits"] = n["failures"] = 0
            elif what == "daily":
                n["stopped"] = DAILY
            elif what == "transient":
                n["waits"] += 1
                n["stopped"] = WAITS if n["waits"] > MOST_WAITS else None
            elif what == "error":
                n["failures"] += 1
                n["stopped"] = FAILURES if n["failures"] >= MOST_FAILURES else None
            n["done"] += n["stopped"] is None
            out.append(self._row(project, position, cnpj, what, n))
            if n["stopped"] is not None:
                break
        if n["stopped"] is not None:
            self._forget(project, n)
        else:
            self._keep(project, n, held, more)
        return out

    def _keep(self, project, n: dict, held: dict[int, set], more: set[int]) -> None:
        """Write the parts that grew; parts are split as what is taken grows, so that a match reads no more of it than one of about PART matches."""
        before = n["parts"]
        while n["held"] > PART * n["parts"]:
            n["parts"] *= 2
        for part in more if before == n["parts"] else range(before):
            split: dict[int, list] = {i: [] for i in range(part, n["parts"], before)}
            for cnpj in held[part] if part in held else self._held(project, part):
                split[_part(cnpj, n["parts"])].append(cnpj)
            for i, cnpjs in split.items():
                self.taken.updateValue((project, i), (cnpjs,))

    def _forget(self, project, n: dict) -> None:
        """What a stopped loop has taken."""
        for part in range(n["parts"]):
            self.taken.removeKey((project, part))
        n["parts"], n["held"] = 1, 0

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, out = expiredTimerInfo.getExpiryTimeInMs(), []
        there = self.due.getValue((at,))
        for project in there[0] if there else []:
            n = self._counters(project)
            if n["stopped"] is None and n["due"] == at:
                n["stopped"] = EXHAUSTED
                self._forget(project, n)
                self.run.updateValue((project,), tuple(n.values()))
                out.append(self._row(project, None, None, None, n))
        self.due.removeKey((at,))
        if out:
            yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in TAKEN.split(", ")]
    columns = dict(zip(names, zip(*rows, strict=True), strict=True))
    kinds = {c: "Int64" if c == "position" else object for c in ("project_id", "position", "cnpj", "outcome", "stopped")}
    return pd.DataFrame({c: pd.array(v, dtype=kinds[c]) if c in kinds else v for c, v in columns.items()})


def pull(matches: DataFrame, budget: int, idle_ms: int | None = None, keep_ms: int | None = None) -> DataFrame:
    """What each project's loop takes of a stream of matches (project_id, position, cnpj, evidence, error), in order of position within a batch.

    Returns TAKEN: a row for each match taken, with the counters after it; the last one says why the loop ``stopped``. A stop without a match (the budget was spent, nothing
    comes for ``idle_ms``) is a row of its own. A match that was taken isn't taken again, unless a passing limit refused it. State that nothing touches for ``keep_ms`` expires, and the project may start anew; what it has taken expires by parts, each from when it last grew.

    Clocks keep a query awake: with one of them set it goes on until it is stopped, so a run over what is there (``once``) has neither, and :func:`stops` tells what had no more rows.
    """
    mode = "None" if idle_ms is None and keep_ms is None else "ProcessingTime"
    rows = matches.select(F.col("project_id").cast("string").alias("project_id"), F.col("position").cast("long").cast("string").alias("position"), F.col("cnpj").cast("string").alias("cnpj"), outcome(F.col("evidence"), F.col("error")).alias("outcome"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("project_id"), F.lit(BUCKETS)).cast("int"))  # a call costs milliseconds, whatever it holds
    return rows.groupBy("bucket").transformWithStateInPandas(PullLoop(budget, idle_ms, keep_ms), TAKEN, "Append", mode)


def start(spark: SparkSession, taken: DataFrame, out_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the loop's rows below ``out_path``; the file sink's log keeps a batch that is tried again from counting twice. The state lives in RocksDB, so it may outgrow memory."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)  # a query keeps the settings that it starts with
    try:
        trigger = {"availableNow": True} if once else {"processingTime": "1 second"}
        return taken.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(**trigger).start(out_path)
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def stops(taken: DataFrame) -> DataFrame:
    """(project_id, spent, scored, no_site, done, stopped): how each project's loop stands at the end of all input; one that nothing stopped has no more rows."""
    last = Window.partitionBy("project_id").orderBy(F.col("stopped").isNotNull().desc(), F.col("position").desc_nulls_last())
    ended = taken.withColumn("_n", F.row_number().over(last)).filter("_n = 1")
    return ended.select("project_id", "spent", "scored", "no_site", "done", F.coalesce("stopped", F.lit(EXHAUSTED)).alias("stopped"))

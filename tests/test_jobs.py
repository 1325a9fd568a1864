"""Streams that stop, progress rows, statistics of the writing pass, tables laid out by key."""

import time

import pytest
from pyspark.sql import functions as F

from garimpo.plans import etl
from garimpo.sources import synthetic
from garimpo.streaming import continuous, loop, progress

MATCH = "project_id string, position long, cnpj string, evidence boolean, error string"


def pulled(spark, tmp_path, batches, **how):
    """What the loop takes of ``batches``, each a file of its own."""
    schema = spark.createDataFrame([], MATCH).schema
    for rows in batches:
        spark.createDataFrame(rows, MATCH).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = continuous.stream_parquet(spark, str(tmp_path / "in"), schema, 1)
    loop.start(spark, loop.pull(stream, **how), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_the_loop_stops(spark, tmp_path):
    good = lambda p, n, at=0: [(p, i + at, f"{p}{i + at}", True, None) for i in range(n)]
    fail = lambda p, text, n, at=0: [(p, i + at, f"{p}{i + at}", True, text) for i in range(n)]
    batches = [
        good("budget", 3) + fail("hard", "bad key", 2) + fail("reset", "bad key", 2) + fail("day", "daily limit", 1, 5) + fail("waits", "HTTP 429", 5) + good("few", 2),
        good("budget", 3, 3) + fail("hard", "bad key", 2, 2) + good("reset", 1, 2) + good("day", 3, 6) + fail("waits", "HTTP 429", 6, 5) + [("none", i, f"n{i}", False, None) for i in range(9)],
        fail("reset", "bad key", 2, 3) + good("hard", 5, 9) + [("few", 0, "few0", True, None), ("few", 3, "few3", None, None)],
    ]
    taken = pulled(spark, tmp_path, batches, budget=5)
    found = {r["project_id"]: tuple(r)[1:] for r in loop.stops(taken).collect()}
    assert found == {
        "budget": (5, 5, 0, 5, "budget"), "hard": (3, 0, 0, 2, "failures"), "reset": (5, 1, 0, 5, "no more rows"), "day": (1, 0, 0, 0, "daily limit"),
        "waits": (5, 0, 0, 5, "budget"), "none": (0, 0, 9, 9, "no more rows"), "few": (2, 2, 1, 3, "no more rows"),
    }
    assert taken.filter("project_id = 'hard' and position >= 3").count() == 0 and taken.filter("cnpj = 'few0'").count() == 1


def test_waits_give_the_match_another_turn(spark, tmp_path):
    refused = [("p", 0, "a", True, "429")]
    taken = pulled(spark, tmp_path, [refused, refused, [("p", 1, "a", True, None)], [("p", 2, "a", True, None)], [("p", 3 + i, f"b{i}", True, "503") for i in range(12)]], budget=99)
    assert [tuple(r) for r in taken.orderBy("position", "spent").select("position", "outcome").limit(3).collect()] == [(0, "transient"), (0, "transient"), (1, "scored")]
    assert loop.stops(taken).select("spent", "stopped").first() == (12, "waits")


def test_silence_and_time_end_a_loop(spark, tmp_path):
    """Timers say that there are no more rows; state expires, after which a match may be taken again."""
    schema = spark.createDataFrame([], MATCH).schema
    rows = spark.createDataFrame([("p", 0, "a", True, None)], MATCH).coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    stream = continuous.stream_parquet(spark, str(tmp_path / "in"), schema, 1)
    query = loop.start(spark, loop.pull(stream, budget=9, idle_ms=1000, keep_ms=6000), str(tmp_path / "out"), str(tmp_path / "check"), once=False)
    try:
        seen = lambda: spark.read.schema(loop.TAKEN).parquet(str(tmp_path / "out")) if (tmp_path / "out" / "_spark_metadata").exists() else spark.createDataFrame([], loop.TAKEN)
        until = time.time() + 90
        while time.time() < until and not seen().filter("stopped = 'no more rows'").count():
            time.sleep(1)
        assert seen().filter("stopped = 'no more rows'").count() == 1
        time.sleep(7)
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        while time.time() < until and seen().filter("cnpj = 'a'").count() < 2:
            time.sleep(1)
        assert [tuple(r) for r in seen().filter("cnpj = 'a'").select("spent", "outcome").collect()] == [(1, "scored")] * 2
    finally:
        query.stop()


def test_progress_rows(spark, tmp_path):
    for i in range(3):
        spark.range(i * 100, i * 100 + 100).selectExpr("id", "id % 4 as k").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = continuous.stream_parquet(spark, str(tmp_path / "in"), "id long, k long", 1)
    reason = F.when(F.col("k") == 1, "one").when(F.col("k") == 2, "two").when(F.col("id") == 203, "odd")
    progress.finish(*progress.run_counted(progress.counted(stream, reason, ["one", "two", "never"]), str(tmp_path / "out"), str(tmp_path / "progress"), str(tmp_path / "check")))
    told = progress.read_progress(spark, str(tmp_path / "progress"))
    assert [tuple(r) for r in told.orderBy("batch").collect()] == [
        (0, 100, 50, {"one": 25, "two": 25, "never": 0}), (1, 100, 50, {"one": 25, "two": 25, "never": 0}), (2, 100, 49, {"one": 25, "two": 25, "never": 0, "other": 1}),
    ]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 149
    assert tuple(progress.summary(told).first()) == (3, 300, 149, 151)


def test_the_writing_pass_counts(spark, tmp_path):
    lines = synthetic.raw_establishments(spark, 5000)
    lines.write.text(str(tmp_path / "lines"))
    read = spark.read.text(str(tmp_path / "lines"))
    companies, tax = etl.companies(synthetic.raw_companies(spark)), etl.tax_regimes(synthetic.raw_tax(spark))
    found = etl.convert(read, companies, tax, str(tmp_path / "est"))
    assert found == {k: int(v) for k, v in etl.stats(lines, etl.clean_establishments(lines)).first().asDict().items()}
    assert found["read"] == 5000 and spark.read.parquet(str(tmp_path / "est")).count() == found["kept"]
    empty = etl.convert(read.limit(0), companies, tax, str(tmp_path / "none"))
    assert set(empty.values()) == {0}


@pytest.mark.parametrize("files", [1, 2])
def test_stream_lines(spark, tmp_path, files):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes("1;São;\"x\"\n\n2;é\n".encode("latin-1"))
    (tmp_path / "in" / "b").write_bytes(b"3;\x01\n")
    continuous.stream_lines(spark, str(tmp_path / "in"), files).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect())[:2] == ['1;São;"x"', "2;é"]


def files_of(path):
    return {f.relative_to(path): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_an_upsert_writes_only_what_it_touches(spark, tmp_path):
    from garimpo.operators import keyed, store

    path = tmp_path / "t"
    rows = spark.range(5000).selectExpr("id", "cast(id as string) as v")
    keyed.write(rows, str(path), ["id"], 32)
    before = files_of(path)
    changed = spark.createDataFrame([(7, "new"), (7, "newest"), (6000, "added"), (4000, "new")], "id long, v string")
    n = keyed.upsert(spark, str(path), changed, ["id"], [F.col("v").desc()])
    after = files_of(path)
    assert 1 <= n <= 3 and len({f.parent for f in before.keys() ^ after.keys()}) == n
    assert all(before[f] == after[f] for f in before.keys() & after.keys()) and len(before.keys() & after.keys()) >= 29
    want = store.upsert(rows, changed, ["id"], [F.col("v").desc()])
    assert sorted(map(tuple, keyed.read(spark, str(path)).collect())) == sorted(map(tuple, want.collect()))
    assert keyed.upsert(spark, str(path), changed.limit(0), ["id"], [F.col("v")]) == 0
    keyed.insert_new(spark, str(path), spark.createDataFrame([(7, "late"), (9000, "first")], "id long, v string"), ["id"])
    assert keyed.read(spark, str(path)).filter("id in (7, 9000)").orderBy("id").collect() == [(7, "newest"), (9000, "first")]


def test_a_failed_upsert_leaves_the_old_rows(spark, tmp_path):
    from garimpo.operators import keyed

    path = tmp_path / "t"
    keyed.write(spark.range(100).selectExpr("id", "id as n"), str(path), ["id"], 4)
    before = files_of(path)
    bad = spark.range(50).select("id", F.when(F.col("id") == 49, F.raise_error(F.lit("lost"))).otherwise(F.col("id") * 2).cast("long").alias("n"))
    with pytest.raises(Exception, match="lost"):
        keyed.upsert(spark, str(path), bad, ["id"], [F.col("n")])
    assert files_of(path) == before and keyed.read(spark, str(path)).filter("id <> n").count() == 0
    counts = tmp_path / "c"
    keyed.write(spark.range(10).selectExpr("id", "1L as n"), str(counts), ["id"], 4)
    keyed.add_counts(spark, str(counts), spark.createDataFrame([(3, 4), (3, 1), (99, 7)], "id long, n long"), ["id"], "n")
    assert keyed.read(spark, str(counts)).filter("n > 1").orderBy("id").collect() == [(3, 6), (99, 7)]


def test_lists_of_bucketed_tables_need_no_shuffle(spark, small, tmp_path):
    import uuid

    from garimpo.operators import keyed
    from garimpo.plans import driver, flows

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = driver.store_tables(spark, small)
        extra = ["cnae", "uf", "razao_social", "data_inicio_atividade"]
        tables["companies"] = tables["companies"].select("*", *[F.lit(None).cast("string").alias(c) for c in extra])
        tables["contacts"] = spark.createDataFrame([], "cnpj string, phone_e164 string, source string")
        laid = {n: keyed.save_bucketed(df, f"t_{n}_{uuid.uuid4().hex}", "cnpj", 4, str(tmp_path / n)) for n, df in tables.items()}
        plan = flows._listed(laid, 1, flows.ListFilters(flags=("none",), scored=True)).orderBy("cnpj").limit(10)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 5 and "Exchange" not in plan and "TakeOrderedAndProject" in plan
        plain = flows._listed(tables, 1, flows.ListFilters(flags=("none",), scored=True))
        assert flows.company_total(laid, 1, flows.ListFilters(flags=("none",), scored=True)).first()[0] == plain.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(TypeError):
        flows.ListFilters(colour="red")
    with pytest.raises(ValueError):
        flows.ListFilters(flags=("lost", "burnt"))


def rows_read(df) -> int:
    """Rows that the Parquet scans of ``df`` gave: those of the row groups that were read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_lookups_read_few_row_groups(spark, tmp_path):
    from garimpo.operators import discovery

    est = synthetic.establishments(spark, 60_000).cache()
    n = est.count()
    spark.conf.set("parquet.block.size", str(1 << 16))
    try:
        spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", str(1 << 16))
        etl.write_establishments(est, str(tmp_path / "est"))
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
        spark.conf.unset("parquet.block.size")
    stored = spark.read.parquet(str(tmp_path / "est"))
    some = [r[0] for r in est.select("cnpj").orderBy(F.xxhash64("cnpj")).limit(3).collect()]
    found = discovery.by_numbers_pushed(stored, [*some, "no such number"])
    assert sorted(r["cnpj"] for r in found.collect()) == sorted(r["cnpj"] for r in discovery.by_numbers(est, spark.createDataFrame([(x,) for x in some], "cnpj string")).collect())
    assert rows_read(found.select("cnpj", "email")) * 10 <= n
    etl.write_sorted(discovery.address_index(est), str(tmp_path / "at"), ["uf", "numero", "cnpj"], 1 << 16)
    index = spark.read.parquet(str(tmp_path / "at"))
    probes = [tuple(r) for r in est.filter("numero <> 'S/N' and uf <> ''").select("cnpj", "logradouro", "numero", "uf").orderBy("cnpj").limit(40).collect()] + [("none", "Rua X", None, None)]
    asked = spark.createDataFrame(probes, "ref string, logradouro string, numero string, uf string")
    assert sorted(map(str, discovery.find_by_address_pushed(index, probes).collect())) == sorted(map(str, discovery.find_by_address(est, asked).collect()))
    assert rows_read(index.filter("uf = 'SP' and numero in ('7', '8')")) * 10 <= index.count()
    with pytest.raises(ValueError):
        discovery.by_numbers_pushed(stored, [str(i) for i in range(1001)])


@pytest.mark.parametrize("order", ["founded-desc", "founded-asc", "name", "capital-desc"])
def test_pages_by_token_are_pages_by_offset(spark, tmp_path, order):
    from garimpo.operators import discovery
    from garimpo.operators.filters import CompanyFilters

    est = synthetic.establishments(spark, 600)
    gone = F.xxhash64("cnpj") % 7 == 0
    est = est.withColumns({"data_inicio_atividade": F.when(~gone, F.trunc("data_inicio_atividade", "year")), "capital_social": F.when(~gone, F.round(F.col("capital_social") % 5)), "nome_fantasia": F.when(~gone, F.left("nome_fantasia", F.lit(7))), "razao_social": F.lit(None).cast("string")})
    etl.write_sorted(est, str(tmp_path / "o"), discovery.ordering(order))
    rows = spark.read.parquet(str(tmp_path / "o")).cache()
    activities = cities = spark.createDataFrame([], "codigo string, descricao string")
    every = [r["cnpj"] for r in rows.orderBy(*discovery.ordering(order)).select("cnpj").collect()]
    after, seen = None, []
    for _ in range(20):
        page = discovery.list_companies(rows, activities, cities, CompanyFilters(), order, 97, after=after)
        seen += [r["cnpj"] for r in page.select("cnpj").collect()]
        if (after := discovery.page_token(page, order)) is None:
            break
    assert seen == every and len(every) > 194 and len(set(every)) == len(every)


def test_a_late_page_reads_no_more_than_the_first(spark, tmp_path):
    from garimpo.operators import discovery

    rows = spark.range(200_000).select(F.lpad(F.col("id").cast("string"), 9, "0").alias("cnpj"), (F.col("id") % 1000).cast("double").alias("capital_social"))
    etl.write_sorted(rows, str(tmp_path / "o"), discovery.ordering("capital-desc"), 1 << 16)
    stored = spark.read.parquet(str(tmp_path / "o"))
    assert rows_read(stored.filter(discovery.beyond("capital-desc", (10.0, "000000000")))) * 10 <= rows_read(stored)


def test_the_text_index_gives_the_rows_of_the_scan(spark, tmp_path):
    from garimpo.operators import textindex
    from garimpo.operators.filters import CompanyFilters, apply

    names = ["Padaria São João", "PADARIA SAO JOAO LTDA", "Pão & Cia", "pao", "a", "", None, "Ação", "AÇÃO   total", "100% natural", "x_y", "padaria", "São  João", "ÇÇÇ", "J̃oao"] * 3
    rows = spark.createDataFrame([(f"c{i}", n, names[i - 1] if i % 4 == 0 else None, n) for i, n in enumerate(names)], "cnpj string, nome_fantasia string, razao_social string, bairro string").repartition(3)
    textindex.write(rows, str(tmp_path / "q"), ["nome_fantasia", "razao_social"])
    textindex.write(rows, str(tmp_path / "b"), ["bairro"])
    for q in ["padaria", "são", "SAO", "ao j", "oão", "ção", "% n", "_y", "  ", "pa", "a", "zzz", "ççç", "João", "padaria são joão", "Ação   total"]:
        for where, f in (("q", CompanyFilters(q=q)), ("b", CompanyFilters(bairro=q))):
            got, want = (sorted(r["cnpj"] for r in apply(x, f).collect()) for x in (textindex.narrowed(rows, str(tmp_path / where), q), rows))
            assert got == want, (where, q)
    assert textindex.candidates(spark, str(tmp_path / "q"), "padaria").count() < rows.count() and textindex.candidates(spark, str(tmp_path / "q"), "pa") is None


@pytest.mark.parametrize("name", ["substring_index", "pages_by_token"])
def test_searches_and_pages_read_a_stored_registry(spark, small, name):
    """each search joined orders, lines and customers anew, and so did each sorted file."""
    import __spark_entry__ as E

    plan = E.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan


class Told:
    """A handle whose state lies in dicts and counts its calls."""

    def __init__(self):
        self.calls = 0

    def _state(self, *_):
        handle, held = self, {}

        class State:
            def __getattribute__(self, name):
                handle.calls += 1
                return {
                    "getValue": held.get, "updateValue": held.__setitem__, "removeKey": lambda k: held.pop(k, None), "containsKey": held.__contains__,
                    "exists": lambda: bool(held), "get": lambda: held[0], "update": lambda v: held.__setitem__(0, v), "clear": held.clear, "size": lambda: len(held),
                }[name]

        return State()

    getMapState = getValueState = _state


def plain_loop(batches, budget):
    """(position, cnpj, outcome) taken of one project, match by match."""
    taken, out, spent, waits, failures = set(), [], 0, 0, 0
    for batch in batches:
        for position, cnpj, what in sorted(batch, key=lambda m: (m[0] is None, m[0] or 0)):
            if spent >= budget:
                return [*out, (None, None, None)], "budget"
            if cnpj in taken:
                continue
            out.append((position, cnpj, what))
            spent += what != "no_site"
            waits, failures = (0, 0) if what == "scored" else (waits + (what == "transient"), failures + (what == "error"))
            if what == "daily" or waits > loop.MOST_WAITS or failures >= loop.MOST_FAILURES:
                return out, {"daily": "daily limit", "transient": "waits", "error": "failures"}[what]
            if what != "transient":
                taken.add(cnpj)
    return out, None


@pytest.mark.parametrize("seed", range(20))
def test_the_loop_is_the_plain_loop(seed):
    """parts of what was taken are split as it grows, nothing is taken twice, and projects of a bucket don't mix."""
    import random

    import pandas as pd

    r, handle, given, got = random.Random(seed), Told(), {}, {}
    machine = loop.PullLoop(r.choice([5, 400, 10**6]), None, None)
    machine.init(handle)
    kinds = r.choice([["no_site", "scored"], ["no_site"] * 30 + ["scored"] * 30 + ["transient", "error"], ["scored", "transient", "error"], ["scored"] * 300 + ["daily"]])
    for _ in range(6):
        rows = [(r.choice(["a", "b", None]), r.choice([None, 2**60 + r.randrange(500), r.randrange(9999)]), r.choice([None, *map(str, range(r.choice([9, 4000])))]), r.choice(kinds)) for _ in range(r.choice([1, 50, 1500]))]
        for p, *match in rows:
            given.setdefault(p, {}).setdefault(_, []).append(tuple(match))
        columns = ["project_id", "position", "cnpj", "outcome"]
        frames = [pd.DataFrame([(p, None if at is None else str(at), c, what) for p, at, c, what in rows[i : i + 700]], columns=columns, dtype=object) for i in range(0, len(rows), 700)]
        for out in machine.handleInputRows((1,), iter(frames), None):
            for row in zip(*(out[c].tolist() for c in out.columns), strict=True):
                got.setdefault(row[0], []).append(tuple(None if x is pd.NA else x for x in row[1:]))
    for p, batches in given.items():
        want, stopped = plain_loop(batches.values(), machine.budget)
        assert [x[:3] for x in got[p]] == want and got[p][-1][-1] == stopped


def test_state_is_not_called_for_each_match():
    """two calls a match and more; a batch of 200 projects of 50 matches made over 20,000."""
    import pandas as pd

    handle = Told()
    machine = loop.PullLoop(10**6, None, None)
    machine.init(handle)
    handle.calls = 0
    for batch in range(2):
        rows = [(f"p{i % 200}", str(i + batch * 10_000), f"c{i + batch * 10_000}", "scored") for i in range(10_000)]
        out = list(machine.handleInputRows((1,), iter([pd.DataFrame(rows, columns=["project_id", "position", "cnpj", "outcome"])]), None))
        assert sum(map(len, out)) == 10_000
    assert handle.calls <= 2 * 200 * 4


def test_buckets_keep_projects_apart(spark, tmp_path, monkeypatch):
    """many projects in one call, one of them with more matches than a part of state holds, and matches that come again."""
    monkeypatch.setattr(loop, "BUCKETS", 2)
    many = [("many", i, f"m{i}", False, None) for i in range(1500)]
    few = [(f"p{i}", 2**60 + i, None if i % 3 else "x", True, None) for i in range(40)]
    nameless = [(None, 1, "n", True, None)]
    again = [("many", i + 5000, f"m{i}", False, None) for i in range(0, 3000, 2)]
    taken = pulled(spark, tmp_path, [many + few, few + nameless, again + nameless], budget=9)
    assert taken.filter("project_id = 'many'").agg(F.count("*"), F.count_distinct("cnpj"), F.max("done")).first() == (2250, 2250, 2250)
    assert sorted(map(tuple, taken.filter("project_id <> 'many'").select("project_id", "position", "cnpj", "spent").collect())) == sorted((p, at, c, 1) for p, at, c, *_ in few)
    assert [tuple(x) for x in taken.filter("project_id is null").select("position", "cnpj", "spent").collect()] == [(1, "n", 1)]


def test_slices_of_many_files_are_no_more_batches(spark, small, monkeypatch):
    """files a batch were a fixed number, so that slices of 211 files, as on check_h, made 176 batches of six."""
    import __spark_entry__ as E
    from garimpo.plans import driver_jobs
    from garimpo.streaming import loop as module

    began, sliced, start = [], driver_jobs.sliced, module.start
    monkeypatch.setattr(driver_jobs, "sliced", lambda df, path, at, key, slices, files=2: sliced(df, path, at, key, slices, 13))
    monkeypatch.setattr(module, "start", lambda *a, **k: began.append(start(*a, **k)) or began[-1])
    assert E.queries()["continuous_stops"](spark, small).count() == spark.read.parquet(f"{small}/events.parquet").select("user_id").distinct().count()
    assert sum(p["numInputRows"] > 0 for p in began[0].recentProgress) <= 6

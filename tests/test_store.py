"""Store operations, flows, streaming and the driver's contract."""

import importlib
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from garimpo.operators import store
from garimpo.plans import flows


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, at int")
    assert rows(store.upsert(old, new, ["k"], [F.desc("at")])) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]
    assert rows(store.insert_new(old, new, ["k"], [F.col("at")])) == [(1, "a", 1), (2, "b", 1), (3, "e", 1)]
    assert rows(store.delete(old, new, ["k"])) == [(1, "a", 1)]
    body = lambda b: spark.createDataFrame([(1, b, 9)], "k int, body string, at int")
    assert rows(store.set_impressions(body("x"), body("  "), ["k"], [F.desc("at")])) == []


def test_query_plan(spark):
    terms = spark.createDataFrame([(0, "pilates"), (1, "yoga"), (2, "pilates")], "term_idx int, term string")
    places = spark.createDataFrame([(0, "Santos SP"), (1, "Campinas SP")], "place_idx int, place string")
    got = [r["query"] for r in store.plan_queries(terms, places, 3).collect()]
    assert got == ['"pilates" Santos SP', '"yoga" Santos SP', '"pilates" Campinas SP']
    assert [r["query"] for r in store.plan_queries(terms, places.limit(0), 5).collect()] == ['"pilates"', '"yoga"']


def test_profiles_and_pages(spark):
    hits = spark.createDataFrame([(1, "linkedin", "h1"), (1, "linkedin", "h2"), (2, "linkedin", "h3"), (2, "site", "h4")], "search_id int, kind string, headline string")
    assert rows(store.ambiguous_profiles(hits).select("search_id", "kind", "headline")) == [(1, "linkedin", None), (1, "linkedin", None), (2, "linkedin", "h3"), (2, "site", "h4")]
    pages = spark.createDataFrame([("https://a.com", None, 200, "<p>" + "texto " * 100 + "</p>", None), ("https://instagram.com/x", None, 200, "<p>x</p>", None), ("https://b.com", None, None, None, "timeout")], "url string, final_url string, http_status int, html string, error string")
    got = {r["url"]: r for r in flows.analyse_pages(pages, {"t": ["texto"]}).collect()}
    assert got["https://a.com"]["probes"] == {"t": True} and got["https://a.com"]["has_form"] is False
    assert got["https://instagram.com/x"]["is_link_hub"] and got["https://instagram.com/x"]["has_form"] is None
    assert got["https://b.com"]["is_dead"] and got["https://b.com"]["text_excerpt"] is None and got["https://b.com"]["probes"] == {}


def test_selection(spark):
    companies = spark.createDataFrame([(1, str(i), i % 2 == 0) for i in range(5)], "project_id int, cnpj string, mei boolean")
    scores = spark.createDataFrame([(1, "1", None, "m", "high"), (1, "2", "failed", None, None), (1, "4", None, "m", "cannot_determine")], "project_id int, cnpj string, error string, model string, confidence string")
    assert rows(flows.to_score(companies, scores).select("cnpj")) == [("0",), ("2",), ("3",)]
    assert rows(flows.to_score(companies, scores, spark.createDataFrame([("1",)], "cnpj string")).select("cnpj")) == [("0",), ("1",), ("2",), ("3",)]
    crawls = spark.createDataFrame([("0", "long text"), ("2", None)], "cnpj string, excerpt string")
    lookups = spark.createDataFrame([("2", True)], "cnpj string, found boolean")
    pending = flows.mei_pending(companies, crawls, lookups, scores, F.length("excerpt") > 3)
    assert rows(pending.select("cnpj")) == [("2",), ("4",)]
    attempts = spark.createDataFrame([("1", "blocked", 0), ("1", "ok", 1), ("2", "empty", 0), ("2", "ok", 1), ("3", "blocked", 0)], "cnpj string, status string, provider_rank int")
    out = flows.presence_outcome(attempts)
    assert rows(out.select("cnpj", "status")) == [("1", "ok"), ("2", "empty"), ("3", "blocked")] and flows.lookup_rows(out).count() == 2


def test_promote(spark):
    leads = spark.createDataFrame([(1, "a.com", "10"), (1, "b.com", "11"), (1, "c.com", None)], "project_id int, apex string, matched_cnpj string")
    companies = spark.createDataFrame([(1, "10", "x")], "project_id int, cnpj string, name string")
    crawls = spark.createDataFrame([("10", "old")], "cnpj string, signals string")
    more = spark.createDataFrame([("a.com", "new"), ("b.com", "new")], "apex string, signals string")
    c, w = store.promote(leads, companies, crawls, more)
    assert rows(c) == [(1, "10", "x"), (1, "11", None)] and rows(w) == [("10", "old"), ("11", "new")]


def test_stream(spark, small):
    from garimpo.plans.driver import stream_dedup_foreach_batch

    want = spark.read.parquet(f"{small}/events.parquet").select("user_id").distinct().count()
    assert stream_dedup_foreach_batch(spark, small).count() == want


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents pages labels".split():
        con.sql(f"create view {name} as select * from '{small}/{name}.parquet'")
    return con


def test_queries_agree_with_sql(spark, small, duck):
    from garimpo.plans import catalogue, driver, driver_jobs, driver_more, driver_web  # noqa: F401

    norm = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    for name, sql in catalogue.SQL.items():
        df, rel = catalogue.QUERIES[name](spark, small), duck.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(rel.columns), name
        mine = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
        theirs = sorted(tuple(norm(dict(zip(rel.columns, r, strict=True))[c]) for c in columns) for r in rel.fetchall())
        assert mine == theirs, name


@pytest.mark.parametrize("missing", ["garimpo.llm", "corpus_pipeline", "sentencepiece"])
def test_entry_works_without_the_text_operators(missing):
    """The guard: with the folder gone, or with something it needs, the rest imports and lists its queries."""
    code = f"""
import sys
class Gone:
    def find_spec(self, name, *_):
        if name == {missing!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, {str(sys.path[0])!r})
import __spark_entry__ as e
assert e.queries() and not any(k.startswith("op") or k == "pipeline" for k in e.queries()) and "discover_list_topk" in e.oracle_sql()
"""
    root = importlib.util.find_spec("garimpo").submodule_search_locations[0].rsplit("/", 1)[0]
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)


def test_first_rows_of_a_stream(spark, tmp_path):
    from garimpo.streaming import continuous

    for i, rows in enumerate([[(2, "a"), (1, "a"), (9, None)], [(0, "a"), (5, "b")], [(4, "b"), (6, "c"), (7, None)]]):
        spark.createDataFrame(rows, "n int, k string").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    for i in range(3):  # one part a batch, in order of their times
        for f in (tmp_path / "in" / f"p{i}").glob("*.parquet"):
            (tmp_path / "flat").mkdir(exist_ok=True)
            f.rename(tmp_path / "flat" / f"{i}.parquet")
            os.utime(tmp_path / "flat" / f"{i}.parquet", (1000 + i, 1000 + i))
    stream = continuous.stream_parquet(spark, str(tmp_path / "flat"), "n int, k string", 1)
    drop = lambda df: df.filter("n <> 1")
    continuous.process_unseen(stream, str(tmp_path / "out"), "k", drop, str(tmp_path / "check"), ["n"]).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("n", "k").collect())) == [(5, "b"), (6, "c"), (9, None)]


def test_picks_are_the_same_on_every_run(spark):
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (2, "c", 1)], "k int, v string, n int")
    for parts in (1, 3):
        some = rows.repartition(parts)
        assert sorted(map(tuple, store.insert_new(rows.limit(0), some, ["k"]).collect())) == [(1, "b", 2), (2, "c", 1)]
        assert sorted(map(tuple, store.update(spark.createDataFrame([(1, "z"), (3, "y")], "k int, v string"), some, ["k"], ["v"]).collect())) == [(1, "b"), (3, "y")]


def test_delete_cascades(spark):
    a, b = spark.createDataFrame([(1, 5), (2, 6)], "project_id int, x int"), spark.createDataFrame([(7,)], "y int")
    left = store.delete_cascade({"a": a, "b": b}, spark.createDataFrame([(1,)], "project_id int"), ["project_id"])
    assert left["a"].collect() == [(2, 6)] and left["b"].collect() == [(7,)]


def test_names_that_begin_alike_meet_by_prefix(spark):
    """2000 candidates and 2000 companies with one common first word: no more pairs meet than agree, and the same ones as by comparing all."""
    from garimpo.functions import names
    from garimpo.plans import enrichment

    letters = str.maketrans("0123456789", "BCDFGHJKLM")
    word = lambda i: str(i).zfill(4).translate(letters)
    a = [(f"a{i}", f"Supermercado {word(i)}{' Filial' if i % 3 else ''}", f"https://{word(i).lower()}abc.com.br") for i in range(2000)]
    b = [(f"c{i}", f"SUPERMERCADO {word(i)} LTDA", f"{word(i)}ABC {word(i + 1)}" if i % 5 == 0 else None) for i in range(2000)]
    candidates = spark.createDataFrame(a, "apex string, name string, website_url string")
    companies = spark.createDataFrame(b, "cnpj string, razao_social string, nome_fantasia string")
    met, found = enrichment.name_pairs(candidates, companies).count(), {tuple(r) for r in enrichment.pair_by_name(candidates, companies).collect()}
    assert len(found) <= met <= 2 * len(found)
    assert found == {(f"a{i}", f"c{i}") for i in range(2000)}
    few = candidates.limit(60).crossJoin(companies.orderBy("cnpj").limit(200))
    told = few.filter(names.verify_mirror_link("website_url", "name", "razao_social", "nome_fantasia")).select("apex", "cnpj")
    some = candidates.limit(60), companies.orderBy("cnpj").limit(200)
    assert {tuple(r) for r in told.collect()} == {tuple(r) for r in enrichment.pair_by_name(*some).collect()}

"""ETL, filters and discovery on a made-up registry: exact cases, and invariants that hold on any data."""

import zipfile

import pytest
from pyspark.sql import functions as F

from garimpo.operators import discovery as D
from garimpo.operators.filters import CompanyFilters, apply, predicate
from garimpo.plans import etl
from garimpo.sources import raw, schemas, synthetic

AS_OF = "2020-01-01"


@pytest.fixture(scope="module")
def est(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("registry") / "est")
    etl.write_establishments(synthetic.establishments(spark, 6000), path)
    return schemas.read_establishments(spark, path)


@pytest.fixture(scope="module")
def codes(spark, est):
    return est.select(F.col("cnae_principal").alias("codigo"), F.concat(F.lit("Atividade é "), "cnae_principal").alias("descricao")).distinct()


def n(est, **f) -> int:
    return apply(est, CompanyFilters(**f)).count()


def test_lines(spark):
    line = 'a;"b;c";"d ""e""";"";f;"open;g'
    assert spark.range(1).select(raw.fields(F.lit(line))).first()[0] == ["a", "b;c", 'd "e"', "", "f", "open;g"]


def test_zip_lines(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a.csv", "1;São\r\n\r\n2;x".encode("latin-1"))
        z.writestr("b.csv", b"3;y\n")
    assert sorted(r[0] for r in raw.read_zip_lines(spark, str(tmp_path)).collect()) == ["1;São", "2;x", "3;y"]
    (tmp_path / "plain.csv").write_bytes("4;Ç\n".encode("latin-1"))
    assert [r[0] for r in raw.read_lines(spark, str(tmp_path / "plain.csv")).collect()] == ["4;Ç"]


def test_kept_rows(spark, est):
    lines = synthetic.raw_establishments(spark, 6000)
    s = etl.stats(lines, est).first()
    assert s["read"] == 6000 and 0 < s["kept"] == s["with_email"] < 3600
    assert est.filter("email <> lower(trim(email)) or cnae_principal = '' or size(cnae_secundaria) = 0").count() == 0
    assert est.filter("cnae_div <> left(cnae_principal, 2)").count() == 0
    assert est.filter("cnae_div < '10'").count() > 0, "divisions keep their leading zero"
    assert est.filter("exists(cnae_secundaria, x -> length(x) <> 7)").count() == 0
    assert est.filter("simples is null or mei is null").count() == 0 and est.filter("razao_social is null").count() > 0
    assert est.filter("length(cnpj) <> 14").count() == 0


def test_conversion_guards(spark, tmp_path):
    with pytest.raises(etl.MissingJoinInput):
        etl.denormalise(None, None, None)
    with pytest.raises(schemas.DatasetMissing):
        schemas.read_establishments(spark, str(tmp_path / "nothing"))
    spark.range(1).write.parquet(str(tmp_path / "old"))
    with pytest.raises(schemas.DatasetStale, match="cnpj"):
        schemas.read_establishments(spark, str(tmp_path / "old"))
    with pytest.raises(TypeError):
        CompanyFilters(unknown=1)


def test_repeated_roots_do_not_multiply(spark):
    lines = synthetic.raw_establishments(spark, 500)
    twice = etl.companies(synthetic.raw_companies(spark)).union(etl.companies(synthetic.raw_companies(spark)))
    assert etl.denormalise(etl.clean_establishments(lines), twice, etl.tax_regimes(synthetic.raw_tax(spark))).count() == etl.clean_establishments(lines).count()


def test_filters_only_narrow(est):
    every = n(est)
    for f in [dict(uf=["SP"]), dict(cnae=["86"]), dict(has_phone=True), dict(is_mobile=True), dict(own_domain_email=True), dict(matriz_only=True), dict(min_capital_social=0), dict(bairro="america"), dict(cep_prefix=["1"]), dict(q="loja"), dict(founded_from="2000-01-01")]:
        assert 0 < n(est, **f) <= every, f
    assert n(est, mei=True) + n(est, mei=False) == every
    assert n(est, founded_from="2005-01-01") + n(est, founded_to="2004-12-31") == est.filter("data_inicio_atividade is not null").count()
    assert n(est, cnae=["99999"]) == 0 and n(est, bairro="AMÉRICA") == n(est, bairro="america")


def test_pruning(est):
    plan = lambda **f: apply(est, CompanyFilters(**f))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cnae_div" in plan(cnae=["8600"])
    assert "PartitionFilters: []" in plan(cnae=["8600"], include_secondary=True)


def test_reach(spark, est, codes):
    off = D.count_reach(est, CompanyFilters(cnae=["86"]), AS_OF).first()
    on = D.count_reach(est, CompanyFilters(cnae=["86"], include_secondary=True), AS_OF).first()
    assert off["principal"] == off["total"] == on["principal"] and off["secundaria"] == 0
    assert on["principal"] + on["secundaria"] == on["total"] > off["total"]
    asked = spark.createDataFrame([(0, "86"), (1, "9999999"), (2, "8600"), (3, "01")], "pos int, code string")
    found = {r["code"]: r for r in D.cnae_reach(est, asked, codes, AS_OF).collect()}
    assert (found["86"]["total"], found["86"]["principal"], found["86"]["recent"]) == (on["total"], on["principal"], on["recent"])
    assert found["9999999"]["total"] == 0 and found["9999999"]["descricao"] is None and found["86"]["principal"] >= found["8600"]["principal"]


def test_match_origin(est):
    f = CompanyFilters(cnae=["86", "0100005"], include_secondary=True)
    for r in D.with_match(apply(est, f), f).collect():
        hit = lambda c: c.startswith("86") or c == "0100005"
        assert (r["cnae_match"] == "principal") == hit(r["cnae_principal"])
        assert r["cnae_secundaria_match"] == [c for c in r["cnae_secundaria"] or [] if hit(c)]


def test_pages(spark, est, codes):
    cities = spark.createDataFrame([("1", "Um")], schemas.DICTIONARY)
    page = lambda **k: D.list_companies(est, codes, cities, **k)
    first, second = page(limit=20).collect(), page(limit=20, offset=20).collect()
    days = [r["data_inicio_atividade"] for r in first + second]
    assert len(first) == 20 and days == sorted(days, reverse=True) and not {r["cnpj"] for r in first} & {r["cnpj"] for r in second}
    assert page(limit=9999).count() == 1000 and first[0]["cnae_descricao"] and first[0]["endereco"]["completo"]
    gone = spark.createDataFrame([(r["cnpj"],) for r in first], "cnpj string")
    assert [r["cnpj"] for r in page(limit=20, exclude=gone).collect()] == [r["cnpj"] for r in second]
    named = page(order="name", limit=1000).collect()
    known = [r["nome_fantasia"] or r["razao_social"] for r in named]
    assert known == sorted((k for k in known if k), key=lambda s: s.encode()) + [None] * known.count(None)


def test_address_lookup(spark, est):
    some = est.filter("numero rlike '^[0-9]+$' and uf <> ''").limit(30).select(F.col("cnpj").alias("ref"), "logradouro", "numero", "uf")
    odd = spark.createDataFrame([("a", "RUA X", None, "SP"), ("b", "RUA A", "1", "SP"), ("c", "RUA FLORES", "1", None)], some.schema)
    found = {r["ref"]: r for r in D.find_by_address(est, some.union(odd)).collect()}
    assert [found[k]["skipped"] for k in "abc"] == ["sem-numero", "rua-curta", "sem-uf"]
    for r in found.values():
        if r["skipped"] is None:
            assert (r["ref"] in r["cnpjs"] or r["ambiguous"] or r["logradouro"].endswith("101")) if "logradouro" in r else r["cnpjs"] is not None
    assert sum(len(r["cnpjs"]) for r in found.values()) > 0
    assert D.find_by_address(est, some.limit(0)).count() == 0


def test_address_lookup_of_all_customers(spark):
    import duckdb

    import __spark_entry__ as entry

    d, con = "/root/testdata/sf0.01", duckdb.connect()
    for name in ("customer", "orders", "nation", "lineitem", "documents", "events", "supplier", "part", "region"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    found = sorted(map(tuple, entry.queries()["address_batch_lookup_all"](spark, d).collect()))
    assert found == sorted(con.sql(entry.oracle_sql()["address_batch_lookup_all"]).fetchall())
    assert len(found) == con.sql("SELECT count(*) FROM customer").fetchall()[0][0] > 200


def test_address_probes_meet_few_establishments(spark):
    there = spark.createDataFrame([(f"{i:05d}", "1", "SP", "RUA DAS FLORES" if i % 2 else "RUA GONCALVES") for i in range(3000)], "cnpj string, numero string, uf string, logradouro string")
    probes = spark.createDataFrame([(f"p{i}", street, "1", "sp") for i, street in enumerate(["RUA FLORES", "RUA ALVES", "RUA NENHUMA"] * 50)], "ref string, logradouro string, numero string, uf string")
    found = {r["ref"]: r for r in D.find_by_address(there, probes).collect()}
    want = [[f"{i:05d}" for i in range(3000) if i % 2 == odd][:12] for odd in (1, 0)] + [[]]
    assert all(found[f"p{i}"]["cnpjs"] == want[i % 3] and found[f"p{i}"]["ambiguous"] == (i % 3 < 2) for i in range(150))


def test_dictionary(spark):
    a = spark.createDataFrame([("8630501", "Clínica médica"), ("8630502", "Exames"), ("8630503", "Outra"), ("0111301", "Cultivo de arroz")] + [(f"470000{i}", f"Loja {i}") for i in range(6)], schemas.DICTIONARY)
    assert [r["codigo"] for r in D.search_activities(a, "CLINICA").collect()] == ["8630501"]
    assert [r["codigo"] for r in D.search_activities(a, "8630", 2).collect()] == ["8630501", "8630502"] and D.search_activities(a, "  ").count() == 0
    said = {r["code"]: r["descricao"] for r in D.describe(spark.createDataFrame([(c,) for c in ("8630501", "8630", "0111", "4700", "9")], "code string"), a).collect()}
    assert said == {"8630501": "Clínica médica", "8630": "3 subclasses — Clínica médica; Exames; Outra", "0111": "Cultivo de arroz", "4700": "6+ subclasses — Loja 0; Loja 1; Loja 2; …", "9": None}


def test_fill_missing(spark):
    t = spark.createDataFrame([(1, None, "x"), (2, "here", "y")], "k int, street string, other string")
    s = spark.createDataFrame([(1, "new"), (2, "never")], "k int, street string")
    assert sorted(map(tuple, etl.fill_missing(t, s, "k", ["street"]).collect())) == [(1, "new", "x"), (2, "here", "y")]


def test_quoted_lines_are_cut_as_tolerantly(spark):
    import random

    rng = random.Random(1)
    lines = ["".join(rng.choice(['"', ";", "a", '";"', '""', "b", ""]) for _ in range(rng.randrange(14))) for _ in range(2000)] + ['"x";"y; z";""', '"a"";""b"', '"', '""', ""]
    df = spark.createDataFrame([(x,) for x in lines], "value string").select(raw.fields("value").alias("a"), raw._tolerant(F.col("value")).alias("b"))
    assert df.filter("not (a <=> b)").count() == 0


def test_a_line_is_parsed_once(spark):
    plan = etl.clean_establishments(spark.createDataFrame([("x",)], "value string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(") == 3 and plan.count('";"') == 1


def test_fresh_replaces_only_what_it_writes(spark, tmp_path):
    path = str(tmp_path / "e")
    made = synthetic.establishments(spark, 3000)
    etl.write_establishments(made, path)
    there = spark.read.parquet(path).groupBy("cnae_div").count().collect()
    most = max(there, key=lambda r: r["count"])["cnae_div"]
    etl.write_establishments(made.filter(F.col("cnae_div") == most).limit(5), path, fresh=True)
    left = {str(r[0]): r[1] for r in spark.read.parquet(path).groupBy("cnae_div").count().collect()}
    assert left.pop(str(most)) == 5 and left == {str(r[0]): r[1] for r in there if str(r[0]) != str(most)}


def test_own_domain_is_what_follows_the_first_at(spark):
    df = spark.createDataFrame([("a@firma.com.br@gmail.com",), ("a@gmail.com@firma.com.br",)], "email string")
    assert [r[0] for r in df.filter(predicate(CompanyFilters(own_domain_email=True))).collect()] == ["a@firma.com.br@gmail.com"]


def test_migrate_and_single_file(spark, tmp_path):
    df = spark.createDataFrame([(1, "7")], "a int, b string")
    assert etl.migrate(df, spark.createDataFrame([], "b long, c string").schema).collect() == [(7, None)]
    etl.write_single(df.union(df).repartition(2), str(tmp_path / "s"))
    assert len(list((tmp_path / "s").glob("*.parquet"))) == 1


def test_the_dictionary_s_prefixes_are_not_broadcast(spark, small):
    """They are several times the dictionary, so that at a gigabyte they filled the driver; each keeps its first six children."""
    import __spark_entry__ as E

    plan = E.queries()["describe_rollup"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "row_number" in plan

"""The driver's queries of smaller operators: scans and sinks, picks, exports, names and lists, each with rows of every outcome."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import candidate, names, pages as P, registry, values as V, web
from ..operators import discovery, filters, store
from ..operators.filters import CompanyFilters
from ..sources import schemas
from ..streaming.continuous import shared
from . import enrichment, etl, flows
from .driver import EST, activities, cities, est, query, t
from .driver_web import K, customers




# ---------------------------------------------------------------- scans and sinks


@query(EST + "SELECT cnpj, cnae_principal, uf FROM est WHERE cnae_principal LIKE '0000%' AND uf IN ('O', 'P')")
def registry_round_trip(spark, d):
    """The registry written by division in two appends and scanned with pruning."""
    path = f"{shared(spark)}/registry-{uuid.uuid4().hex}"
    made = est(spark, d).withColumn("tipo_logradouro", F.lit("RUA")).withColumn("complemento", F.lit(None).cast("string"))
    made = etl.migrate(made, schemas.ESTABLISHMENTS)
    etl.write_establishments(made.filter("uf = 'O'"), path)
    etl.write_establishments(made.filter("uf <> 'O'"), path)
    return filters.apply(schemas.read_establishments(spark, path), CompanyFilters(cnae=["0000"], uf=["O", "P"])).select("cnpj", "cnae_principal", "uf")


@query("SELECT lpad(p_partkey::VARCHAR, 7, '0') AS codigo, p_name AS descricao FROM part")
def dictionary_round_trip(spark, d):
    """A dictionary from its lines, written as one file and scanned."""
    lines = t(spark, d, "part").select(F.concat(F.lit('"'), F.lpad(F.col("p_partkey").cast("string"), 7, "0"), F.lit('";" '), F.col("p_name"), F.lit(' "')).alias("value"))
    path = f"{shared(spark)}/dictionary-{uuid.uuid4().hex}"
    etl.write_single(etl.dictionary(lines), path)
    return schemas.read_dictionary(spark, path)


@query("SELECT o_orderstatus AS part, count(*) AS rows, count(*) FILTER (WHERE o_orderkey % 40 <> 0 OR o_orderstatus = 'P') AS named, coalesce(count(*) FILTER (WHERE o_orderkey % 40 <> 0 OR o_orderstatus = 'P') >= count(*) * 0.976, false) AS covered FROM orders GROUP BY 1")
def etl_coverage(spark, d):
    rows = t(spark, d, "orders").select("o_orderstatus", F.when((F.col("o_orderkey") % 40 != 0) | (F.col("o_orderstatus") == "P"), "n").alias("razao_social"))
    one = lambda s: etl.coverage(rows.filter(F.col("o_orderstatus") == s), 0.976).withColumn("part", F.lit(s))
    return one("F").union(one("O")).union(one("P")).select("part", "rows", "named", "covered")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END, c_name) AS a, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE c_mktsegment END AS b FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 5 <> 0")
def etl_backfill(spark, d):
    k = F.col("o_orderkey")
    target = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), F.when(k % 3 != 0, F.col("o_orderstatus")).alias("a"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("b"))
    source = customers(spark, d).filter(F.col(K) % 5 != 0).select(F.col(K).alias("key"), F.col("c_name").alias("a"), F.col("c_mktsegment").alias("b"))
    return etl.fill_missing(target, source, "key", ["a", "b"]).select("o_orderkey", "a", "b")


# ---------------------------------------------------------------- companies as they are shown


@query(EST + f"""SELECT cnpj, e164, CASE WHEN e164 LIKE '%9________' AND length(e164) = 14 THEN 'https://wa.me/' || e164[2:] END AS wa_me, 'Das Flores ' || upper(bairro[1]) || lower(bairro[2:]) || ', ' || numero AS street FROM (
SELECT *, CASE WHEN ddd IN ({', '.join(repr(x) for x in V.AREA_CODES)}) AND regexp_matches(l, '^(9[0-9]{{8}}|[2-5][0-9]{{7}})$') THEN '+55' || ddd || l END AS e164 FROM (
 SELECT cnpj, ddd, bairro, numero, data_inicio_atividade, CASE WHEN regexp_matches(telefone, '^[6-9]') THEN '9' || telefone ELSE telefone END AS l FROM est WHERE uf = 'F' AND numero <> '0'))
ORDER BY data_inicio_atividade DESC NULLS LAST, cnpj LIMIT 1000""")
def company_presented(spark, d):
    made = est(spark, d).filter("numero <> '0'").withColumn("tipo_logradouro", F.lit(None).cast("string")).withColumn("complemento", F.lit(None).cast("string"))
    page = discovery.list_companies(made, activities(spark, d), cities(spark, d), CompanyFilters(uf=["F"]), limit=5000)
    return page.select("cnpj", F.col("phone.e164").alias("e164"), "wa_me", registry.format_street("tipo_logradouro", "logradouro", "numero", "complemento").alias("street"))


@query("""SELECT 'a' || o_orderkey AS dominio, CASE WHEN o_orderkey % 2 = 0 THEN 'https://f' ELSE 'https://w' END AS site, CASE o_orderkey % 3 WHEN 0 THEN 'já na base, dentro do CNAE' WHEN 1 THEN 'na base, fora do CNAE do projeto' ELSE 'sem CNPJ na Receita' END AS situacao,
CASE WHEN o_orderkey % 2 = 0 THEN 'a@b.c · d@e.f' ELSE '' END AS emails, CASE WHEN o_orderkey % 4 = 0 THEN '5' ELSE '' END AS nota, CASE WHEN o_orderkey % 8 = 0 THEN 'sim' ELSE '' END AS ramo_errado
FROM orders WHERE o_orderkey % 7 <> 0 ORDER BY o_orderkey % 4 = 0 DESC, o_orderdate DESC, dominio LIMIT 400""")
def lead_export(spark, d):
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    two = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    leads = t(spark, d, "orders").select(
        F.lit(1).alias("project_id"), F.concat(F.lit("a"), k).alias("apex"), F.lit("https://w").alias("website_url"), F.when(k % 2 == 0, "https://f").alias("final_url"), none.alias("title"),
        F.when(k % 3 == 0, "in_reach").when(k % 3 == 1, "out_of_reach").otherwise("unmatched").alias("verdict"), none.alias("out_of_reach_by"), none.alias("matched_cnpj"), none.alias("match_via"), none.alias("matched_cnae"),
        F.when(k % 2 == 0, two("a@b.c", "d@e.f")).otherwise(two()).alias("emails"), two().alias("phones"), none.alias("status"), none.alias("notes"), none.alias("read_at"), F.col("o_orderdate").alias("found_at"), F.when(k % 7 == 0, "x").alias("discarded_at"),
    )
    scores = t(spark, d, "orders").filter(k % 4 == 0).select(F.lit(1).alias("project_id"), F.concat(F.lit("a"), k).alias("apex"), F.lit(5).alias("best_fit"), none.alias("tier"), none.alias("confidence"), (k % 8 == 0).alias("wrong_type"), none.alias("hook"), none.alias("advice"))
    return flows.lead_export_rows(leads, scores, limit=400).select("dominio", "site", "situacao", "emails", "nota", "ramo_errado")


# ---------------------------------------------------------------- names, numbers and lists


@query("""SELECT p_partkey, p_name || ' Souza Lima' AS bare, CASE WHEN p_partkey % 2 = 0 THEN '"' || p_name || ' Souza Lima" Santos SP' END AS said, CASE WHEN p_partkey % 3 = 0 THEN 'ana-' || p_partkey END AS slug, p_partkey % 4 = 0 AS entity, 'Padaria de ' || p_type || '|bolos' AS terms,
sha256('p' || p_partkey)[1:16] AS sha FROM part""")
def name_helpers(spark, d):
    p, k = t(spark, d, "part"), F.col("p_partkey")
    full = F.concat(F.when(k % 2 == 0, "12.345.678 ").otherwise(""), F.col("p_name"), F.lit(" Souza Lima"), F.when(k % 5 == 0, " 123456").otherwise(""))
    short = F.when(k % 2 == 0, full).otherwise("Ana da Silva")
    slug = F.concat(F.when(k % 3 == 0, "https://br.linkedin.com/in/Ana-").otherwise("https://linkedin.com/company/x-"), k, F.lit("/x"))
    title = F.when(k % 4 == 0, F.concat("p_name", F.lit(" Padaria | LinkedIn"))).otherwise("Outra Empresa | LinkedIn")
    label = F.concat(F.lit("1091 — Padaria de "), F.col("p_type"), F.lit(" (com venda); bolos; x"))
    return p.select(
        "p_partkey", names.strip_registry_numbers(full).alias("bare"), names.search_query(short, F.lit("x"), F.lit("Santos"), F.lit("SP")).alias("said"), web.profile_slug(slug).alias("slug"),
        names.entity_title_matches(title, F.concat(F.upper("p_name"), F.lit(" PADARIA LTDA")), F.lit(None).cast("string")).alias("entity"), F.array_join(names.terms_from_label(label), "|").alias("terms"), candidate.prompt_sha(F.concat(F.lit("p"), k)).alias("sha"),
    )


@query("""SELECT o_orderkey, CASE WHEN v THEN b ELSE '' END AS numbers FROM (SELECT o_orderkey, b || d1 || d2 AS b, o_orderkey % 2 = 0 AS v FROM (SELECT *, CASE WHEN s1 % 11 < 2 THEN 0 ELSE 11 - s1 % 11 END AS d1, CASE WHEN (s2 + 2 * CASE WHEN s1 % 11 < 2 THEN 0 ELSE 11 - s1 % 11 END) % 11 < 2 THEN 0 ELSE 11 - (s2 + 2 * CASE WHEN s1 % 11 < 2 THEN 0 ELSE 11 - s1 % 11 END) % 11 END AS d2 FROM (
SELECT o_orderkey, b, list_sum(list_transform(range(12), lambda i: b[i + 1]::INTEGER * ((11 - i) % 8 + 2)))::INTEGER AS s1, list_sum(list_transform(range(12), lambda i: b[i + 1]::INTEGER * ((12 - i) % 8 + 2)))::INTEGER AS s2
FROM (SELECT o_orderkey, lpad((o_orderkey * 7919 + 11222333)::VARCHAR, 8, '0') || '0001' AS b FROM orders))))""")
def numbers_in_hits(spark, d):
    """Registry numbers that a hit states: sound ones only, formatted or not."""
    k = F.col("o_orderkey")
    base = F.concat(F.lpad((k * 7919 + 11222333).cast("string"), 8, "0"), F.lit("0001"))
    digit = lambda c, n: F.pmod(sum((F.substring(c, i + 1, 1).cast("int") * ((n - 1 - i) % 8 + 2) for i in range(n)), F.lit(0)), F.lit(11))
    last = lambda c, n: F.when(digit(c, n) < 2, 0).otherwise(11 - digit(c, n)).cast("string")
    made = t(spark, d, "orders").withColumn("b", base).withColumn("b", F.concat("b", last(F.col("b"), 12))).withColumn("b", F.concat("b", last(F.col("b"), 13)))
    wrong = F.concat(F.left("b", F.lit(12)), F.when(F.substring("b", 13, 1) == "1", "2").otherwise("1"), F.substring("b", 14, 1))
    number = F.when(k % 2 == 0, F.col("b")).otherwise(wrong)
    shown = F.when(k % 3 == 0, F.regexp_replace(number, r"^(\d\d)(\d{3})(\d{3})(\d{4})(\d\d)$", "$1.$2.$3/$4-$5")).otherwise(number)
    return made.select("o_orderkey", F.array_join(registry.cnpjs_in(F.lit("CNPJ"), F.concat(F.lit("n "), shown, F.lit("."))), ",").alias("numbers"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'a,b,' || c_custkey ELSE 'a,b' END AS merged, CASE least(c_custkey % 6, 3) WHEN 0 THEN 15 WHEN 1 THEN 15 WHEN 2 THEN 60 ELSE 240 END AS minutes, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE c_custkey * 32.0 / 1000 END AS cost,
CASE c_custkey % 3 WHEN 0 THEN 'Padaria — pão' WHEN 1 THEN 'Pão' END AS declared FROM customer""")
def list_helpers(spark, d):
    k = F.col(K)
    facts = F.struct(F.when(k % 3 == 0, "padaria").alias("name"), F.when(k % 3 == 0, "pão").when(k % 3 == 1, "Pão").alias("description"))
    made = customers(spark, d).withColumn("f", facts)
    return made.select(
        K, F.array_join(web.merge_contacts(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.when(k % 2 == 0, k.cast("string")).otherwise("a"))), ",").alias("merged"), store.cooldown_minutes(k % 6).alias("minutes"),
        enrichment.estimate_cost(F.when(k % 4 != 0, F.lit(32.0)), k).alias("cost"), P.structured_text(F.when(k % 3 == 0, " Padaria "), "f").alias("declared"),
    )


# ---------------------------------------------------------------- the store


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS body FROM orders WHERE NOT (o_orderkey % 3 = 1 AND o_orderkey % 2 = 0) AND (o_orderkey % 3 = 0 OR o_orderkey % 5 <> 0)")
def impressions_blank_deletes(spark, d):
    k = F.col("o_orderkey")
    old = t(spark, d, "orders").filter(k % 5 != 0).select("o_orderkey", F.lit("old").alias("body"))
    new = t(spark, d, "orders").filter((k % 3 == 0) | ((k % 3 == 1) & (k % 2 == 0))).select("o_orderkey", F.when(k % 3 == 0, "new").otherwise("  ").alias("body"))
    return store.set_impressions(old, new, ["o_orderkey"], [F.col("body")])


@query("""SELECT o_orderkey AS cnpj, CASE WHEN o_orderkey % 4 = 0 THEN 'there' END AS name, CASE WHEN o_orderkey % 6 = 0 THEN 'own' WHEN o_orderkey % 2 = 0 THEN 's' || o_orderkey END AS site FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 2 = 0""")
def promote_leads(spark, d):
    """Matched leads become companies; a crawl comes along where the company has none."""
    k, one = F.col("o_orderkey"), F.lit(1).alias("project_id")
    o = t(spark, d, "orders")
    leads = o.select(one, F.concat(F.lit("a"), k).alias("apex"), F.when(k % 2 == 0, k).alias("matched_cnpj"))
    companies = o.filter(k % 4 == 0).select(one, k.alias("cnpj"), F.lit("there").alias("name"))
    crawls = o.filter(k % 6 == 0).select(k.alias("cnpj"), F.lit("own").alias("site"))
    lead_crawls = o.select(F.concat(F.lit("a"), k).alias("apex"), F.concat(F.lit("s"), k).alias("site"))
    made, read = store.promote(leads, companies, crawls, lead_crawls)
    return made.join(read, "cnpj", "left").select("cnpj", "name", "site")


@query("SELECT o_orderkey AS cnpj, o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 5 = 1 AS due, CASE WHEN o_orderkey % 2 = 0 THEN 'cannot_determine' END AS confidence FROM orders")
def scoring_selection(spark, d):
    """What is to be scored: unscored, failed or picked; and the rows of what can't be read."""
    k, one = F.col("o_orderkey"), F.lit(1).alias("project_id")
    o = t(spark, d, "orders")
    companies = o.select(one, k.alias("cnpj"), F.when(k % 2 == 1, "text").otherwise(" ").alias("excerpt"))
    scores = o.filter(k % 3 != 0).select(one, k.alias("cnpj"), F.when(k % 7 == 0, "failed").alias("error"))
    due = flows.to_score(companies, scores, o.filter(k % 5 == 1).select(k.alias("cnpj"))).select("cnpj", F.lit(True).alias("due"))
    unread = store.cannot_determine(companies, flows.is_readable(F.col("excerpt"))).select("cnpj", "confidence")
    return companies.select("cnpj").join(due, "cnpj", "left").join(unread, "cnpj", "left").withColumn("due", F.coalesce("due", F.lit(False)))


@query("""SELECT p, n FROM (SELECT concat_ws(' ', CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, 'SP') AS p, count(*) AS n FROM customer GROUP BY 1)""")
def places_counted(spark, d):
    rows = customers(spark, d).select(F.when(F.col(K) % 3 != 0, F.col("c_mktsegment")).alias("municipio"), F.lit("SP").alias("uf"))
    return flows.place_tally(rows).select(F.col("place").alias("p"), F.col("count").alias("n"))


@query("""SELECT user_id AS cnpj, event_id AS url FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rn FROM events WHERE event_type = 'click') WHERE rn = 1""")
def crawl_first_site(spark, d):
    hits = t(spark, d, "events").select(F.col("user_id").alias("cnpj"), F.when(F.col("event_type") == "click", "site").otherwise("social").alias("kind"), F.col("value").alias("position"), F.col("event_id").alias("url"))
    return store.crawl_urls(hits).select("cnpj", "url")


@query("""SELECT o_orderkey AS cnpj, 1 AS searched, o_orderkey % 4 = 0 AS improved FROM orders WHERE o_orderkey % 2 = 0 ORDER BY o_orderkey LIMIT 120""")
def reprocess_pending(spark, d):
    k = F.col("o_orderkey")
    pending = t(spark, d, "orders").select(k.alias("cnpj"), (k % 2 == 1).alias("already_searched"))
    outcomes = t(spark, d, "orders").select(k.alias("cnpj"), F.when(k % 4 == 0, "ok").otherwise("empty").alias("status"))
    due, improved = enrichment.reprocess(pending, outcomes, False, 120)
    return due.select("cnpj").join(improved.select("cnpj", F.lit(True).alias("improved")), "cnpj", "left").select("cnpj", F.lit(1).alias("searched"), F.coalesce("improved", F.lit(False)).alias("improved"))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE c_custkey % 2 = 0) AS never_searched, count(*) FILTER (WHERE c_custkey % 6 = 0) AS searchable FROM customer""")
def search_counters(spark, d):
    k = F.col(K)
    rows = customers(spark, d).select((k % 2 != 0).alias("already_searched"), F.when(k % 3 == 0, "ANA SOUZA LIMA").otherwise("ANA SOUZA").alias("razao_social"), F.lit("x").alias("nome_fantasia"), F.lit("Santos").alias("municipio"), F.lit("SP").alias("uf"))
    return enrichment.search_pending(rows)

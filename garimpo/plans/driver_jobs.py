"""The driver's queries over names, jobs and stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions import spec
from ..operators import discovery, filters, keyed, textindex
from ..operators.filters import CompanyFilters
from ..streaming import continuous, loop, progress
from . import enrichment, etl, flows
from .driver import _CLEAN, _STORE, EST, activities, cities, dealt, est, query, raw_lines, store_tables, t

DIGITS, LETTERS = "0123456789", "BCDFGHJKLM"


def lettered(c):
    """A number as letters that no legal form or particle is made of."""
    return F.concat(F.lit("Q"), F.translate(c.cast("string"), DIGITS, LETTERS))


@query(f"""WITH n AS (SELECT p_partkey AS k, upper(p_name) AS name FROM part),
a AS (SELECT k, name || ' Q' || translate(k::VARCHAR, '{DIGITS}', '{LETTERS}') AS full_name FROM n),
b AS (SELECT k, name || ' Q' || translate((k // 10)::VARCHAR, '{DIGITS}', '{LETTERS}') AS full_name FROM n)
SELECT a.k AS apex, b.k AS cnpj FROM a JOIN b ON starts_with(a.full_name, b.full_name) OR starts_with(b.full_name, a.full_name)
UNION SELECT 3 * k, k FROM n WHERE k % 7 = 0 AND 3 * k >= 100 AND 3 * k IN (SELECT k FROM n)""")
def name_prefix_pairs(spark, d):
    """Candidates and companies whose names begin with each other; all begin with the same few words. A seventh of the companies also goes by the one word of a candidate's address."""
    k, name = F.col("p_partkey"), F.upper("p_name")
    p = t(spark, d, "part")
    candidates = p.select(k.alias("apex"), F.concat(name, F.lit(" "), lettered(k)).alias("name"), F.when(k % 7 == 0, F.concat(F.lit("https://www."), F.lower(lettered(k)), F.lit("x.com.br/"))).alias("website_url"))
    alone = F.when(k % 7 == 0, F.concat(lettered(3 * k), F.lit("X COMERCIO LTDA")))
    companies = p.select(k.alias("cnpj"), F.concat(name, F.lit(" "), lettered(F.floor(k / 10)), F.lit(" LTDA")).alias("razao_social"), alone.alias("nome_fantasia"))
    return enrichment.pair_by_name(candidates, companies)


# ---------------------------------------------------------------- streams


def sliced(df: DataFrame, path: str, at: str, key: str, slices: int, files: int = 2) -> None:
    """Rows in the order of ``at`` as slices that come one after the other, each of ``files`` files at most; all of a key's rows of a slice lie in one file."""
    low, high = df.agg(F.min(at), F.max(at)).first()
    step = ((high or 0) - (low or 0)) // slices + 1
    for i in range(slices):
        part = df.filter(F.col(at).between((low or 0) + i * step, (low or 0) + (i + 1) * step - 1))
        part.repartition(files, key).write.mode("append").parquet(path)


_LOOP = """WITH e AS (SELECT user_id AS project_id, event_id AS position, CASE WHEN event_type = 'view' THEN 'no_site' WHEN event_type <> 'error' THEN 'scored' WHEN event_id % 211 = 0 THEN 'daily' WHEN event_id % 7 = 0 THEN 'transient' ELSE 'error' END AS outcome FROM events),
s AS (SELECT *, count(*) FILTER (WHERE outcome <> 'no_site') OVER w AS spent, count(*) FILTER (WHERE outcome = 'scored') OVER w AS scored, count(*) FILTER (WHERE outcome = 'no_site') OVER w AS no_site, row_number() OVER w AS done FROM e WINDOW w AS (PARTITION BY project_id ORDER BY position)),
f AS (SELECT *, count(*) FILTER (WHERE outcome = 'error') OVER w AS failures, count(*) FILTER (WHERE outcome = 'transient') OVER w AS waits, spent - (outcome <> 'no_site')::INT AS before FROM s WINDOW w AS (PARTITION BY project_id, scored ORDER BY position)),
r AS (SELECT *, CASE WHEN before >= 30 THEN 'budget' WHEN outcome = 'daily' THEN 'daily limit' WHEN outcome = 'transient' AND waits > 8 THEN 'waits' WHEN outcome = 'error' AND failures >= 3 THEN 'failures' END AS stopped FROM f),
x AS (SELECT project_id, min(position) FILTER (WHERE stopped IS NOT NULL) AS stop FROM r GROUP BY project_id)
"""


@query(_LOOP + """SELECT r.project_id::VARCHAR AS project_id, CASE WHEN stopped = 'budget' THEN before ELSE spent END AS spent, scored - (coalesce(stopped, '') = 'budget' AND outcome = 'scored')::INT AS scored,
no_site - (coalesce(stopped, '') = 'budget' AND outcome = 'no_site')::INT AS no_site, done - (stopped IS NOT NULL)::INT AS done, coalesce(stopped, 'no more rows') AS stopped
FROM r JOIN x USING (project_id) WHERE position = coalesce(stop, (SELECT max(position) FROM e WHERE e.project_id = r.project_id))""")
def continuous_stops(spark, d):
    """Each user's events as matches of a project, pulled in five slices: what stopped the loop, and what it had spent and scored by then."""
    work = f"{continuous.shared(spark)}/loop-{uuid.uuid4().hex}"
    k, kind = F.col("event_id"), F.col("event_type")
    error = F.when(kind == "error", F.when(k % 211 == 0, "daily quota reached").when(k % 7 == 0, "429 Too Many Requests").otherwise("invalid key"))
    matches = t(spark, d, "events").select(F.col("user_id").alias("project_id"), k.alias("position"), k.cast("string").alias("cnpj"), (kind != "view").alias("evidence"), error.alias("error"))
    sliced(matches, f"{work}/in", "position", "project_id", 5, max(2, spark.sparkContext.defaultParallelism))  # by all cores
    files = len(spark.read.schema(matches.schema).parquet(f"{work}/in").inputFiles())
    stream = continuous.stream_parquet(spark, f"{work}/in", matches.schema, max(1, -(-files // 5)))  # as many batches as slices, however many files
    loop.start(spark, loop.pull(stream, budget=30), f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return loop.stops(spark.read.parquet(f"{work}/out"))


@query("""SELECT count(*) AS read, count(*) FILTER (WHERE reason IS NULL) AS kept, count(*) FILTER (WHERE reason = 'refused') AS refused, count(*) FILTER (WHERE reason = 'no value') AS no_value, count(*) FILTER (WHERE reason IS NULL) AS written
FROM (SELECT CASE WHEN event_type = 'error' THEN 'refused' WHEN value < 20 THEN 'no value' END AS reason FROM events)""")
def job_progress(spark, d):
    """A row a batch of what was read, kept and dropped by reason, counted as the batch is written; added up over all batches."""
    work = f"{continuous.shared(spark)}/progress-{uuid.uuid4().hex}"
    source = t(spark, d, "events").select("event_id", "event_type", "value")
    source.repartition(6, "event_id").write.parquet(f"{work}/in")
    stream = continuous.stream_parquet(spark, f"{work}/in", source.schema, 2)
    reason = F.when(F.col("event_type") == "error", "refused").when(F.col("value") < 20, "no value")
    progress.finish(*progress.run_counted(progress.counted(stream, reason, ["refused", "no value"]), f"{work}/out", f"{work}/progress", f"{work}/checkpoint"))
    total = progress.read_progress(spark, f"{work}/progress").agg(F.sum("read").alias("read"), F.sum("kept").alias("kept"), F.sum(F.col("dropped")["refused"]).alias("refused"), F.sum(F.col("dropped")["no value"]).alias("no_value"), F.lit(1).alias("_one"))
    return total.join(spark.read.parquet(f"{work}/out").agg(F.count("*").alias("written"), F.lit(1).alias("_one")), "_one").drop("_one")


@query(_CLEAN + """SELECT (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) AS read, count(*) AS kept, CAST(0 AS BIGINT) AS with_phone, count(*) AS with_email, count(codes) AS with_secondary,
CAST(coalesce(sum(len(string_split(codes, ','))), 0) AS BIGINT) AS codes, count(*) AS written FROM c""")
def etl_convert_counted(spark, d):
    """The conversion's numbers, counted by the pass that writes the registry, beside the rows that were written."""
    path = f"{continuous.shared(spark)}/convert-{uuid.uuid4().hex}"
    none = spark.createDataFrame([], "value string")
    found = etl.convert(raw_lines(spark, d), etl.companies(none), etl.tax_regimes(none), path)
    names = ["read", "kept", "with_phone", "with_email", "with_secondary", "codes"]
    counted = spark.createDataFrame([tuple(found[n] for n in names)], ", ".join(f"{n} long" for n in names)).withColumn("_one", F.lit(1))
    return counted.join(spark.read.parquet(path).agg(F.count("*").alias("written"), F.lit(1).alias("_one")), "_one").drop("_one")


# ---------------------------------------------------------------- stored tables


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 97 = 5 THEN 'new' ELSE o_orderpriority END AS status, CASE WHEN o_orderkey % 97 = 5 THEN -o_orderkey ELSE o_custkey END AS amount FROM orders
UNION ALL SELECT -o_orderkey, 'new', o_orderkey FROM orders WHERE o_orderkey % 97 = 6""")
def upsert_by_bucket(spark, d):
    """A stored table after an upsert of one key in fifty, some of them new: only the buckets that these fall into are written anew."""
    path, o, k = f"{continuous.shared(spark)}/keyed-{uuid.uuid4().hex}", t(spark, d, "orders"), F.col("o_orderkey")
    keyed.write(o.select(k.alias("id"), F.col("o_orderpriority").alias("status"), F.col("o_custkey").alias("amount")), path, ["id"], 32)
    changed = o.filter(k % 97 == 5).select(k.alias("id"), F.lit("new").alias("status"), (-k).alias("amount"))
    added = o.filter(k % 97 == 6).select((-k).alias("id"), F.lit("new").alias("status"), k.alias("amount"))
    earlier = changed.withColumn("status", F.lit("old"))
    keyed.upsert(spark, path, changed.unionByName(added).unionByName(earlier), ["id"], [F.col("status")])
    return keyed.read(spark, path)


_LISTED = _STORE + """, c AS (SELECT companies.*, lpad(o_custkey::VARCHAR, 7, '0') AS cnae, o_orderstatus AS uf, o_orderdate AS founded FROM companies JOIN orders ON cnpj = o_orderkey::VARCHAR),
contacts AS (SELECT l_orderkey::VARCHAR AS cnpj, list('+55' || l_partkey ORDER BY l_linenumber % 2 = 0, '+55' || l_partkey) AS contacts FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1),
j AS (SELECT c.*, final_url, website_url, best_fit, status, body, crawls.cnpj IS NOT NULL AS crawled, scores.cnpj IS NOT NULL AS scored FROM c LEFT JOIN crawls USING (cnpj) LEFT JOIN places USING (cnpj)
 LEFT JOIN scores USING (cnpj, project_id) LEFT JOIN leads USING (cnpj, project_id) LEFT JOIN impressions USING (cnpj, project_id)),
p AS (SELECT 'by score' AS list, * FROM (SELECT * FROM j WHERE coalesce(status, 'none') IN ('none', 'won') AND cnae LIKE '0000%' ORDER BY best_fit DESC NULLS LAST, cnpj LIMIT 150)
UNION ALL SELECT 'by founding', * FROM (SELECT * FROM j WHERE uf = 'F' AND NOT scored ORDER BY founded DESC NULLS LAST, cnpj LIMIT 150)
UNION ALL SELECT 'by name', * FROM (SELECT * FROM j WHERE contains(lower(coalesce(nome_fantasia, '') || '  ' || cnpj), '5-low') AND NOT crawled AND scored ORDER BY nome_fantasia ASC NULLS FIRST, cnpj LIMIT 150))
"""


@query(_LISTED + """SELECT list, cnpj, nome_fantasia, final_url, website_url, best_fit, status, body, array_to_string(coalesce(contacts, []), ' ') AS phones, CASE WHEN email LIKE '%@firma%' THEN 'https://' || split_part(email, '@', 2) END AS guessed_site FROM p LEFT JOIN contacts USING (cnpj)""")
def company_pages(spark, d):
    """Three lists over tables bucketed by number, by each order, with named filters; the joins need no shuffle."""
    work, mark = f"{continuous.shared(spark)}/lists-{uuid.uuid4().hex}", uuid.uuid4().hex
    tables, o, k = store_tables(spark, d), t(spark, d, "orders"), F.col("o_orderkey")
    more = o.select(k.cast("string").alias("cnpj"), F.lpad(F.col("o_custkey").cast("string"), 7, "0").alias("cnae"), F.col("o_orderstatus").alias("uf"), F.lit(None).cast("string").alias("razao_social"), F.col("o_orderdate").alias("data_inicio_atividade"))
    tables["companies"] = tables["companies"].join(more, "cnpj")
    tables["contacts"] = t(spark, d, "lineitem").filter("l_linenumber <= 3").select(F.col("l_orderkey").cast("string").alias("cnpj"), F.concat(F.lit("+55"), "l_partkey").alias("phone_e164"), F.when(F.col("l_linenumber") % 2 == 1, "site").otherwise("registry").alias("source"))
    laid = {n: keyed.save_bucketed(df, f"list_{n}_{mark}", "cnpj", 8, f"{work}/{n}") for n, df in tables.items()}
    page = lambda name, f, order: flows.company_page(laid, 1, f, order, 150).select(F.lit(name).alias("list"), "cnpj", "nome_fantasia", "final_url", "website_url", "best_fit", "status", "body", F.array_join("contacts", " ").alias("phones"), "guessed_site")
    lists = [page("by score", flows.ListFilters(flags=("none", "won"), cnae="0000"), "score"), page("by founding", flows.ListFilters(uf="f", processed=False), "founded"), page("by name", flows.ListFilters(q="5-LOW", crawled=False, scored=True), "name")]
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


# ---------------------------------------------------------------- seeks and lookups


@query(EST + """, r AS (SELECT 'capital-desc' AS list, cnpj, row_number() OVER (ORDER BY capital_social DESC NULLS LAST, cnpj) AS n FROM est WHERE uf IN ('O', 'P')
UNION ALL SELECT 'name', cnpj, row_number() OVER (ORDER BY coalesce(nome_fantasia, CASE WHEN o2.o_orderkey % 2 = 0 THEN razao_social END) NULLS LAST, cnpj) FROM est JOIN orders o2 ON cnpj = o2.o_orderkey::VARCHAR)
SELECT list, cnpj, CAST((n - 1) // 200 AS INTEGER) AS page FROM r WHERE n <= 1000""")
def pages_by_token(spark, d):
    """Five pages of two hundred, each from where the one before ended: by capital, and by name with many ties."""
    companies = enrichment._written(est(spark, d), "registry")  # joined once; each order then samples and sorts the file
    named = companies.withColumn("razao_social", F.when(F.col("cnpj").cast("long") % 2 == 0, F.col("razao_social")))
    work, out = f"{continuous.shared(spark)}/ordered-{uuid.uuid4().hex}", None
    for order, df, f in (("capital-desc", companies, CompanyFilters(uf=["O", "P"])), ("name", named, CompanyFilters())):
        etl.write_sorted(df, f"{work}/{order}", discovery.ordering(order))
        rows, after = spark.read.parquet(f"{work}/{order}"), None
        for n in range(5):
            page = discovery.list_companies(rows, activities(spark, d), cities(spark, d), f, order, 200, after=after)
            told = page.select(F.lit(order).alias("list"), "cnpj", F.lit(n).alias("page"))
            out = told if out is None else out.unionByName(told)
            after = discovery.page_token(page, order)
            if after is None:
                break
    return out


@query(EST + """, x AS (SELECT cnpj, row_number() OVER (ORDER BY cnpj) AS n FROM est), p AS (SELECT cnpj AS ref, logradouro, numero, uf FROM est WHERE cnpj IN (SELECT cnpj FROM x WHERE n <= 40)),
h AS (SELECT ref, e.cnpj, row_number() OVER (PARTITION BY ref ORDER BY e.cnpj) AS k FROM p JOIN est e ON e.numero = p.numero AND e.uf = p.uf AND ends_with(e.logradouro, split_part(p.logradouro, ' ', 3)))
SELECT ref, count(*) > 12 AS ambiguous, array_to_string(list(cnpj ORDER BY cnpj) FILTER (WHERE k <= 12), ' ') AS cnpjs, any_value(e.email) AS email FROM h JOIN (SELECT cnpj AS ref, email FROM est) e USING (ref) GROUP BY ref""")
def point_lookups(spark, d):
    """The first forty establishments by number, and who shares their address, by filters that reach the sorted files."""
    work = f"{continuous.shared(spark)}/lookups-{uuid.uuid4().hex}"
    registry = est(spark, d)
    etl.write_establishments(registry, f"{work}/est")
    etl.write_sorted(discovery.address_index(registry), f"{work}/addresses", ["uf", "numero", "cnpj"])
    stored = spark.read.parquet(f"{work}/est")
    known = [r[0] for r in stored.select("cnpj").orderBy("cnpj").limit(40).collect()]
    found = discovery.by_numbers_pushed(stored, known)
    probes = [tuple(r) for r in found.select("cnpj", "logradouro", "numero", "uf").collect()]
    at = discovery.find_by_address_pushed(spark.read.parquet(f"{work}/addresses"), probes)
    return at.join(found.select(F.col("cnpj").alias("ref"), "email"), "ref").select("ref", "ambiguous", F.array_join("cnpjs", " ").alias("cnpjs"), "email")


# ---------------------------------------------------------------- profiles


@query("""WITH k AS (SELECT c_custkey AS n, c_custkey % 7 AS m FROM customer)
SELECT n AS c_custkey, CASE m WHEN 0 THEN '' WHEN 1 THEN 'spec: esperava um objeto' WHEN 2 THEN 'buyer: texto obrigatório; rubric.axes: nenhum eixo válido' WHEN 3 THEN 'targeting.ufs: esperava uma lista' WHEN 4 THEN 'rubric.axes: esperava uma lista' WHEN 5 THEN 'rubric.axes.fit.question: texto obrigatório' ELSE 'probe.terms: esperava uma lista' END AS faults,
CASE WHEN m = 0 THEN lpad(n::VARCHAR, 7, '0') || ' 85' END AS codes, CASE WHEN m = 0 THEN least(12, n % 20)::INTEGER END AS probes, CASE WHEN m = 0 THEN n::DOUBLE END AS min_capital FROM k""")
def project_specs(spark, d):
    """A profile of each customer, some sound and some with a fault of their own: the faults by path, and what a sound one holds."""
    n, m = F.col("c_custkey"), F.col("c_custkey") % 7
    levels = ", ".join(f'"{i}": "nível {i}"' for i in range(1, 6))
    axis = F.concat(F.lit('{"key": "Fit", "anchors": {'), F.lit(levels), F.lit("}"), F.when(m == 5, "").otherwise(', "question": "Precisa?"'), F.lit("}"))
    axes = F.when(m == 2, "[]").when(m == 4, '"none"').otherwise(F.concat(F.lit("["), axis, F.lit("]")))
    probe = lambda i: F.concat(F.lit('{"key": "p'), i.cast("string"), F.lit('", "terms": '), F.when(m == 6, '"portal"').otherwise('["portal"]'), F.lit("}"))
    probes = F.concat(F.lit("["), F.array_join(F.when((m == 6) | (n % 20 > 0), F.transform(F.sequence(F.lit(1), F.greatest(n % 20, F.lit(1)).cast("int")), probe)).otherwise(F.array().cast("array<string>")), ", "), F.lit("]"))
    targeting = F.concat(F.lit('{"cnaePrefixes": ["'), F.lpad(n.cast("string"), 7, "0"), F.lit('", "8-5", "x"], "ufs": '), F.when(m == 3, '"SP"').otherwise('["sp"]'), F.lit(', "minCapitalSocial": '), n.cast("string"), F.lit("}"))
    whole = F.concat(F.lit('{"summary": "s", "problem": "p", "buyer": '), F.when(m == 2, '" "').otherwise('"b"'), F.lit(', "targeting": '), targeting, F.lit(', "probes": '), probes, F.lit(', "rubric": {"axes": '), axes, F.lit("}}"))
    out = spec.parse_specs(dealt(spark, d, "customer", "c_custkey").select("c_custkey", F.when(m == 1, "[1]").otherwise(whole).alias("spec")))
    told = F.array_join(F.transform("faults", lambda f: F.concat(f["path"], F.lit(": "), f["message"])), "; ")
    return out.select("c_custkey", told.alias("faults"), F.array_join("parsed.targeting.cnae_prefixes", " ").alias("codes"), F.when(F.col("parsed").isNotNull(), F.size("parsed.probes")).alias("probes"), F.col("parsed.targeting.min_capital").alias("min_capital"))


# ---------------------------------------------------------------- text index


@query(EST + """SELECT '#0000001' AS q, cnpj FROM est WHERE contains(lower(coalesce(nome_fantasia, '') || chr(10) || razao_social), '#0000001') UNION ALL SELECT 'ER#000000012', cnpj FROM est WHERE contains(lower(coalesce(nome_fantasia, '') || chr(10) || razao_social), 'er#000000012')
UNION ALL SELECT '33', cnpj FROM est WHERE contains(lower(coalesce(nome_fantasia, '') || chr(10) || razao_social), '33')""")
def substring_index(spark, d):
    """Companies whose names hold a text: one with many hits, one with few, and one too short for the index."""
    path = f"{continuous.shared(spark)}/grams-{uuid.uuid4().hex}"
    registry = enrichment._written(est(spark, d).select("cnpj", "nome_fantasia", "razao_social"), "names")  # joined once; the index and three searches read the file
    textindex.write(registry, path, ["nome_fantasia", "razao_social"])
    out = None
    for q in ("#0000001", "ER#000000012", "33"):
        f = CompanyFilters(q=q)
        found = filters.apply(textindex.narrowed(registry, path, f.q), f).select(F.lit(q).alias("q"), "cnpj")
        out = found if out is None else out.unionByName(found)
    return out

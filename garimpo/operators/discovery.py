"""Discovery queries over the registry: pages, reach, dictionary, batch lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.registry import classify_phone, derive_address, wa_me_link
from ..functions.text import digits, fold
from .filters import CompanyFilters, apply, prefix_match

LIMIT_DEFAULT, LIMIT_MOST = 50, 1000
MIN_STREET_CHARS, AMBIGUOUS_AT = 4, 12
#: Parts that the establishments of one address are dealt to before their smallest numbers are picked.
ADDRESS_SALTS = 64

ORDERS = {
    "founded-desc": ("data_inicio_atividade", "desc"),
    "founded-asc": ("data_inicio_atividade", "asc"),
    "name": ("_name", "asc"),
    "capital-desc": ("capital_social", "desc"),
}


def clamp(n: int | None, least: int, most: int, default: int) -> int:
    return default if n is None else max(least, min(most, int(n)))


def _ordered_by(order: str) -> tuple[Column, str]:
    name, way = ORDERS[order]
    return F.coalesce("nome_fantasia", "razao_social") if name == "_name" else F.col(name), way


def ordering(order: str) -> list[Column]:
    """Nulls last always; the number breaks ties, so that pages are stable."""
    c, way = _ordered_by(order)
    return [c.desc_nulls_last() if way == "desc" else c.asc_nulls_last(), F.col("cnpj").asc()]


def beyond(order: str, token: tuple) -> Column:
    """Rows that come after ``token`` = (order value, number) of the last row seen. The comparisons reach the Parquet scan, so row groups that lie before it are skipped."""
    c, way = _ordered_by(order)
    value, number = token
    later = F.col("cnpj") > F.lit(number)
    if value is None:  # among the last rows, which have no value
        return c.isNull() & later
    v = F.lit(value)
    return (c < v if way == "desc" else c > v) | ((c == v) & later) | c.isNull()


def page_token(page: DataFrame, order: str) -> tuple | None:
    """Where the next page begins: (order value, number) of the page's last row; none if the page is empty. A page is at most ``LIMIT_MOST`` rows."""
    c, _ = _ordered_by(order)
    last = page.select(c.alias("value"), "cnpj").tail(1)
    return tuple(last[0]) if last else None


def with_labels(companies: DataFrame, activities: DataFrame, cities: DataFrame) -> DataFrame:
    """Descriptions of the activity and the city. Both are left joins on code; Spark broadcasts a dictionary if its size allows."""
    a = activities.select(F.col("codigo").alias("cnae_principal"), F.col("descricao").alias("cnae_descricao"))
    c = cities.select(F.col("codigo").alias("municipio_rf"), F.col("descricao").alias("municipio"))
    return companies.join(a, "cnae_principal", "left").join(c, "municipio_rf", "left")


def with_match(companies: DataFrame, f: CompanyFilters) -> DataFrame:
    """Whether the primary activity matched or a secondary one, and the secondary codes that did."""
    if not (f.include_secondary and f.cnae):
        return companies.withColumn("cnae_match", F.lit("principal")).withColumn("cnae_secundaria_match", F.array().cast("array<string>"))
    found = F.coalesce(F.filter("cnae_secundaria", lambda x: prefix_match(x, f.cnae)), F.array().cast("array<string>"))
    return companies.withColumn("cnae_match", F.when(prefix_match("cnae_principal", f.cnae), "principal").otherwise("secundaria")).withColumn("cnae_secundaria_match", found)


def present(companies: DataFrame) -> DataFrame:
    """Read-time columns: the phone's class and link, the address's lines."""
    phone = classify_phone("ddd", "telefone")
    address = derive_address("tipo_logradouro", "logradouro", "numero", "complemento", "bairro", "municipio", "uf", "cep")
    return companies.withColumn("phone", phone).withColumn("wa_me", F.when(F.col("phone.is_mobile"), wa_me_link("phone.e164"))).withColumn("endereco", address)


def list_companies(companies: DataFrame, activities: DataFrame, cities: DataFrame, f: CompanyFilters = CompanyFilters(), order: str = "founded-desc", limit: int | None = None, offset: int = 0, exclude: DataFrame | None = None, after: tuple | None = None) -> DataFrame:
    """A ranked page. Only the page's rows meet the dictionaries and the derived columns. ``after`` is the :func:`page_token` of the page before: unlike an
    offset, whose rows are all sorted and carried, it is a filter."""
    companies = companies if after is None else companies.filter(beyond(order, after))
    page = apply(companies, f, exclude).orderBy(*ordering(order)).offset(max(0, offset)).limit(clamp(limit, 1, LIMIT_MOST, LIMIT_DEFAULT))
    return present(with_labels(with_match(page, f), activities, cities)).orderBy(*ordering(order))


def count_reach(companies: DataFrame, f: CompanyFilters, as_of: str, exclude: DataFrame | None = None) -> DataFrame:
    """One row: all, with phone, with e-mail, founded in the last 24 months, and the disjoint split by how the activity matched."""
    by_primary = prefix_match("cnae_principal", f.cnae) if f.include_secondary and f.cnae else F.lit(True)
    return apply(companies, f, exclude).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("ddd").isNotNull() & F.col("telefone").isNotNull()).alias("with_phone"),
        F.count_if(F.col("email").isNotNull()).alias("with_email"),
        F.count_if(F.col("data_inicio_atividade") >= F.add_months(F.lit(as_of).cast("date"), -24)).alias("recent"),
        F.count_if(by_primary).alias("principal"),
        F.count_if(~by_primary).alias("secundaria"),
    )


def cnae_reach(companies: DataFrame, codes: DataFrame, activities: DataFrame, as_of: str, f: CompanyFilters = CompanyFilters(), include_secondary: bool = True) -> DataFrame:
    """Reach of many codes in one job: (code, descricao, total, with_phone, with_email, recent, principal, secundaria).

    ``codes`` (pos, code) may be prefixes of 2 to 7 digits. Establishments are reduced to counts by activity first, and
    the prefixes meet those few rows; secondary codes are cut to each length, made distinct and counted
    where the primary activity hasn't counted already. Codes without any row stay, with zeros, in their order.
    """
    kept = apply(companies, f)
    phone = F.col("ddd").isNotNull() & F.col("telefone").isNotNull()
    recent = F.coalesce(F.col("data_inicio_atividade") >= F.add_months(F.lit(as_of).cast("date"), -24), F.lit(False))
    sums = [F.count("*").alias("n"), F.count_if(phone).alias("phone"), F.count_if(F.col("email").isNotNull()).alias("mail"), F.count_if(recent).alias("recent")]
    # only the lengths that are asked for: six values at most, whatever the number of codes
    asked = sorted(r[0] for r in codes.select(F.length("code")).distinct().collect() if 2 <= r[0] <= 7) or [7]
    lengths = F.array(*map(F.lit, asked))

    by_activity = kept.groupBy("cnae_principal").agg(*sums).withColumn("len", F.explode(lengths)).withColumn("pfx", F.left("cnae_principal", F.col("len")))
    primary = by_activity.filter(F.length("pfx") == F.col("len")).groupBy("pfx").agg(*[F.sum(c).alias(c) for c in ("n", "phone", "mail", "recent")])
    out = codes.join(primary, codes["code"] == primary["pfx"], "left").drop("pfx")
    if include_secondary:
        wanted = codes.select(F.col("code").alias("pfx")).distinct()
        cut = F.explode(F.array_distinct(F.flatten(F.transform(lengths, lambda n: F.transform("cnae_secundaria", lambda x: F.left(x, n))))))
        spread = kept.filter(F.size("cnae_secundaria") > 0).select("cnae_principal", phone.alias("p"), F.col("email").isNotNull().alias("m"), recent.alias("r"), cut.alias("pfx"))
        other = spread.filter(~F.col("cnae_principal").startswith(F.col("pfx"))).join(wanted, "pfx", "left_semi")
        other = other.groupBy("pfx").agg(F.count("*").alias("n2"), F.count_if("p").alias("phone2"), F.count_if("m").alias("mail2"), F.count_if("r").alias("recent2"))
        out = out.join(other, out["code"] == other["pfx"], "left").drop("pfx")
    else:
        out = out.select("*", *[F.lit(0).alias(c) for c in ("n2", "phone2", "mail2", "recent2")])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    named = describe(codes.select("code").distinct(), activities)
    return out.join(named, "code", "left").select(
        "pos", "code", "descricao", (zero("n") + zero("n2")).alias("total"), (zero("phone") + zero("phone2")).alias("with_phone"),
        (zero("mail") + zero("mail2")).alias("with_email"), (zero("recent") + zero("recent2")).alias("recent"), zero("n").alias("principal"), zero("n2").alias("secundaria"),
    ).orderBy("pos")


def secondary_reach(companies: DataFrame, codes: list[str], length: int) -> DataFrame:
    """(pfx, total, with_phone, with_email) over secondary codes cut to ``length``, where the primary doesn't match too."""
    n = clamp(length, 2, 7, 7)
    cut = companies.select("cnae_principal", "ddd", "telefone", "email", F.explode(F.array_distinct(F.transform("cnae_secundaria", lambda x: F.left(x, F.lit(n))))).alias("pfx"))
    new = ~F.col("cnae_principal").startswith(F.col("pfx"))
    return cut.filter(F.col("pfx").isin(codes)).groupBy("pfx").agg(F.count_if(new).alias("total"), F.count_if(new & F.col("ddd").isNotNull() & F.col("telefone").isNotNull()).alias("with_phone"), F.count_if(new & F.col("email").isNotNull()).alias("with_email"))


def describe(codes: DataFrame, activities: DataFrame) -> DataFrame:
    """(code, descricao): the exact description, else a roll-up of the first six children, else null."""
    # every code of the dictionary under each of its prefixes: an equality, not a prefix test of all against all
    spread = activities.withColumn("_pfx", F.explode(F.transform(F.sequence(F.lit(1), F.length("codigo")), lambda n: F.left("codigo", n))))
    exact = F.col("codigo") == F.col("_pfx")
    # a prefix keeps its exact row and its first six children, however many it has
    first = Window.partitionBy("_pfx", exact).orderBy(F.when(exact, F.col("descricao")).desc_nulls_last(), "codigo", "descricao")
    few = spread.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= 6)
    rolled = few.groupBy("_pfx").agg(
        F.max(F.when(exact, F.col("descricao"))).alias("exact"), F.sort_array(F.collect_list(F.when(~exact, F.struct("codigo", "descricao")))).alias("children"),
    )
    # the prefixes are several times the dictionary, which its size doesn't tell: never broadcast
    pairs = codes.distinct().join(rolled.hint("merge"), codes["code"] == rolled["_pfx"], "left").withColumn("children", F.coalesce("children", F.array().cast(rolled.schema["children"].dataType)))
    n, texts = F.size("children"), F.transform("children", lambda c: c["descricao"])
    many = F.concat(n.cast("string"), F.when(n >= 6, "+").otherwise(""), F.lit(" subclasses — "), F.array_join(F.slice(texts, 1, 3), "; "), F.when(n > 3, "; …").otherwise(""))
    return pairs.select("code", F.coalesce("exact", F.when(n == 1, F.get(texts, 0)).when(n > 1, many)).alias("descricao"))


def search_activities(activities: DataFrame, q: str, limit: int | None = None) -> DataFrame:
    """Codes that begin with the text, then descriptions that hold it, whatever the case and accents."""
    q = q.strip()
    if not q:
        return activities.limit(0)
    by_code = F.col("codigo").startswith(q)
    by_text = F.lower(fold("descricao")).contains(F.lower(fold(F.lit(q))))
    return activities.filter(by_code | by_text).orderBy(by_code.desc(), "codigo").limit(clamp(limit, 1, 200, 25))


def find_by_address(companies: DataFrame, probes: DataFrame) -> DataFrame:
    """(ref, skipped, ambiguous, cnpjs): establishments with a probe's number and state whose street ends with its last word.

    A probe that can't be asked says why: no number, a short street or no state, in this order. At most 12 numbers
    are listed, the smallest; a 13th makes the probe ambiguous. The registry is first reduced to the 13 smallest
    numbers of each (number, state, street's end) that is asked, which the probes then meet by equality.
    """
    p = probes.select("ref", digits(F.coalesce("numero", F.lit(""))).alias("_no"), F.coalesce(F.try_element_at(F.filter(F.split(F.coalesce("logradouro", F.lit("")), r"(?U)\s+"), lambda w: w != ""), F.lit(-1)), F.lit("")).alias("_street"), F.upper(F.coalesce("uf", F.lit(""))).alias("_uf"))
    skipped = F.when(F.col("_no") == "", "sem-numero").when(F.length("_street") < MIN_STREET_CHARS, "rua-curta").when(F.col("_uf") == "", "sem-uf")
    p = p.withColumn("skipped", skipped)
    there = companies.select("cnpj", digits("numero").alias("_n"), F.col("uf").alias("_u"), "logradouro")
    asked = p.filter("skipped is null")
    key = ["_no", "_uf", "_street"]
    wanted = asked.select(*key).distinct()
    ends = wanted.groupBy("_no", "_uf").agg(F.collect_set(F.length("_street")).alias("_lengths"))
    cut = there.join(ends, (there["_n"] == ends["_no"]) & (there["_u"] == ends["_uf"])).withColumn("_length", F.explode("_lengths")).filter(F.length("logradouro") >= F.col("_length"))
    cut = cut.select("cnpj", "_no", "_uf", F.expr("right(logradouro, _length)").alias("_street")).join(wanted, key, "left_semi")
    smallest = lambda df, *by: df.withColumn("_few", F.row_number().over(Window.partitionBy(*by).orderBy("cnpj"))).filter(F.col("_few") <= AMBIGUOUS_AT + 1)
    # in two steps, so that a frequent address doesn't meet in one task
    few = smallest(cut.withColumn("_salt", F.pmod(F.xxhash64("cnpj"), F.lit(ADDRESS_SALTS))), *key, "_salt")
    few = smallest(few, *key).select("cnpj", *key)
    hit = asked.join(few, key)
    ranked = hit.withColumn("_rank", F.row_number().over(Window.partitionBy("ref").orderBy("cnpj"))).filter(F.col("_rank") <= AMBIGUOUS_AT + 1)
    found = ranked.groupBy("ref").agg(F.sort_array(F.collect_list(F.when(F.col("_rank") <= AMBIGUOUS_AT, F.col("cnpj")))).alias("cnpjs"), (F.max("_rank") > AMBIGUOUS_AT).alias("ambiguous"))
    return p.select("ref", "skipped").join(found, "ref", "left").select("ref", "skipped", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), F.coalesce("cnpjs", F.array().cast("array<string>")).alias("cnpjs"))


def find_by_email_domain(companies: DataFrame, domains: DataFrame, limit: int = LIMIT_MOST) -> DataFrame:
    """Companies whose mail is at one of the ``domains`` (domain), newest first."""
    asked = domains.select(F.lower(F.trim("domain")).alias("_domain")).filter("_domain <> ''").distinct()
    return companies.withColumn("_domain", F.split_part(F.lower("email"), F.lit("@"), F.lit(2))).join(asked, "_domain", "left_semi").drop("_domain").orderBy(*ordering("founded-desc")).limit(limit)


def by_numbers(companies: DataFrame, numbers: DataFrame) -> DataFrame:
    """The companies with the given numbers (cnpj)."""
    return companies.join(numbers.select("cnpj").distinct(), "cnpj", "left_semi")


#: Values of one IN that Spark still passes to Parquet one by one, so that Bloom filters can tell; and keys of a point lookup at most.
IN_PUSHED, KEYS_AT_ONCE = 10, 1000


def by_numbers_pushed(companies: DataFrame, numbers: list[str]) -> DataFrame:
    """The companies with the given numbers, at most ``KEYS_AT_ONCE``, looked up by filters that reach the scan: row groups whose statistics and Bloom filters
    have none of them are never read. For longer lists :func:`by_numbers` joins."""
    asked = sorted(set(numbers))
    if len(asked) > KEYS_AT_ONCE:
        raise ValueError(f"more than {KEYS_AT_ONCE} numbers: use by_numbers")
    keep = F.lit(False)
    for i in range(0, len(asked), IN_PUSHED):
        keep |= F.col("cnpj").isin(asked[i : i + IN_PUSHED])
    return companies.filter(keep)


def address_index(companies: DataFrame) -> DataFrame:
    """(cnpj, uf, numero, logradouro): what :func:`find_by_address` asks of the registry, the number as digits. Written sorted by (uf, numero), it answers few probes from few row groups."""
    return companies.select("cnpj", "uf", digits("numero").alias("numero"), "logradouro").filter("numero <> '' and uf is not null and logradouro is not null")


def find_by_address_pushed(index: DataFrame, probes: list[tuple]) -> DataFrame:
    """:func:`find_by_address` of a few probes (ref, logradouro, numero, uf), at most ``KEYS_AT_ONCE``, on an :func:`address_index`: the probes' numbers and states reach the scan as filters."""
    if len(probes) > KEYS_AT_ONCE:
        raise ValueError(f"more than {KEYS_AT_ONCE} probes: use find_by_address")
    asked = sorted({("".join(ch for ch in p[2] or "" if ch in "0123456789"), (p[3] or "").upper()) for p in probes})
    by_state: dict[str, list[str]] = {}
    for number, state in asked:
        by_state.setdefault(state, []).append(number)
    keep = F.lit(False)
    for state, known in by_state.items():
        for i in range(0, len(known), IN_PUSHED):
            keep |= (F.col("uf") == state) & F.col("numero").isin(known[i : i + IN_PUSHED])
    return find_by_address(index.filter(keep), index.sparkSession.createDataFrame(probes, "ref string, logradouro string, numero string, uf string"))

"""Views and dataflows over the project store: lists, tallies, verdicts, scores, sweeps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import web
from ..functions.pages import json_ld, structured_text
from ..functions.registry import cnpjs_in, format_address, format_cep, website_from_email
from ..functions.text import bound
from ..operators import store

# fixed values: states of a lead, verdicts of a web lead and their labels
LEAD_STATES = ["flagged", "contacted", "replied", "won", "lost"]
VERDICTS = ["in_reach", "out_of_reach", "unmatched"]
VERDICT_LABELS = {"unmatched": "sem CNPJ na Receita", "out_of_reach": "na base, fora do CNAE do projeto", "in_reach": "já na base, dentro do CNAE"}
# fixed values: headers of the two CSV exports
COMPANY_HEADER = """
cnpj razao_social nome_fantasia cnae cnae_descricao municipio uf bairro endereco logradouro numero complemento cep data_inicio_atividade porte mei email
telefone telefone_e_celular origem_do_telefone whatsapp site nota tier confianca gancho conselho status anotacoes marcado_em contatado_em
""".split()
LEAD_HEADER = """
dominio site titulo situacao fora_por cnpj_casado casado_por cnae_casado emails telefones nota tier confianca ramo_errado gancho conselho status notas lido_em achado_em
""".split()


# ---------------------------------------------------------------- scores


def best_fit(fits: Column) -> Column:
    """The highest axis; axes without a value don't count."""
    return F.array_max(F.map_values(fits))


def tier(fit: Column) -> Column:
    return F.when(fit.isNull(), F.lit(None)).when(fit >= 5, "hot").when(fit >= 4, "warm").otherwise("cold")


def normalise_fit(value: Column) -> Column:
    """A whole number from 1 to 5, else null."""
    return F.when((value == F.floor(value)) & value.between(1, 5), value.cast("int"))


def join_answers(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """Model answers to their candidates by the digits of the key; a candidate without one is an error row, not a bad score."""
    rest = [F.col(c) for c in sorted(answers.columns) if not answers.schema[c].dataType.typeName() == "map"]
    keyed = store.latest(answers.withColumn("_k", F.regexp_replace("key", "[^0-9]", "")), ["_k"], rest).drop("key")
    joined = candidates.join(keyed, candidates["cnpj"] == keyed["_k"], "left")
    wrong = F.coalesce(F.col("wrong_business_type"), F.lit(False)) | F.coalesce(F.col("justification").contains("[RAMO: errado]"), F.lit(False))
    return joined.withColumn("wrong_type", F.when(F.col("_k").isNotNull(), wrong)).withColumn("error", F.when(F.col("_k").isNull(), "missing answer")).drop("_k")


# ---------------------------------------------------------------- lists


@dataclass(frozen=True)
class ListFilters:
    """What a company list keeps; unknown names are refused by the constructor.

    ``flags`` are states of the lead, ``none`` for companies that were never flagged. Processed means scored: a score is the last
    stage, and one without a site has been processed too.
    """

    q: str | None = None
    cnae: str | None = None
    uf: str | None = None
    flags: tuple[str, ...] = ()
    crawled: bool | None = None
    scored: bool | None = None
    processed: bool | None = None

    def __post_init__(self):
        if odd := set(self.flags) - {*LEAD_STATES, "none"}:
            raise ValueError(f"no such lead state: {', '.join(sorted(odd))}")

    def of_company(self) -> Column:
        """The part that looks at the company alone."""
        keep = F.lit(True)
        if self.cnae:
            keep &= F.coalesce(F.col("cnae").startswith(self.cnae), F.lit(False))
        if self.uf:
            keep &= F.coalesce(F.col("uf") == self.uf.upper(), F.lit(False))
        if self.q:
            keep &= F.lower(F.concat_ws(" ", F.coalesce("nome_fantasia", F.lit("")), F.coalesce("razao_social", F.lit("")), "cnpj")).contains(self.q.lower())
        return keep

    def of_joined(self) -> Column:
        keep = F.coalesce("status", F.lit("none")).isin(*self.flags) if self.flags else F.lit(True)
        for want, there in ((self.crawled, "_crawled"), (self.scored, "_scored"), (self.processed, "_scored")):
            if want is not None:
                keep &= F.col(there).isNotNull() if want else F.col(there).isNull()
        return keep


LIST_ORDERS = {
    "score": lambda: F.col("best_fit").desc_nulls_last(),
    "founded": lambda: F.col("data_inicio_atividade").desc_nulls_last(),
    "name": lambda: F.col("nome_fantasia").asc_nulls_first(),
}


def _listed(tables: dict[str, DataFrame], project_id, f: ListFilters) -> DataFrame:
    """A project's companies with what is known of each. All joins are by number alone, one project having been picked before, so tables
    that are bucketed by it share their layout."""
    own = lambda name: tables[name].filter(F.col("project_id") == project_id).drop("project_id")
    out = own("companies").filter(f.of_company())
    for side in (tables["crawls"].withColumn("_crawled", F.lit(True)), tables["places"], own("scores").withColumn("_scored", F.lit(True)), own("leads"), own("impressions")):
        out = out.join(side, "cnpj", "left")
    return out.filter(f.of_joined())


def company_page(tables: dict[str, DataFrame], project_id, f: ListFilters = ListFilters(), order: str = "score", limit: int = 200) -> DataFrame:
    """The first ``limit`` (at most 1000) companies of a project by score, founding or name, each with its crawl, place, score, lead and impression, its
    ``contacts`` (those of the site first) and the site that its mail suggests. Filtered first, cut after; contacts meet only the page."""
    by = [LIST_ORDERS[order](), F.col("cnpj")]
    page = _listed(tables, project_id, f).orderBy(*by).limit(max(1, min(1000, limit))).drop("_crawled", "_scored")
    phones = page.select("cnpj").join(tables["contacts"], "cnpj").groupBy("cnpj").agg(F.array_sort(F.collect_list(F.struct((F.col("source") != "site").alias("other"), "phone_e164", "source"))).alias("contacts"))
    rows = page.join(phones, "cnpj", "left").withColumn("contacts", F.transform(F.coalesce("contacts", F.array().cast(phones.schema["contacts"].dataType)), lambda c: c["phone_e164"]))
    return rows.withColumn("guessed_site", website_from_email("email")).orderBy(*by)


def company_total(tables: dict[str, DataFrame], project_id, f: ListFilters = ListFilters()) -> DataFrame:
    """One row: how many companies the filters leave."""
    return _listed(tables, project_id, f).agg(F.count("*").alias("total"))


def company_list(companies: DataFrame, places: DataFrame, crawls: DataFrame, scores: DataFrame, leads: DataFrame, impressions: DataFrame, keep: Column | None = None, limit: int = 1000) -> DataFrame:
    """Companies with whatever is known of each: five left joins by key; filtered first, cut after."""
    two = ["project_id", "cnpj"]
    joined = companies.join(crawls, "cnpj", "left").join(places, "cnpj", "left").join(scores, two, "left").join(leads, two, "left").join(impressions, two, "left")
    joined = joined if keep is None else joined.filter(keep)
    return joined.orderBy(F.col("best_fit").desc_nulls_last(), F.col("nome_fantasia").asc_nulls_first(), "cnpj").limit(limit)


def export_companies(companies: DataFrame, contacts: DataFrame) -> DataFrame:
    """Companies with their first phone."""
    phones = store.first_phone(contacts).select("cnpj", "phone_e164", "is_mobile", "source", "wa_me")
    return companies.join(phones, "cnpj", "left")


def company_export_rows(companies: DataFrame, contacts: DataFrame) -> DataFrame:
    """The company export's 31 columns as text, from a :func:`company_list` and its contacts; unknown is empty."""
    df = export_companies(companies, contacts)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    yes = lambda c: F.when(F.col(c).isNull(), "").when(F.col(c), "sim").otherwise("nao")
    own = {
        "endereco": F.coalesce(format_address("tipo_logradouro", "logradouro", "numero", "complemento", "bairro", "municipio", "uf", "cep"), F.lit("")),
        "cep": F.coalesce(format_cep("cep"), F.lit("")), "mei": F.when(F.coalesce("mei", F.lit(False)), "sim").otherwise("nao"), "telefone": text("phone_e164"),
        "telefone_e_celular": yes("is_mobile"), "origem_do_telefone": text("source"), "whatsapp": text("wa_me"), "site": text("final_url"), "nota": text("best_fit"),
        "confianca": text("confidence"), "gancho": text("hook"), "conselho": text("advice"), "anotacoes": text("notes"), "marcado_em": text("flagged_at"), "contatado_em": text("contacted_at"),
    }
    return df.select(*[(own[c] if c in own else text(c)).alias(c) for c in COMPANY_HEADER])


def lead_export_rows(leads: DataFrame, scores: DataFrame, keep: Column | None = None, limit: int = 5000) -> DataFrame:
    """The open-web export's 20 columns as text; lists are joined by a middle dot."""
    df = leads.join(scores, ["project_id", "apex"], "left").filter(F.col("discarded_at").isNull())
    df = df if keep is None else df.filter(keep)
    df = df.orderBy(F.col("best_fit").desc_nulls_last(), F.col("found_at").desc_nulls_last(), "apex").limit(limit)
    label = F.lit(None).cast("string")
    for k, v in VERDICT_LABELS.items():
        label = F.when(F.col("verdict") == k, v).otherwise(label)
    dots = lambda c: F.concat_ws(" · ", c)
    made = [
        F.col("apex"), F.coalesce("final_url", "website_url"), F.col("title"), F.coalesce(label, "verdict"), F.col("out_of_reach_by"), F.col("matched_cnpj"), F.col("match_via"), F.col("matched_cnae"),
        dots("emails"), dots("phones"), F.col("best_fit"), F.col("tier"), F.col("confidence"), F.when(F.col("wrong_type"), "sim"), F.col("hook"), F.col("advice"), F.col("status"), F.col("notes"), F.col("read_at"), F.col("found_at"),
    ]
    return df.select(*[F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in zip(made, LEAD_HEADER, strict=True)])


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV that spreadsheets open as UTF-8: a byte order mark before the header, fields quoted where needed. The
    export is cut to a page's size, so it is one file."""
    from ..functions.registry import csv_line

    header = rows.sparkSession.createDataFrame([(-1, "\ufeff" + ",".join(rows.columns))], "n long, line string")
    lines = rows.select(F.monotonically_increasing_id().alias("n"), csv_line([(F.col(c), dict(rows.dtypes)[c]) for c in rows.columns]).alias("line"))
    header.union(lines).coalesce(1).sortWithinPartitions("n").select("line").write.mode("overwrite").text(path)


def cnae_options(companies: DataFrame) -> DataFrame:
    return companies.groupBy("cnae", "cnae_descricao").count().orderBy(F.col("count").desc(), "cnae")


def cnae_yield(companies: DataFrame, scores: DataFrame) -> DataFrame:
    """What each activity has brought: added, judged (errors aren't), wrong type, hot, warm; the most wrong first."""
    joined = companies.join(scores, ["project_id", "cnpj"], "left")
    judged = F.col("scored_at").isNotNull() & F.col("error").isNull()
    out = joined.groupBy("cnae").agg(
        F.max("cnae_descricao").alias("descricao"), F.count("*").alias("added"), F.count_if(judged).alias("judged"),
        F.count_if(judged & F.col("wrong_type")).alias("wrong_type"), F.count_if(judged & (F.col("tier") == "hot")).alias("hot"), F.count_if(judged & (F.col("tier") == "warm")).alias("warm"),
    )
    return out.orderBy((F.col("wrong_type") / F.greatest(F.col("judged"), F.lit(1))).desc(), "cnae")


def tally(rows: DataFrame, by: str, values: list[str]) -> DataFrame:
    """One row: a count for each value, zeros kept, and the total."""
    return rows.agg(*[F.count_if(F.col(by) == v).alias(v) for v in values], F.count("*").alias("total"))


def place_tally(leads: DataFrame) -> DataFrame:
    return leads.groupBy(F.concat_ws(" ", "municipio", "uf").alias("place")).count().orderBy(F.col("count").desc(), "place")


# ---------------------------------------------------------------- enrichment


def resolve_url() -> tuple[Column, Column]:
    """The address to read and where it came from: by hand, places, search, then guessed from the mail."""
    sources = [("manual", F.col("manual_url")), ("places", F.col("places_url")), ("search", F.col("search_url")), ("email", website_from_email("email"))]
    blank = [(n, F.nullif(F.trim(c), F.lit(""))) for n, c in sources]
    named = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in blank])
    return F.coalesce(*[c for _, c in blank]), named


def probed(text: str, declared: str, shell: str, probes: dict[str, list[str]] | None) -> Column:
    """Probes over a page's text and what it declares; a shell that declares nothing wasn't read, so nothing is asked of it."""
    hidden = F.coalesce(F.col(shell), F.lit(False)) & F.col(declared).isNull()
    return web.run_probes(probes or {}, F.when(~hidden, F.concat_ws(" ", F.nullif(F.col(text), F.lit("")), F.col(declared))))


def analyse_pages(pages: DataFrame, probes: dict[str, list[str]] | None = None) -> DataFrame:
    """Signals of fetched pages (url, final_url, http_status, html, error). What wasn't read stays null; hubs aren't analysed,
    but their address may name the profile."""
    out = bound(pages.withColumn("_host", web.host_of(F.coalesce("final_url", "url"))))
    out = out.withColumn("is_link_hub", web.is_hub(F.col("_host"))).withColumn("is_free_builder", web.is_builder(F.col("_host"))).drop("_host").withColumn("is_dead", F.coalesce(F.col("http_status") >= 400, F.lit(False)) | F.col("error").isNotNull())
    read = F.when(F.col("html").isNotNull() & ~F.col("is_link_hub") & ~F.col("is_dead"), F.col("html"))
    # each step reads the columns of the one before it, so that no expression stands in another one's place
    out = bound(out.withColumn("_html", read).withColumn("_final", F.coalesce("final_url", "url")))
    later = web.signals_of_signals("_html")
    out = bound(out.withColumns({k: c for k, c in web.page_signals("_html", "_final").items() if k not in later}).withColumn("structured", json_ld("_html")))
    out = bound(out.withColumns(later).withColumn("structured_text", structured_text("meta_description", "structured")))
    profile = F.nullif(F.regexp_extract("_final", r"(?i)instagram\.com/([A-Za-z0-9_.]{2,30})", 1), F.lit(""))
    out = out.withColumn("ig_handle", F.when(F.col("is_link_hub"), profile).otherwise(F.col("ig_handle")))
    return out.withColumn("probes", probed("text_excerpt", "structured_text", "is_js_shell", probes)).drop("_html", "_final", "html")


def is_readable(excerpt: Column, structured: Column | None = None, js_shell: Column | None = None) -> Column:
    """Structured data is enough; else a page that isn't an empty shell and has text. Unread is unreadable."""
    said = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    shell = F.lit(False) if js_shell is None else F.coalesce(js_shell, F.lit(False))
    text = said(excerpt) & ~shell
    return text if structured is None else said(structured) | text


def presence_outcome(attempts: DataFrame) -> DataFrame:
    """One outcome a company from its providers' attempts: the next provider counts only after a block or an unknown page."""
    final = ~F.col("status").isin("blocked", "unrecognized")
    return store.latest(attempts, ["cnpj"], [final.desc(), F.col("provider_rank")])


def lookup_rows(outcomes: DataFrame) -> DataFrame:
    """Only what was really looked up is recorded: found or none, never blocked or unverifiable."""
    return outcomes.filter(F.col("status").isin("ok", "empty"))


def mei_pending(companies: DataFrame, crawls: DataFrame, lookups: DataFrame, scores: DataFrame, readable: Column) -> DataFrame:
    """Sole traders still unjudged and unread; one without a score row has no model and belongs here."""
    joined = companies.join(crawls, "cnpj", "left").join(lookups, "cnpj", "left").join(scores, ["project_id", "cnpj"], "left")
    open_ = F.col("model").isNull() | (F.col("confidence") == "cannot_determine")
    return joined.filter(F.col("mei") & open_ & ~F.coalesce(readable, F.lit(False)))


def to_score(companies: DataFrame, scores: DataFrame, picked: DataFrame | None = None) -> DataFrame:
    """Unscored or failed companies, and any that were picked."""
    marked = companies.join(scores.select("project_id", "cnpj", "error", F.lit(True).alias("_scored")), ["project_id", "cnpj"], "left")
    need = F.col("_scored").isNull() | F.col("error").isNotNull()
    if picked is not None:
        marked = marked.join(picked.select("cnpj", F.lit(True).alias("_picked")).dropDuplicates(), "cnpj", "left")
        need = need | F.col("_picked").isNotNull()
    return marked.filter(need).select(*companies.columns)


# ---------------------------------------------------------------- the open-web sweep


def gate_hits(hits: DataFrame) -> DataFrame:
    """Why a search hit isn't a business's own site (null: it is), and the registry numbers it states."""
    reason = (
        F.when(web.is_non_result("url"), "non_result")
        .when(web.looks_like_registry_mirror("title", "description"), "mirror")
        .when(web.classify_hit("url") != "site", "not_a_site")
        .when(web.is_non_business("url"), "non_business")
    )
    out = hits.withColumn("reason", reason).withColumn("apex", web.apex_of("url")).withColumn("cnpj_hints", cnpjs_in("title", "description"))
    # only hits without a reason are ranked: the apexes of hubs and engines, which nearly all hits share, never meet in one task
    kept = out.filter("reason is null").withColumn("_nth", F.row_number().over(Window.partitionBy("apex").orderBy("position", "url")))
    kept = kept.withColumn("reason", F.when(F.col("_nth") > 1, "duplicate")).drop("_nth")
    return out.filter("reason is not null").unionByName(kept.select(*out.columns))


def gate_tally(gated: DataFrame) -> DataFrame:
    return gated.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).count()


def verdict(cnae: Column, uf: Column, matched: Column, prefixes: list[str], excluded: list[str], ufs: list[str]) -> Column:
    """struct(verdict, by): in reach, out of it (activity before state), or unmatched."""
    from ..functions.text import any_of

    hit = any_of([cnae.startswith(p) for p in prefixes if p])
    out = any_of([cnae.startswith(p) for p in excluded if p])
    here = F.lit(True) if not ufs else F.coalesce(uf.isin(ufs), F.lit(False))
    said = F.when(~matched, "unmatched").when(hit & ~out & here, "in_reach").otherwise("out_of_reach")
    by = F.when(matched & (~hit | out), "cnae").when(matched & ~here, "uf")
    return F.struct(said.alias("verdict"), by.alias("by"))


def profile_queue(hits: DataFrame, companies: DataFrame, pages: DataFrame, budget: int) -> DataFrame:
    """Company pages before profiles, then by number; companies that already have a page row are done; cut at the budget."""
    due = hits.filter(F.col("kind").isin("linkedin", "linkedin_company")).join(companies.select("cnpj").distinct(), "cnpj", "left_semi").join(pages.select("cnpj").distinct(), "cnpj", "left_anti")
    due = store.latest(due, ["cnpj", "url"], [F.col("kind")]).withColumn("mode", F.when(F.col("kind") == "linkedin_company", 0).otherwise(1))
    return due.orderBy("mode", "cnpj", "url").limit(budget)

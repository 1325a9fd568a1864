"""Dataflows of enrichment end to end: verified hits, sites over several pages, the pipeline, the open-web sweep, counters and views."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import names, pages as P, registry, web
from ..functions import values as V
from ..functions.text import bound
from ..operators import discovery, store
from ..streaming.continuous import shared
from . import flows

#: Pages of one site that are read at most.
SITE_PAGES = 40
#: Characters by which the lengths of the other side's names are looked up; names of two tokens have so many at least.
NAME_HEAD = 4


# ---------------------------------------------------------------- hits


def verify_hits(hits: DataFrame, companies: DataFrame) -> DataFrame:
    """The hits (search_id, cnpj, url, title, description, ...) that are really about their company.

    Kinds that aren't stored go first, then registry mirrors; then each kind has its own test of identity: a profile's
    title must lead with the name, a company page's title must agree with one of the names, anything else must hold
    the name somewhere (``matched_on``). Of several profiles in one search none keeps its headline.
    """
    legal, trade = F.col("razao_social"), F.col("nome_fantasia")
    name = F.coalesce(legal, trade)
    told = hits.join(companies.select("cnpj", "razao_social", "nome_fantasia"), "cnpj").withColumn("kind", web.classify_hit("url"))
    told = told.filter(web.is_storable_kind(F.col("kind")) & ~F.coalesce(web.looks_like_registry_mirror("title", "description"), F.lit(False)))
    on = (
        F.when(F.col("kind") == "linkedin", F.when(names.title_leads_with_name("title", name), "title"))
        .when(F.col("kind") == "linkedin_company", F.when(names.entity_title_matches("title", legal, trade), "title"))
        .otherwise(names.match_strength("url", "title", "description", name))
    )
    page = F.col("kind").isin("linkedin", "linkedin_company")
    said = F.when(page & F.coalesce(F.col("description").rlike(names.BOILERPLATE), F.lit(False)), "").otherwise(F.col("description"))
    kept = told.withColumn("matched_on", on).filter("matched_on is not null").withColumn("description", said)
    kept = kept.withColumn("headline", F.when(F.col("kind") == "linkedin", names.parse_profile_title("title")["headline"]))
    return store.ambiguous_profiles(kept).drop("razao_social", "nome_fantasia")


# ---------------------------------------------------------------- sites


def site_signals(pages: DataFrame, probes: dict[str, list[str]] | None = None) -> DataFrame:
    """Signals of whole sites from their fetched pages (site, position, url, final_url, http_status, html, error).

    The first page gives the signals; contacts and text of the pages that follow, at most ``SITE_PAGES`` a site, are merged
    in reading order, then ranked and cut. Probes look at the joined text and what the first page declares.
    """
    first = flows.analyse_pages(pages.filter("position = 0"), probes)
    few = pages.filter((F.col("position") > 0) & (F.col("position") < SITE_PAGES) & F.col("html").isNotNull() & (F.col("http_status") < 400))
    host = first.select("site", web.host_of(F.coalesce("final_url", "url")).alias("_host"))
    read = few.join(host, "site").select("site", F.struct("position", web.emails_of("html", F.col("_host")).alias("e"), web.phones_of("html").alias("p"), web.extract_text("html").alias("t")).alias("page"))
    # at most SITE_PAGES excerpts of 8000 characters a site
    more = bound(read).groupBy("site").agg(F.array_sort(F.collect_list("page")).alias("_pages"))
    out = first.join(more, "site", "left").join(host, "site")
    rest = F.coalesce("_pages", F.array().cast(more.schema["_pages"].dataType))
    own = ~F.col("is_link_hub") & ~F.col("is_dead")
    merged = lambda c, k: F.aggregate(rest, F.col(c), lambda acc, p: web.merge_contacts(acc, p[k]))
    text = F.left(F.concat_ws(" ", F.col("text_excerpt"), F.transform(rest, lambda p: p["t"])), F.lit(V.EXCERPT_CHARS))
    out = bound(out.withColumns({"_emails": merged("emails", "e"), "_phones": merged("phones", "p")}))
    out = out.withColumns(
        {
            "emails": F.when(own, web.rank_emails("_emails", F.col("_host"))),
            "phones": F.when(own, F.col("_phones")),
            "text_excerpt": F.when(own, text),
            "site_phone": F.when(own, F.coalesce("site_phone", F.get(F.filter(F.flatten(F.transform(rest, lambda p: F.slice(p["p"], 1, 1))), lambda x: x.isNotNull()), 0))),
            "pages_fetched": F.when(F.col("is_link_hub"), 0).otherwise(1 + F.size(rest)),
        }
    )
    return bound(out).withColumn("probes", flows.probed("text_excerpt", "structured_text", "is_js_shell", probes)).drop("_pages", "_host", "_emails", "_phones")


# ---------------------------------------------------------------- the pipeline


def crawl_targets(companies: DataFrame, crawls: DataFrame, places: DataFrame, hits: DataFrame, picked: DataFrame | None = None, recheck: bool = False, limit: int = 50) -> DataFrame:
    """(cnpj, url, source): what to read next, not yet crawled unless ``recheck``; an explicit pick implies it. By number, cut at ``limit``."""
    return _targets(companies, crawls, places, hits, picked, recheck).filter("url is not null").orderBy("cnpj").limit(limit)


def crawl_counts(companies: DataFrame, crawls: DataFrame, places: DataFrame, hits: DataFrame, picked: DataFrame | None = None, recheck: bool = False, limit: int = 50) -> DataFrame:
    """One row: companies considered, queued and skipped by :func:`crawl_targets`."""
    found = _targets(companies, crawls, places, hits, picked, recheck).agg(F.count("*").alias("considered"), F.least(F.count("url"), F.lit(limit)).alias("queued"))
    return found.withColumn("skipped", F.col("considered") - F.col("queued"))


def _targets(companies, crawls, places, hits, picked, recheck) -> DataFrame:
    due = companies if picked is None else companies.join(picked.select("cnpj").distinct(), "cnpj", "left_semi")
    if not recheck and picked is None:
        due = due.join(crawls.select("cnpj"), "cnpj", "left_anti")
    manual = F.col("manual_url") if "manual_url" in companies.columns else F.lit(None).cast("string")
    due = due.withColumn("manual_url", manual).join(places.select("cnpj", F.col("website_url").alias("places_url")), "cnpj", "left")
    due = due.join(store.crawl_urls(hits).select("cnpj", F.col("url").alias("search_url")), "cnpj", "left")
    url, source = flows.resolve_url()
    return due.select("cnpj", url.alias("url"), source.alias("source"))


def run_pipeline(companies: DataFrame, places: DataFrame, pages: DataFrame, crawls: DataFrame, contacts: DataFrame, probes: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Crawl, then score: the address of each company (places before mail), the signals of its site, upserted crawls and contacts,
    and two outcomes that together are all companies: those a model can judge and rows that say why one can't.

    ``pages`` are fetched pages by ``site``, the address asked for. ``crawls`` and ``contacts`` are what is stored. The signals are written to the shared folder first,
    so that every page is read once, whatever of the four frames is asked for.
    """
    guessed = companies.join(places.select("cnpj", "website_url"), "cnpj", "left")
    there = F.nullif(F.trim("website_url"), F.lit(""))
    asked = guessed.select("cnpj", F.coalesce(there, registry.website_from_email("email")).alias("website"), F.when(there.isNotNull(), "places").otherwise("email").alias("url_source")).filter("website is not null")
    signals = _written(site_signals(pages, probes), "signals")
    read = asked.join(signals, asked["website"] == signals["site"]).drop("site")
    fresh = read.select("cnpj", F.col("website").alias("website_url"), "url_source", "final_url", "http_status", "error", "text_excerpt", "structured_text", "is_js_shell", "site_phone", "pages_fetched")
    kept = store.upsert(crawls, fresh, ["cnpj"], [F.col("website_url")])
    digits = F.regexp_replace("site_phone", r"^\+55", "")
    phone = registry.classify_phone(F.left(digits, F.lit(2)), F.substring(digits, 3, 20))
    called = fresh.withColumn("p", phone).filter("p is not null")
    called = called.select("cnpj", F.col("p.e164").alias("phone_e164"), F.col("p.is_mobile").alias("is_mobile"), F.lit("site").alias("source"), registry.wa_me_link(F.col("p.e164")).alias("wa_me"))
    readable = flows.is_readable(F.col("text_excerpt"), F.col("structured_text"), F.col("is_js_shell"))
    judged = companies.join(kept.select("cnpj", "text_excerpt", "structured_text", "is_js_shell"), "cnpj", "left")
    return {
        "crawls": kept,
        "contacts": store.insert_new(contacts, called, ["cnpj", "phone_e164"], [F.col("source")]),
        "to_score": judged.filter(readable),
        "unjudged": store.cannot_determine(judged, readable),
    }


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a file of its own: computed once, and safe from lost executors."""
    path = f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reprocess(pending: DataFrame, outcomes: DataFrame, recheck: bool, most: int) -> tuple[DataFrame, DataFrame]:
    """Sole traders without a conclusion: those searched now (once each unless ``recheck``, at most ``most``), and of them those
    whose search found something, which are the ones to score again."""
    due = (pending if recheck else pending.filter(~F.col("already_searched"))).orderBy("cnpj").limit(most)
    return due, due.join(outcomes.filter(F.col("status") == "ok").select("cnpj"), "cnpj", "left_semi")


# ---------------------------------------------------------------- the open-web sweep


def _variants(df: DataFrame, key: str, named: list[Column]) -> DataFrame:
    """(key, tokens): one row a name of one word or more."""
    listed = df.select(F.col(key), F.explode(F.array_distinct(F.array(*[names.company_tokens(n) for n in named]))).alias("tokens"))
    return listed.filter(F.size("tokens") > 0).withColumn("squeezed", F.array_join("tokens", ""))


def _beginning(shorter: DataFrame, longer: DataFrame) -> DataFrame:
    """The rows of both sides where a text of ``shorter`` (_short, ...) is a prefix of one of ``longer`` (_long, ...).

    Every longer text emits its prefixes, but only of lengths that a shorter text with the same first ``NAME_HEAD`` characters has, and meets the shorter ones by equality.
    """
    head = lambda c: F.left(c, F.lit(NAME_HEAD))
    lengths = shorter.groupBy(head("_short").alias("_head")).agg(F.collect_set(F.length("_short")).alias("_lengths"))
    fitting = F.filter("_lengths", lambda n: n <= F.length("_long"))
    cut = longer.withColumn("_head", head("_long")).join(lengths, "_head").withColumn("_n", F.explode(fitting)).withColumn("_prefix", F.left("_long", F.col("_n")))
    return shorter.join(cut.drop("_head", "_lengths", "_n"), F.col("_short") == F.col("_prefix")).drop("_prefix")


def name_pairs(candidates: DataFrame, companies: DataFrame) -> DataFrame:
    """(apex, cnpj) for every pair of names that agree, as often as their variants do.

    Two names agree if one begins with the other, spaces aside: the shorter one equals a prefix of the longer one, so the sides meet by equality of
    prefixes, and no pair is compared that doesn't agree. A candidate's name of one word agrees with the companies' first words that equal it.
    """
    a = _variants(candidates, "apex", [F.col("name"), web.apex_label("website_url")])
    b = _variants(companies, "cnpj", [F.col("razao_social"), F.col("nome_fantasia")]).filter(F.size("tokens") >= names.MIN_COMPANY_TOKENS)
    word = F.get("tokens", 0)
    single = a.filter((F.size("tokens") == 1) & (F.length(word) >= names.MIN_SINGLE_CHARS)).select("apex", word.alias("_word")).distinct()
    first = b.select("cnpj", word.alias("_word")).distinct()
    several, named = a.filter(F.size("tokens") > 1).select("apex", "squeezed").distinct(), b.select("cnpj", "squeezed").distinct()
    forth = _beginning(several.withColumnRenamed("squeezed", "_short"), named.withColumnRenamed("squeezed", "_long"))
    # the other way round without equal names, which met already
    back = _beginning(named.withColumnRenamed("squeezed", "_short"), several.withColumnRenamed("squeezed", "_long")).filter("_short <> _long")
    return single.join(first, "_word").select("apex", "cnpj").unionByName(forth.select("apex", "cnpj")).unionByName(back.select("apex", "cnpj"))


def pair_by_name(candidates: DataFrame, companies: DataFrame) -> DataFrame:
    """(apex, cnpj): candidates (apex, website_url, name) and companies (cnpj, razao_social, nome_fantasia) whose names agree."""
    return name_pairs(candidates, companies).distinct()


def sweep(candidates: DataFrame, est: DataFrame, hints: DataFrame, prefixes: list[str], excluded: list[str], ufs: list[str]) -> DataFrame:
    """Web leads of candidates (apex, website_url, name, address): matched by address, then by mail domain, then by the
    registry numbers (cnpj) that mirrors handed over, each only where the names agree; then the verdict.

    Returns (apex, website_url, verdict, out_of_reach_by, matched_cnpj, match_via, matched_cnae).
    """
    company = est.select("cnpj", "razao_social", "nome_fantasia", F.col("cnae_principal").alias("cnae"), "uf", "email")
    parsed = candidates.withColumn("_a", P.parse_place_address("address")).filter(F.col("_a.logradouro").isNotNull())
    probes = parsed.select(F.col("apex").alias("ref"), "_a.logradouro", "_a.numero", "_a.uf")
    at = discovery.find_by_address(est, probes).select(F.col("ref").alias("apex"), F.explode("cnpjs").alias("cnpj"))
    by_mail = candidates.select("apex").join(company.select("cnpj", registry.mail_domain("email").alias("apex")), "apex")
    agreed = lambda pairs: _agreeing(pairs, candidates, company)
    named = pair_by_name(candidates, discovery.by_numbers(company, hints))
    claims = agreed(at).withColumn("route", F.lit("address")).union(agreed(by_mail).withColumn("route", F.lit("email_domain"))).union(named.withColumn("route", F.lit("mirror")))
    won = store.claim(claims.withColumn("position", F.lit(0))).select("apex", F.col("cnpj").alias("matched_cnpj"), F.col("route").alias("match_via"))
    facts = company.select(F.col("cnpj").alias("matched_cnpj"), F.col("cnae").alias("matched_cnae"), F.col("uf").alias("_uf"))
    out = candidates.select("apex", "website_url").join(won, "apex", "left").join(facts, "matched_cnpj", "left")
    out = out.withColumn("_v", flows.verdict(F.coalesce("matched_cnae", F.lit("")), F.col("_uf"), F.col("matched_cnpj").isNotNull(), prefixes, excluded, ufs))
    return out.select("apex", "website_url", F.col("_v.verdict").alias("verdict"), F.col("_v.by").alias("out_of_reach_by"), "matched_cnpj", "match_via", "matched_cnae")


def _agreeing(pairs: DataFrame, candidates: DataFrame, company: DataFrame) -> DataFrame:
    told = pairs.join(candidates.select("apex", "website_url", "name"), "apex").join(company.select("cnpj", "razao_social", "nome_fantasia"), "cnpj")
    return told.filter(names.verify_mirror_link("website_url", "name", "razao_social", "nome_fantasia")).select("apex", "cnpj")


def leads_to_crawl(leads: DataFrame, only_without_contact: bool = False) -> DataFrame:
    """Kept leads out of reach of the project's own query; on request only those never read or read without a contact."""
    due = leads.filter(F.col("discarded_at").isNull() & (F.col("verdict") != "in_reach"))
    nothing = F.col("crawled_at").isNull() | ((F.coalesce(F.size("emails"), F.lit(0)) <= 0) & (F.coalesce(F.size("phones"), F.lit(0)) <= 0))
    return due.filter(nothing) if only_without_contact else due


def leads_to_score(leads: DataFrame, scores: DataFrame, only_failed: bool = True) -> DataFrame:
    """Unmatched leads without a score, and those with a failed one; all unmatched ones unless ``only_failed``."""
    due = leads.filter(F.col("verdict") == "unmatched")
    if not only_failed:
        return due
    good = scores.filter(F.col("error").isNull()).select("project_id", "apex").distinct()
    return due.join(good, ["project_id", "apex"], "left_anti")


# ---------------------------------------------------------------- counters and views


def project_stats(companies: DataFrame, scores: DataFrame) -> DataFrame:
    """One row a project: companies, scored, failed, of the wrong type, hot, warm, cold; zeros kept."""
    n = companies.groupBy("project_id").agg(F.count("*").alias("companies"))
    judged = scores.groupBy("project_id").agg(
        F.count_if(F.col("error").isNull()).alias("scored"), F.count("error").alias("failed"), F.count_if("wrong_type").alias("wrong_type"),
        *[F.count_if(F.col("tier") == t).alias(t) for t in ("hot", "warm", "cold")],
    )
    out = n.join(judged, "project_id", "full")
    return out.select("project_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in out.columns if c != "project_id"])


def crawl_pending(companies: DataFrame, crawls: DataFrame) -> DataFrame:
    """One row: companies not yet crawled, and those of them whose mail suggests a site."""
    open_ = companies.join(crawls.select("cnpj"), "cnpj", "left_anti")
    return open_.agg(F.count("*").alias("not_crawled"), F.count(registry.website_from_email("email")).alias("with_guessable_site"))


def search_pending(pending: DataFrame) -> DataFrame:
    """One row: companies without a conclusion, those never searched, those of them whose name can be searched."""
    fresh = ~F.col("already_searched")
    query = names.search_query("razao_social", "nome_fantasia", "municipio", "uf")
    return pending.agg(F.count("*").alias("total"), F.count_if(fresh).alias("never_searched"), F.count_if(fresh & query.isNotNull()).alias("searchable"))


def lead_list(leads: DataFrame, companies: DataFrame, scores: DataFrame, crawls: DataFrame, status: str | None = None, limit: int = 1000) -> DataFrame:
    """Leads with their company, score and site; best first, then the latest flagged, then by number."""
    kept = leads if status is None else leads.filter(F.col("status") == status)
    two = ["project_id", "cnpj"]
    out = kept.join(companies, two, "left").join(scores, two, "left").join(crawls, "cnpj", "left")
    return out.orderBy(F.col("best_fit").desc_nulls_last(), F.col("flagged_at").desc_nulls_last(), "cnpj").limit(limit)


def results(scores: DataFrame, companies: DataFrame, crawls: DataFrame, include: str = "ranked", limit: int = 100) -> DataFrame:
    """Scores with their company and site: the ranked ones, the discarded ones (wrong type) or the failed ones; cut after the filter."""
    failed, wrong = F.col("error").isNotNull(), F.coalesce(F.col("wrong_type"), F.lit(False))
    keep = {"ranked": ~failed & ~wrong, "discarded": ~failed & wrong, "failed": failed}[include]
    top = scores.filter(keep).orderBy(F.col("best_fit").desc_nulls_last(), "cnpj").limit(discovery.clamp(limit, 1, 500, 100))
    out = top.join(companies, ["project_id", "cnpj"], "left").join(crawls.select("cnpj", "final_url"), "cnpj", "left")
    return out.orderBy(F.col("best_fit").desc_nulls_last(), "cnpj")


def sweep_yield(leads: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: leads by verdict, queries spent and businesses seen."""
    counts = flows.tally(leads, "verdict", flows.VERDICTS).drop("total").withColumn("_one", F.lit(1))
    spent = queries.agg(F.count("*").alias("queries_spent"), F.coalesce(F.sum("considered"), F.lit(0)).alias("businesses_seen"), F.lit(1).alias("_one"))
    return counts.join(spent, "_one").drop("_one")


def check_suggestions(suggested: DataFrame, reach: DataFrame) -> DataFrame:
    """(code, status, descricao, total): suggested codes (code) against their reach: unknown to the dictionary, empty, or ok.

    In the order of a list to choose from: usable first, then chosen ones, then by reach and code.
    """
    told = suggested.join(reach.select("code", "descricao", "total"), "code", "left")
    status = F.when(F.col("descricao").isNull(), "unknown").when(F.col("total") == 0, "empty").otherwise("ok")
    rows = told.withColumn("status", status).withColumn("total", F.coalesce("total", F.lit(0)))
    rank = F.when(F.col("status") == "ok", 0).when(F.col("status") == "empty", 1).otherwise(2)
    return rows.orderBy(rank, F.col("chosen").desc(), F.col("total").desc(), "code")


def crowded_addresses(companies: DataFrame, by: list[str], most: int = 1) -> DataFrame:
    """The addresses that hold the most establishments."""
    return companies.groupBy(*by).count().orderBy(F.col("count").desc(), *by).limit(most)


def recent(rows: DataFrame, at: str, key: str, most: int) -> DataFrame:
    """The latest rows; ties by key."""
    return rows.orderBy(F.col(at).desc_nulls_last(), key).limit(most)


def within_budget(requests: DataFrame, sku: str, order: list[str], used: DataFrame, limits: DataFrame, most: int | None = None) -> DataFrame:
    """``requests`` with ``allowed``: the first ones of each SKU, by ``order``, until what was used this month reaches its limit or the
    run has made ``most``. ``used`` (sku, used) and ``limits`` (sku, free); an unlisted SKU has nothing free."""
    nth = F.row_number().over(Window.partitionBy(sku).orderBy(*order))
    held = requests.withColumn("_nth", nth).join(used, sku, "left").join(limits, sku, "left")
    left = F.coalesce("free", F.lit(0)) - F.coalesce("used", F.lit(0))
    return held.withColumn("allowed", (F.col("_nth") <= left) & (F.lit(True) if most is None else F.col("_nth") <= most)).drop("_nth", "used", "free")


def estimate_cost(price_per_thousand: Column, requests: Column) -> Column:
    """What requests cost beyond the free allowance."""
    return F.coalesce(price_per_thousand, F.lit(0.0)) * requests / 1000


# ---------------------------------------------------------------- profile pages


def plan_fetches(hits: DataFrame, companies: DataFrame, pages: DataFrame, budget: int | None) -> DataFrame:
    """(cnpj, url, mode): pages worth a visit: company pages whose title agrees, then profiles whose title leads with the name;
    companies that have a page row are done; cut at the budget, all without one."""
    told = hits.filter(F.col("kind").isin("linkedin", "linkedin_company")).join(companies.select("cnpj", "razao_social", "nome_fantasia"), "cnpj").join(pages.select("cnpj"), "cnpj", "left_anti")
    entity = (F.col("kind") == "linkedin_company") & web.is_linkedin_entity("url") & names.entity_title_matches("title", "razao_social", "nome_fantasia")
    person = (F.col("kind") == "linkedin") & web.is_linkedin_profile("url") & names.title_leads_with_name("title", F.coalesce("razao_social", "nome_fantasia"))
    mode = F.when(entity, "entity").when(person, "profile")
    told = bound(told.select("cnpj", "url", mode.alias("mode"))).filter("mode is not null")
    plans = told.withColumn("url", F.when(F.col("mode") == "entity", web.linkedin_about_url("url")).otherwise(F.col("url"))).filter("url is not null").distinct()
    return plans if budget is None else plans.orderBy("mode", "cnpj", "url").limit(budget)


def page_outcomes(fetched: DataFrame) -> DataFrame:
    """One row a visited page (cnpj, url, mode, http_status, html): status, facts and whether they say more than the name."""
    ok = F.col("status") == "ok"
    # status and facts are bound, so that neither is found again for each field that is read
    out = bound(fetched.withColumn("status", F.coalesce(P.wall("html", "url", "http_status"), F.lit("ok"))))
    out = bound(out.withColumn("entity", F.when((F.col("mode") == "entity") & ok, P.entity_facts("html"))).withColumn("person", F.when((F.col("mode") == "profile") & ok, P.profile_facts("html"))))
    more = F.coalesce(*[F.col(f"entity.{c}").cast("string") for c in ("description", "industry", "employees_on_site", "website", "founded")], F.col("entity.employee_range.min").cast("string"), F.col("person.headline"))
    return out.withColumn("has_substance", more.isNotNull()).drop("html")

"""The project store as snapshots: inserts, upserts, updates and deletes are joins and windows by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key. The order should end in something unique."""
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rn = 1").drop("_rn")


def _every(rows: DataFrame) -> list[Column]:
    """All columns that have an order, by name: a last resort that makes a pick the same on every run."""
    return [F.col(f"`{f.name}`") for f in sorted(rows.schema.fields, key=lambda f: f.name) if "map<" not in f.dataType.simpleString()]


def insert_new(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Insert, do nothing where the key exists; of repeated new keys the first by ``order``, or else by all columns, goes in."""
    fresh = rows.join(target.select(*keys), keys, "left_anti")
    fresh = latest(fresh, keys, [*(order or []), *_every(fresh)])
    return target.unionByName(fresh.select(*target.columns))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Insert or replace: the latest of the new rows by ``order`` wins over what is stored."""
    fresh = latest(rows, keys, order).select(*target.columns)
    return target.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def add_counts(target: DataFrame, rows: DataFrame, keys: list[str], counter: str) -> DataFrame:
    """Counters that grow by what is added."""
    both = target.select(*keys, counter).unionByName(rows.select(*keys, counter))
    return both.groupBy(*keys).agg(F.sum(counter).alias(counter))


def update(target: DataFrame, rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Set ``values`` on rows whose key is in ``rows``; other rows stay. Of rows of one key the least by all columns counts."""
    named = latest(rows, keys, _every(rows)).select(*keys, F.lit(True).alias("_hit"), *[F.col(v).alias(f"_{v}") for v in values])
    joined = target.join(named, keys, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])


def delete(target: DataFrame, keys_gone: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(keys_gone.select(*keys).distinct(), keys, "left_anti")


def delete_cascade(tables: dict[str, DataFrame], keys_gone: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Every table that has the keys, without the rows of those that are gone; other tables stay."""
    return {name: delete(df, keys_gone, keys) if set(keys) <= set(df.columns) else df for name, df in tables.items()}


def set_impressions(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Upsert where a blank body deletes the row."""
    merged = upsert(target, rows, keys, order)
    return merged.filter(F.trim(F.coalesce("body", F.lit(""))) != "")


def promote(leads: DataFrame, companies: DataFrame, crawls: DataFrame, lead_crawls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matched leads become companies, and bring their crawl along where the company has none."""
    matched = leads.filter(F.col("matched_cnpj").isNotNull())
    made = matched.select("project_id", F.col("matched_cnpj").alias("cnpj"))
    fresh = made.dropDuplicates().join(companies.select("project_id", "cnpj"), ["project_id", "cnpj"], "left_anti")
    for c in companies.columns:
        if c not in fresh.columns:
            fresh = fresh.withColumn(c, F.lit(None).cast(companies.schema[c].dataType))
    carried = matched.select(F.col("matched_cnpj").alias("cnpj"), "apex").join(lead_crawls, "apex").drop("apex")  # of several sites the least row
    return companies.unionByName(fresh.select(*companies.columns)), insert_new(crawls, carried, ["cnpj"])


def cannot_determine(candidates: DataFrame, readable: Column) -> DataFrame:
    """A row of its own, with no model, for what couldn't be read: unknown is recorded, never guessed."""
    gone = candidates.filter(~F.coalesce(readable, F.lit(False)))
    return gone.select("project_id", "cnpj", F.lit(None).cast("int").alias("best_fit"), F.lit(None).cast("string").alias("tier"), F.lit("cannot_determine").alias("confidence"), F.lit(None).cast("string").alias("model"))


# ---------------------------------------------------------------- picks and ranks


def first_phone(contacts: DataFrame) -> DataFrame:
    """One phone a company: those from its site before those of the registry."""
    return latest(contacts, ["cnpj"], [(F.col("source") == "site").desc(), F.col("phone_e164")])


def top_hits(hits: DataFrame, most: int = 3) -> DataFrame:
    """The best ``most`` search hits a company: sites, then social profiles, then LinkedIn, each in the order found."""
    rank = F.when(F.col("kind") == "site", 0).when(F.col("kind") == "social", 1).otherwise(2)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("cnpj").orderBy(rank, "position", "url"))).filter(F.col("rank") <= most)


def crawl_urls(hits: DataFrame) -> DataFrame:
    """The first hit of kind site of each company."""
    return latest(hits.filter(F.col("kind") == "site"), ["cnpj"], [F.col("position"), F.col("url")])


def ambiguous_profiles(hits: DataFrame) -> DataFrame:
    """Two or more profiles in one search: none of their headlines counts."""
    n = F.count(F.when(F.col("kind") == "linkedin", 1)).over(Window.partitionBy("search_id"))
    several = (F.col("kind") == "linkedin") & (n >= 2)
    return hits.withColumn("ambiguous", several).withColumn("headline", F.when(~several, F.col("headline")))


ROUTES = ("address", "email_domain", "mirror")


def claim(claims: DataFrame) -> DataFrame:
    """One company a site: the first route that names one, by route, then position, then number."""
    rank = F.array_position(F.array(*map(F.lit, ROUTES)), F.col("route"))
    return latest(claims, ["apex"], [rank, F.col("position"), F.col("cnpj")])


def refusal_streaks(outcomes: DataFrame, by: list[str], order: list[str], limit: int = 3) -> DataFrame:
    """Length of the run of refusals that ends at each row, and whether it stops the search. A success starts anew."""
    w = Window.partitionBy(*by).orderBy(*order)
    islands = outcomes.withColumn("_island", F.sum(F.when(F.col("refused"), 0).otherwise(1)).over(w))
    streak = F.sum(F.when(F.col("refused"), 1).otherwise(0)).over(Window.partitionBy(*by, "_island").orderBy(*order))
    return islands.withColumn("streak", streak).withColumn("stopped", F.col("streak") >= limit).drop("_island")


def throttle_slots(requests: DataFrame, host: str, at: str, order: str, gap_seconds: float = 1.0) -> DataFrame:
    """The earliest second at which each request may go: at least the gap after the host's previous one.

    With n the row's number in its host, slot = max over earlier rows of (at - n * gap), plus n * gap.
    """
    w = Window.partitionBy(host).orderBy(at, order)
    n = F.row_number().over(w) - 1
    return requests.withColumn("_n", n).withColumn("slot", F.max(F.col(at).cast("double") - F.col("_n") * gap_seconds).over(w) + F.col("_n") * gap_seconds).drop("_n")


def cooldown_minutes(strike: Column) -> Column:
    """15 minutes, an hour, four hours from the third strike on."""
    return F.element_at(F.array(F.lit(15), F.lit(60), F.lit(240)), F.greatest(F.lit(1), F.least(strike, F.lit(3))).cast("int"))


def plan_queries(terms: DataFrame, places: DataFrame, most: int) -> DataFrame:
    """(query, term, place): every term in the first place, then in the second, ..., up to ``most``.

    ``terms`` (term_idx, term) and ``places`` (place_idx, place) are short lists of a project; each term is spread over the places it needs.
    """
    # of a term only the first places can be among the first ``most`` rows, and of the places only those
    few = lambda df, by: df.orderBy(by).limit(most)
    t = few(latest(terms, ["term"], [F.col("term_idx")]), "term_idx").withColumn("_t", F.row_number().over(Window.orderBy("term_idx")) - 1)
    p = few(latest(places, ["place"], [F.col("place_idx")]), "place_idx").withColumn("_p", F.row_number().over(Window.orderBy("place_idx")) - 1)
    # row n is term n mod terms in place n div terms: both sides are found by number
    size = t.agg(F.count("*").alias("_terms"), F.lit(0).alias("_z"))
    n = p.agg(F.greatest(F.count("*"), F.lit(1)).alias("_places"), F.lit(0).alias("_z"))
    rows = size.join(n, "_z").filter("_terms > 0").select("_terms", F.explode(F.expr(f"sequence(0L, least({int(most)}L, _terms * _places) - 1L)")).alias("_n"))
    rows = rows.withColumn("_t", F.expr("cast(_n % _terms as int)")).withColumn("_p", F.expr("cast(_n div _terms as int)"))
    place = F.coalesce(F.col("place"), F.lit(""))
    query = F.concat(F.lit('"'), F.col("term"), F.lit('"'), F.when(place != "", F.concat(F.lit(" "), place)).otherwise(""))
    return rows.join(t, "_t").join(p, "_p", "left").orderBy("_n").select(query.alias("query"), "term", place.alias("place"))

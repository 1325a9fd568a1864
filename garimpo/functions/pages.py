"""Search pages, structured data, profile pages, robots files and free-form addresses.

Everything is a column expression; JSON is read with Spark's variant functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import values as V
from .text import any_of, blank_to_null, col, collapse, fold, group, let
from .web import decode_html, extract_text, is_non_result, path_of, title_of, unwrap_redirect

MAX_HITS, FIELD = 12, 400


# ---------------------------------------------------------------- search pages


def parse_search_pages(pages: DataFrame, max_hits: int = MAX_HITS) -> DataFrame:
    """(search_id, status, position, url, title, description) from (search_id, provider, html).

    One row a hit; a page without hits gives one row that says why: empty, blocked or unrecognized. Results win over
    a provider's warnings on google, and a block wins on duckduckgo.
    """
    html, ddg = F.col("html"), F.col("provider") == "duckduckgo"
    # each result starts at its mark; what stands before the first one isn't a result
    blocks = F.transform(F.slice(F.split(html, r"""(?i)<div[^>]+class="[^"]*\bresult\b[^"]*\""""), 2, 1000), lambda b: F.struct(
        F.regexp_extract(b, r"""(?is)<a[^>]+class="[^"]*result__a[^"]*"[^>]*href="([^"]+)"[^>]*>.*?</a>""", 1).alias("href"),
        F.regexp_extract(b, r"""(?is)<a[^>]+class="[^"]*result__a[^"]*"[^>]*href="[^"]+"[^>]*>(.*?)</a>""", 1).alias("title"),
        F.regexp_extract(b, r"""(?is)class="[^"]*result__snippet[^"]*"[^>]*>(.*?)</(?:a|div)>""", 1).alias("description"),
    ))
    heads = F.transform(F.slice(F.split(html, r"""(?is)(?=<a[^>]+href="[^"]+"(?:(?!<a\s).){0,600}?<h3)"""), 1, 1000), lambda b: F.struct(
        F.regexp_extract(b, r"""(?is)href="([^"]+)""", 1).alias("href"),
        F.regexp_extract(b, r"(?is)<h3[^>]*>(.{0,300}?)</h3>", 1).alias("title"),
        F.regexp_replace(F.regexp_extract(b, r"(?is)</h3>(.*)$", 1), "(?is)<(script|style).*?</\\1>|<[^>]*>", " ").alias("description"),
    ))
    raw = F.filter(F.when(ddg, blocks).otherwise(heads), lambda h: (h["href"] != "") & (h["title"] != ""))
    found = pages.select("search_id", "provider", "html", F.posexplode_outer(raw).alias("at", "h"))
    found = found.withColumn("url", unwrap_redirect("h.href")).withColumn("title", F.left(decode_html("h.title"), F.lit(FIELD))).withColumn("description", F.left(decode_html("h.description"), F.lit(FIELD)))
    good = F.col("url").isNotNull() & ~is_non_result("url") & (F.col("title") != "")
    first = F.row_number().over(Window.partitionBy("search_id", "url", good).orderBy("at")) == 1
    kept = found.withColumn("_good", good & first)
    n = F.sum(F.col("_good").cast("int")).over(Window.partitionBy("search_id").orderBy("at", F.col("url").asc_nulls_last()))
    total = F.sum(F.col("_good").cast("int")).over(Window.partitionBy("search_id"))
    row = F.row_number().over(Window.partitionBy("search_id").orderBy(F.col("_good").desc(), "at"))
    kept = kept.withColumn("position", n).withColumn("_total", total).withColumn("_row", row)
    blank = F.trim(F.coalesce(html, F.lit(""))) == ""
    why = (
        F.when(blank, "unrecognized")
        .when(ddg, F.when(html.rlike(V.DDG_BLOCKED), "blocked").when(html.rlike(V.DDG_EMPTY), "empty"))
        .when(html.rlike(V.GOOGLE_BLOCKED) | html.rlike(V.GOOGLE_CONSENT), "blocked")
        .when(html.rlike(V.GOOGLE_EMPTY), "empty")
    )
    ok = (F.col("_total") > 0) & ~(ddg & html.rlike(V.DDG_BLOCKED))
    status = F.when(ok, "ok").otherwise(F.coalesce(why, F.lit("unrecognized")))
    out = kept.withColumn("status", status).filter((ok & F.col("_good") & (F.col("position") <= max_hits)) | (~ok & (F.col("_row") == 1)))
    blanked = lambda c: F.when(F.col("status") == "ok", F.col(c)).alias(c)
    return out.select("search_id", "status", blanked("position"), blanked("url"), blanked("title"), blanked("description"))


# ---------------------------------------------------------------- structured data


def _nodes(html: Column) -> Column:
    """All objects of a page's JSON-LD blocks, ``@graph`` members behind their block; blocks that aren't JSON are skipped."""
    bodies = F.regexp_extract_all(F.left(html, F.lit(400_000)), F.lit(r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    blocks = F.filter(F.transform(bodies, lambda b: F.trim(b)), lambda b: (b != "") & (F.length(b) <= 100_000))
    listed = F.transform(blocks, lambda b: F.when(b.startswith("["), b).otherwise(F.concat(F.lit("["), b, F.lit("]"))))
    items = F.flatten(F.transform(listed, lambda b: F.coalesce(F.from_json(b, "array<string>"), F.array().cast("array<string>"))))
    members = F.transform(items, lambda i: F.concat(F.array(i), F.coalesce(F.from_json(F.get_json_object(i, "$['@graph']"), "array<string>"), F.array().cast("array<string>"))))
    return F.filter(F.flatten(members), lambda x: x.startswith("{"))


def _field(node: Column, key: str, cap: int = 600) -> Column:
    return blank_to_null(F.left(collapse(F.get_json_object(node, f"$.{key}")), F.lit(cap)))


def _type(node: Column) -> Column:
    raw = F.get_json_object(node, "$['@type']")
    return F.coalesce(F.get_json_object(raw, "$[0]"), raw)


def json_ld(html: Column | str) -> Column:
    """struct(type, name, description, telephone, address, url, same_as) of the page's business, else of the
    first object with a name or description; null if there is none."""
    # nodes, node and address are bound: what follows mentions them many times
    return let(let(_nodes(col(html)), _business), _facts)


def _business(nodes: Column) -> Column:
    useful = "(?i)^(" + "|".join(V.USEFUL_TYPES) + ")$"
    return F.coalesce(F.get(F.filter(nodes, lambda n: _type(n).rlike(useful)), 0), F.get(F.filter(nodes, lambda n: _field(n, "name").isNotNull() | _field(n, "description").isNotNull()), 0))


def _address(raw: Column) -> Column:
    parts = [_field(raw, k) for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode")]
    return F.when(raw.startswith("{"), blank_to_null(F.concat_ws(", ", *parts))).otherwise(blank_to_null(collapse(raw)))


def _facts(node: Column) -> Column:
    address = let(F.coalesce(F.get_json_object(node, "$.address[0]"), F.get_json_object(node, "$.address")), _address)
    listed = lambda same: F.coalesce(F.from_json(F.when(same.startswith("["), same), "array<string>"), F.when(same.isNotNull(), F.array(same)), F.array().cast("array<string>"))
    same_as = F.slice(F.array_distinct(F.filter(let(F.get_json_object(node, "$.sameAs"), listed), lambda u: u.rlike("(?i)^https?://"))), 1, 8)
    name = F.coalesce(_field(node, "name"), _field(node, "legalName"))
    made = F.struct(_type(node).alias("type"), name.alias("name"), _field(node, "description").alias("description"), _field(node, "telephone").alias("telephone"), address.alias("address"), _field(node, "url").alias("url"), same_as.alias("same_as"))
    something = lambda f: f["name"].isNotNull() | f["description"].isNotNull() | f["telephone"].isNotNull() | f["address"].isNotNull() | (F.size(f["same_as"]) > 0)
    return F.when(node.isNotNull(), let(made, lambda f: F.when(something(f), f)))


def structured_text(meta: Column | str, facts: Column | str) -> Column:
    """Meta description, name and description, each once whatever its case, joined by a dash; 2000 characters at most."""
    f = col(facts)
    parts = F.filter(F.transform(F.array(col(meta), f["name"], f["description"]), lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != ""))
    once = lambda ps, low: F.filter(ps, lambda p, i: F.array_position(low, F.lower(p)) == i + 1)
    return blank_to_null(F.left(F.array_join(let(parts, lambda ps: let(F.transform(ps, F.lower), lambda low: once(ps, low))), " — "), F.lit(2000)))


# ---------------------------------------------------------------- profile pages


def wall(html: Column | str, url: Column | str, status: Column | str) -> Column:
    """What stands before a page: checkpoint, gone, auth, or null. The status decides first, then the path, then the text."""
    # the text is bound, and made only where neither status nor path decides
    text = extract_text(F.left(col(html), F.lit(600_000)), 20_000)
    said = lambda t: F.when(t.rlike(V.CHECKPOINT_TEXT), "checkpoint").when(t.rlike(V.GONE_TEXT), "gone").when(t.rlike(V.AUTH_TEXT) & (F.length(t) < 4_000), "auth")
    s, path = col(status), path_of(url)
    out = F.when(s.isin(999, 429), "checkpoint").when(s.isin(404, 410), "gone").when(s == 403, "auth")
    for pattern, kind in V.WALL_PATHS:
        out = out.when(path.rlike(pattern), kind)
    return out.otherwise(let(text, said))


def _count(raw: Column) -> Column:
    d = F.regexp_replace(raw, r"[.,\s]", "")
    return F.when(d.rlike("^[0-9]{1,9}$"), d.cast("int"))


def employee_range(text: Column | str) -> Column:
    """struct(min, max) of a stated band; an open band has no max."""
    c = col(text)
    low, high = _count(F.regexp_extract(c, V.STAFF_RANGE, 1)), _count(F.regexp_extract(c, V.STAFF_RANGE, 2))
    open_ = F.coalesce(_count(F.regexp_extract(c, V.STAFF_OPEN, 1)), _count(F.regexp_extract(c, V.STAFF_ABOVE, 1)))
    band = lambda a, b: F.struct(a.alias("min"), b.cast("int").alias("max"))
    return F.when(high >= low, band(low, high)).when(open_.isNotNull(), band(open_, F.lit(None)))


def entity_facts(html: Column | str) -> Column:
    """Facts of a company page: from its structured data first, then from its text."""
    text, node = extract_text(F.left(col(html), F.lit(600_000)), 20_000), _node(html, "Organization|Corporation|EducationalOrganization|School")
    return let(text, lambda t: let(node, lambda n: _entity(t, n)))  # bound: each is read many times


def _node(html: Column | str, types: str) -> Column:
    """A page's first object of one of the types."""
    return F.get(F.filter(_nodes(col(html)), lambda n: _type(n).rlike(f"(?i)^({types})$")), 0)


def _entity(text: Column, node: Column) -> Column:
    low, high = _count(F.get_json_object(node, "$.numberOfEmployees.minValue")), _count(F.get_json_object(node, "$.numberOfEmployees.maxValue"))
    exact = F.coalesce(_count(F.get_json_object(node, "$.numberOfEmployees.value")), _count(F.get_json_object(node, "$.numberOfEmployees")))
    said = lambda words, what: blank_to_null(F.trim(F.regexp_extract(text, rf"(?iu)(?:{words})\s*:?\s*({what})", 1)))
    return F.struct(
        _field(node, "name").alias("name"), _field(node, "description").alias("description"), said("setor|indústria|industria|industry", r"[^\n|·]{2,60}?(?=\s{2,}|$|\||·)").alias("industry"),
        F.coalesce(F.when(low.isNotNull(), F.struct(low.alias("min"), high.alias("max"))), employee_range(text)).alias("employee_range"),
        F.coalesce(F.when(low.isNull(), exact), _count(F.regexp_extract(text, V.STAFF_ON_SITE, 1))).alias("employees_on_site"),
        F.coalesce(_field(node, "url", 300), said("site da empresa|website|site", r"https?://\S+")).alias("website"),
        F.coalesce(_field(node, "foundingDate", 40), said("fundada em|fundado em|founded", r"\d{4}")).alias("founded"), _count(F.regexp_extract(text, V.FOLLOWERS, 1)).alias("followers"),
    )


def profile_facts(html: Column | str) -> Column:
    """Facts of a person's page; the name falls back to the page's title."""
    return let(_node(html, "Person"), lambda n: _person(n, col(html)))


def _person(node: Column, html: Column) -> Column:
    address = F.get_json_object(node, "$.address")
    place = F.when(address.startswith("{"), blank_to_null(F.concat_ws(", ", *[_field(address, k, 80) for k in ("addressLocality", "addressRegion", "addressCountry")]))).otherwise(blank_to_null(address))
    headline = F.coalesce(*[_field(node, k, 300) for k in ("jobTitle", "disambiguatingDescription", "description")])
    return F.struct(F.coalesce(_field(node, "name", 200), title_of(html)).alias("name"), headline.alias("headline"), place.alias("location"))


# ---------------------------------------------------------------- robots files


def robots(text: Column | str, agent: str = "garimpo") -> Column:
    """struct(disallow, crawl_delay_ms): rules of the groups for everyone or for ``agent``; a delay counts up to 30 seconds.

    Groups are cut at User-agent lines; a line belongs to the last one before it.
    """
    lines = F.filter(F.transform(F.split(F.regexp_replace(col(text), "#[^\r\n]*", ""), "\r?\n"), lambda x: F.trim(x)), lambda x: x.contains(":"))
    groups = F.slice(F.split(F.array_join(lines, "\n"), r"(?im)^user-agent\s*:\s*"), 2, 10_000)
    ours = F.filter(groups, lambda g: F.trim(F.substring_index(g, "\n", 1)).isin("*") | F.lower(F.substring_index(g, "\n", 1)).contains(agent))
    rules = F.array_join(ours, "\n")
    delay = F.element_at(F.concat(F.array(F.lit("0")), F.regexp_extract_all(rules, F.lit(r"(?im)^crawl-delay[ \t]*:[ \t]*(\d+(?:\.\d+)?)[ \t]*$"), F.lit(1))), -1)
    return F.struct(F.regexp_extract_all(rules, F.lit(r"(?im)^disallow[ \t]*:[ \t]*(\S[^\n]*?)[ \t]*$"), F.lit(1)).alias("disallow"), F.least(delay.cast("double") * 1000, F.lit(30_000.0)).alias("crawl_delay_ms"))


def robots_allows(rules: Column | str, path: Column | str) -> Column:
    return ~F.exists(col(rules)["disallow"], lambda r: (r == "/") | col(path).startswith(r))


# ---------------------------------------------------------------- free-form addresses


def normalised(c: Column | str) -> Column:
    return collapse(F.regexp_replace(F.upper(fold(c)), r"[^A-Z0-9\s]", " "))


def parse_street(raw: Column | str) -> Column:
    """struct(tipo, logradouro, numero): the number stands after the last comma, the type is the first word, short or long."""
    types = F.create_map(*[F.lit(x) for kv in V.STREET_TYPES.items() for x in kv])

    def of(c: Column) -> Column:
        number = F.upper(group(c, r"^.+,\s*(\d+[A-Za-z]?)[^,]*$"))
        return let(number, lambda no: let(F.when(no.isNotNull(), F.regexp_replace(c, ",[^,]*$", "")).otherwise(c), lambda street: named(street, no)))

    def named(street: Column, no: Column) -> Column:
        first = F.replace(F.lower(fold(F.regexp_extract(street, r"^\s*(\S+)", 1))), F.lit("."), F.lit(""))
        return let(types[first], lambda kind: let(normalised(street), lambda words: built(kind, words, no)))

    def built(kind: Column, words: Column, no: Column) -> Column:
        rest = F.when(kind.isNotNull(), F.regexp_replace(words, r"^\S+\s*", "")).otherwise(words)
        return let(rest, lambda r: F.when(r != "", F.struct(kind.alias("tipo"), r.alias("logradouro"), no.alias("numero"))))

    return let(col(raw), of)


def parse_place_address(raw: Column | str) -> Column:
    """struct(tipo, logradouro, numero, bairro, municipio, uf, cep) of an address in one line."""

    def of(c: Column) -> Column:
        code = F.regexp_extract(c, r"(\d{5}-?\d{3})\b", 1)
        rest = F.regexp_replace(c, r"^(.*?)\d{5}-?\d{3}\b", "$1 ")
        return let(code, lambda cep: let(rest, lambda r: let(group(r, r"[-,]\s*([A-Z]{2})\b"), lambda uf: cut(cep, r, uf))))

    def cut(cep: Column, rest: Column, uf: Column) -> Column:
        left = F.when(uf.isNotNull(), F.regexp_replace(rest, r"^(.*?)[-,]\s*[A-Z]{2}\b", "$1 ")).otherwise(rest)
        parts = F.filter(F.transform(F.split(left, r"\s+-\s+|,"), lambda s: F.trim(s)), lambda s: s != "")
        return let(parts, lambda p: let(F.coalesce(F.get(p, 1).rlike(r"^\d+[A-Za-z]?$"), F.lit(False)), lambda numbered: placed(cep, uf, p, numbered)))

    def placed(cep: Column, uf: Column, parts: Column, numbered: Column) -> Column:
        street = parse_street(F.when(numbered, F.concat_ws(", ", F.get(parts, 0), F.get(parts, 1))).otherwise(F.get(parts, 0)))
        return let(street, lambda s: let(F.slice(parts, F.when(s["numero"].isNotNull() & numbered, 3).otherwise(2), F.lit(100)), lambda tail: built(cep, uf, s, tail)))

    def built(cep: Column, uf: Column, street: Column, tail: Column) -> Column:
        city = F.when(F.size(tail) > 0, blank_to_null(normalised(F.element_at(tail, -1))))
        district = F.when(F.size(tail) > 1, blank_to_null(normalised(F.get(tail, 0))))
        number = blank_to_null(F.replace(cep, F.lit("-"), F.lit("")))
        known = street.isNotNull() | (F.size(tail) > 0) | uf.isNotNull()
        return F.when(known, F.struct(street["tipo"].alias("tipo"), F.coalesce(street["logradouro"], F.lit("")).alias("logradouro"), street["numero"].alias("numero"), district.alias("bairro"), city.alias("municipio"), uf.alias("uf"), number.alias("cep")))

    return let(col(raw), of)


# ---------------------------------------------------------------- errors and answers


def describe_fetch_error(code: Column | str, message: Column | str) -> Column:
    named = F.create_map(*[F.lit(x) for kv in V.FETCH_ERRORS.items() for x in kv])[col(code)]
    return F.coalesce(named, F.when(col(message) == "fetch failed", "site inacessível").otherwise(F.left(col(message), F.lit(200))))


def rate_limit_kind(error: Column | str) -> Column:
    """daily, transient or none."""
    e = F.coalesce(col(error), F.lit(""))
    again = [r"(?i)\b429\b|rate.?limit|too many requests|quota|resource_exhausted", r"(?i)\b50[23]\b|overloaded|unavailable|try again later"]
    return F.when(e.rlike(r"(?i)per[-\s_]?day|perday|daily"), "daily").when(any_of([e.rlike(p) for p in again]), "transient").otherwise("none")


def backoff_ms(attempt: Column | str) -> Column:
    """Half a minute, doubled with each attempt, five minutes at most."""
    return F.least(F.lit(30_000) * F.pow(F.lit(2), F.greatest(col(attempt) - 1, F.lit(0))), F.lit(300_000)).cast("long")


def salvage_json(answer: Column | str, schema: str) -> Column:
    """A model's answer: as it is, without its code fence, or its outermost braces; null if none is JSON."""
    c = F.trim(F.regexp_replace(col(answer), r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    sound = lambda t: F.when(F.try_parse_json(t).isNotNull(), F.from_json(t, schema))
    return F.coalesce(sound(c), sound(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))))


def answer_rows(answer: Column | str, item: str) -> Column:
    """The rows of a model's answer, an array of ``item`` (a DDL schema): a bare list, or the list under ``results`` or ``leads``;
    fences and words around are taken off; null if nothing is JSON."""
    c = F.trim(F.regexp_replace(col(answer), r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    listed = f"array<struct<{', '.join(':'.join(x.split(None, 1)) for x in item.split(', '))}>>"
    bare = F.when(c.startswith("[") & F.try_parse_json(c).isNotNull(), F.from_json(c, listed))
    found = salvage_json(answer, f"results {listed}, leads {listed}")
    return F.coalesce(bare, found["results"], found["leads"])

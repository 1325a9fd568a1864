"""Hosts, addresses on the web, search hits and page markup."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import values as V
from .text import any_of, blank_to_null, col, collapse, fold, group, let

# ---------------------------------------------------------------- hosts


def host_of(url: Column | str) -> Column:
    """The host in lower case without ``www.``; empty where the text is no absolute address."""
    host = F.lower(F.regexp_extract(col(url), r"(?i)^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@\s]*@)?([^/?#:\s]+)", 1))
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def path_of(url: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(col(url), r"(?i)^\s*[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_in(host: Column, listed: list[str]) -> Column:
    """The host itself or any name below it is listed."""
    return host.isin(listed) | any_of([host.endswith("." + x) for x in listed])


def is_hub(host: Column) -> Column:
    return host_in(host, V.LINK_HUBS)


def is_builder(host: Column) -> Column:
    return any_of([host.endswith(x) for x in V.FREE_BUILDERS])


def apex_of(url: Column | str) -> Column:
    """The registrable name: two labels, three under a two-label ending; IPv4 and free builders whole."""

    def of(host: Column) -> Column:
        tail = lambda n: F.substring_index(host, ".", -n)
        whole = (tail(2) == host) | host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | is_builder(host)
        return F.when(whole, host).when(tail(2).isin(V.TWO_LABEL_ENDINGS), tail(3)).otherwise(tail(2))

    return let(host_of(url), of)  # the host is bound: the tests would each repeat its expressions


def apex_label(url: Column | str) -> Column:
    return collapse(F.regexp_replace(F.substring_index(apex_of(url), ".", 1), "[-_]+", " "))


def is_social_profile(url: Column | str) -> Column:
    """A profile on a hub: chat hosts always, else a single path segment, or a channel's two, that isn't content."""
    host, path = host_of(url), F.regexp_replace(path_of(url), "/+$", "")
    chat = host.isin(V.CHAT_HOSTS)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    numbered = (path == "/profile.php") & col(url).rlike(r"\?(?:[^#]*&)?id=")
    channel = (F.size(segments) == 2) & F.coalesce(F.get(segments, 0), F.lit("")).rlike(r"(?i)^(c|channel|user|@[\w.-]+)$")
    return chat | ((host != "") & (path != "") & ~path.rlike(V.NOT_A_PROFILE) & (numbered | (F.size(segments) == 1) | channel))


def is_linkedin_profile(url: Column | str) -> Column:
    path = F.lower(path_of(url))
    return ~path.startswith("/pub/dir") & path.rlike(r"^/(?:[a-z]{2}/)?(in|pub)/[^/]+")


def is_linkedin_entity(url: Column | str) -> Column:
    path = F.regexp_replace(F.lower(path_of(url)), "/+$", "")
    return path.rlike(r"^/(?:[a-z]{2}/)?(company|school|showcase)/(?!unavailable(?:/|$))[^/]+(/(about|life|people))?$")


def linkedin_entity_slug(url: Column | str) -> Column:
    return group(F.regexp_replace(F.lower(path_of(url)), "/+$", ""), r"^/(?:[a-z]{2}/)?(?:company|school|showcase)/([^/]+)")


def profile_slug(url: Column | str) -> Column:
    return group(F.lower(path_of(url)), r"^/(?:[a-z]{2}/)?(?:in|pub)/([^/]+)")


def linkedin_about_url(url: Column | str) -> Column:
    return F.concat(F.lit("https://www.linkedin.com/company/"), linkedin_entity_slug(url), F.lit("/about/"))


def classify_hit(url: Column | str) -> Column:
    """What a search hit leads to; the first kind that fits, in this order."""
    host = host_of(url)
    linkedin = F.when(is_linkedin_profile(url), "linkedin").when(is_linkedin_entity(url), "linkedin_company").otherwise("resume")
    return (
        F.when(host == "", "unknown")
        .when(host_in(host, V.LEGAL), "legal")
        .when(host_in(host, V.DOCUMENTS), "document")
        .when(host_in(host, V.AGGREGATORS), "aggregator")
        .when(host_in(host, V.RESUME), "resume")
        .when(host_in(host, V.LINKEDIN), linkedin)
        .when(is_hub(host), F.when(is_social_profile(url), "social").otherwise("document"))
        .otherwise("site")
    )


def is_storable_kind(kind: Column) -> Column:
    return kind.isin("social", "site", "linkedin", "linkedin_company")


def is_non_result(url: Column | str) -> Column:
    host = host_of(url)
    return (host == "") | host_in(host, V.NON_RESULTS)


def is_non_business(url: Column | str) -> Column:
    host = host_of(url)
    return (host == "") | host_in(host, V.NON_BUSINESS)


def looks_like_registry_mirror(title: Column | str, description: Column | str) -> Column:
    """Two registry phrases, or one and a registry number's shape."""
    text = F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.coalesce(col(description), F.lit("")))
    phrases = F.size(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(V.REGISTRY_PHRASES), F.lit(1))))
    return (phrases >= 2) | ((phrases >= 1) & text.rlike(V.CNPJ_SHAPE))


def unwrap_redirect(url: Column | str) -> Column:
    """The address inside a search engine's redirect, up to two levels deep; null for anything but http(s)."""
    absolute = lambda u: F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.rlike(r"^/(?:url|l/?)\?"), F.concat(F.lit("https://duckduckgo.com"), u)).otherwise(u)

    def inner(u: Column) -> Column:
        query = lambda k: F.try_url_decode(group(u, rf"[?&]{k}=([^&#]*)"))
        goes_on = path_of(u).rlike(r"^/url$|/l/?$")
        return F.coalesce(query("uddg"), F.when(goes_on, F.coalesce(query("q"), query("url"))))

    def step(u: Column) -> Column:
        return let(inner(u), lambda found: F.when(found.isNotNull(), absolute(found)).otherwise(u))

    last = lambda u: F.when(u.rlike("(?i)^https?://[^/]") & inner(u).isNull(), u)
    return let(absolute(F.trim(col(url))), lambda u: let(step(u), lambda v: let(step(v), last)))


# ---------------------------------------------------------------- markup


def decode_entities(c: Column) -> Column:
    """The few named entities pages use, then any other to a space. Numeric ones below 128 and Latin-1 by rule."""
    for pattern, text in (("(?i)&quot;", '"'), ("(?i)&#0*39;|&apos;|&#x27;", "'"), ("(?i)&nbsp;|&#160;", " "), ("(?i)&lt;", "<"), ("(?i)&gt;", ">")):
        c = F.regexp_replace(c, pattern, text)
    pieces = F.regexp_extract_all(c, F.lit(r"(?s)((?:(?!&#\d{2,5};).)+|&#\d{2,5};)"), F.lit(1))
    number = lambda p: F.regexp_extract(p, r"^&#0*(\d{2,5});$", 1)
    one = lambda p: F.when(number(p) != "", F.decode(F.unhex(F.lpad(F.hex(number(p).cast("int")), 4, "0")), "UTF-16BE")).otherwise(p)
    c = F.when(c.rlike(r"&#\d{2,5};"), F.array_join(F.transform(pieces, one), "")).otherwise(c)
    return F.regexp_replace(F.regexp_replace(c, "(?i)&amp;", "&"), "(?i)&[a-z]+;", " ")


def decode_html(c: Column | str) -> Column:
    return collapse(decode_entities(F.regexp_replace(col(c), "<[^>]+>", "")))


def extract_text(html: Column | str, limit: int = V.EXCERPT_CHARS) -> Column:
    """A page's words: without scripts, styles, comments and tags, at most ``limit`` characters."""
    c = col(html)
    for noise in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<!--.*?-->", r"<[^>]+>", "(?i)&nbsp;"):
        c = F.regexp_replace(c, noise, " ")
    c = F.regexp_replace(F.regexp_replace(c, "(?i)&amp;", "&"), "(?i)&[a-z]+;", " ")
    return F.left(collapse(c), F.lit(limit))


def _raw_title(html: Column | str) -> Column:
    return F.regexp_extract(col(html), r"(?is)<title[^>]*>(.{0,300}?)</title>", 1)


def title_of(html: Column | str) -> Column:
    return blank_to_null(F.left(decode_html(_raw_title(html)), F.lit(200)))


def plain_title_of(html: Column | str) -> Column:
    """The title by the plainer rule of the texts: ``&amp;`` is read, any other named entity is a space, numeric ones stay, and only ASCII white space is collapsed."""
    c = F.regexp_replace(_raw_title(html), "<[^>]+>", "")
    for pattern, text in (("(?i)&amp;", "&"), ("(?i)&[a-z]+;", " "), (r"[\t\n\f\r ]+", " "), (r"^\p{Zs}+|\p{Zs}+$", "")):
        c = F.regexp_replace(c, pattern, text)
    return blank_to_null(F.left(c, F.lit(200)))


def generator_of(html: Column | str) -> Column:
    return blank_to_null(F.trim(F.regexp_extract(col(html), r"""(?i)<meta[^>]+name=["']generator["'][^>]+content=["']([^"']+)["']""", 1)))


def platform_of(html: Column | str, generator: Column | None = None) -> Column:
    """The generator first, then marks in the markup, in order."""
    h, g = F.lower(col(html)), F.lower(generator_of(html) if generator is None else generator)
    out = F
    for name in V.GENERATORS:
        out = out.when(g.contains(name), name)
    for mark, name in V.PLATFORM_MARKS:
        out = out.when(h.contains(mark), name)
    return out


def footer_year(html: Column | str) -> Column:
    years = F.regexp_extract_all(col(html), F.lit(r"(?i)(?:©|&copy;|copyright)[^0-9]{0,20}(20\d{2})"), F.lit(1))
    return F.array_max(F.filter(F.transform(years, lambda y: y.cast("int")), lambda y: y <= 2100))


def meta_description(html: Column | str) -> Column:
    """description, og: or twitter: description, attributes in either order."""
    head = F.left(col(html), F.lit(200_000))

    def meta(key: str) -> list[Column]:
        attr = rf"""(?:name|property)=["']{key}["']"""
        either = (rf"""(?i)<meta[^>]+{attr}[^>]+content=["']([^"']*)["']""", rf"""(?i)<meta[^>]+content=["']([^"']*)["'][^>]+{attr}""")
        return [blank_to_null(F.left(collapse(decode_entities(F.regexp_extract(head, p, 1))), F.lit(600))) for p in either]

    return F.coalesce(*meta("description"), *meta("og:description"), *meta("twitter:description"))


def ig_handle(html: Column | str) -> Column:
    found = F.regexp_extract(col(html), r"""(?i)instagram\.com/([A-Za-z0-9_.]{2,30})(?:[/?"'\s]|$)""", 1)
    return F.when(~found.isin("", "p", "reel", "explore"), found)


def _e164(raw: Column) -> Column:
    d = F.regexp_replace(raw, "[^0-9]", "")
    return F.when(d.startswith("55") & (F.length(d) >= 12), F.concat(F.lit("+"), d)).otherwise(F.concat(F.lit("+55"), d))


def phones_of(html: Column | str) -> Column:
    """Chat links, then tel links, then ``(DD) ...`` in the text; 10 to 13 digits, no run of seven equal ones; at most 8."""
    c = col(html)
    wa = F.regexp_extract_all(c, F.lit(r"(?i)(?:wa\.me/|api\.whatsapp\.com/send\?phone=)(\+?55\d{10,11})"), F.lit(1))
    tel = F.regexp_extract_all(c, F.lit(r"""(?i)href=["']tel:(\+?[\d\s().-]{10,20})["']"""), F.lit(1))
    text = F.regexp_extract_all(c, F.lit(r"(\(\d{2}\)\s?9?\d{4}[-\s]?\d{4}\b)"), F.lit(1))
    number = F.transform(F.concat(wa, tel, text), lambda x: F.regexp_replace(x, "[^0-9]", ""))
    sound = F.filter(number, lambda d: F.length(d).between(10, 13) & ~d.rlike(r"(\d)\1{6,}"))
    return F.slice(F.array_distinct(F.transform(sound, _e164)), 1, V.MAX_CONTACTS)


def emails_of(html: Column | str, site_host: Column | str | None = None) -> Column:
    """mailto links, then addresses in the prose; the site's own first, then free mailboxes, then others; at most 8."""
    c = col(html)
    linked = F.regexp_extract_all(c, F.lit(r"""(?i)href=["']mailto:([^"']+)"""), F.lit(1))
    prose = c
    for noise in (r"(?is)<(script|style)\b[^>]*>.*?</\1>", r"(?s)<!--.*?-->", r"""(?i)href=["']mailto:[^"']+"""):
        prose = F.regexp_replace(prose, noise, " ")
    found = F.concat(linked, F.regexp_extract_all(decode_html(prose), F.lit(f"({V.EMAIL})"), F.lit(1)))

    def tidy(x: Column) -> Column:
        x = F.lower(F.coalesce(F.try_url_decode(F.replace(F.trim(x), F.lit("+"), F.lit("%2B"))), x))
        x = F.trim(F.substring_index(F.regexp_replace(x, "^mailto:", ""), "?", 1))
        return F.regexp_replace(F.regexp_replace(x, r"""^[<("'\s]+""", ""), r"""[>)"'\s.,;:]+$""", "")

    domain = lambda x: F.split_part(x, F.lit("@"), F.lit(2))
    sound = lambda x: x.contains("@") & ~x.rlike(V.NOT_A_CONTACT) & ~x.rlike(V.ASSET_AT) & (F.length(F.substring_index(x, "@", 1)) >= 2) & domain(x).contains(".")
    kept = F.array_distinct(F.filter(F.transform(found, tidy), sound))
    return F.slice(rank_emails(kept, site_host), 1, V.MAX_CONTACTS)


def rank_emails(emails: Column | str, site_host: Column | str | None = None) -> Column:
    """The site's own addresses, then those of free mailboxes, then others, each in the order found."""

    def ranked(own: Column) -> Column:
        def rank(x: Column) -> Column:
            mine = lambda d: (own == "") | (d == own) | d.endswith(F.concat(F.lit("."), own))
            free = lambda d: d.isin(V.FREE_MAIL) | d.rlike(V.FREE_ANY_ENDING)
            return let(F.split_part(x, F.lit("@"), F.lit(2)), lambda d: F.when(mine(d), 0).when(free(d), 1).when(d.isNotNull(), 2))

        told = F.transform(col(emails), lambda x: F.struct(x.alias("x"), rank(x).alias("rank")))
        of = lambda all_, n: F.transform(F.filter(all_, lambda e: e["rank"] == n), lambda e: e["x"])
        return let(told, lambda all_: F.concat(of(all_, 0), of(all_, 1), of(all_, 2)))

    # the site's own domain is computed once a row, an address's rank once an address
    return let(apex_of(F.concat(F.lit("https://"), col(site_host))) if site_host is not None else F.lit(""), ranked)


def merge_contacts(current: Column | str, found: Column | str) -> Column:
    return F.slice(F.array_distinct(F.concat(col(current), col(found))), 1, V.MAX_CONTACTS)


def resolve_href(href: Column | str, base: Column | str) -> Column:
    """Origin and path of a link on a page, dot segments resolved, query and fragment off; null for anything but http(s)."""
    h, here = F.trim(col(href)), col(base)
    origin = F.regexp_extract(here, r"(?i)^([a-z][a-z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_replace(F.coalesce(F.nullif(path_of(here), F.lit("")), F.lit("/")), "[^/]*$", "")
    bare = F.regexp_replace(h, "[?#].*$", "")
    absolute = (
        F.when(h.rlike("(?i)^https?://"), bare)
        .when(h.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None))
        .when(h.startswith("//"), F.concat(F.regexp_extract(here, "^([^:]+:)", 1), bare))
        .when(h.startswith("/"), F.concat(origin, bare))
        .when(bare == "", F.concat(origin, F.coalesce(F.nullif(path_of(here), F.lit("")), F.lit("/"))))
        .otherwise(F.concat(origin, folder, bare))
    )

    def tidy(u: Column) -> Column:
        return let(path_of(u), lambda p: joined(u, p))

    def joined(u: Column, plain: Column) -> Column:
        empty = F.array().cast("array<string>")
        dots = plain.contains("/.")  # nothing to resolve in nearly all
        parts = F.split(plain, "/")
        step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
        kept = F.array_join(F.aggregate(parts, empty, step), "/")
        path = F.when(dots, F.concat(kept, F.when(plain.rlike(r"/\.{1,2}$"), "/").otherwise(""))).otherwise(plain)
        return F.concat(F.lower(F.regexp_extract(u, "(?i)^([a-z]+://[^/?#]+)", 1)), let(path, lambda p: F.when(p == "", "/").otherwise(p)))

    return let(absolute, tidy)


def internal_links(html: Column | str, base: Column | str, limit: int = 5, every: bool = False) -> Column:
    """Links of the same host to read next, by origin and path, without the root: those whose path promises contacts or
    services. With ``every`` also the others, after them, but no files."""
    return chosen_links(links_here(html, base), limit, every)


def links_here(html: Column | str, base: Column | str) -> Column:
    """Every link of the same host but the root, as (u, path, first: whether its path promises contacts or services), in the page's order."""
    hrefs = F.regexp_extract_all(col(html), F.lit(r"""(?i)href=["']([^"'#]+)["']"""), F.lit(1))
    full = F.filter(F.transform(F.array_distinct(hrefs), lambda h: resolve_href(h, base)), lambda u: u.isNotNull())
    told = F.transform(F.array_distinct(full), lambda u: let(path_of(u), lambda p: F.struct(u.alias("u"), p.alias("path"), p.rlike(V.INTERESTING).alias("first"))))
    return let(host_of(base), lambda host: F.filter(told, lambda e: ~e["path"].isin("", "/") & (host_of(e["u"]) == host)))


def chosen_links(here: Column | str, limit: int = 5, every: bool = False) -> Column:
    """Of :func:`links_here` those to read next."""
    kept = F.slice(F.filter(col(here), (lambda e: ~e["path"].rlike(V.FILE_ENDING)) if every else (lambda e: e["first"])), 1, 4 * limit)
    ranked = lambda k: F.concat(F.filter(k, lambda e: e["first"]), F.filter(k, lambda e: ~e["first"]))
    return F.transform(F.slice(let(kept, ranked), 1, limit), lambda e: e["u"])


def page_signals(html: Column | str, final_url: Column | str) -> dict[str, Column]:
    """The columns of a page's signals, by name."""
    text = extract_text(html)
    c, head = col(html), F.left(col(html), F.lit(200_000))
    contact = c.rlike(r"""(?i)href=["']tel:""") | c.rlike(r"(?i)(?:wa\.me/|api\.whatsapp\.com/send)") | c.rlike(r"""(?i)href=["']mailto:""")
    return {
        "has_viewport": head.rlike(r"""(?i)<meta[^>]+name=["']viewport["']"""),
        "has_wa_link": c.rlike(r"(?i)(?:wa\.me/|api\.whatsapp\.com/send|whatsapp://send)"),
        "has_contact_path": contact | head.rlike(r"(?iu)\b(agendar|agendamento|marcar hor[áa]rio|reservar|fale conosco|contato)\b"),
        "has_form": c.rlike(r"(?i)<form[\s>]"),
        "generator": generator_of(head),
        "platform": platform_of(c),
        "footer_year": footer_year(c),
        "title": title_of(head),
        "ig_handle": ig_handle(c),
        "emails": emails_of(c, host_of(final_url)),
        "phones": phones_of(c),
        "is_https": col(final_url).startswith("https://"),
        "text_excerpt": text,
        "meta_description": meta_description(c),
        "site_phone": F.get(phones_of(c), 0),
        "is_js_shell": (F.length(text) < V.SHELL_TEXT_CHARS) & c.rlike(V.MOUNT_POINTS),
    }


def signals_of_signals(html: Column | str) -> dict[str, Column]:
    """Those of :func:`page_signals` that follow from others, once these are columns."""
    return {"site_phone": F.get("phones", 0), "is_js_shell": (F.length("text_excerpt") < V.SHELL_TEXT_CHARS) & col(html).rlike(V.MOUNT_POINTS)}


def run_probes(probes: dict[str, list[str]], text: Column | str) -> Column:
    """Map probe -> whether one of its terms stands as a whole word in the folded text; empty where nothing was read."""

    def term(t: str) -> str:
        from .text import _FROM, _TO

        plain = t.translate(str.maketrans(_FROM, _TO)).lower()
        return "".join("\\" + ch if ch in r".*+?^${}()|[]\\" else ch for ch in plain)

    tests = {k: "(?:^|[^a-z0-9])(?:" + "|".join(map(term, terms)) + ")(?:[^a-z0-9]|$)" for k, terms in probes.items() if terms}
    empty = F.create_map().cast("map<string,boolean>")
    if not tests:
        return empty
    # the folded text is bound, so that it is made once for all probes
    made = let(F.lower(fold(text)), lambda hay: F.create_map(*[x for k, p in tests.items() for x in (F.lit(k), hay.rlike(p))]))
    return F.when(F.coalesce(F.trim(col(text)), F.lit("")) == "", empty).otherwise(made)

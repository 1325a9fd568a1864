"""Names of companies and people, and whether a text is about one."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import values as V
from .text import blank_to_null, col, collapse, fold, let

MIN_NAME_TOKENS, MIN_COMPANY_TOKENS, MIN_SINGLE_CHARS = 3, 2, 5
# fixed values: legal forms at a name's end
LEGAL_FORMS = "LTDA LIMITADA ME EPP EIRELI SA CIA MEI EI SS".split()
# fixed values: headlines that say nothing
GENERIC_HEADLINES = [
    "ESTUDANTE", "AUTONOMO", "AUTONOMA", "PROFISSIONAL", "PROFISSIONAL LIBERAL", "EMPREENDEDOR", "EMPREENDEDORA", "EMPRESARIO", "EMPRESARIA", "FREELANCER",
    "MICROEMPREENDEDOR INDIVIDUAL", "MEI", "APOSENTADO", "APOSENTADA", "DESEMPREGADO", "DESEMPREGADA", "COLABORADOR", "CEO", "OPEN TO WORK",
    "DISPONIVEL PARA TRABALHAR", "DISPONIVEL PARA O MERCADO", "BUSCANDO OPORTUNIDADES", "EM BUSCA DE OPORTUNIDADES", "NA", "NAO INFORMADO",
]
# fixed values: shapes of profile titles
CHROME = r"(?i)^\s*(linkedin|linkedin brasil|perfil profissional|professional profile|profile|perfil)\s*$"
DASH = r"\s+[-–—·]\s+"
TRAILING_BRAND = r"(?i)\s*[-–—|·]\s*linkedin(\s+brasil)?\s*$"
LOCATION_SHAPE = r"(?iu)(,\s*(brasil|brazil)\s*$)|^(regiao|região|grande)\s+"
BOILERPLATE = r"(?iu)(maior comunidade profissional|world'?s largest professional|comunidade profissional do mundo|bilh(ão|ao|ões|oes) de membros|billion members|ver o perfil de|view .{0,40}profile on linkedin)"


def _words(c: Column) -> Column:
    return F.split(F.regexp_replace(F.upper(fold(c)), r"[^A-Z\s]", " "), r"\s+")


def strip_registry_numbers(raw: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(col(raw), V.LEADING_CNPJ, ""), V.TRAILING_DIGITS, ""))


def name_tokens(raw: Column | str) -> Column:
    """Upper-case words without accents, particles, single letters and registry numbers; none for null."""
    words = _words(strip_registry_numbers(raw))
    return F.coalesce(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(V.NAME_STOPWORDS)), F.array().cast("array<string>"))


def _haystack(raw: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(F.filter(_words(raw), lambda w: ~w.isin(V.NAME_STOPWORDS)), " "), F.lit(" "))


def is_name_match(haystack: Column | str, name: Column | str) -> Column:
    """At least three name tokens, in a row and as whole words, in the text."""
    tokens = name_tokens(name)
    return F.coalesce((F.size(tokens) >= MIN_NAME_TOKENS) & (col(haystack) != "") & _haystack(col(haystack)).contains(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))), F.lit(False))


def match_strength(url, title, description, name) -> Column:
    """Where a name is found: title, description, url, or null."""
    words = F.regexp_replace(col(url), r"[/._\-+?=&:]+", " ")
    return F.when(is_name_match(title, name), "title").when(is_name_match(description, name), "description").when(is_name_match(words, name), "url")


def search_query(legal, trade, city, state) -> Column:
    """The quoted name and its place; null if the name has fewer than three tokens."""
    name = strip_registry_numbers(F.trim(F.coalesce(col(legal), col(trade), F.lit(""))))
    where = F.concat_ws(" ", blank_to_null(city), blank_to_null(state))
    return F.when(F.size(name_tokens(name)) >= MIN_NAME_TOKENS, F.concat(F.lit('"'), name, F.lit('"'), F.when(where != "", F.concat(F.lit(" "), where)).otherwise("")))


def company_tokens(raw: Column | str) -> Column:
    """Name tokens without legal forms at the end."""
    forms = "|".join(LEGAL_FORMS)
    joined = F.regexp_replace(F.array_join(name_tokens(raw), " "), rf"(?:(?:^| )(?:{forms}))+$", "")
    return F.filter(F.split(joined, " "), lambda w: w != "")


def _matches(candidate: Column, name: Column) -> Column:
    # an agreement with spaces is one without them, too
    ax, bx = F.array_join(candidate, ""), F.array_join(name, "")
    single = (F.length(F.get(candidate, 0)) >= MIN_SINGLE_CHARS) & (F.get(candidate, 0) == F.get(name, 0))
    either = ax.startswith(bx) | bx.startswith(ax)
    return F.when(F.size(candidate) == 0, False).when(F.size(candidate) == 1, single).otherwise(either)


def names_agree(candidate: Column, name: Column) -> Column:
    """Two lists of company tokens agree; the second one has two at least."""
    return F.coalesce((F.size(name) >= MIN_COMPANY_TOKENS) & _matches(candidate, name), F.lit(False))


def verify_mirror_link(site_url, site_title, legal, trade) -> Column:
    """A site's title or domain label agrees with one of a company's names."""
    from .web import apex_label

    # each side's words are computed once and bound: the test of two lists mentions both many times
    said = F.array(company_tokens(site_title), company_tokens(apex_label(site_url)))
    called = F.array(company_tokens(legal), company_tokens(trade))
    return F.coalesce(let(called, lambda ns: F.exists(said, lambda c: F.exists(ns, lambda n: names_agree(c, n)))), F.lit(False))


# ---------------------------------------------------------------- profile titles


def parse_profile_title(title: Column | str) -> Column:
    """struct(leading, headline) of a profile page's title."""
    raw = F.trim(F.regexp_replace(collapse(F.coalesce(col(title), F.lit(""))), TRAILING_BRAND, ""))
    segments = F.filter(F.transform(F.split(raw, r"\|"), lambda s: F.trim(s)), lambda s: (s != "") & ~s.rlike(CHROME))
    dashed = F.filter(F.transform(F.split(F.get(segments, 0), DASH), lambda s: F.trim(s)), lambda s: s != "")
    rest = F.concat(F.slice(dashed, F.lit(2), F.greatest(F.size(dashed), F.lit(1))), F.slice(segments, F.lit(2), F.greatest(F.size(segments), F.lit(1))))
    return F.struct(F.get(dashed, 0).alias("leading"), blank_to_null(F.array_join(rest, " - ")).alias("headline"))


def title_leads_with_name(title, name) -> Column:
    tokens, leading = name_tokens(name), parse_profile_title(title)["leading"]
    said = F.array_join(F.filter(_words(leading), lambda w: w != ""), " ")
    return F.coalesce((F.size(tokens) >= MIN_NAME_TOKENS) & said.startswith(F.array_join(tokens, " ")), F.lit(False))


def headline_has_substance(headline) -> Column:
    raw = collapse(F.coalesce(col(headline), F.lit("")))
    words = F.filter(_words(raw), lambda w: w != "")
    said = F.array_join(words, " ")
    long = F.filter(words, lambda w: F.length(w) > 1)
    empty = (F.length(raw) < 3) | raw.rlike(LOCATION_SHAPE) | raw.rlike(BOILERPLATE) | (said == "") | said.isin(GENERIC_HEADLINES) | (F.size(long) == 0)
    return ~(empty | ((F.size(long) == 1) & F.coalesce(F.get(long, 0).isin(GENERIC_HEADLINES), F.lit(False))))


def headline_repeats_name(headline, name) -> Column:
    h, n = F.array_join(name_tokens(headline), " "), F.array_join(name_tokens(name), " ")
    return (h != "") & (n != "") & (n.startswith(h) | h.startswith(n))


def profile_is_evidence(headline, ambiguous, name) -> Column:
    return ~F.coalesce(col(ambiguous), F.lit(False)) & headline_has_substance(headline) & ~headline_repeats_name(headline, name)


def entity_title_matches(title, legal, trade) -> Column:
    """A company page's leading title and one of the names begin with each other; two tokens at least."""
    page = company_tokens(parse_profile_title(title)["leading"])
    a = F.array_join(page, " ")

    def one(name) -> Column:
        tokens = company_tokens(name)
        b = F.array_join(tokens, " ")
        return (F.size(tokens) >= MIN_COMPANY_TOKENS) & (a.startswith(b) | b.startswith(a))

    return F.coalesce((F.size(page) >= MIN_COMPANY_TOKENS) & (one(legal) | one(trade)), F.lit(False))


def terms_from_label(label: Column | str) -> Column:
    """Search terms in an activity's label: what follows the dash, split at semicolons, without brackets, six words each."""
    c = col(label)
    body = F.when(c.contains("—"), F.regexp_replace(c, "^[^—]*—", "")).otherwise(c)
    part = lambda p: F.array_join(F.slice(F.split(collapse(F.regexp_replace(p, r"\([^)]*\)", " ")), " "), 1, 6), " ")
    return F.filter(F.transform(F.split(body, ";"), part), lambda p: F.length(p) >= 4)

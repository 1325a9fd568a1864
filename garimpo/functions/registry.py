"""Registry fields: phones, registry numbers, mail domains, addresses, CSV fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import values as V
from .text import any_of, blank_to_null, col, collapse, digits, let, strip

# ---------------------------------------------------------------- phones


def local_number(telephone: Column | str) -> Column:
    """Digits; an eight-digit number that starts 6 to 9 gets the mobile 9 in front."""
    d = digits(telephone)
    return F.when(d.rlike("^[6-9][0-9]{7}$"), F.concat(F.lit("9"), d)).otherwise(d)


def classify_phone(area: Column | str, telephone: Column | str) -> Column:
    """struct(e164, is_mobile); null where area code or shape is no Brazilian number's.

    Nine digits from 9 on are mobile, eight from 2 to 5 fixed; leading zeros of an area code are tolerated.
    """
    code = F.regexp_replace(digits(area), "^0+", "")
    local = local_number(telephone)
    mobile, fixed = local.rlike("^9[0-9]{8}$"), local.rlike("^[2-5][0-9]{7}$")
    return F.when(code.isin(V.AREA_CODES) & (mobile | fixed), F.struct(F.concat(F.lit("+55"), code, local).alias("e164"), mobile.alias("is_mobile")))


def is_mobile_shape(telephone: Column | str) -> Column:
    """The filter's test, on the stored text alone: 9 digits from 9 on, or 8 from 6 on."""
    t = col(telephone)
    return ((F.length(t) == 9) & t.startswith("9")) | ((F.length(t) == 8) & t.rlike("^[6-9]"))


def wa_me_link(e164: Column | str) -> Column:
    return F.concat(F.lit("https://wa.me/"), F.regexp_replace(col(e164), r"\+", ""))


# ---------------------------------------------------------------- registry numbers


def _check_digit(d: Column, n: int) -> Column:
    total = F.lit(0)
    for i in range(n):
        total = total + F.substring(d, i + 1, 1).cast("int") * ((n - 1 - i) % 8 + 2)
    rest = total % 11
    return F.when(rest < 2, 0).otherwise(11 - rest)


def is_cnpj_valid(raw: Column | str) -> Column:
    """Fourteen digits, not all equal, with both modulo-11 check digits right."""
    d = digits(raw)
    shaped = d.rlike("^[0-9]{14}$") & ~d.rlike(r"^(\d)\1{13}$")
    right = (_check_digit(d, 12) == F.substring(d, 13, 1).cast("int")) & (_check_digit(d, 13) == F.substring(d, 14, 1).cast("int"))
    return F.coalesce(shaped & right, F.lit(False))


def cnpjs_in(title: Column | str, description: Column | str) -> Column:
    """Valid registry numbers in a search hit, in order of appearance, once each."""
    text = F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.coalesce(col(description), F.lit("")))
    found = F.transform(F.regexp_extract_all(text, F.lit(V.CNPJ_FULL), F.lit(1)), digits)
    return F.array_distinct(F.filter(found, is_cnpj_valid))


def full_cnpj(root: Column | str, order: Column | str, check: Column | str) -> Column:
    from .text import pad_left

    return F.concat(pad_left(root, 8), pad_left(order, 4), pad_left(check, 2))


# ---------------------------------------------------------------- raw fields


def rf_date(raw: Column | str) -> Column:
    """A date from ``yyyymmdd``; null for other lengths, zero parts and impossible days."""
    d = strip(raw)
    sound = d.rlike("^[0-9]{8}$") & ~d.startswith("0000") & (F.substring(d, 5, 2) != "00") & (F.substring(d, 7, 2) != "00")
    return F.when(sound, F.try_to_date(d, "yyyyMMdd"))


def rf_decimal(raw: Column | str) -> Column:
    """A double from text with a decimal comma; null if anything else is there."""
    d = F.regexp_replace(strip(raw), "^([^,]*),", "$1.")
    return F.when(d.rlike(r"^-?\d+(\.\d+)?$"), d.cast("double"))


# ---------------------------------------------------------------- mail


def mail_domain(email: Column | str) -> Column:
    """What follows the last @, trimmed, in lower case."""
    return F.lower(strip(F.substring_index(col(email), "@", -1)))


def is_own_domain(domain: Column) -> Column:
    """A domain that isn't a free mailbox, a misspelt one, an institution's, the state's or an accountant's."""
    out = [
        domain.isin(V.FREE_MAIL),
        *(domain.rlike(p) for p in (V.TYPO_MAIL, V.FREE_ANY_ENDING, V.INSTITUTIONAL, V.ACCOUNTANT, V.ACCOUNTANT_WORD)),
        domain.endswith(".gov.br"),
        domain.endswith(".cnt.br"),
    ]
    return domain.contains(".") & (F.length(domain) >= 5) & ~any_of(out)


def website_from_email(email: Column | str) -> Column:
    domain = mail_domain(email)
    return F.when(col(email).contains("@") & is_own_domain(domain), F.concat(F.lit("https://"), domain))


# ---------------------------------------------------------------- addresses


def title_case(raw: Column | str) -> Column:
    """Title case by word: highways before a number, Roman numerals and words that aren't plain letters stay;
    particles after the first word are lower case."""

    def cased(words: Column, w: Column, i: Column, c: Column) -> Column:
        upper, lower = F.upper(c), F.lower(c)
        following = F.coalesce(F.get(words, i + 1), F.lit(""))
        stays = (upper.isin(V.HIGHWAY) & following.rlike("^[0-9]")) | upper.rlike(V.ROMAN) | ~lower.rlike("^[a-zà-ÿ]+$")
        word = F.when((i > 0) & lower.isin(V.PARTICLES), lower).otherwise(F.concat(F.upper(F.substring(lower, 1, 1)), F.substring(lower, F.lit(2), F.length(lower))))
        around = lambda n: F.regexp_extract(w, AROUND, n)
        return F.when(stays, w).otherwise(F.concat(around(1), word, around(3)))

    one = lambda words: lambda w, i: let(F.regexp_extract(w, AROUND, 2), lambda c: cased(words, w, i, c))
    return let(F.filter(F.split(col(raw), SPLIT), lambda w: w != ""), lambda words: F.array_join(F.transform(words, one(words)), " "))


AROUND = r"^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$"
SPLIT = r"(?U)\s+"


def is_without_number(number: Column | str) -> Column:
    return col(number).rlike(r"(?i)^s\s*/?\s*n\.?$")


def format_cep(cep: Column | str) -> Column:
    d = digits(cep)
    return F.when(F.length(d) == 8, F.concat(F.substring(d, 1, 5), F.lit("-"), F.substring(d, 6, 3)))


def _clean(c: Column | str) -> Column:
    return blank_to_null(collapse(c))


def _cleaned(**named: Column | str) -> Column:
    """The fields without needless white space, null where blank, as one value to bind."""
    return F.struct(*[_clean(c).alias(n) for n, c in named.items()])


def format_street(kind, street, number, complement) -> Column:
    """Type (unless repeated) and street, number or s/n, complement; null without a street."""

    def line(a: Column) -> Column:
        repeated = F.upper(a["street"]).startswith(F.concat(F.upper(a["kind"]), F.lit(" ")))
        whole = title_case(F.when(a["kind"].isNotNull() & ~repeated, F.concat_ws(" ", a["kind"], a["street"])).otherwise(a["street"]))
        no = F.when(a["number"].isNull(), F.lit("")).when(is_without_number(a["number"]), F.lit(", s/n")).otherwise(F.concat(F.lit(", "), F.upper(a["number"])))
        extra = F.when(a["complement"].isNull(), F.lit("")).otherwise(F.concat(F.lit(" — "), title_case(a["complement"])))
        return F.when(a["street"].isNotNull(), F.concat(whole, no, extra))

    return let(_cleaned(kind=kind, street=street, number=number, complement=complement), line)


def _address(line: Column, district, city, state, cep) -> Column:
    def whole(a: Column) -> Column:
        head = F.concat_ws(" - ", line, F.when(a["district"].isNotNull(), title_case(a["district"])))
        place = F.concat_ws(" - ", F.when(a["city"].isNotNull(), title_case(a["city"])), F.upper(a["state"]))
        return blank_to_null(F.concat_ws(", ", blank_to_null(head), blank_to_null(place), format_cep(cep)))

    return let(_cleaned(district=district, city=city, state=state), whole)


def format_address(kind, street, number, complement, district, city, state, cep) -> Column:
    """``street - district, city - UF, cep`` without what is missing; null if nothing is there."""
    return _address(format_street(kind, street, number, complement), district, city, state, cep)


def percent_encoded(c: Column) -> Column:
    """As encodeURIComponent has it: spaces as %20, and ! ' ( ) * ~ left alone."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def derive_address(kind, street, number, complement, district, city, state, cep) -> Column:
    """struct(linha, completo, maps), or null if nothing is known."""
    start = F.lit("https://www.google.com/maps/search/?api=1&query=")
    shown = lambda line, full: F.when(full.isNotNull(), F.struct(line.alias("linha"), full.alias("completo"), F.concat(start, percent_encoded(full)).alias("maps")))
    return let(format_street(kind, street, number, complement), lambda line: let(_address(line, district, city, state, cep), lambda full: shown(line, full)))


# ---------------------------------------------------------------- CSV fields


def csv_field(c: Column, kind: str = "string") -> Column:
    """A field's text: null empty, booleans sim/nao, quoted where a comma, quote or line feed is inside."""
    text = F.when(c, F.lit("sim")).otherwise(F.lit("nao")) if kind == "boolean" else c.cast("string")
    text = F.when(c.isNull(), F.lit("")).otherwise(text)
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(columns: list[tuple[Column, str]]) -> Column:
    return F.concat_ws(",", *[csv_field(c, kind) for c, kind in columns])

"""A project's compiled profile, as a model wrote it: read from JSON by VARIANT columns, every fault named by its path.

Nothing in it is trusted: lists are cut, codes are cleaned, what has the wrong type is told or falls back to its default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import SPACES, bound, let

# fixed values: limits of a profile
MOST_AXES, MOST_PROBES, MOST_TERMS, MOST_CODES, MOST_STATES, MOST_ACTIONS, MOST_NOTES, MOST_HOOKS, MOST_CRITERIA = 3, 12, 8, 40, 27, 6, 8, 4, 20
TEXT_CHARS, CRITERION_CHARS = 400, 200
# fixed values: texts that mean nothing, and names of fields that are no recommendations
NULLISH = ["null", "undefined", "none", "n/a", "na", "-"]
RESERVED = ["notes", "hookbad", "hookgood", "hook_bad", "hook_good", "axes", "probes", "targeting", "rubric", "summary", "buyer", "problem", "sitesignals", "site_signals"]
# fixed values: what is told of a fault, and the two recommendations of a profile that has none
NEEDS_TEXT, NEEDS_LIST, NEEDS_OBJECT, NO_AXIS = "texto obrigatório", "esperava uma lista", "esperava um objeto", "nenhum eixo válido"
DEFAULT_ACTIONS = [("abordar", "Abordar", "encaixa no perfil"), ("descartar", "Descartar", "não encaixa")]

_FAULT = "array<struct<path:string,message:string>>"


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def _kind(v: Column) -> Column:
    """STRING, BIGINT, BOOLEAN, VOID, ARRAY<...>, OBJECT<...>, ...; null where there is nothing."""
    return F.schema_of_variant(v)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(_kind(v).startswith(kind), F.lit(False))


def _said(v: Column) -> Column:
    """A text, trimmed; null for other types."""
    return F.regexp_replace(F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string")), rf"^{SPACES}|{SPACES}$", "")


def _plain(v: Column, most: int = TEXT_CHARS) -> Column:
    """The text itself, trimmed and cut; null for other types and for blanks."""
    return F.nullif(F.left(_said(v), F.lit(most)), F.lit(""))


def _text(v: Column, most: int = TEXT_CHARS) -> Column:
    """:func:`_plain`, where words that mean nothing are nothing."""
    return let(_said(v), lambda t: F.when(~F.lower(t).isin([*NULLISH, ""]), F.left(t, F.lit(most))))


def _key(v: Column) -> Column:
    return F.regexp_replace(F.lower(_text(v, 40)), "[^a-z0-9_]+", "_")


def _items(v: Column) -> Column:
    """The items of a list, else none."""
    return F.coalesce(F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")), F.array().cast("array<variant>"))


def _objects(v: Column) -> Column:
    return F.filter(_items(v), lambda x: _is(x, "OBJECT"))


def _texts(v: Column, most: int, chars: int = TEXT_CHARS) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(_items(v), lambda x: _plain(x, chars)), lambda x: x.isNotNull())), 1, most)


def _no_list(v: Column) -> Column:
    """Something is there that is no list."""
    return v.isNotNull() & ~_is(v, "VOID") & ~_is(v, "ARRAY")


def _flag(v: Column, otherwise: bool = False) -> Column:
    return F.coalesce(F.when(_is(v, "BOOLEAN"), F.try_variant_get(v, "$", "boolean")), F.lit(otherwise))


def _number(v: Column, least: float, most: float) -> Column:
    """A number within bounds; texts that are one count, blanks and null are 0, anything else is nothing."""
    n = F.when(_is(v, "VOID"), F.lit(0.0)).when(_is(v, "STRING"), let(_said(v), lambda t: F.when(t == "", F.lit(0.0)).otherwise(t.try_cast("double"))))
    n = n.when(_is(v, "BOOLEAN"), F.try_variant_get(v, "$", "boolean").cast("double")).when(~_is(v, "ARRAY") & ~_is(v, "OBJECT"), F.try_variant_get(v, "$", "double"))
    return let(n, lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.least(F.greatest(x, F.lit(float(least))), F.lit(float(most)))))


def _codes(v: Column) -> Column:
    digits = F.transform(_texts(v, MOST_CODES, 20), lambda c: F.regexp_replace(c, "[^0-9]", ""))
    return F.filter(digits, lambda c: F.length(c).between(2, 7))


def _first_of_key(rows: Column) -> Column:
    """Of structs with equal ``key`` the first."""
    first = lambda rs, keys: F.filter(rs, lambda r, i: F.array_position(keys, r["key"]) == i + 1)
    # rows and keys are bound: inside the filter they would be computed again for each row
    return let(rows, lambda rs: let(F.transform(rs, lambda r: r["key"]), lambda keys: first(rs, keys)))


def _targeting(t: Column) -> Column:
    return F.struct(
        _codes(_at(t, "cnaePrefixes")).alias("cnae_prefixes"),
        _codes(_at(t, "cnaeExclude")).alias("cnae_exclude"),
        F.transform(_texts(_at(t, "ufs"), MOST_STATES, 2), F.upper).alias("ufs"),
        F.filter(F.transform(_items(_at(t, "channels")), lambda c: _plain(c)), lambda c: c.isin("mobile", "landline")).alias("channels"),
        _texts(_at(t, "naturezaPrefixes"), 8, 4).alias("natureza_prefixes"),
        _flag(_at(t, "excludeMei")).alias("exclude_mei"),
        _flag(_at(t, "matrizOnly"), True).alias("matriz_only"),
        _number(_at(t, "minCapitalSocial"), 0, 1e12).alias("min_capital"),
        _number(_at(t, "minAgeYears"), 0, 200).alias("min_age_years"),
        _number(_at(t, "maxAgeYears"), 0, 200).alias("max_age_years"),
        _flag(_at(t, "requireNomeFantasia")).alias("require_trade_name"),
    )


def _probes(v: Column) -> Column:
    one = lambda p: F.struct(
        _key(_at(p, "key")).alias("key"), F.coalesce(_text(_at(p, "label"), 80), _key(_at(p, "key"))).alias("label"), _texts(_at(p, "terms"), MOST_TERMS, 60).alias("terms"),
        F.when(_plain(_at(p, "meaning")) == "negative", "negative").otherwise("positive").alias("meaning"), F.coalesce(_number(_at(p, "weight"), 0, 10), F.lit(1.0)).alias("weight"),
    )
    sound = F.filter(F.transform(_objects(v), one), lambda p: F.coalesce(p["key"] != "", F.lit(False)) & (F.size(p["terms"]) > 0))
    return F.slice(_first_of_key(sound), 1, MOST_PROBES)


def _axes(v: Column) -> Column:
    """Axes whose five levels are all described, the first few; the question may still lack."""
    one = lambda a: F.struct(
        _key(_at(a, "key")).alias("key"), F.coalesce(_text(_at(a, "label"), 80), _key(_at(a, "key"))).alias("label"), _plain(_at(a, "question")).alias("question"),
        F.array(*[_text(F.try_variant_get(a, f"$.anchors['{n}']", "variant"), 200) for n in range(1, 6)]).alias("anchors"),
    )
    sound = F.filter(F.transform(_objects(v), one), lambda a: F.coalesce(a["key"] != "", F.lit(False)) & F.forall(a["anchors"], lambda x: x.isNotNull()))
    return F.slice(sound, 1, MOST_AXES)


def _actions(v: Column) -> Column:
    one = lambda x: F.struct(F.coalesce(_key(_at(x, "value")), F.lit("")).alias("value"), F.coalesce(_text(_at(x, "label"), 80), F.lit("")).alias("label"), F.coalesce(_text(_at(x, "when"), 200), F.lit("")).alias("when"))
    sound = F.slice(F.filter(F.transform(_objects(v), one), lambda x: (x["value"] != "") & (x["label"] != "") & ~x["value"].isin(RESERVED)), 1, MOST_ACTIONS)
    usual = F.array(*[F.struct(*[F.lit(c).alias(n) for n, c in zip(("value", "label", "when"), row, strict=True)]) for row in DEFAULT_ACTIONS])
    return let(sound, lambda rows: F.when(F.size(rows) > 0, rows).otherwise(usual))


def _coverage(v: Column) -> Column:
    one = lambda x: F.struct(F.coalesce(_text(_at(x, "criterion"), CRITERION_CHARS), F.lit("")).alias("criterion"), _flag(_at(x, "mapped")).alias("mapped"), F.coalesce(_text(_at(x, "mappedTo"), CRITERION_CHARS), F.lit("")).alias("mapped_to"))
    return F.slice(F.filter(F.transform(_objects(v), one), lambda x: x["criterion"] != ""), 1, MOST_CRITERIA)


def parse_specs(specs: DataFrame, text: str = "spec") -> DataFrame:
    """``specs`` with ``parsed``, the profile as columns, and ``faults``, all that make it invalid as (path, message); ``parsed`` is null where there is one.

    Text that is no JSON, and JSON that is no object, is a fault of ``spec``. What can fall back falls back: lists are cut and made distinct, probes without key or
    terms go, axes without all five levels go, and a profile without any axis left is invalid.
    """
    v = F.col("_v")
    # the parts are columns of their own, written once in the plan and read by what follows
    parts = specs.withColumn("_v", F.try_parse_json(text)).withColumn("_object", _is(v, "OBJECT"))
    parts = parts.withColumns({"_t": _at(v, "targeting"), "_r": _at(v, "rubric"), "_p": _at(v, "probes")})
    parts = parts.withColumns({**{f"_{c}": _plain(_at(v, c)) for c in ("summary", "buyer", "problem")}, "_axes": _axes(_at(F.col("_r"), "axes"))})
    parts = bound(parts)
    t, r = F.col("_t"), F.col("_r")
    fault = lambda bad, path, message: F.when(bad, F.array(F.struct(F.lit(path).alias("path"), F.lit(message).alias("message")))).otherwise(F.array().cast(_FAULT))
    lists = [("targeting.cnaePrefixes", _at(t, "cnaePrefixes")), ("targeting.cnaeExclude", _at(t, "cnaeExclude")), ("targeting.ufs", _at(t, "ufs")), ("targeting.naturezaPrefixes", _at(t, "naturezaPrefixes"))]
    rubric = [("rubric.notes", _at(r, "notes")), ("rubric.hookBad", _at(r, "hookBad")), ("rubric.hookGood", _at(r, "hookGood"))]
    axes = _at(r, "axes")
    found = F.concat(
        *[fault(F.col(f"_{c}").isNull(), c, NEEDS_TEXT) for c in ("summary", "buyer", "problem")],
        *[fault(_no_list(x), path, NEEDS_LIST) for path, x in lists],
        fault(F.exists(_objects(F.col("_p")), lambda p: _no_list(_at(p, "terms"))), "probe.terms", NEEDS_LIST),
        fault(~_is(axes, "ARRAY"), "rubric.axes", NEEDS_LIST),
        F.transform(F.filter("_axes", lambda a: a["question"].isNull()), lambda a: F.struct(F.concat(F.lit("rubric.axes."), a["key"], F.lit(".question")).alias("path"), F.lit(NEEDS_TEXT).alias("message"))),
        fault(_is(axes, "ARRAY") & (F.size("_axes") == 0), "rubric.axes", NO_AXIS),
        *[fault(_no_list(x), path, NEEDS_LIST) for path, x in rubric],
    )
    faults = F.when(F.col("_object"), found).otherwise(F.array(F.struct(F.lit("spec").alias("path"), F.lit(NEEDS_OBJECT).alias("message"))))
    detail = _plain(_at(r, "siteSignals"))
    parsed = F.struct(
        F.lit(1).alias("schema_version"), *[F.col(f"_{c}").alias(c) for c in ("summary", "buyer", "problem")], _targeting(t).alias("targeting"), _probes(F.col("_p")).alias("probes"),
        F.struct(
            F.col("_axes").alias("axes"), _actions(_at(r, "recommendations")).alias("recommendations"), _texts(_at(r, "notes"), MOST_NOTES).alias("notes"),
            F.when(detail.isin("none", "minimal"), detail).otherwise("full").alias("site_signals"), _texts(_at(r, "hookBad"), MOST_HOOKS).alias("hook_bad"), _texts(_at(r, "hookGood"), MOST_HOOKS).alias("hook_good"),
        ).alias("rubric"),
        _coverage(_at(F.col("_v"), "icpCoverage")).alias("icp_coverage"),
    )
    # bound again, so that faults are found once and the profile isn't built anew for each field that is read
    told = bound(parts.withColumn("faults", faults))
    return bound(told.withColumn("parsed", F.when(F.size("faults") == 0, parsed)).select(*specs.columns, "parsed", "faults"))

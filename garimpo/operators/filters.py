"""The filter algebra of discovery: optional predicates, all of them ANDed, as one column expression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.registry import is_mobile_shape, is_own_domain
from ..functions.text import any_of, digits, fold


@dataclass(frozen=True)
class CompanyFilters:
    """An unset field is off; unknown fields are refused by the constructor."""

    cnae: list[str] = field(default_factory=list)
    include_secondary: bool = False
    uf: list[str] = field(default_factory=list)
    municipio_rf: list[str] = field(default_factory=list)
    porte: list[str] = field(default_factory=list)
    founded_from: str | None = None
    founded_to: str | None = None
    has_phone: bool = False
    has_email: bool = False
    matriz_only: bool = False
    mei: bool | None = None
    q: str | None = None
    email_domain: list[str] = field(default_factory=list)
    own_domain_email: bool = False
    is_mobile: bool = False
    natureza_prefix: list[str] = field(default_factory=list)
    min_capital_social: float | None = None
    cep_prefix: list[str] = field(default_factory=list)
    bairro: str | None = None


def prefix_match(c: Column | str, codes: list[str]) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return any_of([c.startswith(x) for x in codes])


def primary_match(codes: list[str]) -> Column:
    """The primary activity, with the partition constraint that the prefixes imply, so that the scan is pruned."""
    divisions = sorted({c[:2] for c in codes if len(c) >= 2})
    whole = prefix_match("cnae_principal", codes)
    return F.col("cnae_div").isin(divisions) & whole if len(divisions) and all(len(c) >= 2 for c in codes) else whole


def secondary_match(codes: list[str], listed: Column | str = "cnae_secundaria") -> Column:
    """Full codes by set overlap, shorter ones by a prefix test on each element; false for no code or no list."""
    c = F.col(listed) if isinstance(listed, str) else listed
    exact, short = [x for x in codes if len(x) >= 7], [x for x in codes if len(x) < 7]
    tests = []
    if exact:
        tests.append(F.arrays_overlap(c, F.array(*map(F.lit, exact))))
    if short:
        tests.append(F.exists(c, lambda x: prefix_match(x, short)))
    return F.coalesce(any_of(tests), F.lit(False))


def predicate(f: CompanyFilters) -> Column:
    """Everything that can be pushed to the scan comes first; array and text tests follow."""
    tests: list[Column] = []
    add = tests.append
    if f.cnae:
        add(primary_match(f.cnae) | secondary_match(f.cnae) if f.include_secondary else primary_match(f.cnae))
    for name in ("uf", "municipio_rf", "porte"):
        if values := getattr(f, name):
            add(F.col(name).isin(values))
    if f.founded_from:
        add(F.col("data_inicio_atividade") >= F.lit(f.founded_from).cast("date"))
    if f.founded_to:
        add(F.col("data_inicio_atividade") <= F.lit(f.founded_to).cast("date"))
    if f.has_phone:
        add(F.col("ddd").isNotNull() & F.col("telefone").isNotNull())
    if f.has_email:
        add(F.col("email").isNotNull())
    if f.matriz_only:
        add(F.col("is_matriz"))
    if f.mei is not None:
        add(F.col("mei") if f.mei else ~F.col("mei"))
    if f.min_capital_social is not None:
        add(F.col("capital_social") >= f.min_capital_social)
    if f.natureza_prefix:
        add(prefix_match("natureza_juridica", f.natureza_prefix))
    if f.q and f.q.strip():
        q = f.q.strip().lower()
        add(F.coalesce(F.lower("nome_fantasia").contains(q), F.lit(False)) | F.coalesce(F.lower("razao_social").contains(q), F.lit(False)))
    if f.email_domain:
        add(F.split_part(F.lower("email"), F.lit("@"), F.lit(2)).isin([d.strip().lower() for d in f.email_domain]))
    if f.own_domain_email:
        # what stands between the first @ and the next, as in the test of email_domain
        add(F.col("email").contains("@") & is_own_domain(F.split_part(F.lower("email"), F.lit("@"), F.lit(2))))
    if f.is_mobile:
        add(is_mobile_shape("telefone"))
    if f.cep_prefix:
        wanted = ["".join(ch for ch in p if ch.isdigit()) for p in f.cep_prefix]
        add(prefix_match(digits("cep"), [p for p in wanted if p]))
    if f.bairro and f.bairro.strip():
        add(F.lower(fold("bairro")).contains(F.lower(fold(F.lit(f.bairro.strip())))))
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def apply(companies: DataFrame, f: CompanyFilters, exclude: DataFrame | None = None) -> DataFrame:
    """Rows that pass, without those whose number is in ``exclude`` (an anti-join, however long the list is)."""
    kept = companies.filter(predicate(f))
    return kept.join(exclude.select("cnpj"), "cnpj", "left_anti") if exclude is not None else kept

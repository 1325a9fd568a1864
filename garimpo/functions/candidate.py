"""A candidate as the short text that a model reads."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: lengths of the parts, and from how much text on a silent page is a contradiction
PAGE_CHARS, DECLARED_CHARS, CONCLUSIVE_CHARS, IMPRESSION_CHARS = 700, 400, 1500, 1200


def years(founded: Column | str, as_of: str) -> Column:
    """Age in words; whole years of 365.25 days."""
    c = F.col(founded) if isinstance(founded, str) else founded
    n = F.floor(F.datediff(F.lit(as_of).cast("date"), c) / 365.25)
    return F.when(c.isNull(), "idade desconhecida").when(n < 1, "aberta há menos de 1 ano").otherwise(F.concat(F.lit("aberta há "), n.cast("string"), F.lit(" anos")))


def render(probes: dict[str, str], as_of: str, impression: str | None = None) -> Column:
    """The facts of one row, from its columns of these names: what is known, what was looked for and found, and what was looked
    for and is absent; nothing is said of what wasn't read. ``probes``: label by key."""
    c = F.col
    site = (
        F.when(~F.coalesce(c("crawled"), F.lit(False)), "NÃO VERIFICADO")
        .when(c("is_link_hub"), "só link na bio (Instagram/Linktree), página não lida")
        .when(c("is_dead"), "fora do ar")
        .when(c("final_url").isNull(), "NÃO ENCONTRADO")
        .otherwise(c("final_url"))
    )
    told = F.coalesce(F.concat(F.lit("cnae: "), c("cnae"), F.coalesce(F.concat(F.lit(" ("), c("cnae_descricao"), F.lit(")")), F.lit(""))), F.lit("cnae: não encontrado na Receita (não sabemos)"))
    unknown = lambda x: F.coalesce(c(x), F.lit("?"))
    facts = F.concat_ws(
        " | ",
        F.concat(F.lit("cnpj: "), c("cnpj")),
        F.concat(F.lit("nome: "), F.coalesce("nome_fantasia", "razao_social", F.lit("(sem nome)"))),
        told,
        F.concat(F.lit("local: "), unknown("municipio"), F.lit("/"), unknown("uf")),
        years("data_inicio_atividade", as_of),
        F.concat(F.lit("porte: "), c("porte")),
        F.when(c("mei"), "MEI"),
        F.concat(F.lit("site: "), site),
    )
    listed = lambda want: F.nullif(F.concat_ws(", ", *[F.when(c("probes")[k] == F.lit(want), label) for k, label in probes.items()]), F.lit(""))
    hits, misses, read = listed(True), listed(False), F.coalesce(F.length("text_excerpt"), F.lit(0))
    seen = F.coalesce(c("crawled"), F.lit(False))
    line = lambda when, *parts: F.when(when, F.concat(F.lit("  "), *[F.lit(p) if isinstance(p, str) else p for p in parts]))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("- "), facts),
        line(seen & hits.isNotNull(), "encontrado na página: ", hits),
        line(seen & misses.isNotNull(), "procurado e NÃO encontrado (li ", read.cast("string"), " caracteres): ", misses),
        line(F.lit(bool(probes)) & seen & hits.isNull() & (read >= CONCLUSIVE_CHARS), "CONFLITO: li a página inteira (", read.cast("string"), " caracteres) e NENHUM sinal do produto apareceu."),
        line(c("structured_text").isNotNull(), "descrição declarada pelo site: ", F.left("structured_text", F.lit(DECLARED_CHARS))),
        line(F.coalesce(c("text_excerpt") != "", F.lit(False)), "texto da página: ", F.left("text_excerpt", F.lit(PAGE_CHARS))),
        *([line(F.trim(c(impression)) != "", "impressão de quem olhou: <<<", F.left(F.trim(c(impression)), F.lit(IMPRESSION_CHARS)), ">>>")] if impression else []),
    )


def prompt_sha(prompt: Column | str) -> Column:
    """The first 16 hexadecimal digits of the prompt's SHA-256."""
    return F.left(F.sha2(F.col(prompt) if isinstance(prompt, str) else prompt, 256), F.lit(16))

"""A made-up registry, the same on every run: for tests, and to measure the ETL at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

STREETS = ["DAS FLORES", "SETE DE SETEMBRO", "JOAO ALVES", "DOS GONCALVES", "BR 101"]
MAILS = ["gmail.com", "lojaboa.com.br", "contabilsilva.com.br", "gmial.com", "prefeitura.gov.br", "escola.edu.br", "acme.com", "x.cnt.br"]
STATES = ["SP", "RJ", "MG", "PR", ""]


def pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def raw_establishments(spark: SparkSession, n: int) -> DataFrame:
    """(value): ``n`` raw lines with inactive, blank and malformed rows among them; a third share one division."""
    i = F.col("id")
    h = F.pmod(F.xxhash64("id"), F.lit(1_000_000_007))
    code = F.concat(F.when(h % 3 == 0, "86").otherwise(F.lpad((h % 90 + 1).cast("string"), 2, "0")), F.lpad((h % 977).cast("string"), 5, "0"))
    second = lambda k: F.lpad((h * k % 9_000_017).cast("string"), 7, "0")
    cells = {
        0: (h % 100_000).cast("string"), 1: (i % 10_000).cast("string"), 2: (h % 100).cast("string"), 3: F.when(h % 4 == 0, "1").otherwise("2"),
        4: F.when(h % 5 == 0, "").otherwise(F.concat(F.lit("Loja  "), h)), 5: F.when(h % 10 < 6, "02").otherwise("08"),
        10: F.when(h % 50 == 0, "0").when(h % 50 == 1, "20240230").otherwise(F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), (h % 12_000).cast("int")), "yyyyMMdd")),
        11: F.when(h % 101 == 0, " ").otherwise(code), 12: F.when(h % 5 < 2, "").otherwise(F.concat_ws(",", second(3), second(7), second(3))),
        13: F.lit("RUA"), 14: pick(STREETS, h), 15: F.when(h % 9 == 0, "S/N").otherwise((h % 400).cast("string")), 16: F.when(h % 6 == 0, "SALA 2; FUNDOS").otherwise(""),
        17: F.lit("Jardim América"), 18: F.lpad((h % 99_999_999).cast("string"), 8, "0"), 19: pick(STATES, h), 20: (h % 500).cast("string"),
        21: (h % 89 + 11).cast("string"), 22: F.when(h % 7 == 0, "").otherwise((h % 79_999_999 + 20_000_000).cast("string")),
        27: F.when(h % 8 == 0, " ").otherwise(F.concat(F.lit("Contato"), h, F.lit("@"), pick(MAILS, h))),
    }
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(";", *[quoted(cells[k]) if k in cells else F.lit('""') for k in range(30)])
    return spark.range(n).select(line.alias("value"))


def raw_companies(spark: SparkSession, n: int = 100_000) -> DataFrame:
    i = F.col("id")
    return spark.range(n).filter(i % 20 != 0).select(F.concat_ws(";", i.cast("string"), F.concat(F.lit('"COMERCIO  '), i, F.lit(' LTDA"')), F.lit("2062"), F.lit(""), F.when(i % 3 == 0, "1000,50").when(i % 3 == 1, "abc").otherwise(i.cast("string")), F.lpad((i % 5).cast("string"), 2, "0")).alias("value"))


def raw_tax(spark: SparkSession, n: int = 100_000) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(F.concat_ws(";", i.cast("string"), F.when(i % 3 == 0, "S").otherwise("N"), F.lit(""), F.lit(""), F.when(i % 6 == 0, "S").otherwise("N")).alias("value"))


def establishments(spark: SparkSession, n: int) -> DataFrame:
    """The converted registry."""
    from ..plans import etl

    return etl.denormalise(etl.clean_establishments(raw_establishments(spark, n)), etl.companies(raw_companies(spark)), etl.tax_regimes(raw_tax(spark)))

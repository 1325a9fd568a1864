"""From bulk lines to the serving tables: filter, clean, denormalise, partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.registry import full_cnpj, rf_date, rf_decimal
from ..functions.text import blank_to_null, collapse, strip
from ..sources import schemas
from ..sources.raw import columns


class MissingJoinInput(FileNotFoundError):
    """Establishments can't be converted before the tables that are folded into them."""


def dictionary(lines: DataFrame) -> DataFrame:
    raw = columns(lines, schemas.RAW_DICTIONARY)
    return raw.select(*[strip(c).alias(c) for c in raw.columns])


def companies(lines: DataFrame) -> DataFrame:
    raw = columns(lines, schemas.RAW_COMPANY)
    return raw.select(
        strip("cnpj_basico").alias("cnpj_basico"),
        blank_to_null(collapse("razao_social")).alias("razao_social"),
        blank_to_null(strip("natureza_juridica")).alias("natureza_juridica"),
        rf_decimal("capital_social").alias("capital_social"),
        blank_to_null(strip("porte")).alias("porte"),
    )


def tax_regimes(lines: DataFrame) -> DataFrame:
    """Only companies in one of the two regimes."""
    raw = columns(lines, schemas.RAW_TAX)
    return raw.filter((F.col("simples") == "S") | (F.col("mei") == "S")).select(strip("cnpj_basico").alias("cnpj_basico"), (F.col("simples") == "S").alias("simples"), (F.col("mei") == "S").alias("mei"))


def secondary_codes(c: Column | str) -> Column:
    """A list without repeats; null, never ``['']``, where the field is blank."""
    return F.array_distinct(F.split(blank_to_null(F.col(c) if isinstance(c, str) else c), ","))


def clean_establishments(lines: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Active establishments with an activity and an e-mail, cleaned; one row a kept line. ``seen`` counts the lines as they pass."""
    raw = columns(lines, schemas.RAW_ESTABLISHMENT)
    raw = raw if seen is None else raw.observe(seen, F.count(F.lit(1)).alias("read"))
    kept = raw.filter((F.col("situacao") == schemas.ACTIVE) & (strip("cnae_principal") != "") & (strip("email") != ""))
    text = lambda c: blank_to_null(collapse(c))
    return kept.select(
        strip("cnpj_basico").alias("cnpj_basico"),
        full_cnpj(strip("cnpj_basico"), strip("ordem"), strip("dv")).alias("cnpj"),
        (blank_to_null(strip("matriz")) == "1").alias("is_matriz"),
        text("nome_fantasia").alias("nome_fantasia"),
        strip("cnae_principal").alias("cnae_principal"),
        secondary_codes(strip("cnae_secundaria")).alias("cnae_secundaria"),
        rf_date("data_inicio").alias("data_inicio_atividade"),
        strip("uf").alias("uf"),
        blank_to_null(strip("municipio")).alias("municipio_rf"),
        *[text(c).alias(c) for c in ("tipo_logradouro", "logradouro", "numero", "complemento", "bairro")],
        *[blank_to_null(strip(c)).alias(c) for c in ("cep", "ddd", "telefone")],
        F.lower(strip("email")).alias("email"),
    )


def _one(df: DataFrame, key: str) -> DataFrame:
    """One row a key, the least by its other columns, so that every run picks the same."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_one")).select(key, "_one.*")


def denormalise(establishments: DataFrame, companies: DataFrame | None, tax: DataFrame | None) -> DataFrame:
    """Fold companies and tax regimes into each row: two left joins on the company's root number.

    Both build sides must be unique in it, or rows would multiply; repeated roots are reduced to one first.
    """
    if companies is None or tax is None:
        raise MissingJoinInput("convert companies and tax regimes first")
    companies, tax = (_one(df, "cnpj_basico") for df in (companies, tax))
    joined = establishments.join(companies, "cnpj_basico", "left").join(tax, "cnpj_basico", "left")
    joined = joined.withColumn("simples", F.coalesce("simples", F.lit(False))).withColumn("mei", F.coalesce("mei", F.lit(False)))
    return joined.withColumn("cnae_div", F.substring("cnae_principal", 1, 2)).select(*schemas.ESTABLISHMENTS.fieldNames())


def stats(lines: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: lines read and rows kept, with phone, with e-mail, with secondary codes."""
    read = lines.agg(F.lit(1).alias("_one"), F.count("*").alias("read"))
    return kept.agg(F.lit(1).alias("_one"), *_counts()).join(read, "_one").drop("_one")


def _counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("kept"),
        F.count_if(F.col("ddd").isNotNull() & F.col("telefone").isNotNull()).alias("with_phone"),
        F.count("email").alias("with_email"),
        F.count("cnae_secundaria").alias("with_secondary"),
        F.coalesce(F.sum(F.size("cnae_secundaria")), F.lit(0)).alias("codes"),
    ]


def convert(lines: DataFrame, companies: DataFrame, tax: DataFrame, path: str, fresh: bool = False) -> dict[str, int]:
    """Clean, denormalise and write the establishments, and count in the same pass: the numbers of :func:`stats`, without a second look at the lines.

    The counts are those of the tasks that read the lines. A task that is lost after it was counted and runs again counts its lines
    once more; where that matters, hold ``kept`` against the rows that were written.
    """
    read, kept = Observation(), Observation()
    rows = clean_establishments(lines, read).observe(kept, *_counts())
    write_establishments(denormalise(rows, companies, tax), path, fresh)
    return {k: int(v or 0) for k, v in (kept.get | read.get).items()}


def coverage(establishments: DataFrame, least: float = 0.95) -> DataFrame:
    """One row: how many rows have their company's name, and whether that is enough to drop the join's inputs."""
    out = establishments.agg(F.count("*").alias("rows"), F.count("razao_social").alias("named"))
    return out.withColumn("covered", F.coalesce(F.col("named") >= F.col("rows") * least, F.lit(False)))


def write_establishments(df: DataFrame, path: str, fresh: bool = False) -> None:
    """Partitioned by division. Rows are rebalanced by division first: few files in small ones, several in large ones.
    Row groups carry a Bloom filter of the numbers, for lookups by number over all divisions.
    ``fresh`` replaces the divisions that this run writes and leaves all others as they are."""
    out = df.hint("rebalance", "cnae_div").sortWithinPartitions("cnae_div", "cnae_principal").write.partitionBy("cnae_div").option("compression", "zstd")
    out = out.option("parquet.bloom.filter.enabled#cnpj", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    (out.mode("overwrite").option("partitionOverwriteMode", "dynamic") if fresh else out.mode("append")).parquet(path)


def write_sorted(df: DataFrame, path: str, by: list[Column | str], row_group_bytes: int = 16 << 20) -> None:
    """One global order over all files, in small row groups, so that statistics tell which few of them a seek or a lookup needs. Ranges are cut by a sample, and equal keys of very many rows go on by all columns of ``by``."""
    (df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", row_group_bytes).parquet(path))


def write_single(df: DataFrame, path: str) -> None:
    """A small table, a dictionary or one part's companies, as one file."""
    df.coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(path)


def migrate(df: DataFrame, schema) -> DataFrame:
    """``df`` under another schema: columns that are there are cast, new ones are null, others go."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def fill_missing(target: DataFrame, source: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Fill null columns of ``target`` from ``source``; values that are there stay."""
    found = _one(source.select(key, *names), key).select(key, *[F.col(n).alias(f"_{n}") for n in names])
    joined = target.join(found, key, "left")
    return joined.select(*[F.coalesce(c, f"_{c}").alias(c) if c in names else F.col(c) for c in target.columns])

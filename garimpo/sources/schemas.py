"""Schemas of the serving tables and of the raw bulk files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T


def _schema(text: str) -> T.StructType:
    kinds = {"string": T.StringType(), "boolean": T.BooleanType(), "date": T.DateType(), "double": T.DoubleType(), "array<string>": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in text.split(","))])


ESTABLISHMENTS = _schema(
    "cnpj string,is_matriz boolean,nome_fantasia string,cnae_principal string,cnae_secundaria array<string>,data_inicio_atividade date,"
    "uf string,municipio_rf string,tipo_logradouro string,logradouro string,numero string,complemento string,bairro string,cep string,"
    "ddd string,telefone string,email string,razao_social string,natureza_juridica string,capital_social double,porte string,"
    "simples boolean,mei boolean,cnae_div string"
)
DICTIONARY = _schema("codigo string,descricao string")
COMPANIES = _schema("cnpj_basico string,razao_social string,natureza_juridica string,capital_social double,porte string")
TAX = _schema("cnpj_basico string,simples boolean,mei boolean")

# fixed values: places of the fields in a raw line
RAW_ESTABLISHMENT = {
    "cnpj_basico": 0, "ordem": 1, "dv": 2, "matriz": 3, "nome_fantasia": 4, "situacao": 5, "data_inicio": 10, "cnae_principal": 11, "cnae_secundaria": 12,
    "tipo_logradouro": 13, "logradouro": 14, "numero": 15, "complemento": 16, "bairro": 17, "cep": 18, "uf": 19, "municipio": 20, "ddd": 21, "telefone": 22, "email": 27,
}
RAW_COMPANY = {"cnpj_basico": 0, "razao_social": 1, "natureza_juridica": 2, "capital_social": 4, "porte": 5}
RAW_TAX = {"cnpj_basico": 0, "simples": 1, "mei": 4}
RAW_DICTIONARY = {"codigo": 0, "descricao": 1}
ACTIVE = "02"


class DatasetMissing(FileNotFoundError):
    """There is no dataset where one is expected."""


class DatasetStale(ValueError):
    """A dataset was written with another schema; missing columns are named, never filled with null."""


def read_establishments(spark: SparkSession, path: str) -> DataFrame:
    """The partitioned registry. The division stays text (``05``), whatever partition inference is set to."""
    from pyspark.errors import AnalysisException

    try:
        there = spark.read.parquet(path).columns
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            raise DatasetMissing(path) from e
        raise
    missing = [f.name for f in ESTABLISHMENTS if f.name not in there]
    if missing:
        raise DatasetStale(f"{path} lacks {', '.join(missing)}")
    return spark.read.schema(ESTABLISHMENTS).parquet(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DICTIONARY).parquet(path)

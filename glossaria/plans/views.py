"""The catalogue views of the registered queries over the driver tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import first_wins


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a catalogue: half as many keys as documents, the whole text as value, doc_id as order."""
    docs = read(spark, sf_dir, "documents")
    m = max(docs.count() // 2, 1)
    return docs.select(
        F.concat(F.col("source"), F.lit(".text."), (F.col("doc_id") % m).cast("string")).alias("key"), F.col("lang").alias("locale"),
        F.concat("source", F.lit("/"), "lang", F.lit(".json")).alias("file"), F.trim("text").alias("value"), F.col("doc_id").alias("ord"),
    )


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with one row per key and locale, the first in order."""
    return first_wins(catalog(spark, sf_dir), ["key", "locale"])


def coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a digit of the text's hash as value, so that translations can equal their source or be empty."""
    docs = read(spark, sf_dir, "documents")
    m = max(docs.count() // 2, 1)
    rows = docs.select(
        F.concat(F.col("source"), F.lit(".text."), (F.col("doc_id") % m).cast("string")).alias("key"), F.col("lang").alias("locale"),
        F.concat("source", F.lit("/"), "lang", F.lit(".json")).alias("file"), F.when(F.left(F.md5("text"), F.lit(1)) == "0", "").otherwise(F.substring(F.md5("text"), 2, 1)).alias("value"), F.col("doc_id").alias("ord"),
    )
    return first_wins(rows, ["key", "locale"])


def locales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("lang").alias("locale")).distinct()


_M = "(select greatest(count(*) // 2, 1) from documents)"
CATALOG = f"""catalog as (select source || '.text.' || cast(doc_id % {_M} as varchar) as key, lang as locale, source || '/' || lang || '.json' as file,
  trim(text) as value, doc_id as ord from documents)"""
VALUES = f"""{CATALOG}, vals as (select key, locale, arg_min(file, ord) as file, arg_min(value, ord) as value, min(ord) as ord from catalog group by key, locale)"""
COARSE = f"""rough as (select source || '.text.' || cast(doc_id % {_M} as varchar) as key, lang as locale, source || '/' || lang || '.json' as file,
  case when left(md5(text), 1) = '0' then '' else substr(md5(text), 2, 1) end as value, doc_id as ord from documents),
vals as (select key, locale, arg_min(file, ord) as file, arg_min(value, ord) as value, min(ord) as ord from rough group by key, locale)"""
LOCALES = "locs as (select distinct lang as locale from documents)"
EN = "en as (select key, value from vals where locale = 'en')"
GRID = f"""{COARSE}, {LOCALES}, {EN}, grid as (select k.key, l.locale, v.value, e.value as source from (select distinct key from vals) k cross join locs l
  left join vals v on v.key = k.key and v.locale = l.locale left join en e on e.key = k.key)"""
DIAGNOSTICS = f"""{GRID}, diag as (
  select key, locale, 'missing-default' as code from grid where locale = 'en' and coalesce(source, '') = ''
  union all select key, locale, 'untranslated-missing' from grid where locale <> 'en' and coalesce(source, '') <> '' and coalesce(value, '') = ''
  union all select key, locale, 'untranslated-same' from grid where locale <> 'en' and coalesce(source, '') <> '' and value = source and value <> '')"""

"""Corpus pipeline: quality classifier, exact dedup, n-gram Jaccard join, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; run() writes each stage's rows as Parquet
in the shared folder and reads them again. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.llm import exact_dedup, jaccard_join, kneser_ney, packing, pii
from glossaria.llm.common import clear, made, scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier rejects go."""
    return kneser_ney.keep(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id stays."""
    return exact_dedup.survivors(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest doc_id stays."""
    return jaccard_join.survivors(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind; n_chars, where there is one, is the new text's length."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.packed(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("pii", private), ("packing", packed)]
#: Two of the stages are learned models and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last. What a stage wrote in passing is deleted when its rows are written."""
    docs, before = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        clear(spark, before, keep=path)
        docs = spark.read.parquet(path)
    return docs

"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import dedup

    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import join

    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"))


def op9_sentencepiece_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_bpe import encoded

    return encoded(table(spark, sf_dir, "documents"))


def op2_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import found

    return found(table(spark, sf_dir, "documents"))


def op7_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op1_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hilbert_ann import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .context_mixing import scored

    return scored(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op12_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergences

    return divergences(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}

"""One named query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    chats,
    codes,
    collocations,
    decontaminate,
    embeddings,
    languages,
    near_dups,
    pieces,
    quality,
    secrets,
    suffixes,
    templates,
    toxicity,
)
from .sql import STATEMENTS

__all__ = ["REGISTRY", "STATEMENTS"]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_embedding_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    """Links, component and representative of every vector."""
    return embeddings.near_duplicates(_table(spark, folder, "embeddings"))


def op2_sentencepiece_sampling(spark: SparkSession, folder: str) -> DataFrame:
    """Sampled pieces of every text, and whether they decode to it."""
    return pieces.encode_report(_table(spark, folder, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes removed from every document because a string of 400 bytes over them is repeated."""
    return suffixes.report(_table(spark, folder, "documents"))


def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Repaired role, moves and rendered fragment of every turn."""
    return chats.format_chats(_table(spark, folder, "conversations"))


def op5_lexicon_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score and prediction of every text."""
    return toxicity.report(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op6_language_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every text."""
    return languages.report(_table(spark, folder, "documents"))


def op7_quality_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Log importance weight, Gumbel key and whether the draw takes the document."""
    return quality.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op8_log_template_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Texts without the lines of recurring templates, with line counts."""
    return templates.drop_templates(_table(spark, folder, "documents").select("doc_id", "text"))


def op9_minhash_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    """Class of near copies of every document, and whether the document stands for it."""
    return near_dups.report(_table(spark, folder, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words inside benchmark windows, the items they come from, and whether the document is contaminated."""
    return decontaminate.report(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op11_secret_novelty(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every text: counts and digest of the patterns' spans, and all spans."""
    return secrets.report(_table(spark, folder, "documents"))


def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 strongest collocations of each language."""
    return collocations.report(_table(spark, folder, "documents"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Code and errors of every vector, and the digest of the trained codebooks."""
    return codes.report(_table(spark, folder, "embeddings"))


REGISTRY = {name: query for name, query in list(globals().items()) if name.startswith("op")}

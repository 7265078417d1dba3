"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage works on all rows its predecessor kept. ``ORACLE_SQL`` is None: the quality draw and the sampled
segmentation cannot be put in SQL; the tests hold the stages against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citetide.llm import decontaminate, near_dups, pieces, quality, templates
from citetide.session import shared_folder


def _table(docs: DataFrame, folder: str, name: str) -> DataFrame:
    return docs.sparkSession.read.parquet(f"{folder}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality draw takes."""
    return quality.keep_good(docs, _table(docs, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates; ``n_chars`` follows the text."""
    found = templates.drop_templates(docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*(F.col(f"`{c}`") for c in docs.columns))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dups.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontaminate.keep_clean(docs, _table(docs, sf_dir, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their pieces, and whether these decode to the text."""
    return pieces.encode(docs, ["doc_id"], check=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents`` in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        path = f"{folder}/{i}-{name}"
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return docs

"""Line-based inputs without a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """One id per line: distinct ``gene_id`` values."""
    lines = spark.read.text(path).select(F.trim("value").alias("gene_id")).filter(F.col("gene_id") != "")
    return lines.select(F.col("gene_id").cast("bigint")).distinct()


def read_columns(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of blank-separated fields as ``value``."""
    return spark.read.text(path)


def nth_column(n: int, line: str = "value") -> Column:
    """The ``n``-th blank-separated field of a line, counted from 1; a short line is an error."""
    fields = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    return F.element_at(fields, n)

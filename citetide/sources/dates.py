"""Publication dates and daily id files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citetide.functions.scalars import iso_day, pub_year
from citetide.sinks import write_table


def parse_dates(lines: DataFrame, column: str = "value") -> DataFrame:
    """``<date> <id>`` lines -> ``pmid, year, pub_date``; works on batch and streaming frames.

    The date is ``YYYY``, ``YYYY/MM/DD`` or ``YYYY-MM-DD``; a bare year has no ``pub_date``.
    """
    rows = lines.filter(F.trim(column) != "")
    fields = F.split(F.trim(F.regexp_replace(column, r"\s+", " ")), " ")
    day = F.regexp_replace(fields[0], "/", "-")
    return rows.select(
        fields[1].cast("bigint").alias("pmid"),
        pub_year(fields[0]).alias("year"),
        F.when(day.contains("-"), F.to_date(day, "yyyy-MM-dd")).alias("pub_date"),
    )


def read_pub_dates(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_dates(spark.read.text(path))


def read_daily_dates(spark: SparkSession, folder: str) -> DataFrame:
    """All daily files below ``folder`` as one table: ``pmid, year, pub_date``."""
    return parse_dates(
        spark.read.option("pathGlobFilter", "*.ssv").option("recursiveFileLookup", True).text(folder)
    )


def date_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every day from ``start`` to ``end`` (ISO strings), both included: ``pub_date``."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias("pub_date"))


def extract_ids(responses: DataFrame, text: Column | str = "text", name: str = "pmid") -> DataFrame:
    """One row per ``<Id>digits</Id>`` in each response; the other columns are repeated.

    Rows are independent, so a day of any size needs no grouping.
    """
    column = F.col(text) if isinstance(text, str) else text
    ids = F.regexp_extract_all(column, F.lit("<Id>([0-9]+)</Id>"), F.lit(1)).cast("array<bigint>")
    kept = [c for c in responses.columns if c != text]
    return responses.select(*kept, F.explode(ids).alias(name))


def write_daily_dates(ids: DataFrame, folder: str) -> None:
    """``pub_date, pmid`` rows as one folder per day with ``YYYY-MM-DD pmid`` lines; empty days have none.
    Days that are not among the rows stay as they are."""
    lines = ids.select("pub_date", iso_day(F.col("pub_date")).alias("day"), "pmid")
    write_table(lines, folder, "csv", ["pub_date"], sep=" ", extension="ssv", partitionOverwriteMode="dynamic")

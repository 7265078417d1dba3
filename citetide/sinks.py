"""Writers. Every writer replaces its target (daily files: the days it writes) and writes in parallel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from citetide.functions.scalars import MISSING
from citetide.schemas import ANNOTATIONS, named

#: Columns of the transcript tables.
_TRANSCRIPT = ["refseq_id", "chrom", "tx_start", "tx_end", "symbol", "description", "type_of_gene", "citations"]


#: Signs that would end a field or a line of text, or that the writer would take as quotes and comments.
BREAKS = "\t\n\r\0\1"


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), **options: str | bool
) -> None:
    """Write a table folder. Rows are rebalanced by the partition columns first: few files per value, and
    adaptive execution splits a value that holds a large share of the rows."""
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    df.write.mode("overwrite").format(fmt).options(**options).partitionBy(*partition_by).save(path)


def write_bucketed(df: DataFrame, name: str, by: Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """Write the table ``name`` with its rows hashed by ``by`` into ``buckets`` files and sorted in them, and read it.

    Tables with the same buckets are joined and grouped by these columns without a shuffle, in every later report.
    The warehouse folder, or ``path``, must be one that all executors share. A key stays in one bucket: use it for
    columns without hot keys, and enough buckets that one fits a task.
    """
    writer = df.repartition(buckets, *by).write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by)
    (writer if path is None else writer.option("path", path)).saveAsTable(name)
    return df.sparkSession.table(name)


def write_tsv(
    df: DataFrame, path: str, header: bool = False, partition_by: Sequence[str] = (), null: str = ""
) -> None:
    """Tab-separated text without quoting; a null is an empty field.

    Blanks around values, quotes and ``#`` are kept. Tabs, line breaks and the signs 0 and 1 inside a text cannot be
    written without quoting: each becomes a blank.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in partition_by]
    df = df.withColumns({name: F.translate(F.col(f"`{name}`"), BREAKS, " " * len(BREAKS)) for name in texts})
    text = {"sep": "\t", "header": header, "quote": "", "escape": "", "escapeQuotes": False, "comment": "\1"}
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    write_table(df, path, "csv", partition_by, nullValue=null, emptyValue="", **text, **blanks)


def register(df: DataFrame, name: str) -> DataFrame:
    """Name a table for SQL."""
    df.createOrReplaceTempView(name)
    return df


def write_totals(totals: DataFrame, path: str) -> None:
    """Gene totals: taxon, gene, ``-``, symbol, description, type, count."""
    columns = ["tax_id", "gene_id", F.lit(MISSING).alias("year"), "symbol", "description", "type_of_gene", "citations"]
    write_tsv(totals.select(*columns), path)


def write_by_year(by_year: DataFrame, path: str) -> None:
    """Yearly counts: taxon, gene, year, symbol, description, type, count."""
    columns = ["tax_id", "gene_id", "year", "symbol", "description", "type_of_gene", "citations"]
    write_tsv(by_year.select(*columns), path)


def write_transcript_by_year(by_year: DataFrame, path: str) -> None:
    """Yearly counts on transcripts, 11 columns: taxon, gene, year, transcript, locus, gene attributes, count."""
    write_tsv(by_year.select("tax_id", "gene_id", "year", *_TRANSCRIPT), path)


def write_transcript_totals(totals: DataFrame, path: str) -> None:
    """All-time counts on transcripts: the same columns without the year."""
    write_tsv(totals.select("tax_id", "gene_id", *_TRANSCRIPT), path)


def write_annotations(annotations: DataFrame, path: str) -> None:
    """The annotation table in the order of ``sources.read_annotations``."""
    write_tsv(annotations.select(*named(ANNOTATIONS)), path)


def write_ranked(ranked: DataFrame, path: str) -> None:
    """The yearly ranking with its header."""
    renamed = ranked.select(
        "year",
        "pos",
        F.col("citations").alias("count"),
        F.col("gene_id").alias("geneid"),
        "symbol",
        F.col("description").alias("name"),
        F.col("tax_id").alias("taxid"),
    )
    write_tsv(renamed, path, header=True)


def write_wide(wide: DataFrame, path: str) -> None:
    """A pivot with header ``gene`` and the years; absent cells are blank."""
    write_tsv(wide.withColumnRenamed("symbol", "gene"), path, header=True)


def write_by_strand(refgene_counts: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Transcript counts split by strand in one write."""
    write_table(refgene_counts, path, fmt, partition_by=["strand"])

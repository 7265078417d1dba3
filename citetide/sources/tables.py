"""Tab-separated tables. Plain and gzipped files are read alike; paths may be globs or lists.

Malformed numbers stop the job (FAILFAST), quotes are ordinary characters, and ``#`` lines are skipped.
A gzip file cannot be split: convert large ones once (``sinks.write_table``) and work from parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citetide import schemas
from citetide.functions.scalars import trim_commas

Path = str | list[str]


def _tsv(spark: SparkSession, path: Path, schema: T.StructType, comment: str | None = "#") -> DataFrame:
    reader = spark.read.schema(schema).option("sep", "\t").option("quote", "").option("mode", "FAILFAST")
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(path).select(*schemas.named(schema))


def read_gene2pubmed(spark: SparkSession, path: Path) -> DataFrame:
    """``tax_id, gene_id, pmid``"""
    return _tsv(spark, path, schemas.GENE2PUBMED)


def read_gene_info(spark: SparkSession, path: Path) -> DataFrame:
    """``tax_id, gene_id, symbol, description, type_of_gene, full_name``"""
    return _tsv(spark, path, schemas.GENE_INFO)


def read_gene2refseq(spark: SparkSession, path: Path) -> DataFrame:
    """``tax_id, gene_id, accession``"""
    return _tsv(spark, path, schemas.GENE2REFSEQ)


def read_refgene(spark: SparkSession, path: Path) -> DataFrame:
    """Transcripts with positions; exon lists without outer commas. A missing name is an empty string."""
    rows = _tsv(spark, path, schemas.REFGENE, comment=None)
    return rows.withColumns(
        {
            "name": F.coalesce("name", F.lit("")),
            "exon_starts": trim_commas(F.col("exon_starts")),
            "exon_ends": trim_commas(F.col("exon_ends")),
        }
    )


def read_chrom_info(spark: SparkSession, path: Path) -> DataFrame:
    """``chrom, length``"""
    return _tsv(spark, path, schemas.CHROM_INFO, comment=None)


def read_interactions(spark: SparkSession, path: Path) -> DataFrame:
    """``src, dst``"""
    return _tsv(spark, path, schemas.INTERACTIONS)


def read_gene_disease(spark: SparkSession, path: Path) -> DataFrame:
    """Columns named by the header line, all text except ``NumberOfPubmeds``. Short or long lines, and files with
    another header, stop the job."""
    header = spark.read.text(path).first()  # one line
    if header is None:
        raise ValueError(f"no header line in {path}")
    kinds = {"NumberOfPubmeds": T.IntegerType()}
    schema = T.StructType([T.StructField(name, kinds.get(name, T.StringType())) for name in header.value.split("\t")])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    return reader.option("sep", "\t").option("quote", "").option("mode", "FAILFAST").csv(path)


def read_annotations(spark: SparkSession, path: Path) -> DataFrame:
    """The 14-column annotation table."""
    return _tsv(spark, path, schemas.ANNOTATIONS, comment=None)


def read_by_year(spark: SparkSession, path: Path) -> DataFrame:
    """Yearly counts as written by ``sinks.write_by_year``."""
    return _tsv(spark, path, schemas.BY_YEAR, comment=None)

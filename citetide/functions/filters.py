"""Row filters. Each is a plain predicate, so it reaches the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetide.functions.scalars import MISSING


def for_species(df: DataFrame, tax_id: int | None) -> DataFrame:
    return df if tax_id is None else df.filter(F.col("tax_id") == tax_id)


def for_type(df: DataFrame, type_of_gene: str, negate: bool = False) -> DataFrame:
    match = F.col("type_of_gene") == type_of_gene
    return df.filter(~match if negate else match)


def for_symbol(df: DataFrame, symbol: str) -> DataFrame:
    return df.filter(F.col("symbol") == symbol)


def for_strand(df: DataFrame, strand: str) -> DataFrame:
    return df.filter(F.col("strand") == strand)


def for_paper(df: DataFrame, pmid: int) -> DataFrame:
    return df.filter(F.col("pmid") == pmid)


def for_association(df: DataFrame, association_type: str, column: str = "associationType") -> DataFrame:
    return df.filter(F.col(column) == association_type)


def primary_chromosomes(refgene: DataFrame) -> DataFrame:
    """Named transcripts on chromosomes whose name has no ``_``."""
    return refgene.filter(~F.col("chrom").contains("_") & (F.col("name") != ""))


def with_accession(df: DataFrame, column: str = "refseq_id") -> DataFrame:
    return df.filter(F.col(column) != MISSING)


def min_citations(df: DataFrame, n: int) -> DataFrame:
    """Keep counts strictly above ``n``."""
    return df.filter(F.col("citations") > n)


def drop_missing_edges(edges: DataFrame) -> DataFrame:
    """Drop an edge when either end is exactly ``-``."""
    return edges.filter((F.col("src") != MISSING) & (F.col("dst") != MISSING))

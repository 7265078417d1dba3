"""One survivor per key where the sources hold several.

Which row survives is fixed by value: the latest year, the smallest gene id, the smallest accession, the
first locus. Each rule is a partial + final aggregate, never a window over the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetide.functions.scalars import MISSING, strip_version
from citetide.operators.counting import first_by
from citetide.operators.skew import deal


def one_year_per_pub(dates: DataFrame) -> DataFrame:
    """``pmid, year`` with the latest year of each paper."""
    return dates.groupBy("pmid").agg(F.max("year").alias("year"))


def years_per_pub(dates: DataFrame) -> DataFrame:
    """``pmid, year, n`` for joins in which every date row counts; repeated rows travel as a number."""
    return dates.groupBy("pmid", "year").agg(F.count("*").alias("n"))


def gene_refseq_pairs(gene2refseq: DataFrame, size: int | None = None) -> DataFrame:
    """Distinct ``gene_id, refseq_id`` pairs that have an accession, dealt by the number of rows ``size`` if it is known."""
    pairs = gene2refseq.select("gene_id", strip_version(F.col("accession")).alias("refseq_id"))
    return deal(pairs.filter(F.col("refseq_id") != MISSING), size, "gene_id", "refseq_id").distinct()


def gene_of_refseq(gene2refseq: DataFrame) -> DataFrame:
    """One gene per accession: ``refseq_id, tax_id, gene_id`` with the smallest gene id."""
    named = gene2refseq.select("tax_id", "gene_id", strip_version(F.col("accession")).alias("refseq_id"))
    return first_by(named, ["refseq_id"], ["gene_id", "tax_id"]).select("refseq_id", "tax_id", "gene_id")


def refseq_of_gene(gene2refseq: DataFrame) -> DataFrame:
    """One accession per gene: ``tax_id, gene_id, refseq_id``.

    Accessions are first given to one gene each. The missing mark is taken only where nothing else is.
    """
    owned = gene_of_refseq(gene2refseq).withColumn("_missing", F.col("refseq_id") == MISSING)
    return first_by(owned, ["tax_id", "gene_id"], ["_missing", "refseq_id"]).drop("_missing")


def one_locus_per_name(refgene: DataFrame) -> DataFrame:
    """One row per transcript name: the first by chromosome and start, then by the other columns."""
    leading = ["chrom", "tx_start", "tx_end"]
    others = [c for c in refgene.columns if c not in ("name", *leading)]
    return first_by(refgene, ["name"], [*leading, *others]).select(*refgene.columns)


def gene_attributes(
    gene_info: DataFrame,
    keys: Sequence[str] = ("tax_id", "gene_id"),
    columns: Sequence[str] = ("symbol", "description", "type_of_gene"),
) -> DataFrame:
    """One row per gene with its attributes and ``copies``, the number of source rows."""
    return first_by(gene_info, keys, columns, copies="copies")

"""The gene annotation table: transcripts with gene attributes and citation counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetide.functions.scalars import int_list, strip_version
from citetide.operators.counting import count_by
from citetide.operators.dedupe import gene_refseq_pairs
from citetide.operators.intervals import union_intervals
from citetide.operators.skew import KeyStatistics, skew_join

COLUMNS = (
    "chrom",
    "tx_start",
    "tx_end",
    "symbol",
    "citations",
    "strand",
    "refseq_id",
    "gene_id",
    "type_of_gene",
    "full_name",
    "cds_start",
    "cds_end",
    "exon_starts",
    "exon_ends",
)


def gene_row_counts(gene2pubmed: DataFrame) -> DataFrame:
    """``gene_id, citations``"""
    return count_by(gene2pubmed, ["gene_id"])


def refseq_citations(gene2pubmed: DataFrame, gene2refseq: DataFrame) -> DataFrame:
    """``gene_id, refseq_id, citations`` for every transcript of a cited gene."""
    return skew_join(gene_refseq_pairs(gene2refseq), gene_row_counts(gene2pubmed), "gene_id", unique=True)


def cited_genes(gene_info: DataFrame, gene2pubmed: DataFrame) -> DataFrame:
    """``gene_id, symbol, type_of_gene, full_name, citations``: genes matched by id alone."""
    rows = gene_info.select("gene_id", "symbol", "type_of_gene", "full_name")
    return skew_join(rows, gene_row_counts(gene2pubmed), "gene_id", unique=True)


def annotation_statistics(gene_info: DataFrame, gene2refseq: DataFrame, refgene: DataFrame) -> KeyStatistics:
    """Sketches of the source columns on which :func:`gene_annotations` joins rows to rows."""
    accession = strip_version(F.col("accession")).alias("refseq_id")
    return KeyStatistics(
        {
            "gene2refseq.gene_id": (gene2refseq, ["gene_id"]),
            "gene2refseq.accession": (gene2refseq, [accession]),
            "gene_info.gene_id": (gene_info, ["gene_id"]),
            "refgene.name": (refgene, ["name"]),
        }
    )


def gene_annotations(
    gene_info: DataFrame,
    gene2pubmed: DataFrame,
    gene2refseq: DataFrame,
    refgene: DataFrame,
    statistics: KeyStatistics | None = None,
    size: int | None = None,
) -> DataFrame:
    """The 14 columns of ``COLUMNS``, one row per locus of each transcript of a cited gene.

    Attributes and the count are put on the gene's transcripts first, then on the loci, so the widest
    table is shuffled once. Pass ``statistics`` (:func:`annotation_statistics`) to share the sketches with other
    reports over the same tables. ``size`` is the number of rows of ``gene2refseq`` or more, by which the joins are dealt, if
    it is known.
    """
    known = annotation_statistics(gene_info, gene2refseq, refgene) if statistics is None else statistics
    named = skew_join(
        gene_refseq_pairs(gene2refseq, size),
        cited_genes(gene_info, gene2pubmed),
        "gene_id",
        rows=size,
        by=["refseq_id"],
        both=True,
        bound=gene_info,
        probe=known["gene2refseq.gene_id"],
        probe_right=known["gene_info.gene_id"],
    )
    loci = refgene.withColumnRenamed("name", "refseq_id")
    joined = skew_join(
        loci,
        named,
        "refseq_id",
        both=True,
        probe=known["refgene.name"],
        probe_right=known["gene2refseq.accession"],
        rows=size,
    )
    return joined.select(*COLUMNS)


def exon_intervals(annotations: DataFrame) -> DataFrame:
    """``gene_id, chrom, strand, exon_start, exon_end``: one row per exon of an annotation row."""
    pairs = F.arrays_zip(
        int_list(F.col("exon_starts")).alias("exon_start"), int_list(F.col("exon_ends")).alias("exon_end")
    )
    rows = annotations.select("gene_id", "chrom", "strand", F.explode(pairs).alias("exon"))
    return rows.select("gene_id", "chrom", "strand", "exon.*")


def exon_unions(exons: DataFrame) -> DataFrame:
    """Merged exons per gene, chromosome and strand."""
    return union_intervals(exons, ["gene_id", "chrom", "strand"], "exon_start", "exon_end")


def transcript_bounds(unions: DataFrame) -> DataFrame:
    """First start and last end of each gene's merged exons."""
    return unions.groupBy("gene_id", "chrom", "strand").agg(
        F.min("exon_start").alias("tx_start"), F.max("exon_end").alias("tx_end")
    )

"""Transcripts with genome-wide positions and gene citation counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetide.functions.scalars import gene_length, with_uid
from citetide.operators.counting import count_by, greatest_by
from citetide.operators.dedupe import one_locus_per_name, refseq_of_gene
from citetide.operators.running import global_running
from citetide.operators.skew import skew_join
from citetide.plans.citations import GENE


def cumulative_offsets(chrom_info: DataFrame, small: bool = False) -> DataFrame:
    """``chrom, length, chrom_offset``: start of each chromosome when laid end to end, longest first."""
    order = [F.desc("length"), F.asc("chrom")]
    return global_running(chrom_info.select("chrom", "length"), order, "length", "chrom_offset", small)


def with_genome_coords(refgene: DataFrame, offsets: DataFrame, strict: bool = True) -> DataFrame:
    """Add ``chrom_offset, genome_tx_start, genome_tx_end, gene_length``.

    With ``strict`` a chromosome without an offset stops the job, also when a later filter on the
    chromosome would remove the row: the check is part of the column that filter reads. Otherwise such
    rows are dropped.
    """
    lookup = offsets.select("chrom", "chrom_offset")
    joined = skew_join(refgene, lookup, "chrom", "left" if strict else "inner")
    if strict:
        unknown = F.raise_error(F.concat(F.lit("unknown chromosome: "), F.col("chrom")))
        joined = joined.withColumn("chrom", F.when(F.col("chrom_offset").isNull(), unknown).otherwise(F.col("chrom")))
    return joined.select(
        *refgene.columns,
        "chrom_offset",
        (F.col("chrom_offset") + F.col("tx_start")).alias("genome_tx_start"),
        (F.col("chrom_offset") + F.col("tx_end")).alias("genome_tx_end"),
        gene_length(F.col("tx_start"), F.col("tx_end")).alias("gene_length"),
    )


def gene_counts(gene2pubmed: DataFrame) -> DataFrame:
    """``tax_id, gene_id, citations``: all rows, dated or not."""
    return count_by(gene2pubmed, GENE)


def refseq_counts(gene2pubmed: DataFrame, gene2refseq: DataFrame) -> DataFrame:
    """``tax_id, gene_id, refseq_id, citations``: gene counts on one accession per gene."""
    counts = greatest_by(gene_counts(gene2pubmed), GENE)
    return counts.join(refseq_of_gene(gene2refseq), list(GENE)).select(*GENE, "refseq_id", "citations")


def attach_counts(
    refgene: DataFrame, counts: DataFrame, one_locus: bool = False, source: DataFrame | None = None
) -> DataFrame:
    """Add ``citations`` to transcripts by accession: at every locus, or at one locus per transcript.

    ``source`` is the transcript table that ``refgene`` is derived from, if it is.
    """
    named = counts.select(F.col("refseq_id").alias("name"), "citations")
    if one_locus:
        return one_locus_per_name(refgene).join(named, "name")
    return skew_join(refgene, named, "name", bound_left=source, probe=source)


def refgene_counts(
    refgene: DataFrame,
    offsets: DataFrame,
    gene2pubmed: DataFrame,
    gene2refseq: DataFrame,
    keys: list[str] | None = None,
) -> DataFrame:
    """Transcripts with genome-wide positions, counts and a row id.

    ``keys`` are the columns of the id digest; without them ids are random.
    """
    placed = with_genome_coords(refgene, offsets)
    counted = attach_counts(placed, refseq_counts(gene2pubmed, gene2refseq), source=refgene)
    columns = [
        "name",
        "chrom",
        "strand",
        "tx_start",
        "tx_end",
        "genome_tx_start",
        "genome_tx_end",
        "cds_start",
        "cds_end",
        "exon_count",
        "exon_starts",
        "exon_ends",
        "gene_name",
        "citations",
    ]
    return with_uid(counted.select(*columns), keys)

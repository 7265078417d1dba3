"""Citation counts shown on transcripts, and gene ids for transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetide.functions.scalars import strip_version
from citetide.operators.counting import first_by, roll_up
from citetide.operators.dedupe import gene_of_refseq, one_locus_per_name
from citetide.operators.skew import skew_join
from citetide.plans.citations import ATTRIBUTES, GENE, citation_counts
from citetide.session import pin

LOCUS = ("chrom", "tx_start", "tx_end")


def gene_transcripts(gene_info: DataFrame, gene2refseq: DataFrame) -> DataFrame:
    """Gene attributes on each of the gene's transcript rows: ``tax_id, gene_id, symbol, description,
    type_of_gene, refseq_id``."""
    rows = gene2refseq.select(*GENE, strip_version(F.col("accession")).alias("refseq_id"))
    joined = skew_join(rows, gene_info.select(*GENE, *ATTRIBUTES), GENE, both=True)
    return joined.select(*GENE, *ATTRIBUTES, "refseq_id")


def located_refseq(gene2refseq: DataFrame, refgene: DataFrame) -> DataFrame:
    """Distinct ``tax_id, gene_id, refseq_id`` whose transcript is placed on the genome.

    The mark for a missing accession can be the commonest one; distinct rows are spread by gene.
    """
    rows = gene2refseq.select(*GENE, strip_version(F.col("accession")).alias("refseq_id"))
    names = refgene.select(F.col("name").alias("refseq_id"))
    return skew_join(rows.distinct(), names.distinct(), "refseq_id", "left_semi", by=GENE, bound=names, probe=rows)


def transcript_by_year(
    gene_info: DataFrame, gene2pubmed: DataFrame, dates: DataFrame, gene2refseq: DataFrame, refgene: DataFrame
) -> DataFrame:
    """``tax_id, gene_id, year, refseq_id, chrom, tx_start, tx_end, symbol, description, type_of_gene, citations``.

    A paper counts once per gene, however many transcripts or repeated rows the gene has, and each gene is
    shown on its first located transcript. Counting distinct gene-paper pairs and attaching the transcript
    afterwards avoids a row per transcript and paper.
    """
    pairs = gene2pubmed.select(*GENE, "pmid").distinct()
    counts = citation_counts(pairs, dates, probe=gene2pubmed)
    attributes = first_by(gene_info, GENE, ATTRIBUTES)
    transcript = first_by(located_refseq(gene2refseq, refgene), GENE, ["refseq_id"])
    loci = one_locus_per_name(refgene.select("name", *LOCUS)).withColumnRenamed("name", "refseq_id")
    placed = transcript.join(loci, "refseq_id")
    joined = counts.join(attributes, list(GENE)).join(placed, list(GENE))
    return joined.select(*GENE, "year", "refseq_id", *LOCUS, *ATTRIBUTES, "citations")


def transcript_totals(by_year: DataFrame) -> DataFrame:
    """All-time counts from ``transcript_by_year``."""
    return roll_up(by_year)


def mark_gene_ids(refgene: DataFrame, gene2refseq: DataFrame) -> DataFrame:
    """The transcripts with ``gene_id`` in front and ``has_gene`` behind, from one join, as a written table in which the
    rows with and without a gene lie apart."""
    genes = gene_of_refseq(gene2refseq).select(F.col("refseq_id").alias("name"), "gene_id", F.lit(True).alias("has_gene"))
    marked = skew_join(refgene, genes, "name", "left", unique=True)
    return pin(
        marked.select("gene_id", *refgene.columns, F.coalesce("has_gene", F.lit(False)).alias("has_gene")), ["has_gene"]
    )


def add_gene_id(refgene: DataFrame, gene2refseq: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transcripts with ``gene_id`` in front, and the names of transcripts without a gene."""
    marked = mark_gene_ids(refgene, gene2refseq)
    return marked.filter("has_gene").drop("has_gene"), marked.filter("not has_gene").select("name")

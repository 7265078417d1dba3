"""How many papers a list of genes covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetide.operators.skew import hot_keys, is_small, skew_join
from citetide.operators.topk import top_k
from citetide.session import pin


def top_transcript_genes(annotations: DataFrame, k: int) -> DataFrame:
    """Gene ids of the ``k`` most cited annotation rows; a gene can come up more than once."""
    order = [F.desc("citations"), F.desc("gene_id"), F.desc("refseq_id"), F.desc("chrom"), F.desc("tx_start")]
    return top_k(annotations, order, k).select("gene_id")


def paper_coverage(gene2pubmed: DataFrame, genes: DataFrame, tax_id: int) -> DataFrame:
    """One row: ``genes`` in the list, ``gene_papers`` citing any of them (all species), and
    ``species_papers`` of the species.

    The list is written once, as it is counted and joined. Citation rows are flagged, then reduced to one row per paper, which combines on the map side.
    """
    listed = pin(genes.select("gene_id").distinct()).withColumn("listed", F.lit(1))
    rows = gene2pubmed.select("gene_id", "pmid", (F.col("tax_id") == tax_id).cast("int").alias("own"))
    hot = [] if is_small(listed) else hot_keys(rows, ["gene_id"])
    flagged = skew_join(rows.distinct() if hot else rows, listed, "gene_id", "left", by=["pmid"], hot=hot)
    papers = flagged.groupBy("pmid").agg(F.max("listed").alias("listed"), F.max("own").alias("own"))
    none = F.lit(0)
    parts = papers.select(none.alias("genes"), "listed", "own").unionByName(
        listed.select(F.lit(1).alias("genes"), none.alias("listed"), none.alias("own"))
    )
    totals = {"genes": "genes", "listed": "gene_papers", "own": "species_papers"}
    return parts.agg(*[F.coalesce(F.sum(c), none.cast("bigint")).alias(name) for c, name in totals.items()])


def papers_of_genes(gene2pubmed: DataFrame, genes: DataFrame) -> DataFrame:
    """Distinct papers citing any listed gene."""
    rows = gene2pubmed.select("gene_id", "pmid")
    listed = genes.select("gene_id").distinct()
    hot = [] if is_small(listed) else hot_keys(rows, ["gene_id"])
    kept = skew_join(rows.distinct() if hot else rows, listed, "gene_id", "left_semi", by=["pmid"], hot=hot)
    return kept.select("pmid").distinct()

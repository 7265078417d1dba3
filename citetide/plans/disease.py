"""Gene-disease associations through named SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetide.operators.skew import deal, hot_keys, skew_join, spread
from citetide.sinks import register


def register_gene_diseases(associations: DataFrame, view: str = "gene_diseases") -> DataFrame:
    return register(associations, view)


def top_association(
    associations: DataFrame, association_type: str = "GeneticVariation", view: str = "gene_diseases"
) -> DataFrame:
    """The association of a type with the most publications; equal ones in gene and disease order."""
    session = register_gene_diseases(associations, view).sparkSession
    return session.sql(
        """
        SELECT * FROM IDENTIFIER(:view) WHERE associationType = :type
        ORDER BY NumberOfPubmeds DESC, geneId, diseaseId LIMIT 1
        """,
        {"type": association_type, "view": view},
    )


def associated_genes(
    associations: DataFrame, association_type: str = "GeneticVariation", view: str = "gene_diseases", results: str = "results"
) -> DataFrame:
    """Genes of a type's associations, registered as the view ``results`` and read back from it."""
    session = register_gene_diseases(associations, view).sparkSession
    statement = "SELECT geneId FROM IDENTIFIER(:view) WHERE associationType = :type"
    return register(session.sql(statement, {"type": association_type, "view": view}), results)


def gene_by_month(gene2pubmed: DataFrame, dates: DataFrame, size: int | None = None) -> DataFrame:
    """``gene_id, month, citations``: citation rows per gene and month (its first day). A paper counts in the month of
    its latest day; papers without a day do not count. ``size`` is the number of rows of the larger table, by which the
    join is dealt, if it is known."""
    months = dates.filter(F.col("pub_date").isNotNull()).groupBy("pmid").agg(F.max("pub_date").alias("pub_date"))
    months = months.select("pmid", F.trunc("pub_date", "month").alias("month"))
    dated = skew_join(gene2pubmed.select("gene_id", "pmid"), months, "pmid", unique=True, rows=size)
    return dated.groupBy("gene_id", "month").agg(F.count("*").alias("citations"))


def disease_by_month(gene_months: DataFrame, associations: DataFrame, size: int | None = None) -> DataFrame:
    """``disease_id, month, genes, citations``: the monthly counts of a disease's genes added up.

    Genes meet their diseases after counting, so a gene with many diseases repeats its counts and not its citations; a
    gene is one of a disease's however many associations name it. A gene's months (a year has twelve) travel as one row,
    and are unfolded where a disease's genes are together: unfolded beside the genes, nearly every task would hold
    counts of all diseases and months. ``size`` is the number of association rows or more, by which the diseases are
    dealt, if it is known. Sort the result by month for a report.
    """
    pairs = associations.select(F.col("geneId").alias("gene_id"), F.col("diseaseId").alias("disease_id"))
    listed = F.array_sort(F.collect_list(F.struct("month", "citations"))).alias("months")
    genes = gene_months.groupBy("gene_id").agg(listed).select("gene_id", "months.month", "months.citations")
    joined = skew_join(pairs.distinct(), genes, "gene_id", unique=True, rows=size)
    hot = hot_keys(pairs, ["disease_id"]) if size is not None else []
    dealt = deal(spread(joined, ["disease_id"], hot, "_salt", ["gene_id"]), size, "disease_id", "_salt")
    counts = dealt.select("disease_id", F.inline(F.arrays_zip("month", "citations")))
    totals = counts.groupBy("disease_id", "month")
    return totals.agg(F.count("*").alias("genes"), F.sum("citations").alias("citations"))

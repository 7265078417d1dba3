"""The most cited genes of each year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citetide.functions.filters import for_symbol, min_citations
from citetide.operators.lists import BLOCK, blocked_lists
from citetide.operators.topk import top_per_group
from citetide.plans.citations import gene_by_year_fanout


RANKED = ("citations", "gene_id", "symbol", "description")


def _order() -> list[Column]:
    return [*(F.desc(c) for c in RANKED), F.col("tax_id").cast("string").desc()]


def top_genes_by_year(
    gene_info: DataFrame, gene2pubmed: DataFrame, dates: DataFrame, k: int = 20, min_count: int = 10
) -> DataFrame:
    """``year, pos, citations, gene_id, symbol, description, tax_id``: genes cited more than ``min_count``
    times in a year, largest first; equal counts in descending gene order. Taxon ids compare as text."""
    counts = min_citations(gene_by_year_fanout(gene_info, gene2pubmed, dates), min_count)
    ranked = top_per_group(counts, "year", _order(), k)
    return ranked.select("year", "pos", "citations", "gene_id", "symbol", "description", "tax_id")


def gene_lists_by_year(
    gene_info: DataFrame, gene2pubmed: DataFrame, dates: DataFrame, min_count: int = 10, size: int = BLOCK
) -> DataFrame:
    """``year, block, genes``: all genes cited more than ``min_count`` times in a year, in the order of
    :func:`top_genes_by_year`, as lists of at most ``size`` structs of count, gene and attributes."""
    counts = min_citations(gene_by_year_fanout(gene_info, gene2pubmed, dates), min_count)
    return blocked_lists(counts, ["year"], [*RANKED, "tax_id"], _order(), size, "genes")


def symbol_lookup(by_year: DataFrame, symbol: str) -> DataFrame:
    """Yearly counts of one symbol, smallest first."""
    return for_symbol(by_year, symbol).orderBy("citations", "gene_id", "year")

"""Citation counts of genes, in total and by year, and statistics of the whole corpus.

The fact table (gene to paper) is shuffled once, by paper, to learn the years; counts per gene and year are
combined before they meet the gene attributes, so no gene is hot in that second join. Gene attributes are
one row per gene with the number of source rows, which multiplies the counts as the row-level join would.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetide.functions.filters import for_species
from citetide.operators.counting import count_by, distinct_count_by, roll_up, sum_by
from citetide.operators.dedupe import gene_attributes, one_year_per_pub, years_per_pub
from citetide.operators.skew import deal, hot_keys, is_small, skew_join
from citetide.operators.topk import top_k
from citetide.session import pin

GENE = ("tax_id", "gene_id")
ATTRIBUTES = ("symbol", "description", "type_of_gene")


def cited_dates(dates: DataFrame, gene2pubmed: DataFrame) -> DataFrame:
    """Date rows of papers that cite a gene.

    The papers are made distinct first, which collapses a hot paper on the map side.
    """
    return skew_join(dates, gene2pubmed.select("pmid").distinct(), "pmid", "left_semi")


def dated_pairs(
    gene2pubmed: DataFrame,
    dates: DataFrame,
    keys: Sequence[str],
    dedupe_dates: bool,
    probe: DataFrame | None = None,
    size: int | None = None,
) -> DataFrame:
    """``*keys, pmid, year, n``: rows of ``gene2pubmed`` with the year of the paper, ``n`` source rows each.
    ``size`` is the number of rows of the larger table, by which the join is dealt, if it is known.

    If some paper is hot, equal rows are combined before the join, since copies would stay together when
    the paper's rows are spread by gene.
    """
    years = one_year_per_pub(dates).withColumn("n", F.lit(1).cast("bigint")) if dedupe_dates else years_per_pub(dates)
    rows = gene2pubmed.select(*keys, "pmid")
    small = is_small(years)
    hot = [] if small else hot_keys(rows if probe is None else probe, ["pmid"])
    if not hot:
        size = None if small else size
        return deal(rows, size, "pmid").join(deal(years, size, "pmid"), "pmid").select(*keys, "pmid", "year", "n")
    combined = count_by(rows, [*keys, "pmid"], "copies")
    joined = skew_join(combined, years, "pmid", by=keys, hot=hot, rows=size)
    return joined.select(*keys, "pmid", "year", (F.col("n") * F.col("copies")).alias("n"))


def citation_counts(
    gene2pubmed: DataFrame,
    dates: DataFrame,
    keys: Sequence[str] = GENE,
    dedupe_dates: bool = True,
    by_year: bool = True,
    probe: DataFrame | None = None,
    size: int | None = None,
) -> DataFrame:
    """``*keys[, year], citations``: citation rows with a date.

    With ``dedupe_dates`` a paper has its latest year only; without, it counts under each of its dates.
    ``probe`` is a source table with the papers, if ``gene2pubmed`` is derived; ``size`` as in :func:`dated_pairs`.
    """
    pairs = dated_pairs(gene2pubmed, dates, keys, dedupe_dates, probe, size)
    return pairs.groupBy(*keys, *(["year"] if by_year else [])).agg(F.sum("n").alias("citations"))


def attach_genes(counts: DataFrame, gene_info: DataFrame, keys: Sequence[str] = GENE) -> DataFrame:
    """Add gene attributes to counts per gene; genes without them are dropped."""
    attributes = gene_attributes(gene_info, keys)
    joined = counts.join(attributes, list(keys)).withColumn("citations", F.col("citations") * F.col("copies"))
    columns = [c for c in counts.columns if c != "citations"]
    return joined.select(*columns, *ATTRIBUTES, "citations")


def gene_totals(
    gene_info: DataFrame, gene2pubmed: DataFrame, dates: DataFrame, tax_id: int | None = None
) -> DataFrame:
    """``tax_id, gene_id, symbol, description, type_of_gene, citations``"""
    counts = citation_counts(for_species(gene2pubmed, tax_id), dates, by_year=False)
    return attach_genes(counts, for_species(gene_info, tax_id))


def gene_by_year(
    gene_info: DataFrame, gene2pubmed: DataFrame, dates: DataFrame, tax_id: int | None = None
) -> DataFrame:
    """``tax_id, gene_id, year, symbol, description, type_of_gene, citations``"""
    counts = citation_counts(for_species(gene2pubmed, tax_id), dates)
    return attach_genes(counts, for_species(gene_info, tax_id))


def gene_by_year_fanout(
    gene_info: DataFrame, gene2pubmed: DataFrame, dates: DataFrame, size: int | None = None
) -> DataFrame:
    """``gene_id, symbol, description, tax_id, year, citations``: genes matched by id alone, every date counts."""
    counts = citation_counts(gene2pubmed, dates, keys=("gene_id",), dedupe_dates=False, size=size)
    genes = gene_info.groupBy("gene_id", "symbol", "description", "tax_id").agg(F.count("*").alias("copies"))
    joined = counts.join(genes, "gene_id")
    return joined.select(
        "gene_id",
        "symbol",
        "description",
        "tax_id",
        "year",
        (F.col("citations") * F.col("copies")).alias("citations"),
    )


def totals_from_years(by_year: DataFrame) -> DataFrame:
    """Gene totals from yearly counts that are already at hand."""
    return roll_up(by_year)


def most_cited(totals: DataFrame, k: int) -> DataFrame:
    return top_k(totals, [F.desc("citations"), F.asc("tax_id"), F.asc("gene_id")], k)


def genes_per_year(by_year: DataFrame) -> DataFrame:
    return distinct_count_by(by_year, ["year"], "gene_id", "genes")


def citations_per_year(by_year: DataFrame) -> DataFrame:
    return sum_by(by_year, ["year"])


def citations_by_type(totals: DataFrame) -> DataFrame:
    """Citation rows per gene type, from totals or yearly counts."""
    return sum_by(totals, ["type_of_gene"])


def genes_by_type(totals: DataFrame) -> DataFrame:
    return distinct_count_by(totals, ["type_of_gene"], "gene_id", "genes")


def type_by_year(by_year: DataFrame) -> DataFrame:
    return sum_by(by_year, ["type_of_gene", "year"])


def genes_per_paper(gene_info: DataFrame, gene2pubmed: DataFrame, dates: DataFrame) -> DataFrame:
    """``pmid, genes``: citation rows per dated paper.

    Genes without attributes are dropped first; counts per paper are complete before the dates are met.
    """
    attributes = count_by(gene_info, GENE, "copies")
    rows = gene2pubmed.select(*GENE, "pmid")
    hot = [] if is_small(attributes) else hot_keys(rows, GENE)
    if hot:
        rows = count_by(rows, [*GENE, "pmid"], "n")
    else:
        rows = rows.withColumn("n", F.lit(1).cast("bigint"))
    known = skew_join(rows, attributes, GENE, by=["pmid"], hot=hot)
    papers = known.groupBy("pmid").agg(F.sum(F.col("n") * F.col("copies")).alias("genes"))
    return papers.join(dates.select("pmid").distinct(), "pmid", "left_semi")


def yearly_statistics(by_year: DataFrame) -> DataFrame:
    """``statistic, year, type_of_gene, genes, citations`` from one scan of the yearly counts: a row per year
    (``statistic`` is ``year``) and one per gene type (``type``).

    Grouping sets first reduce the rows to one per gene and year and one per gene and type, combined in each task;
    counting these rows then counts the different genes, so no task collects the genes of a group. Years and types
    may be null.
    """
    sets = [["gene_id", "year"], ["gene_id", "type_of_gene"]]
    of_year = F.grouping("type_of_gene") == 1
    per_gene = by_year.groupingSets(sets, "gene_id", "year", "type_of_gene").agg(
        F.when(of_year, "year").otherwise("type").alias("statistic"), F.sum("citations").alias("citations")
    )
    genes = F.count("gene_id").alias("genes")
    return per_gene.groupBy("statistic", "year", "type_of_gene").agg(genes, F.sum("citations").alias("citations"))


def corpus_stats(
    gene_info: DataFrame, gene2pubmed: DataFrame, dates: DataFrame, by_year: DataFrame | None = None
) -> dict[str, DataFrame]:
    """All corpus statistics. Those of years and types are views of one small written table
    (:func:`yearly_statistics`), so the counts are computed once; pass ``by_year`` if they are at hand."""
    counts = gene_by_year(gene_info, gene2pubmed, dates) if by_year is None else by_year
    found = pin(yearly_statistics(counts), ["statistic"])
    years, types = found.filter("statistic = 'year'"), found.filter("statistic = 'type'")
    return {
        "genes_per_year": years.select("year", "genes"),
        "citations_per_year": years.select("year", "citations"),
        "genes_per_paper": genes_per_paper(gene_info, gene2pubmed, dates),
        "citations_by_type": types.select("type_of_gene", "citations"),
        "genes_by_type": types.select("type_of_gene", "genes"),
    }


def papers_per_species(gene2pubmed: DataFrame) -> DataFrame:
    """``tax_id, papers``: distinct papers, fewest first."""
    return distinct_count_by(gene2pubmed, ["tax_id"], "pmid", "papers").orderBy("papers", "tax_id")


def publications_per_year(dates: DataFrame) -> DataFrame:
    """``year, publications``: date rows, cited or not."""
    return dates.groupBy("year").agg(F.count("*").alias("publications")).orderBy("year")


def pubs_with_year(gene2pubmed: DataFrame, dates: DataFrame) -> DataFrame:
    """``gene_id, tax_id, pmid, year`` for every date row of each cited paper."""
    rows = gene2pubmed.select("gene_id", "tax_id", "pmid")
    return skew_join(rows, dates.select("pmid", "year"), "pmid", both=True).select(
        "gene_id", "tax_id", "pmid", "year"
    )

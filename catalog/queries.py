"""The named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.lens import Lens
from citetide.functions.filters import for_paper, for_strand, for_type, primary_chromosomes
from citetide.functions.scalars import MISSING, int_list, trim_commas
from citetide.operators import counting, dedupe, graph, layers, pivots
from citetide.plans import annotations, citations, columns, coverage, daily, disease, ranking, refgene, streams, transcripts
from citetide.sources.dates import date_spine

#: Fixed parameter of the queries.
SPECIES = 9

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(build: Callable[[Lens], DataFrame]) -> Callable[[Lens], DataFrame]:
    REGISTRY[build.__name__] = lambda spark, folder: build(Lens(spark, folder))
    return build


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Doubles to six places, without a negative zero."""
    return df.withColumns({name: F.round(name, 6) + F.lit(0.0) for name in names})


def _by_year(t: Lens) -> DataFrame:
    return citations.gene_by_year(t.gene_info(), t.gene2pubmed(), t.pmid_dates())


# Citation counts


@query
def gene_total(t: Lens) -> DataFrame:
    totals = citations.gene_totals(t.gene_info(), t.gene2pubmed(), t.pmid_dates())
    return totals.withColumn("year", F.lit(MISSING))


@query
def gene_by_year(t: Lens) -> DataFrame:
    return _by_year(t)


@query
def gene_by_year_species(t: Lens) -> DataFrame:
    return citations.gene_by_year(t.gene_info(), t.gene2pubmed(), t.pmid_dates(), tax_id=SPECIES)


@query
def gene_total_from_years(t: Lens) -> DataFrame:
    return citations.totals_from_years(_by_year(t))


@query
def most_cited_genes(t: Lens) -> DataFrame:
    return citations.most_cited(citations.gene_totals(t.gene_info(), t.gene2pubmed(), t.pmid_dates()), 10)


@query
def gene_by_year_fanout(t: Lens) -> DataFrame:
    return citations.gene_by_year_fanout(t.gene_info(), t.gene2pubmed(), t.pmid_dates_multi(), t.rows("lineitem"))


@query
def cited_dates(t: Lens) -> DataFrame:
    return citations.cited_dates(t.pmid_dates(), t.gene2pubmed()).select("pmid", "year")


@query
def genes_per_year(t: Lens) -> DataFrame:
    return citations.genes_per_year(_by_year(t))


@query
def citations_per_year(t: Lens) -> DataFrame:
    return citations.citations_per_year(_by_year(t))


@query
def genes_per_paper_top10(t: Lens) -> DataFrame:
    papers = citations.genes_per_paper(t.gene_info(), t.gene2pubmed(), t.pmid_dates())
    return papers.orderBy(F.desc("genes"), "pmid").limit(10)


@query
def genes_per_paper(t: Lens) -> DataFrame:
    return citations.genes_per_paper(t.gene_info(), t.gene2pubmed(), t.pmid_dates())


@query
def citations_by_type(t: Lens) -> DataFrame:
    return citations.citations_by_type(citations.gene_totals(t.gene_info(), t.gene2pubmed(), t.pmid_dates()))


@query
def genes_by_type(t: Lens) -> DataFrame:
    return citations.genes_by_type(citations.gene_totals(t.gene_info(), t.gene2pubmed(), t.pmid_dates()))


@query
def yearly_statistics(t: Lens) -> DataFrame:
    return citations.yearly_statistics(_by_year(t))


@query
def type_rows(t: Lens) -> DataFrame:
    return for_type(_by_year(t), "PROMO")


@query
def papers_per_species(t: Lens) -> DataFrame:
    return citations.papers_per_species(t.gene2pubmed())


@query
def publications_per_year(t: Lens) -> DataFrame:
    return citations.publications_per_year(t.pmid_dates())


@query
def pubs_with_year(t: Lens) -> DataFrame:
    return citations.pubs_with_year(t.gene2pubmed(), t.pmid_dates())


@query
def dates_last_year(t: Lens) -> DataFrame:
    return dedupe.one_year_per_pub(t.pmid_dates_multi())


@query
def year_range(t: Lens) -> DataFrame:
    return counting.year_range(_by_year(t))


@query
def row_counts(t: Lens) -> DataFrame:
    return counting.row_count(_by_year(t))


@query
def distinct_symbols(t: Lens) -> DataFrame:
    return counting.distinct_values(_by_year(t), "symbol")


@query
def type_index(t: Lens) -> DataFrame:
    return counting.index_categories(_by_year(t), "type_of_gene")


@query
def symbol_index(t: Lens) -> DataFrame:
    return counting.index_categories(_by_year(t), "symbol")


# Rankings and lookups


@query
def top_genes_by_year(t: Lens) -> DataFrame:
    return ranking.top_genes_by_year(t.gene_info(), t.gene2pubmed(), t.pmid_dates())


@query
def top_genes_by_year_min3(t: Lens) -> DataFrame:
    return ranking.top_genes_by_year(t.gene_info(), t.gene2pubmed(), t.pmid_dates(), min_count=3)


@query
def gene_lists_by_year(t: Lens) -> DataFrame:
    lists = ranking.gene_lists_by_year(t.gene_info(), t.gene2pubmed(), t.pmid_dates(), min_count=3, size=100)
    ids = F.array_join(F.transform("genes", lambda g: g["gene_id"].cast("string")), ",")
    return lists.select("year", "block", F.size("genes").alias("genes"), ids.alias("gene_ids"))


@query
def symbol_lookup(t: Lens) -> DataFrame:
    return ranking.symbol_lookup(_by_year(t), "red widget")


@query
def paper_lookup(t: Lens) -> DataFrame:
    return for_paper(t.gene2pubmed(), 7).select("pmid").limit(1)


# Wide tables


@query
def symbol_by_year(t: Lens) -> DataFrame:
    return pivots.pivot_years(_by_year(t), pivots.year_labels(t.pmid_dates()))


@query
def symbol_by_decade(t: Lens) -> DataFrame:
    return pivots.pivot_decades(_by_year(t), pivots.year_labels(t.pmid_dates()))


@query
def top_symbols_by_decade(t: Lens) -> DataFrame:
    return pivots.pivot_top(_by_year(t), 20, pivots.year_labels(t.pmid_dates()))


@query
def top_by_year(t: Lens) -> DataFrame:
    return pivots.top_by_year(_by_year(t), 20)


@query
def symbol_totals(t: Lens) -> DataFrame:
    return pivots.symbol_totals(_by_year(t))


# Paper coverage


def _annotations(t: Lens) -> DataFrame:
    size = t.rows("lineitem")
    return annotations.gene_annotations(t.gene_info(), t.gene2pubmed(), t.gene2refseq(), t.refgene(), size=size)


def _coverage(t: Lens, k: int) -> DataFrame:
    return coverage.paper_coverage(t.gene2pubmed(), coverage.top_transcript_genes(_annotations(t), k), SPECIES)


@query
def paper_coverage_top100(t: Lens) -> DataFrame:
    return _coverage(t, 100)


@query
def paper_coverage_top10(t: Lens) -> DataFrame:
    return _coverage(t, 10)


@query
def papers_of_top10(t: Lens) -> DataFrame:
    return coverage.papers_of_genes(t.gene2pubmed(), coverage.top_transcript_genes(_annotations(t), 10))


# Transcripts and annotations


@query
def gene_of_refseq(t: Lens) -> DataFrame:
    return dedupe.gene_of_refseq(t.gene2refseq())


@query
def refseq_of_gene(t: Lens) -> DataFrame:
    return dedupe.refseq_of_gene(t.gene2refseq())


@query
def gene_refseq_pairs(t: Lens) -> DataFrame:
    return dedupe.gene_refseq_pairs(t.gene2refseq())


@query
def located_refseq(t: Lens) -> DataFrame:
    return transcripts.located_refseq(t.gene2refseq(), primary_chromosomes(t.refgene()))


@query
def gene_transcripts(t: Lens) -> DataFrame:
    return transcripts.gene_transcripts(t.gene_info(), t.gene2refseq())


def _transcript_by_year(t: Lens) -> DataFrame:
    return transcripts.transcript_by_year(
        t.gene_info(), t.gene2pubmed(), t.pmid_dates(), t.gene2refseq(), primary_chromosomes(t.refgene())
    )


@query
def transcript_by_year(t: Lens) -> DataFrame:
    return _transcript_by_year(t)


@query
def transcript_totals(t: Lens) -> DataFrame:
    return transcripts.transcript_totals(_transcript_by_year(t))


@query
def transcripts_with_gene(t: Lens) -> DataFrame:
    return transcripts.add_gene_id(t.refgene(), t.gene2refseq())[0]


@query
def transcripts_unmatched(t: Lens) -> DataFrame:
    return transcripts.add_gene_id(t.refgene(), t.gene2refseq())[1]


@query
def chrom_offsets(t: Lens) -> DataFrame:
    return refgene.cumulative_offsets(t.chrom_info())


def _positions(t: Lens) -> DataFrame:
    offsets = refgene.cumulative_offsets(t.chrom_info())
    return refgene.with_genome_coords(primary_chromosomes(t.refgene()), offsets)


@query
def refgene_positions(t: Lens) -> DataFrame:
    return _positions(t)


@query
def gene_row_counts(t: Lens) -> DataFrame:
    return annotations.gene_row_counts(t.gene2pubmed())


@query
def gene_counts(t: Lens) -> DataFrame:
    return refgene.gene_counts(t.gene2pubmed())


@query
def refseq_counts(t: Lens) -> DataFrame:
    return refgene.refseq_counts(t.gene2pubmed(), t.gene2refseq())


def _refgene_counts(t: Lens) -> DataFrame:
    keys = ["name", "chrom", "strand", "tx_start", "tx_end", "citations"]
    offsets = refgene.cumulative_offsets(t.chrom_info())
    return refgene.refgene_counts(
        primary_chromosomes(t.refgene()), offsets, t.gene2pubmed(), t.gene2refseq(), keys
    )


@query
def refgene_counts(t: Lens) -> DataFrame:
    return _refgene_counts(t)


@query
def refgene_counts_plus(t: Lens) -> DataFrame:
    return for_strand(_refgene_counts(t), "+")


@query
def refgene_counts_minus(t: Lens) -> DataFrame:
    return for_strand(_refgene_counts(t), "-")


@query
def refgene_one_locus(t: Lens) -> DataFrame:
    counts = refgene.refseq_counts(t.gene2pubmed(), t.gene2refseq())
    return refgene.attach_counts(primary_chromosomes(t.refgene()), counts, one_locus=True)


@query
def refseq_citations(t: Lens) -> DataFrame:
    return annotations.refseq_citations(t.gene2pubmed(), t.gene2refseq())


@query
def cited_genes(t: Lens) -> DataFrame:
    return annotations.cited_genes(t.gene_info(), t.gene2pubmed())


@query
def gene_annotations(t: Lens) -> DataFrame:
    return _annotations(t)


@query
def exon_array(t: Lens) -> DataFrame:
    rows = t.refgene()
    exons = F.posexplode(int_list(F.col("exon_starts"))).alias("exon", "exon_start")
    return rows.select("name", trim_commas(F.col("exon_ends")).alias("exon_ends"), exons)


@query
def exon_union(t: Lens) -> DataFrame:
    return annotations.exon_unions(t.exons())


@query
def annotation_exon_unions(t: Lens) -> DataFrame:
    return annotations.exon_unions(annotations.exon_intervals(_annotations(t)))


@query
def transcript_bounds(t: Lens) -> DataFrame:
    return annotations.transcript_bounds(annotations.exon_unions(t.exons()))


# Graph, diseases, text and days


@query
def pagerank3(t: Lens) -> DataFrame:
    return rounded(graph.pagerank(t.interactions(), 3), "rank")


@query
def link_lists(t: Lens) -> DataFrame:
    lists = graph.adjacency(t.interactions(), size=8)
    return lists.select("src", "block", F.array_join("targets", ",").alias("targets"))


@query
def gene_disease_top(t: Lens) -> DataFrame:
    return disease.top_association(t.gene_diseases())


@query
def gene_disease_genes(t: Lens) -> DataFrame:
    return disease.associated_genes(t.gene_diseases())


@query
def disease_by_month(t: Lens) -> DataFrame:
    size = t.rows("lineitem")
    months = disease.gene_by_month(t.gene2pubmed(), t.pmid_dates_multi(), size)
    found = disease.disease_by_month(months, t.gene_diseases(), size)
    return found.withColumn("month", F.date_format("month", "yyyy-MM"))


@query
def column_frequency(t: Lens) -> DataFrame:
    return columns.count_by_column(t.lines(), 3)


@query
def daily_ids(t: Lens) -> DataFrame:
    responses = t.responses()
    bounds = responses.agg(F.min("pub_date").alias("first"), F.max("pub_date").alias("last")).first()
    days = date_spine(t.spark, bounds["first"], bounds["last"]).select(F.col("pub_date").cast("string"))
    return daily.pub_dates_from_responses(responses, days)


@query
def dates_union(t: Lens) -> DataFrame:
    return daily.union_dates(t.pmid_dates(), t.pmid_dates_multi())


# Layers


def _layers(t: Lens) -> DataFrame:
    return streams.type_layers(_by_year(t))


def _stacked(t: Lens, how: str) -> DataFrame:
    return rounded(streams.stacked_layers(_layers(t), how), "lower", "upper")


def _alternating(t: Lens, how: str) -> DataFrame:
    return rounded(streams.alternating_layers(_layers(t), how), "lower", "upper")


@query
def type_year_dense(t: Lens) -> DataFrame:
    return _layers(t)


@query
def non_type_by_year(t: Lens) -> DataFrame:
    return citations.type_by_year(for_type(_by_year(t), "STANDARD", negate=True))


@query
def top_symbol_layers(t: Lens) -> DataFrame:
    return streams.symbol_layers(pivots.top_by_year(_by_year(t), 20))


@query
def series_onset(t: Lens) -> DataFrame:
    return layers.onset_order(streams.symbol_layers(pivots.top_by_year(_by_year(t), 20)))


@query
def layers_symmetric(t: Lens) -> DataFrame:
    return _stacked(t, "symmetric")


@query
def layers_zero(t: Lens) -> DataFrame:
    return _stacked(t, "zero")


@query
def layers_wiggle(t: Lens) -> DataFrame:
    return _stacked(t, "wiggle")


@query
def layers_alternating(t: Lens) -> DataFrame:
    return _alternating(t, "zero")


@query
def layers_alt_symmetric(t: Lens) -> DataFrame:
    return _alternating(t, "symmetric")


@query
def layers_alt_positive(t: Lens) -> DataFrame:
    return _alternating(t, "positive")


@query
def layers_alt_wiggle(t: Lens) -> DataFrame:
    return _alternating(t, "wiggle")

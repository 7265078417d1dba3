"""Readers of the gene, genome, date and list files."""

from citetide.sources.dates import (
    date_spine,
    extract_ids,
    parse_dates,
    read_daily_dates,
    read_pub_dates,
    write_daily_dates,
)
from citetide.sources.tables import (
    read_annotations,
    read_by_year,
    read_chrom_info,
    read_gene2pubmed,
    read_gene2refseq,
    read_gene_disease,
    read_gene_info,
    read_interactions,
    read_refgene,
)
from citetide.sources.text import nth_column, read_columns, read_id_list

__all__ = [
    "date_spine",
    "extract_ids",
    "nth_column",
    "parse_dates",
    "read_annotations",
    "read_by_year",
    "read_chrom_info",
    "read_columns",
    "read_daily_dates",
    "read_gene2pubmed",
    "read_gene2refseq",
    "read_gene_disease",
    "read_gene_info",
    "read_id_list",
    "read_interactions",
    "read_pub_dates",
    "read_refgene",
    "write_daily_dates",
]

"""Layouts of the text files.

A trailing or inner column whose name starts with ``_`` is never read: readers select the named columns,
so the CSV parser skips the others and files with more or fewer trailing columns still parse.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _layout(*columns: tuple[str, T.DataType] | None) -> T.StructType:
    return T.StructType(
        [
            T.StructField(f"_skipped{position}", T.StringType())
            if column is None
            else T.StructField(column[0], column[1])
            for position, column in enumerate(columns)
        ]
    )


INT, LONG, STRING, DATE = T.IntegerType(), T.LongType(), T.StringType(), T.DateType()

GENE2PUBMED = _layout(("tax_id", INT), ("gene_id", LONG), ("pmid", LONG), None)

GENE_INFO = _layout(
    ("tax_id", INT),
    ("gene_id", LONG),
    ("symbol", STRING),
    *[None] * 5,
    ("description", STRING),
    ("type_of_gene", STRING),
    None,
    ("full_name", STRING),
    *[None] * 4,
)

GENE2REFSEQ = _layout(("tax_id", INT), ("gene_id", LONG), None, ("accession", STRING), *[None] * 12)

REFGENE = _layout(
    None,
    ("name", STRING),
    ("chrom", STRING),
    ("strand", STRING),
    ("tx_start", LONG),
    ("tx_end", LONG),
    ("cds_start", LONG),
    ("cds_end", LONG),
    ("exon_count", INT),
    ("exon_starts", STRING),
    ("exon_ends", STRING),
    None,
    ("gene_name", STRING),
    *[None] * 3,
)

CHROM_INFO = _layout(("chrom", STRING), ("length", LONG), None)

INTERACTIONS = _layout(None, ("src", STRING), *[None] * 4, ("dst", STRING), *[None] * 11)

ANNOTATIONS = T.StructType(
    [
        T.StructField("chrom", STRING),
        T.StructField("tx_start", LONG),
        T.StructField("tx_end", LONG),
        T.StructField("symbol", STRING),
        T.StructField("citations", LONG),
        T.StructField("strand", STRING),
        T.StructField("refseq_id", STRING),
        T.StructField("gene_id", LONG),
        T.StructField("type_of_gene", STRING),
        T.StructField("full_name", STRING),
        T.StructField("cds_start", LONG),
        T.StructField("cds_end", LONG),
        T.StructField("exon_starts", STRING),
        T.StructField("exon_ends", STRING),
    ]
)

BY_YEAR = T.StructType(
    [
        T.StructField("tax_id", INT),
        T.StructField("gene_id", LONG),
        T.StructField("year", INT),
        T.StructField("symbol", STRING),
        T.StructField("description", STRING),
        T.StructField("type_of_gene", STRING),
        T.StructField("citations", LONG),
    ]
)


def named(schema: T.StructType) -> list[str]:
    """The columns of a layout that are read."""
    return [name for name in schema.names if not name.startswith("_")]

"""Scalar expressions on identifiers, dates and positions; all stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks a missing value in the source files.
MISSING = "-"


def strip_version(accession: Column) -> Column:
    """``NM_000020.3`` -> ``NM_000020``."""
    return F.split_part(accession, F.lit("."), F.lit(1))


def pub_year(date: Column) -> Column:
    """Year of a date column, or of a ``YYYY``, ``YYYY/MM/DD`` or ``YYYY-MM-DD`` string."""
    return F.split(date.cast("string"), "[-/]")[0].cast("int")


def decade(year: Column) -> Column:
    """First year of the decade: 1997 -> 1990."""
    return (F.floor(year / 10) * 10).cast("int")


def iso_day(date: Column) -> Column:
    """A date or timestamp as ``YYYY-MM-DD``."""
    return F.date_format(date, "yyyy-MM-dd")


def trim_commas(positions: Column) -> Column:
    return F.trim(positions, F.lit(","))


def int_list(positions: Column) -> Column:
    """``"1,2,3,"`` -> ``[1, 2, 3]``."""
    return F.split(trim_commas(positions), ",").cast("array<bigint>")


def gene_length(tx_start: Column, tx_end: Column) -> Column:
    return tx_end - tx_start


def delimited(*columns: Column | str, sep: str = "\t") -> Column:
    """One text line per row; a null becomes an empty field."""
    fields = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("")) for c in fields])


def with_uid(df: DataFrame, keys: list[str] | None = None, name: str = "uid") -> DataFrame:
    """Add a row id: random without ``keys``, else a digest of the key columns that a rerun repeats."""
    if keys is None:
        return df.withColumn(name, F.uuid())
    return df.withColumn(name, F.sha2(delimited(*keys, sep="|"), 256))

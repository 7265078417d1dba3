"""Wide tables: one row per symbol, one column per year or decade.

Each column is one conditional aggregate, so the table needs a single shuffle, combined on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citetide.functions.scalars import decade
from citetide.operators.counting import sum_by, year_range
from citetide.operators.topk import top_per_group


def year_labels(dated: DataFrame) -> list[int]:
    """All years from the first to the last in a table with a ``year``."""
    bounds = year_range(dated).first()  # one row
    return [] if bounds.min_year is None else list(range(bounds.min_year, bounds.max_year + 1))


def _decades(years: Sequence[int]) -> list[int]:
    return sorted({year // 10 * 10 for year in years})


def _wide(df: DataFrame, label: Column, labels: Sequence[int], agg) -> DataFrame:
    cells = [agg(F.when(label == F.lit(one), F.col("citations"))).alias(str(one)) for one in labels]
    return df.groupBy("symbol").agg(*cells)


def pivot_years(by_year: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """Symbol by year. Of several genes that share a symbol in a year, the smallest count is shown."""
    return _wide(by_year, F.col("year"), years or year_labels(by_year), F.min)


def pivot_decades(by_year: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """Symbol by decade (named by its first year), summed over years and genes."""
    return _wide(by_year, decade(F.col("year")), _decades(years or year_labels(by_year)), F.sum)


def top_by_year(by_year: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most cited rows of each year; equal counts in gene order."""
    order = [F.desc("citations"), F.asc("gene_id"), F.asc("tax_id")]
    return top_per_group(by_year, "year", order, n)


def pivot_top(by_year: DataFrame, n: int = 20, years: Sequence[int] | None = None) -> DataFrame:
    """Symbol by decade over the yearly top ``n`` only."""
    return pivot_decades(top_by_year(by_year, n), years or year_labels(by_year))


def symbol_totals(by_year: DataFrame) -> DataFrame:
    return sum_by(by_year, ["symbol"])

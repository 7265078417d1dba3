"""Counts. All combine on the map side, so a hot key reaches a reducer as one row per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citetide.operators.running import global_index


def count_by(df: DataFrame, keys: Sequence[str], name: str = "citations") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def distinct_count_by(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.countDistinct(column).alias(name))


def sum_by(df: DataFrame, keys: Sequence[str], column: str = "citations", name: str = "citations") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(column).alias(name))


def greatest_by(df: DataFrame, keys: Sequence[str], column: str = "citations") -> DataFrame:
    """One row per key, keeping the greater value."""
    return df.groupBy(*keys).agg(F.max(column).alias(column))


def first_by(df: DataFrame, keys: Sequence[str], columns: Sequence[str], copies: str | None = None) -> DataFrame:
    """One row per key: the smallest combination of ``columns``, nulls last, optionally with the number of rows."""
    ordered = [part for c in columns for part in (F.col(c).isNull().alias(f"_no_{c}"), F.col(c))]
    found = [F.min(F.struct(*ordered)).alias("_first")]
    if copies:
        found.append(F.count("*").alias(copies))
    kept = df.groupBy(*keys).agg(*found)
    return kept.select(*keys, *(f"_first.{c}" for c in columns), *([copies] if copies else []))


def roll_up(by_year: DataFrame, drop: Sequence[str] = ("year",)) -> DataFrame:
    """Sum yearly counts to all time."""
    keys = [c for c in by_year.columns if c not in (*drop, "citations")]
    return sum_by(by_year, keys)


def frequency(df: DataFrame, value: Column, value_name: str = "value", name: str = "occurrences") -> DataFrame:
    """Occurrences of each value, rarest first."""
    counted = df.select(value.alias(value_name)).groupBy(value_name).agg(F.count("*").alias(name))
    return counted.orderBy(name, value_name)


def row_count(df: DataFrame, name: str = "row_count") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def year_range(df: DataFrame, column: str = "year") -> DataFrame:
    """One row: ``min_year``, ``max_year``."""
    return df.agg(F.min(column).alias("min_year"), F.max(column).alias("max_year"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def index_categories(df: DataFrame, column: str, name: str = "category_index") -> DataFrame:
    """Each distinct value with its number from 0 in value order."""
    return global_index(distinct_values(df, column), [F.col(column)], name)

"""Frequencies of the values in a column of plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from citetide.operators.counting import frequency
from citetide.sources.text import nth_column


def count_by_column(lines: DataFrame, n: int, line: str = "value") -> DataFrame:
    """``value, occurrences`` of the ``n``-th blank-separated field (from 1), rarest first."""
    return frequency(lines, nth_column(n, line))

"""Publication dates from daily search responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetide.sources.dates import extract_ids


def pub_dates_from_responses(responses: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """``pub_date, pmid``: every id in each day's response text, optionally for the given days only.

    ``responses`` has ``pub_date`` and ``text``. ``days`` is one row per day (``date_spine``).
    """
    rows = responses.select("pub_date", "text")
    if days is not None:
        rows = rows.join(days.select("pub_date").distinct(), "pub_date", "left_semi")
    return extract_ids(rows)


def union_dates(*tables: DataFrame) -> DataFrame:
    """Date tables appended to each other: ``pmid, year``."""
    parts = [table.select("pmid", F.col("year")) for table in tables]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole

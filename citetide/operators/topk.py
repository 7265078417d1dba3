"""Top-k overall and per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: First-round groups for a ``k`` that Spark's own pre-limit does not cover.
SPLITS = 256


def top_per_group(
    df: DataFrame, group: str | Sequence[str], order: Sequence[Column], k: int, position: str = "pos"
) -> DataFrame:
    """The first ``k`` rows of each group, numbered from 0.

    Spark limits each group to ``k`` rows per task before the shuffle as long as ``k`` is within
    ``spark.sql.optimizer.windowGroupLimitThreshold``. Beyond it, a first ranking on parts of each group
    does that, so a group is never sent whole to one task.
    """
    group = [group] if isinstance(group, str) else list(group)
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit:
        parts = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(SPLITS)))
        df = _ranked(parts, [*group, "_part"], order, k).drop("_part", "_rank")
    ranked = _ranked(df, group, order, k)
    return ranked.withColumn(position, (F.col("_rank") - 1).cast("int")).drop("_rank")


def _ranked(df: DataFrame, group: list[str], order: Sequence[Column], k: int) -> DataFrame:
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= k)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows overall: each task keeps ``k``, then one merge."""
    return df.orderBy(*order).limit(k)

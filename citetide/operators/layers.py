"""Layer geometry of stacked time series (stream graphs).

A layer table has one row per ``series`` and ``x``; ``position`` numbers the series from 0 in stacking
order. ``x`` is an integer axis such as a year. The formulas follow Byron and Wattenberg, "Stacked
Graphs - Geometry & Aesthetics" (2008).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citetide.operators.running import exact_sum, global_index, position_chunk, running
from citetide.session import pin


def densify(df: DataFrame, series: str, x: str, value: str) -> DataFrame:
    """``series, x, value`` with every series at every step from the first to the last ``x``; 0 if absent.

    The sums are written once and then filled up by adding zero rows, which needs no join.
    """
    rows = df.select(F.col(series).alias("series"), F.col(x).alias("x"), F.col(value).alias("value"))
    sums = pin(rows.groupBy("series", "x").agg(F.sum("value").alias("value")))
    bounds = sums.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()  # one row
    if bounds.lo is None:
        return sums
    steps = F.explode(F.sequence(F.lit(bounds.lo), F.lit(bounds.hi))).alias("x")
    spine = sums.select("series").distinct().select("series", steps)
    zeros = spine.withColumn("value", F.lit(0).cast(sums.schema["value"].dataType))
    return sums.unionByName(zeros).groupBy("series", "x").agg(F.sum("value").alias("value"))


def onset_order(layers: DataFrame, small: bool = False) -> DataFrame:
    """``series, onset, position``: by the first ``x`` with a value above 0; series without one come last."""
    onset = layers.groupBy("series").agg(F.min(F.when(F.col("value") > 0, F.col("x"))).alias("onset"))
    return global_index(onset, [F.asc_nulls_last("onset"), F.asc("series")], small=small)


def order_series(layers: DataFrame, small: bool = False) -> DataFrame:
    """Add ``position`` in onset order to a layer table. The result is a written table, as the baseline and the
    stacking both read it."""
    order = onset_order(layers, small)
    return pin(layers.drop("position").join(order.select("series", "position"), "series"))


def _below(layers: DataFrame, value: str, out: str, by: Sequence[str] = ("x",)) -> DataFrame:
    """Running sum of the series before each, at one ``x``."""
    return running(layers, list(by), ["position"], value, out, position_chunk("position"))


def _step(layers: DataFrame, value: str, first: Column) -> Column:
    """Change of ``value`` since the previous ``x`` of the series; ``first`` at the start."""
    along = Window.partitionBy("position").orderBy("x")
    return F.coalesce(F.col(value) - F.lag(value).over(along), first)


def _accumulate(steps: DataFrame, out: str) -> DataFrame:
    """Running sum of ``step`` along ``x``, one row per ``x``."""
    return running(steps, [], ["x"], "step", out, position_chunk("x"), inclusive=True).select("x", out)


def baseline(layers: DataFrame, how: str = "wiggle") -> DataFrame:
    """``x, baseline``: ``symmetric``, ``zero`` or ``wiggle`` (weighted, 0 where an ``x`` sums to 0)."""
    if how == "symmetric":
        return layers.groupBy("x").agg((exact_sum("value") * -0.5).alias("baseline"))
    if how == "zero":
        return layers.select("x").distinct().withColumn("baseline", F.lit(0.0))
    if how != "wiggle":
        raise ValueError(f"unknown baseline {how!r}")
    rows = layers.select("position", "x", F.col("value").cast("double").alias("value"))
    rows = rows.withColumn("change", _step(rows, "value", F.col("value")))
    rows = _below(rows, "change", "change_below")
    moved = exact_sum((F.col("change") * 0.5 + F.col("change_below")) * F.col("value"))
    step = F.coalesce(-F.try_divide(moved, exact_sum("value")), F.lit(0.0))
    return _accumulate(rows.groupBy("x").agg(step.alias("step")), "baseline")


def stack(layers: DataFrame, baseline: DataFrame, yoffset: float = 0.0) -> DataFrame:
    """``series, position, x, lower, upper``: layers on top of each other from the baseline up."""
    rows = layers.select("series", "position", "x", F.col("value").cast("double").alias("value"))
    placed = _below(rows, "value", "below").join(baseline, "x")
    lower = F.col("baseline") + yoffset + F.col("below")
    return placed.select("series", "position", "x", lower.alias("lower"), (lower + F.col("value")).alias("upper"))


def alternate_bounds(layers: DataFrame) -> DataFrame:
    """Even positions stacked upwards from 0, odd positions downwards; adds ``lower`` and ``upper``."""
    rows = layers.select("series", "position", "x", F.col("value").cast("double").alias("value"))
    rows = rows.withColumn("odd", F.col("position") % 2)
    placed = _below(rows, "value", "nearer", by=["x", "odd"])
    farther = F.col("nearer") + F.col("value")
    odd = F.col("odd") == 1
    return placed.select(
        "series",
        "position",
        "x",
        "value",
        F.when(odd, -farther).otherwise(F.col("nearer")).alias("lower"),
        F.when(odd, -F.col("nearer")).otherwise(farther).alias("upper"),
    )


def alternate_baseline(bounds: DataFrame, how: str = "wiggle") -> DataFrame:
    """``x, baseline`` for alternating bounds: ``symmetric``, ``positive``, ``zero`` or ``wiggle``.

    The wiggle form weights signed values (minus for odd positions), starts at 0 and takes no step where
    the layers have no height.
    """
    least, most = F.min("lower"), F.max("upper")
    if how in ("symmetric", "positive"):
        level = (least + most) * 0.5 if how == "symmetric" else least
        return bounds.groupBy("x").agg(level.alias("baseline"))
    if how == "zero":
        return bounds.select("x").distinct().withColumn("baseline", F.lit(0.0))
    if how != "wiggle":
        raise ValueError(f"unknown baseline {how!r}")
    sign = F.when(F.col("position") % 2 == 1, -1.0).otherwise(1.0)
    rows = bounds.withColumn("signed", F.abs("value") * sign)
    rows = rows.withColumn("change", _step(rows, "signed", F.lit(0.0)))
    rows = _below(rows, "change", "change_below")
    moved = exact_sum((F.col("change") * 0.5 + F.col("change_below")) * F.col("signed"))
    step = F.coalesce(-F.try_divide(moved, most - least), F.lit(0.0))
    return _accumulate(rows.groupBy("x").agg(step.alias("step")), "baseline")


def layer_outlines(bounds: DataFrame, baseline: DataFrame) -> DataFrame:
    """``series, position, x, lower, upper`` measured from the baseline."""
    lower, upper = F.col("lower") - F.col("baseline"), F.col("upper") - F.col("baseline")
    return bounds.join(baseline, "x").select(
        "series", "position", "x", lower.alias("lower"), upper.alias("upper")
    )

"""Stream graph layers of citation counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetide.operators.layers import (
    alternate_baseline,
    alternate_bounds,
    baseline,
    densify,
    layer_outlines,
    order_series,
    stack,
)
from citetide.plans.citations import type_by_year


def type_layers(by_year: DataFrame) -> DataFrame:
    """Citations per gene type and year, zero-filled: ``series, x, value``."""
    return densify(type_by_year(by_year), "type_of_gene", "year", "citations")


def symbol_layers(top: DataFrame) -> DataFrame:
    """Layers of the symbols in ``pivots.top_by_year``: ``series, x, value``. Of several genes that share a symbol in
    a year, the smallest count is shown, as in ``pivots.pivot_years``."""
    shown = top.groupBy("symbol", "year").agg(F.min("citations").alias("citations"))
    return densify(shown, "symbol", "year", "citations")


def stacked_layers(layers: DataFrame, how: str = "wiggle", yoffset: float = 0.0) -> DataFrame:
    """Layers in onset order, stacked upwards from the baseline ``how``."""
    ordered = order_series(layers)
    return stack(ordered, baseline(ordered, how), yoffset)


def alternating_layers(layers: DataFrame, how: str = "wiggle") -> DataFrame:
    """Layers in onset order, stacked by turns above and below, measured from the baseline ``how``."""
    bounds = alternate_bounds(order_series(layers))
    return layer_outlines(bounds, alternate_baseline(bounds, how))

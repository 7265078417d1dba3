"""Unions of overlapping intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Start positions per chunk, as a power of two. Genome positions fit in 32 bits, so a group has at most
#: 65,536 chunks, and after keeping the longest interval per start a chunk has at most 65,536 rows.
CHUNK_BITS = 16


def union_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Merge overlapping or touching intervals of each group: one row per union with its bounds.

    Equal starts are first reduced to the farthest end, which collapses copies on the map side. Intervals are then
    merged within chunks of start positions, and the merged ones dealt out once more by chunk: from there on one
    branch sums each chunk up (how far it reaches, where its first and last merged intervals open), the other carries
    the intervals, and both read the same shuffle. Over the chunks (a far smaller table) two running maxima tell how
    far the earlier ones reach and where their last union opened. Only chunks that open within that reach are linked,
    so chunks that stand alone, and groups of one chunk, pass without a partner. No task holds a whole group. Rows
    with a null key or bound are no intervals and are dropped.
    """
    keys = list(keys)
    chunk = [*keys, "_chunk"]
    # said for each column, as the join infers it for one branch and both must stay alike to share the shuffle
    present = df.select(*keys, start, end)
    for column in (*keys, start, end):
        present = present.filter(F.col(column).isNotNull())
    longest = present.groupBy(*keys, start).agg(F.max(end).alias(end))
    longest = longest.withColumn("_chunk", F.shiftright(start, CHUNK_BITS)).filter(F.col("_chunk").isNotNull())

    along = Window.partitionBy(*chunk).orderBy(start)
    before = F.max(end).over(along.rowsBetween(Window.unboundedPreceding, -1))
    marked = longest.withColumn("_before", before)
    opening = F.when(F.col("_before").isNull() | (F.col(start) > F.col("_before")), F.col(start))
    opened = F.max(opening).over(along.rowsBetween(Window.unboundedPreceding, 0))
    merged = marked.withColumn("_open", opened).groupBy(*chunk, "_open").agg(F.max(end).alias(end))
    # dealt out in another order of columns than the windows, or the planner would leave this shuffle out
    merged = merged.repartition("_chunk", *keys)

    chunks = merged.groupBy(*chunk).agg(F.max(end).alias("_end"), F.min("_open").alias("_first"), F.max("_open").alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_reach", F.max("_end").over(earlier))
    # merged intervals of a chunk are apart, so the last one opens a union if any of them does
    own = F.when(F.col("_reach").isNull() | (F.col("_last") > F.col("_reach")), F.col("_last"))
    chunks = chunks.withColumn("_own", own).withColumn("_carried", F.max("_own").over(earlier))
    linked = chunks.filter(F.col("_first") <= F.col("_reach")).select(*chunk, "_reach", "_carried")

    joined = merged.join(linked, chunk, "left")
    union = F.when(F.col("_open") <= F.col("_reach"), F.col("_carried")).otherwise(F.col("_open"))
    bounds = joined.withColumn("_union", union).groupBy(*keys, "_union").agg(F.max(end).alias(end))
    return bounds.select(*keys, F.col("_union").alias(start), end)

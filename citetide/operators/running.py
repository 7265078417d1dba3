"""Running totals and global numbering that never gather a whole group in one task.

A running total needs everything before a row, but not in the same task: the group is cut into ordered
chunks, the chunk totals (few) are summed up in order, and each row adds its own chunk's carry. Tables of all
sizes take the same way.

Doubles are added up as decimals: sums of decimals do not depend on the order of the rows, so the last bits of a
result do not depend on how the table is laid out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType

from citetide.session import pin

#: Width of the chunks over a dense integer order.
CHUNK = 4096
#: The decimals that stand in for doubles in a sum: magnitudes below 10^23, to 15 places.
EXACT = DecimalType(38, 15)


def addable(column: Column, kind: DataType) -> Column:
    """``column`` in a type whose sums are the same in any order."""
    return column.cast(EXACT) if isinstance(kind, (DoubleType, FloatType)) else column


def exact_sum(column: Column | str) -> Column:
    """Sum of doubles, the same whatever the order of the rows."""
    column = F.col(column) if isinstance(column, str) else column
    return F.sum(column.cast(EXACT)).cast("double")


def _frame(window, inclusive: bool):
    return window.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column | str],
    value: str,
    out: str,
    chunk: Column | None,
    inclusive: bool = False,
) -> DataFrame:
    """Add ``out``, the running sum of ``value`` in ``order`` within ``by``; 0 before the first row.

    ``chunk`` must not decrease along ``order``; None means one window per group, for groups known to be short.
    Null keys are a group.
    """
    kind = df.schema[value].dataType
    term = addable(F.col(value), kind)
    zero = addable(F.lit(0).cast(kind), kind)

    def so_far(column: Column, window) -> Column:
        return F.coalesce(F.sum(column).over(window), zero)

    if chunk is None:
        window = _frame(Window.partitionBy(*by).orderBy(*order), inclusive)
        return df.withColumn(out, so_far(term, window).cast(kind))
    rows = df.withColumn("_chunk", chunk)
    totals = rows.groupBy(*by, "_chunk").agg(F.sum(term).alias("_total"))
    earlier = _frame(Window.partitionBy(*by).orderBy("_chunk"), False)
    names = [f"_by_{i}" for i in range(len(by))]
    carries = totals.select(
        *(F.col(c).alias(n) for c, n in zip(by, names)), F.col("_chunk").alias("_of"), so_far(F.col("_total"), earlier).alias("_carry")
    )
    within = _frame(Window.partitionBy(*by, "_chunk").orderBy(*order), inclusive)
    # a chunk is one of an ordered range, so the join keys are never hotter than a chunk is wide
    same = F.col("_chunk") == F.col("_of")
    for c, n in zip(by, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    joined = rows.join(carries, same)
    return joined.withColumn(out, (F.col("_carry") + so_far(term, within)).cast(kind)).select(*df.columns, out)


def range_chunks(df: DataFrame, order: Sequence[Column], name: str = "_range") -> DataFrame:
    """Range-partition by ``order`` and record each row's partition number.

    The rows are pinned: range bounds come from a sample, so the number must be read, not recomputed.
    Every shuffle partition is one chunk, which bounds the number of chunks.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pin(df.repartitionByRange(partitions, *order).withColumn(name, F.spark_partition_id()))


def global_running(
    df: DataFrame, order: Sequence[Column], value: str, out: str, small: bool = False
) -> DataFrame:
    """Exclusive running sum of ``value`` over the whole table. ``order`` must identify the rows.

    ``small`` says that the table is known to fit in one task; the result is the same.
    """
    if small:
        return running(df, [], order, value, out, None)
    chunked = range_chunks(df, order)
    return running(chunked, [], order, value, out, F.col("_range")).drop("_range")


def global_index(df: DataFrame, order: Sequence[Column], out: str = "position", small: bool = False) -> DataFrame:
    """Number all rows from 0 in ``order``, which must identify the rows."""
    counted = global_running(df.withColumn("_one", F.lit(1).cast("bigint")), order, "_one", out, small)
    return counted.drop("_one")


def position_chunk(column: str) -> Column:
    """Chunks of at most ``CHUNK`` positions."""
    return F.floor(F.col(column) / CHUNK)

"""Values gathered into lists per key, in blocks of bounded length.

One list per key would grow with the key. Here a key has as many blocks as it needs, numbered from 0 and filled in
order, so a key that holds a third of all rows is split by construction and no task or row ever holds it whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citetide.operators.running import range_chunks, running
from citetide.session import pin, unpin

#: Values of a block.
BLOCK = 1024


def blocked_lists(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    order: Sequence[Column] | None = None,
    size: int = BLOCK,
    name: str = "items",
) -> DataFrame:
    """``*keys, block, <name>``: the distinct ``values`` of each key in ``order`` (by value unless given), at most
    ``size`` in a block. Of one value column the lists hold the values, of several structs; nulls are values.

    ``order`` must tell different values apart, so that the blocks do not depend on the layout. The rows are sorted by
    ranges of key and value and numbered within them; a range adds what its key has in earlier ones. The result is
    a written table.
    """
    if size < 1:
        raise ValueError("a block holds at least one value")
    keys, values = list(keys), list(values)
    order = [F.asc(c) for c in values] if order is None else list(order)
    rows = df.select(*keys, *values).distinct().withColumn("_one", F.lit(1).cast("bigint"))
    dealt = range_chunks(rows, [*(F.asc(k) for k in keys), *order])
    numbered = running(dealt, keys, order, "_one", "_at", F.col("_range"))
    value = F.col(values[0]) if len(values) == 1 else F.struct(*values)
    blocks = numbered.groupBy(*keys, F.floor(F.col("_at") / size).cast("bigint").alias("block"))
    held = F.array_sort(F.collect_list(F.struct(F.col("_at"), value.alias("_value"))))
    found = pin(blocks.agg(held.alias("_held")).select(*keys, "block", F.col("_held._value").alias(name)))
    unpin(dealt)
    return found


def unblocked(blocks: DataFrame, name: str = "items") -> DataFrame:
    """The rows of :func:`blocked_lists`, one per value, in the column ``name``."""
    others = [c for c in blocks.columns if c not in ("block", name)]
    return blocks.select(*others, F.explode(name).alias(name))

"""Equi-joins that stay balanced when a few keys hold a large share of the rows.

``skew_join`` looks at the data before it plans:

1. If the optimizer's size estimate is within the broadcast threshold for a side, that side is broadcast:
   the large side is not shuffled, so its key distribution does not matter.
2. Otherwise a frequent-items sketch finds the keys above ``SHARE`` of the left rows. With none, the
   join is again left to Spark and can reuse an existing partitioning.
3. Keys are hashed in the type in which the join compares them, on both sides. Rows of the found keys are spread over ``SALTS`` sub-keys by a hash of their other columns, and the
   matching right rows are repeated once per sub-key. All other keys keep a single copy.

The sketch only chooses the layout. The result is the same whichever keys it names, and salts come from
row contents, so a recomputed task sends each row to the same place.

A report that joins on the same source columns several times holds their sketches in one :class:`KeyStatistics`,
which reads all columns in one job. A side that holds each key once needs no sketch: adaptive execution splits the
rows of the other side, and nothing has to be repeated.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

#: A key above this share of the rows is spread.
SHARE = 1 / 4000
#: Sub-keys per spread key.
SALTS = 256
#: Keys a sketch keeps, which sets the smallest share it can tell, and the most it reports: no more keys can
#: be above ``SHARE``, and the driver never sees more numbers.
TRACKED, REPORTED = 16384, 4000
#: Sketches are merged in these numbers of groups before the last merge, so that no task merges more than 64.
MERGE_GROUPS = (2048, 32)
#: Rows of a task where a shuffle is dealt by a known number of rows.
TASK_ROWS = 1 << 18


def deal(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` into a task for each ``TASK_ROWS`` of ``rows``, so that more rows make more tasks and
    not larger ones: merged by their bytes, partitions of narrow rows hold millions. Where a core's share is smaller
    anyhow, or ``rows`` is not known, adaptive execution deals it."""
    if rows is None or rows <= TASK_ROWS * df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(-(-rows // TASK_ROWS), *keys)


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate, or None where the session does not expose it."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return None


def is_small(df: DataFrame) -> bool:
    """Whether the estimate is within the session's broadcast threshold."""
    size = estimated_bytes(df)
    if size is None:
        return False
    return size <= df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def comparable(left: DataFrame, right: DataFrame, on: Sequence[str]) -> list[Column] | None:
    """The key columns in the types in which a join of the two sides compares them, or None if a key is a string
    with a collation: equal strings may then have different hashes."""
    keys = []
    for name in on:
        types = [side.schema[name].dataType for side in (left, right)]
        if any(isinstance(t, StringType) and not t.isUTF8BinaryCollation() for t in types):
            return None
        key = F.col(name)
        if types[0] != types[1]:
            common = F.coalesce(*(F.lit(None).cast(t) for t in types)).alias("key")
            key = key.cast(left.sparkSession.range(1).select(common).schema["key"].dataType)
        keys.append(key)
    return keys


def hot_keys(df: DataFrame, on: Sequence[str | Column]) -> list[int]:
    """Hashes of the keys that hold more than ``SHARE`` of the rows (at most ``REPORTED`` numbers)."""
    return _sketched({"": (df, on)})[""]


def _sketched(sources: dict[str, tuple[DataFrame, Sequence[str | Column]]]) -> dict[str, list[int]]:
    """:func:`hot_keys` of several tables in one job.

    Sketches are grouped by source in every step, as Spark cannot merge the sketch of a partition without rows.
    """
    first, second = MERGE_GROUPS
    part = F.pmod(F.spark_partition_id(), F.lit(first)).alias("part")
    rows = None
    for i, (df, on) in enumerate(sources.values()):
        keys = df.select(F.lit(i).alias("source"), part, F.xxhash64(*on).alias("key"))
        rows = keys if rows is None else rows.unionByName(keys)
    counted = [F.expr(f"approx_top_k_accumulate(key, {TRACKED})").alias("sketch"), F.count("*").alias("n")]
    merged = [F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch"), F.sum("n").alias("n")]
    found = rows.groupBy("source", "part").agg(*counted)
    found = found.groupBy("source", F.pmod("part", F.lit(second)).alias("part")).agg(*merged)
    found = found.groupBy("source").agg(*merged).select("source", "n", F.expr(f"approx_top_k_estimate(sketch, {REPORTED})").alias("top"))
    hot = {r.source: [item["item"] for item in r.top if item["count"] > SHARE * r.n] for r in found.collect()}
    return {name: hot.get(i, []) for i, name in enumerate(sources)}


class KeyStatistics:
    """Hot keys of named source columns, found in one job when a join first asks and shared by all joins."""

    def __init__(self, sources: dict[str, tuple[DataFrame, Sequence[str | Column]]]):
        self.sources = sources
        self._hot: dict[str, list[int]] | None = None
        self._cast: dict[tuple, list[int]] = {}

    def __getitem__(self, name: str) -> "KeySource":
        if name not in self.sources:
            raise KeyError(name)
        return KeySource(self, name)

    def hot(self, name: str, types: Sequence[DataType]) -> list[int]:
        """Hot keys of a source, hashed in ``types``; a column that must be cast is sketched apart, once for each type."""
        df, on = self.sources[name]
        own = [field.dataType for field in df.select(*on).schema]
        if list(types) == own:
            if self._hot is None:
                self._hot = _sketched(self.sources)
            return self._hot[name]
        key = (name, *(t.simpleString() for t in types))
        if key not in self._cast:
            columns = [F.col(c) if isinstance(c, str) else c for c in on]
            self._cast[key] = hot_keys(df, [c.cast(t) for c, t in zip(columns, types)])
        return self._cast[key]


@dataclass(frozen=True)
class KeySource:
    """A source column of :class:`KeyStatistics`, to be given to a join as its probe."""

    statistics: KeyStatistics
    name: str


def _probe(source: DataFrame | KeySource, side: DataFrame, compared: Sequence[Column]) -> list[int]:
    if isinstance(source, KeySource):
        return source.statistics.hot(source.name, [field.dataType for field in side.select(*compared).schema])
    return hot_keys(source, compared)


def is_hot(on: Sequence[str | Column], hot: list[int]) -> Column:
    return F.xxhash64(*on).isin(hot) if hot else F.lit(False)


def spread(df: DataFrame, on: Sequence[str | Column], hot: list[int], name: str, by: Sequence[str] | None = None) -> DataFrame:
    """Add sub-key ``name``: a hash of ``by`` (all columns by default) for hot keys, 0 for the others."""
    by = list(by or df.columns)
    salt = F.when(is_hot(on, hot), F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(F.lit(0))
    return df.withColumn(name, salt.cast("int"))


def replicate(df: DataFrame, on: Sequence[str | Column], hot: list[int], name: str) -> DataFrame:
    """Repeat the rows of hot keys once per sub-key; others get sub-key 0 only."""
    salts = F.when(is_hot(on, hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return df.withColumn(name, F.explode(salts))


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    by: Sequence[str] | None = None,
    both: bool = False,
    hot: list[int] | None = None,
    bound: DataFrame | None = None,
    bound_left: DataFrame | None = None,
    probe: DataFrame | KeySource | None = None,
    probe_right: DataFrame | KeySource | None = None,
    unique: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Join ``left`` to ``right`` on equal columns when keys of ``left`` may be hot.

    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``. Keys may differ in type. Strings with a
    collation are joined without salts. ``by`` names the left columns that
    spread a hot key (all others by default). With ``both`` (inner only) the hot keys of the right side
    are spread too, so a key that is hot on both sides is worked on as a grid of sub-keys.

    A derived side is estimated and sketched through a source table of it: ``bound`` and
    ``bound_left`` have at least the rows of ``right`` and ``left``, ``probe`` and ``probe_right`` hold the key columns
    of the sides or are columns of :class:`KeyStatistics`. ``hot`` passes keys that are already known. ``unique`` says
    that ``right`` holds each key at most once: the join is then left to adaptive execution. ``rows`` is about the number
    of rows of the larger side; a join that is not broadcast is dealt by it (:func:`deal`).
    """
    on = [on] if isinstance(on, str) else list(on)
    if both and how != "inner":
        raise ValueError("both sides can be spread only for an inner join")
    hot_right: list[int] = []
    compared = comparable(left, right, on)
    if compared is None:
        return left.join(right, on, how)
    if unique:
        rows = None if is_small(right) else rows
        return deal(left, rows, *on).join(deal(right, rows, *on), on, how)
    if hot is None:
        # no hint: adaptive execution broadcasts a side whose size at run time is within the threshold
        if is_small(right if bound is None else bound):
            # small by its source may still be too large for Spark to broadcast
            rows = None if bound is None or is_small(right) else rows
            return deal(left, rows, *on).join(deal(right, rows, *on), on, how)
        if how == "inner" and is_small(left if bound_left is None else bound_left):
            return left.join(right, on, how)
        hot = _probe(left if probe is None else probe, left, compared)
        if both:
            hot_right = _probe(right if probe_right is None else probe_right, right, compared)
    keys = list(on)
    if hot:
        left = spread(left, compared, hot, "_salt_left", by)
        right = replicate(right, compared, hot, "_salt_left")
        keys.append("_salt_left")
    if hot_right:
        others = [c for c in right.columns if c not in (*on, "_salt_left")]
        right = spread(right, compared, hot_right, "_salt_right", others)
        left = replicate(left, compared, hot_right, "_salt_right")
        keys.append("_salt_right")
    return deal(left, rows, *keys).join(deal(right, rows, *keys), keys, how).drop("_salt_left", "_salt_right")

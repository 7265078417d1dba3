"""Importance resampling of documents: hashed n-gram models of target and raw text, drawn by Gumbel top-k.

A text's n-grams are single words and pairs of words, and runs of one to three token shapes (small, capitalised,
upper-case, digits, mixed, one sign, or the same word again). They fall into ``BUCKETS`` buckets. The raw model
counts the buckets of all documents, the target model those of documents labelled good; the log weight of a
document is the sum over its n-grams of the log ratio of the two. Keys are log weights plus Gumbel noise that a
hash of the row gives, and the ``k`` largest keys are a sample without replacement in proportion to the weights.

``k`` is the number of documents whose log weight reaches the cut that separates the labelled good documents
from the bad ones best. Ties at the last key are all kept, so repeated rows share their fate. A null or empty text
has weight 0 before noise (log 1: it is as likely under both models) and is treated as any other. Rows without
label count in the raw model only. With no usable label nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citetide.session import pin

from .rows import fresh, with_fields
from .textblocks import U64, SpanHasher, blocks, bound_batches, frugal, mix, row_sums, spans, windows

BUCKETS = 1 << 14
#: At most so many labelled rows, the first by a hash of their id, fit the target model and the cut.
LABELLED = 20_000
SEED = 7
#: Bins of one pass of the search for the last key.
BINS = 2048

_SMALL, _CAPITAL, _UPPER, _DIGITS, _MIXED, _AGAIN = range(256, 262)


def ngrams(data: np.ndarray, offsets: np.ndarray, hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every n-gram of a block."""
    kind = np.zeros(256, np.uint8)  # 0 blank, 1 small or beyond ASCII, 2 capital, 3 digit, 4 sign
    kind[33:127] = 4
    kind[97:123] = kind[128:] = 1
    kind[65:91], kind[48:58] = 2, 3
    of = kind[data]
    starts, ends, rows = spans((of > 0) & (of < 4), offsets)
    low = data.copy()
    capital = of == 2
    low[capital] += 32
    words = hasher.load(low).of(starts, ends)
    capitals = np.concatenate([[0], np.cumsum(capital)])
    digits = np.concatenate([[0], np.cumsum(of == 3)])
    size = ends - starts
    upper, digit = capitals[ends] - capitals[starts], digits[ends] - digits[starts]
    first = capital[starts] if len(starts) else np.zeros(0, bool)
    shape = np.full(len(starts), _MIXED, np.int64)
    shape[(upper == 0) & (digit == 0)] = _SMALL
    shape[(upper == 1) & first & (digit == 0)] = _CAPITAL
    # letters beyond ASCII have no case here, so a word counts as upper-case from two capitals on
    shape[(upper >= 2) & (digit == 0) & (upper * 4 >= size)] = _UPPER
    shape[digit == size] = _DIGITS
    same = np.zeros(len(starts), bool)
    same[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    shape[same] = _AGAIN
    signs = np.flatnonzero(of == 4)
    at = np.concatenate([starts, signs])
    order = np.argsort(at, kind="stable")
    tokens = mix(np.concatenate([shape, data[signs].astype(np.int64)])[order].astype(U64) + U64(1 << 32))
    token_rows = np.concatenate([rows, np.searchsorted(offsets, signs, side="right") - 1])[order]
    found, where = [words, tokens], [rows, token_rows]
    for items, of_rows, n in ((words, rows, 2), (tokens, token_rows, 2), (tokens, token_rows, 3)):
        grams, begin = windows(items, of_rows, n)
        found.append(grams)
        where.append(of_rows[begin])
    return (np.concatenate(found) % U64(BUCKETS)).astype(np.int64), np.concatenate(where)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = SpanHasher(SEED)
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for part, data, offsets in blocks(batch, "text"):
            good = part.column(part.schema.get_field_index("good")).to_numpy(zero_copy_only=False).astype(bool)
            buckets, rows = ngrams(data, offsets, hasher)
            counts[0] += np.bincount(buckets, minlength=BUCKETS)
            counts[1] += np.bincount(buckets[good[rows]], minlength=BUCKETS)
    used = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0][used]), pa.array(counts[1][used])], ["bucket", "raw", "target"])


def labelled(labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """``doc_id`` and ``good`` of at most ``limit`` documents, one row each (bad wins among repeated labels)."""
    return (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy(F.col("doc_id").alias("_id"))
        .agg((F.min("quality") == 1).alias("_good"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(limit)
    )


def fit(documents: DataFrame, sample: DataFrame) -> np.ndarray:
    """Log ratio of target to raw for each bucket, from all documents; ``sample`` is :func:`labelled`."""
    bound_batches(documents.sparkSession)
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"), "left").select(
        "text", F.coalesce("_good", F.lit(False)).alias("good")
    )
    counted = rows.mapInArrow(frugal(_count), "bucket long, raw long, target long")
    table = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    raw[table.bucket] += table.raw
    target[table.bucket] += table.target
    if not table.target.sum():
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigh(documents: DataFrame, ratios: np.ndarray, name: str = "log_weight") -> DataFrame:
    """The documents with their log weight in the further column ``name``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher(SEED)
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                buckets, rows = ngrams(data, offsets, hasher)
                weights = row_sums(ratios[buckets], rows, part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(weights)], [*part.schema.names, name])

    return documents.mapInArrow(frugal(score), with_fields(documents, f"`{name}` double"))


def gumbel(*row: str, seed: int = SEED) -> Column:
    """Standard Gumbel noise from a hash of the row."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *row), 12).cast("double") + 0.5) * 2.0**-52
    return -F.log(-F.log(u))


def cut_of(weights: DataFrame, sample: DataFrame) -> float | None:
    """The log weight that parts good from bad labelled documents with the fewest errors, where losing a good
    document counts four times; the middle of the widest gap among equally good cuts. Rows with one id count once, with
their smallest weight."""
    rows = weights.join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    one_each = rows.groupBy("_id").agg(F.min("log_weight").alias("log_weight"), F.first("_good").alias("_good"))
    known = one_each.toPandas().sort_values("log_weight")
    good = known._good.to_numpy(bool)
    if good.all() or not good.any():
        return None
    values = known.log_weight.to_numpy()
    errors = 4 * np.concatenate([[0], np.cumsum(good)]) + np.concatenate([np.cumsum(~good[::-1])[::-1], [0]])
    errors[1:-1][values[1:] == values[:-1]] = errors.max() + 1
    edges = np.concatenate([[values[0] - 1], values, [values[-1] + 1]])
    best = np.flatnonzero(errors == errors.min())
    widest = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[widest] + edges[widest + 1]) / 2)


def kth_largest(table: DataFrame, column: str, k: int) -> float:
    """The ``k``-th largest value, found by counting bins within ever narrower bounds."""
    low, high = table.agg(F.min(column), F.max(column)).first()
    value = F.col(column)
    while low < high:
        width = (high - low) / BINS
        inside = table.where((value >= low) & (value <= high))
        if width <= abs(low) * 1e-12 or width == 0:
            break
        bins = inside.groupBy(F.least(F.floor((value - low) / width), F.lit(BINS - 1)).alias("bin")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        )
        for row in sorted(bins.collect(), key=lambda r: -r.bin):
            if row.n >= k:
                low, high = row.low, row.high
                break
            k -= row.n
    return low


def resample(weights: DataFrame, sample: DataFrame) -> DataFrame:
    """Add ``sample_key`` and ``kept``; ``weights`` is a pinned table with ``doc_id``, ``log_weight``, ``noise``."""
    keyed = weights.withColumn("sample_key", F.col("log_weight") + F.col("noise"))
    cut = cut_of(weights, sample)
    k = None if cut is None else weights.where(F.col("log_weight") >= cut).count()
    if k is None:
        return keyed.withColumn("kept", F.lit(True))
    if k == 0:
        return keyed.withColumn("kept", F.lit(False))
    return keyed.withColumn("kept", F.col("sample_key") >= kth_largest(keyed, "sample_key", k))


def classify(documents: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """``doc_id``, ``log_weight``, ``sample_key`` and ``kept`` of every document."""
    sample = pin(labelled(labels, limit))
    weighed = weigh(documents.select("doc_id", "text"), fit(documents, sample))
    table = pin(weighed.select("doc_id", "log_weight", gumbel("doc_id", "text").alias("noise")))
    return resample(table, sample).select("doc_id", "log_weight", "sample_key", "kept")


def keep_good(documents: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """The documents that the draw takes, with their columns."""
    sample = pin(labelled(labels, limit))
    weight, noise = fresh(documents, "log_weight"), fresh(documents, "noise")
    weighed = weigh(documents, fit(documents, sample), weight)
    table = pin(weighed.withColumn(noise, gumbel("doc_id", "text")))
    narrow = table.select("doc_id", F.col(weight).alias("log_weight"), F.col(noise).alias("noise"))
    cut = cut_of(narrow, sample)
    if cut is None:
        return table.select(*documents.columns)
    k = narrow.where(F.col("log_weight") >= cut).count()
    if k == 0:
        return table.select(*documents.columns).limit(0)
    last = kth_largest(narrow.select((F.col("log_weight") + F.col("noise")).alias("key")), "key", k)
    return table.where(F.col(weight) + F.col(noise) >= last).select(*documents.columns)

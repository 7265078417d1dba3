"""Bloom filters of fixed size over long keys, to leave out rows before a shuffle.

A filter only spares work: rows that pass it are joined as usual. It takes ``WORDS`` 64-bit words whatever the
number of keys; with very many keys nearly every row passes, and the join alone decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import U64, frugal, mix

WORDS = 1 << 19


def _slots(keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    mixed = mix(keys.astype(U64))
    out = []
    for shift in (0, 32):
        place = (mixed >> U64(shift)) & U64(0xFFFFFFFF)
        out.append(((place >> U64(6)).astype(np.int64) % WORDS, U64(1) << (place & U64(63))))
    return out


def build(keys: DataFrame, column: str) -> np.ndarray:
    """The filter of a column of longs without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(WORDS, U64)
        for batch in batches:
            for word, bit in _slots(batch.column(0).to_numpy()):
                np.bitwise_or.at(table, word, bit)
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(table[used].astype(np.int64))], ["word", "bits"])

    words = keys.select(column).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits"))
    found = words.toPandas()
    table = np.zeros(WORDS, U64)
    table[found.word.to_numpy(np.int64)] = found.bits.to_numpy(np.int64).astype(U64)
    return table


def may_contain(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    hit = np.ones(len(keys), bool)
    for word, bit in _slots(keys):
        hit &= (table[word] & bit) != 0
    return hit


def sift(rows: DataFrame, column: str, table: np.ndarray, inside: bool = True) -> DataFrame:
    """The rows whose key in ``column`` (no nulls) may be in the filter; those that surely are not if not ``inside``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = may_contain(table, batch.column(column).to_numpy())
            yield batch.filter(pa.array(hit == inside))

    return rows.mapInArrow(frugal(run), rows.schema)

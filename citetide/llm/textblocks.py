"""Texts as byte arrays: row blocks of bounded size, word spans and hashes of spans, all in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Text bytes worked on at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19

#: Rows and bytes that Spark sends to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

U64 = np.uint64


def bound_batches(spark: SparkSession) -> None:
    """Let the session send rows to Python in batches of bounded size, unless its own are smaller."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        held = spark.conf.get(key)
        if not held.rstrip("b").isdigit() or not 0 < int(held.rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Return freed memory to the system; a Python worker lives on for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(run: Callable) -> Callable:
    """An Arrow function that gives back its memory when it has ended."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of ``batch`` with the bytes of their texts (null: empty) and the row offsets into them."""
    index = batch.schema.get_field_index(column)
    texts = pc.fill_null(batch.column(index).cast(pa.large_string()), "")
    size = len(texts)
    if not size:
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + size + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < size:
        last = int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1
        last = min(size, max(first + 1, last))
        yield batch.slice(first, last - first), data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1) from hashes."""
    return ((mix(x) >> U64(12)).astype(np.float64) + 0.5) * 2.0**-52


def fold_table() -> np.ndarray:
    """Byte to byte: ASCII capitals to small letters."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def word_table() -> np.ndarray:
    """Bytes of words: ASCII digits and small letters, and every byte of a character beyond ASCII."""
    table = np.zeros(256, bool)
    table[48:58] = table[97:123] = table[128:] = True
    return table


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of true cells that stay within a row."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


class SpanHasher:
    """64-bit hashes of spans from prefix sums of a polynomial over mixed bytes."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, seed: int = 0):
        self.letters = mix(np.arange(1, 257, dtype=U64) + U64(seed * 257))
        self.inverse = pow(self.BASE, -1, 1 << 64)
        self.powers = self.back = np.ones(1, U64)

    def load(self, data: np.ndarray) -> "SpanHasher":
        size = len(data) + 1
        if len(self.powers) < size:
            grown = max(size, BLOCK_BYTES + 1)
            self.powers = np.full(grown, self.BASE, U64)
            self.back = np.full(grown, self.inverse, U64)
            self.powers[0] = self.back[0] = 1
            np.multiply.accumulate(self.powers, out=self.powers)
            np.multiply.accumulate(self.back, out=self.back)
        self.sums = np.zeros(size, U64)
        np.cumsum(self.letters[data] * self.powers[: size - 1], out=self.sums[1:])
        return self

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])


def windows(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive items of one row, and where each window begins."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[:count] == rows[size - 1 :])
    out = np.zeros(len(at), U64)
    for i in range(size):
        out = out * U64(0xD6E8FEB86659FD93) + hashes[at + i]
    return mix(out), at


def row_sums(values: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=count)

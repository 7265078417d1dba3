"""Vector code compression: product codes trained and assigned in exact integers by limb-split matrix products.

A component x becomes the integer floor(4096 x). Vectors are cut into ``PARTS`` equal consecutive parts; every part
position has a codebook of ``ENTRIES`` entries, which starts as that part of the rows with the smallest ``vec_id``.
A round assigns each part to the nearest entry (squared Euclidean distance, ties to the lower index) and replaces
each used entry by its parts' componentwise floor(sum / count).

Exact products: integers are broken into limbs of so few bits that a product of two limbs, summed over a part, stays
below 2^53, where float64 is exact. Limbs are multiplied by BLAS, the products shifted and added in int64, and the
first smallest of ``|entry|^2 - 2 part . entry`` is taken. Vectors whose distances could pass 64 bits (components
beyond about 2^15) are computed in Python's integers instead; an error that passes a long is given as the greatest
long. A round is one job: tasks add up their parts per entry, Spark adds up the tasks, and the driver gets one row
per entry and position.

Rows whose vector is null or holds null or non-finite components are dropped; others are kept as often as they are
repeated. Rows with equal ``vec_id`` start the codebooks in the order of their stored bytes, null ids come last. With fewer than ``ENTRIES``
rows the codebooks are smaller. Vectors of a length that is no multiple of ``PARTS``, or shorter than the longest, are
filled up with zeros. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetide.session import pin

from .rows import with_fields

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows worked on at once.
ROWS = 4096
#: Mantissa bits of a double; distances must stay below this power of two to be held in int64.
EXACT_BITS, SAFE_BITS = 53, 62
LONGEST = (1 << 63) - 1
TOTALS = "part int, entry int, n long, totals array<string>"


def limb_bits(width: int) -> int:
    """Bits of a limb, so that ``width`` products of two limbs add up to less than 2^53."""
    return (EXACT_BITS - max(width, 1).bit_length()) // 2


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Digits of ``values`` (int64) in base ``2^bits`` as doubles, lowest first; the highest carries the sign."""
    out, rest = [], values
    while True:
        if not len(rest) or (rest.max(initial=0) < 1 << bits and rest.min(initial=0) >= -(1 << bits)):
            return [*out, rest.astype(np.float64)]
        out.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits


def exact_products(left: np.ndarray, right: np.ndarray, bits: int | None = None) -> np.ndarray:
    """``left @ right.T`` of int64 arrays, in int64, by float64 products of limbs."""
    bits = limb_bits(left.shape[1]) if bits is None else bits
    total = np.zeros((len(left), len(right)), np.int64)
    others = limbs(right, bits)
    for i, a in enumerate(limbs(left, bits)):
        for j, b in enumerate(others):
            total += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return total


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry of each part; int64, or Python integers if ``parts`` are."""
    if parts.dtype == object or entries.dtype == object:
        parts, entries = parts.astype(object), entries.astype(object)
        products = parts @ entries.T
    else:
        products = exact_products(parts, entries)
    scores = (entries * entries).sum(axis=1)[None, :] - 2 * products
    best = scores.argmin(axis=1)
    return best, scores[np.arange(len(parts)), best] + (parts * parts).sum(axis=1)


def narrow(values: np.ndarray) -> np.ndarray:
    """Python integers as int64, if no squared distance of such values can pass it."""
    most = max((abs(x) for x in values.flat), default=0)
    width = values.shape[-1] if values.ndim else 1
    return values.astype(np.int64) if 2 * int(most).bit_length() + 2 + width.bit_length() <= SAFE_BITS else values


def integers(vector: np.ndarray) -> np.ndarray | None:
    """floor(4096 x) of finite doubles: int64 where it fits, Python integers otherwise; None if any is not finite."""
    if not np.isfinite(vector).all():
        return None
    if not len(vector) or np.abs(vector).max() < 2.0**50:
        return np.floor(vector * SCALE).astype(np.int64)
    # a double this large is an integer already
    return np.array([int(x) * SCALE if abs(x) >= 2.0**50 else int(np.floor(x * SCALE)) for x in vector.tolist()], object)


def _packed(values: np.ndarray) -> str:
    return ",".join(map(str, values.tolist()))


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with finite vectors: components as int64 bytes, or as decimal text if any is too large."""
    for batch in batches:
        column = batch.column("embedding")
        ends, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
        flat = column.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        at, small, large, sizes = [], [], [], []
        for i in np.flatnonzero(valid).tolist():
            found = integers(flat[ends[i] : ends[i + 1]])
            if found is None:
                continue
            fits = found.dtype != object and narrow_enough(found)
            at.append(i)
            small.append(found.tobytes() if fits else None)
            large.append(None if fits else _packed(found))
            sizes.append(len(found))
        ids = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("vec_id", "label")]
        yield pa.RecordBatch.from_arrays(
            [*ids, pa.array(small, pa.binary()), pa.array(large, pa.string()), pa.array(sizes, pa.int32())],
            ["vec_id", "label", "small", "large", "size"],
        )


def narrow_enough(values: np.ndarray) -> bool:
    most = int(np.abs(values).max(initial=0))
    return 2 * most.bit_length() + 2 + len(values).bit_length() <= SAFE_BITS


def _rows(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and parts (row, part, position within part) of the rows with small and those with large components."""
    small, large = batch.column("small"), batch.column("large")
    for kind in (small, large):
        at = np.flatnonzero(kind.is_valid().to_numpy(zero_copy_only=False))
        for first in range(0, len(at), ROWS):
            here = at[first : first + ROWS]
            held = np.zeros((len(here), PARTS * width), np.int64 if kind is small else object)
            for row, i in enumerate(here.tolist()):
                cell = kind[i].as_py()
                found = np.frombuffer(cell, np.int64) if kind is small else [int(x) for x in cell.split(",")]
                held[row, : len(found)] = found
            yield here, held.reshape(len(here), PARTS, width)


def _sums(books: list[np.ndarray], width: int):
    """Arrow function: how often each entry is nearest in a partition, and the sums of its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list] = {}
        for batch in batches:
            for _, rows in _rows(batch, width):
                for part, book in enumerate(books):
                    own = rows[:, part]
                    best, _ = nearest(own, book)
                    for entry in np.unique(best).tolist():
                        mine = own[best == entry]
                        held = totals.setdefault((part, entry), [0, [0] * width])
                        held[0] += len(mine)
                        held[1] = [a + int(b) for a, b in zip(held[1], mine.sum(axis=0).tolist())]
        yield from _total_rows(totals).to_batches()

    return run


def _total_rows(totals: dict[tuple[int, int], list]) -> pa.Table:
    """Totals as decimal text, since they may pass 64 bits."""
    keys = sorted(totals)
    columns = {
        "part": pa.array([k[0] for k in keys], pa.int32()),
        "entry": pa.array([k[1] for k in keys], pa.int32()),
        "n": pa.array([totals[k][0] for k in keys], pa.int64()),
        "totals": pa.array([[str(x) for x in totals[k][1]] for k in keys], pa.list_(pa.string())),
    }
    return pa.table(columns)


def _add_up(rows: pa.Table) -> pa.Table:
    """The sum of all tasks' rows of one part and entry."""
    totals = [sum(map(int, column)) for column in zip(*rows.column("totals").to_pylist())]
    key = (rows.column("part")[0].as_py(), rows.column("entry")[0].as_py())
    return _total_rows({key: [sum(rows.column("n").to_pylist()), totals]})


def train(rows: DataFrame, width: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks (entry, position) of all parts after ``rounds`` rounds over all ``rows`` (:func:`quantised`)."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "large", "small").limit(ENTRIES).toArrow().combine_chunks()
    starts = [None] * first.num_rows
    for batch in first.to_batches():
        for at, parts in _rows(batch, width):
            for i, part in zip(at.tolist(), parts):
                starts[i] = part.astype(object)
    books = [narrow(np.array([s[part] for s in starts], object).reshape(len(starts), width)) for part in range(PARTS)]
    for _ in range(rounds if starts else 0):
        found = rows.mapInArrow(_sums(books, width), TOTALS)
        # one row per task, part and entry becomes one per part and entry
        summed = found.groupBy("part", "entry").applyInArrow(_add_up, TOTALS).collect()
        fresh = [book.astype(object) for book in books]
        for r in summed:
            fresh[r["part"]][r["entry"]] = [int(x) // r["n"] for x in r["totals"]]
        books = [narrow(book) for book in fresh]
    return books


def quantised(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """The usable rows as integers, written once for all rounds, and the width of a part."""
    schema = with_fields(embeddings.select("vec_id", "label"), "small binary, large string, size int")
    rows = pin(embeddings.select("vec_id", "label", "embedding").mapInArrow(_quantise, schema))
    longest = rows.agg(F.max("size")).first()[0] or 0
    return rows, max(1, -(-longest // PARTS))


def digest(books: list[np.ndarray]) -> str:
    """Lowercase hex SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.flat).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """``vec_id``, ``label``, ``code`` (two hex digits per part) and ``error`` of the rows of :func:`quantised`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, parts in _rows(batch, width):
                found = [nearest(parts[:, i], book) for i, book in enumerate(books)]
                codes = np.stack([best for best, _ in found], axis=1).astype(np.uint8)
                errors = [min(LONGEST, sum(map(int, e))) for e in zip(*(d.tolist() for _, d in found))]
                ids = [batch.column(c).take(pa.array(at)) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays(
                    [*ids, pa.array([c.tobytes().hex() for c in codes]), pa.array(errors, pa.int64())],
                    ["vec_id", "label", "code", "error"],
                )

    schema = with_fields(rows.select("vec_id", "label"), "code string, error long")
    return rows.select("vec_id", "label", "small", "large").mapInArrow(run, schema)


def decode(codes: DataFrame, books: list[np.ndarray], length: int) -> DataFrame:
    """The rows of :func:`encode` with ``vector``: the entries of the code, back in the scale of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digits = [np.frombuffer(bytes.fromhex(c), np.uint8) for c in batch.column("code").to_pylist()]
            found = [np.concatenate([book[d] for book, d in zip(books, code)]).astype(np.float64)[:length] / SCALE for code in digits]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], [*batch.schema.names, "vector"])

    return codes.mapInArrow(run, with_fields(codes, "vector array<double>"))


def report(embeddings: DataFrame) -> DataFrame:
    """Code, error, error of all vectors of the label, and digest of the codebooks, of every usable vector.

    A label may hold a third of all rows: errors are added up per label before they meet the rows. The sums hold a label
    once, so adaptive execution splits the rows of such a label where it does not broadcast the sums.
    """
    rows, width = quantised(embeddings)
    books = train(rows, width)
    coded = pin(encode(rows, books, width)).withColumns({"no_label": F.col("label").isNull(), "key": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    wide = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy("no_label", "key").agg(F.least(wide, F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    joined = coded.join(sums, ["no_label", "key"])
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))

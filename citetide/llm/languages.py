"""Language identification by bit-sliced Bloom filters of n-grams.

A text's n-grams are the strings of ``SIZES`` bytes of its words, each word with the blanks around it (words as in
:func:`decontaminate.normalise`: ASCII letters in lower case, digits, characters beyond ASCII). A language's filter
holds the n-grams that are not rare in it: at least ``LEAST`` occurrences, and a share of at least ``RATIO`` of the
share in the language where it is most frequent. The filters of all languages lie side by side, one bit of each in
a mask for every place of the table, so one look-up of an n-gram (the masks at its ``HASHES`` places, combined by
and) gives all languages that contain it. Counting these bits over a text gives each language's hits; hits that a
filter gives by chance, in proportion to how full it is, are taken off, and the language with the most is
predicted. The score is its corrected share of the n-grams. Without any hit the most frequent language of the
sample is predicted with score 0.

The filters are fitted on at most ``SAMPLE`` documents, the first by a hash of their id among those that are to be
learnt from. ``und`` is predicted, with score 0, if a text is null or has no letter, and if nothing could be learnt.
Ties go to the language that sorts first. Repeated rows are treated alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import normalise
from .textblocks import U64, blocks, mix

SIZES = (3, 4)
SAMPLE, LEAST, RATIO = 20_000, 3, 0.05
#: Places of the table (a power of two) and look-ups of an n-gram.
BITS, HASHES = 21, 2


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and row of every n-gram of a block."""
    text, at, rows = normalise(data, offsets)
    row = np.zeros(len(text), np.int64)
    # a row ends with a blank that belongs to no word; n-grams that reach over it begin with a word's last bytes
    last = np.flatnonzero(np.append(rows[1:] != rows[:-1], True)) if len(rows) else np.zeros(0, np.int64)
    firsts = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    marks = np.zeros(len(text) + 1, np.int64)
    if len(last):
        heads = at[firsts]
        marks[heads[0]] = rows[0]
        marks[heads[1:]] = np.diff(rows[firsts])
    row = np.cumsum(marks[:-1])
    wide = text.astype(U64)
    found, where = [], []
    for size in SIZES:
        count = len(text) - size + 1
        if count <= 0:
            continue
        code = np.full(count, size, U64)
        inner = np.zeros(count, bool)
        for i in range(size):
            code = (code << U64(8)) | wide[i : i + count]
            if 0 < i < size - 1:
                inner |= text[i : i + count] == 32
        ends = (text[:count] == 32) & (text[size - 1 :] == 32) & (size == 2)
        good = np.flatnonzero(~inner & ~ends)
        found.append(code[good])
        where.append(row[good])
    if not found:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(where)


def places(codes: np.ndarray) -> list[np.ndarray]:
    mixed = mix(codes)
    return [((mixed >> U64(32 * i)) & U64((1 << BITS) - 1)).astype(np.int64) for i in range(HASHES)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in blocks(batch, "text"):
            codes, rows = grams(data, offsets)
            names = part.column("lang").to_pylist()
            for lang in sorted(set(names)):
                own = np.array([n == lang for n in names])
                code, n = np.unique(codes[own[rows]], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n)], ["lang", "code", "n"]
                )


def _set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        code = batch.column("code").to_numpy().astype(U64)
        for place in places(code):
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(place)], ["lang", "place"])


class Filters:
    """Bit-sliced filters: ``table[place]`` has a bit for each language that sets this place."""

    def __init__(self, languages: list[str], usual: str | None, table: np.ndarray):
        self.languages, self.usual, self.table = languages, usual, table
        bits = np.unpackbits(table, axis=1, bitorder="little")[:, : len(languages)]
        self.chance = np.minimum(bits.mean(axis=0) ** HASHES, 0.999)

    def hits(self, codes: np.ndarray, rows: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Corrected hits of each row and language, and the n-grams of each row."""
        masks = None
        for place in places(codes):
            found = self.table[place]
            masks = found if masks is None else masks & found
        total = np.bincount(rows, minlength=count).astype(float)
        raw = np.zeros((count, len(self.languages)))
        for i in range(len(self.languages)):
            bit = (masks[:, i >> 3] >> (i & 7)) & 1
            raw[:, i] = np.bincount(rows, weights=bit, minlength=count)
        return np.maximum(raw - total[:, None] * self.chance, 0) / (1 - self.chance), total


def fit(documents: DataFrame, learn: Column, sample: int = SAMPLE) -> Filters:
    """Filters of the languages of the documents for which ``learn`` holds."""
    known = documents.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    ids = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = known.join(F.broadcast(ids), "doc_id", "left_semi").select("lang", "text")
    counts = picked.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    try:
        totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        languages = sorted(totals)
        if not languages:
            return Filters([], None, np.zeros((1 << BITS, 1), np.uint8))
        share = F.col("n") / F.create_map(*(F.lit(x) for kv in totals.items() for x in kv))[F.col("lang")]
        shared = counts.where(F.col("n") >= LEAST).withColumn("share", share)
        most = shared.groupBy("code").agg(F.max("share").alias("most"))
        kept = shared.join(most, "code").where(F.col("share") >= RATIO * F.col("most")).select("lang", "code")
        set_places = kept.mapInArrow(_set, "lang string, place long").distinct()
        table = np.zeros((1 << BITS, (len(languages) + 7) // 8), np.uint8)
        for i, lang in enumerate(languages):
            own = set_places.where(F.col("lang") == lang).select("place").toPandas().place.to_numpy()
            table[own, i >> 3] |= np.uint8(1 << (i & 7))
        return Filters(languages, max(languages, key=lambda x: totals[x]), table)
    finally:
        counts.unpersist()


def predict(documents: DataFrame, filters: Filters) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*filters.languages, "und"])
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                lettered = part.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
                if filters.languages:
                    codes, rows = grams(data, offsets)
                    hits, total = filters.hits(codes, rows, part.num_rows)
                    best = hits.argmax(axis=1)
                    top = hits[np.arange(len(hits)), best]
                    best[top == 0] = filters.languages.index(filters.usual)
                    score = np.clip(top / np.maximum(total, 1), 0, 1)
                else:
                    best, score = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
                    lettered = lettered & False
                best[~lettered], score[~lettered] = len(names) - 1, 0.0
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
                )

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text", lettered).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def report(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every document. A null id is not held out, nor is
    it learnt from."""
    filters = fit(documents, ~held_out() & F.col("doc_id").isNotNull(), sample)
    found = predict(documents, filters)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")

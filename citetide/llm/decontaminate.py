"""Benchmark decontamination by Wu-Manber multi-pattern search.

Words are the runs of ASCII letters (lower-cased), ASCII digits and characters beyond ASCII. The patterns are the
windows of ``WINDOW`` consecutive words of each benchmark item; an item of fewer words, but not none, is one
pattern. Texts and patterns are compared as words joined by single blanks.

Search: a table gives, for the last ``BLOCK`` bytes under a window of the shortest pattern's length, how far the
window may move without passing a pattern's start. Where it may not move, the bucket of patterns that have this
block at that place is looked up, and each is compared byte by byte. Many windows over a block of texts move at
once, so that every step is a numpy operation. Patterns are searched in groups of similar length, which keeps the
moves long. The pattern set is handed out in parts of at most ``PART_BYTES``; with several parts the texts are
searched once for each.

A document word inside any occurrence is hit. A document is contaminated if it has hit words and they are at least
a twentieth of its words. Null and empty texts have no words; benchmark rows with a null id or text are ignored;
repeated items or documents are treated alike; other columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetide.session import pin

from .rows import fresh, with_fields
from .textblocks import U64, SpanHasher, blocks, bound_batches, fold_table, frugal, spans, word_table

WINDOW = 13
BLOCK = 8
#: Pattern bytes searched for in one pass, and the least lengths of the pattern groups.
PART_BYTES, GROUPS = 16 << 20, (0, BLOCK, 32)
TABLE_BITS = 20
#: Bytes of text that one moving window is in charge of.
STRETCH = 1024
#: Pairs of a place and a pattern that are compared at once; a place's pairs stay together.
PAIRS = 1 << 17


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a block, each with a blank before it and each row with one more behind; the place of each
    word's blank; the row of each word."""
    low = fold_table()[data]
    inside = word_table()[low]
    starts, ends, rows = spans(inside, offsets)
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)])[:-1] + rows if len(starts) else np.zeros(0, np.int64)
    out = np.full(int((size + 1).sum()) + len(offsets) - 1, 32, np.uint8)
    out[np.repeat(at + 1 - starts, size) + np.flatnonzero(inside)] = low[inside]
    return out, at, rows


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in blocks(batch, "text"):
            out, at, rows = normalise(data, offsets)
            ids = part.column(0).to_pylist()
            items, found, words = [], [], []
            for row in range(part.num_rows):
                first, last = np.searchsorted(rows, [row, row + 1])
                for i in range(first, max(last - WINDOW + 1, first + (last > first))):
                    n = min(WINDOW, last - first)
                    end = at[i + n] if i + n < last else (at[i + n - 1] + 1 + _length(out, at[i + n - 1] + 1))
                    items.append(ids[row])
                    found.append(out[at[i] : end + 1].tobytes())
                    words.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(found, pa.binary()), pa.array(words, pa.int32())], ["item", "pattern", "n"]
            )


def _length(out: np.ndarray, begin: int) -> int:
    return int(np.argmax(out[begin:] == 32))


def patterns(benchmark: DataFrame) -> DataFrame:
    """``pattern``, its number of words ``n`` and the ``items`` that hold it."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    found = rows.mapInArrow(_patterns, "item string, pattern binary, n int")
    return found.groupBy("pattern").agg(F.first("n").alias("n"), F.collect_set("item").alias("items"))


class Group:
    """Shift and bucket tables of patterns of similar length."""

    def __init__(self, found: list[bytes], ids: np.ndarray, hasher: SpanHasher):
        self.ids, self.found = ids, found
        sizes = np.array([len(p) for p in found])
        self.least = least = int(sizes.min())
        self.block = block = min(BLOCK, least)
        self.mask = U64((1 << (8 * block)) - 1)
        self.shift = np.full(1 << TABLE_BITS, least - block + 1, np.int32)
        text = np.frombuffer(b"".join(found) + bytes(BLOCK), np.uint8)
        begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        for j in range(least - block + 1):
            np.minimum.at(self.shift, self.slot(self.blocks(text, begin + j)), least - block - j)
        keys = self.blocks(text, begin + least - block)
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(keys))
        self.order, self.sizes = order, sizes
        self.hashes = hasher.load(text).of(begin, begin + sizes)

    def blocks(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        eight = np.lib.stride_tricks.sliding_window_view(text, BLOCK)[at]
        return np.ascontiguousarray(eight).view(U64)[:, 0] & self.mask

    def slot(self, block: np.ndarray) -> np.ndarray:
        return ((block * U64(0x9E3779B97F4A7C15)) >> U64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, text: np.ndarray, size: int, sums: SpanHasher) -> tuple[np.ndarray, np.ndarray]:
        """Start and pattern of every occurrence in the first ``size`` bytes; ``text`` has padding behind them."""
        last = size - self.least + 1
        if last <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(0, last, STRETCH)
        until = np.minimum(at + STRETCH, last)
        stops, reach = [], self.least - self.block
        while len(at):
            moves = self.shift[self.slot(self.blocks(text, at + reach))]
            here = at[moves == 0]
            stops.append(here[text[here] == 32])
            at = at + np.maximum(moves, 1)
            going = at < until
            at, until = at[going], until[going]
        at = np.concatenate(stops)
        keys = self.blocks(text, at + reach)
        slot = np.searchsorted(self.keys, keys)
        slot[slot == len(self.keys)] = 0
        known = self.keys[slot] == keys
        at, slot = at[known], slot[known]
        total = np.cumsum(self.first[slot + 1] - self.first[slot])
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, side="right")))
            found.append(self.compare(text, size, sums, at[a:b], slot[a:b]))
            a = b
        return tuple(np.concatenate(x) for x in zip(*found))

    def compare(self, text: np.ndarray, size: int, sums: SpanHasher, at: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and pattern of the occurrences at the places ``at``, whose patterns are in the buckets ``slot``."""
        count = self.first[slot + 1] - self.first[slot]
        place = np.repeat(self.first[slot] - np.concatenate([[0], np.cumsum(count)])[:-1], count) + np.arange(count.sum())
        at, which = np.repeat(at, count), self.order[place]
        fits = at + self.sizes[which] <= size
        at, which = at[fits], which[fits]
        alike = sums.of(at, at + self.sizes[which]) == self.hashes[which]
        at, which = at[alike], which[alike]
        same = [text[a : a + self.sizes[w]].tobytes() == self.found[w] for a, w in zip(at.tolist(), which.tolist())]
        same = np.array(same, bool)
        return at[same], which[same]


def _searcher(found: list[tuple[bytes, int, list[str]]], ranges: str, items: str, n_words: str, n_hit: str):
    """Arrow function that adds hits of the patterns ``found`` to the four columns, which hold those so far."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, groups = SpanHasher(), []
        sizes = np.array([len(p) for p, _, _ in found])
        for low, high in zip(GROUPS, (*GROUPS[1:], 1 << 62)):
            ids = np.flatnonzero((sizes >= low) & (sizes < high))
            if len(ids):
                groups.append(Group([found[i][0] for i in ids], ids, hasher))
        words_in = np.array([n for _, n, _ in found])
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                text, at, rows = normalise(data, offsets)
                size = len(text)
                padded = np.concatenate([text, np.zeros(BLOCK + 1, np.uint8)])
                hasher.load(text)
                word_at = np.full(size + 1, -1, np.int64)
                word_at[at] = np.arange(len(at))
                first, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for group in groups:
                    begin, pattern = group.search(padded, size, hasher)
                    first.append(word_at[begin])
                    which.append(group.ids[pattern])
                first, which = np.concatenate(first), np.concatenate(which)
                row_first = np.searchsorted(rows, np.arange(part.num_rows + 1))
                old_ranges, old_items = part.column(ranges).to_pylist(), part.column(items).to_pylist()
                new_ranges, new_items, hits = [], [], np.zeros(part.num_rows, np.int64)
                order = np.argsort(first, kind="stable")
                first, which = first[order], which[order]
                cuts = np.searchsorted(first, row_first)
                for row in range(part.num_rows):
                    a, b = cuts[row], cuts[row + 1]
                    if a == b:
                        new_ranges.append(old_ranges[row])
                        new_items.append(old_items[row])
                        hits[row] = sum(old_ranges[row][1::2]) - sum(old_ranges[row][0::2])
                        continue
                    begin = first[a:b] - row_first[row]
                    names = {name for i in which[a:b].tolist() for name in found[i][2]}
                    flags = np.zeros(int(row_first[row + 1] - row_first[row]) + 1, np.int64)
                    np.add.at(flags, begin, 1)
                    np.add.at(flags, begin + words_in[which[a:b]], -1)
                    for x, y in zip(old_ranges[row][0::2], old_ranges[row][1::2]):
                        flags[x] += 1
                        flags[y] -= 1
                    hit = np.concatenate([[False], np.cumsum(flags) > 0, [False]])
                    edges = np.flatnonzero(hit[1:] != hit[:-1])
                    new_ranges.append(edges.tolist())
                    new_items.append(sorted(names | set(old_items[row])))
                    hits[row] = (edges[1::2] - edges[0::2]).sum()
                keep = [c for c in part.schema.names if c not in (ranges, items, n_words, n_hit)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in keep),
                        pa.array(np.diff(row_first)),
                        pa.array(hits),
                        pa.array(new_ranges, pa.list_(pa.int32())),
                        pa.array(new_items, pa.list_(pa.string())),
                    ],
                    [*keep, n_words, n_hit, ranges, items],
                )

    return search


def find_items(documents: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents with ``n_words``, ``n_hit``, ``hit_ranges`` (first word, word after the last, and so on),
    ``items`` (sorted) and ``contaminated``; names that clash get underscores in front."""
    bound_batches(documents.sparkSession)
    found = pin(patterns(benchmark))
    size = found.agg(F.sum(F.length("pattern") + 16)).first()[0] or 0
    parts = max(1, math.ceil(size / part_bytes))
    n_words, n_hit, ranges, items, contaminated = (
        fresh(documents, name) for name in ("n_words", "n_hit", "hit_ranges", "items", "contaminated")
    )
    table = documents
    empty = {
        n_words: F.lit(0).cast("long"),
        n_hit: F.lit(0).cast("long"),
        ranges: F.array().cast("array<int>"),
        items: F.array().cast("array<string>"),
    }
    table = table.withColumns(empty)
    schema = with_fields(documents, f"`{n_words}` long, `{n_hit}` long, `{ranges}` array<int>, `{items}` array<string>")
    for part in range(parts):
        inside = F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part
        held = [(bytes(r.pattern), r.n, sorted(r["items"])) for r in found.where(inside).collect()]
        table = table.mapInArrow(frugal(_searcher(held, ranges, items, n_words, n_hit)), schema)
        if part + 1 < parts:
            table = pin(table)
    dirty = (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))
    return table.withColumn(contaminated, dirty)


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: words, hit words, items and whether it is contaminated."""
    found = find_items(documents.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        "contaminated",
    )


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    found = find_items(documents, benchmark)
    return found.where(~F.col(found.columns[-1])).select(*(F.col(f"`{c}`") for c in documents.columns))

"""Removal of repeated strings by suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else in the corpus is removed; strings
are judged on the input, overlaps count, and matches stay within a document.

1. Sharding by content: each window of ``LENGTH`` bytes names as its anchor the ``GRAM``-byte string in it with the
   least hash (the first of equals). Equal windows name equal anchors, so windows need only be compared with those
   of the same anchor. Consecutive windows of one anchor make up one segment of the text.
2. Segments whose anchor occurs once are unique. Equal segments are collapsed to one with a count; with a count of
   two all its windows are repeated.
   Wherever a window's anchor stands in it, the window holds one of ``CONTEXTS`` fixed contexts of the anchor, each
   of which trades text before the anchor for text behind it. Equal windows hold equal contexts, so a segment none of
   whose contexts has an equal in another segment holds no repeated window and is left out.
3. The different segments of an anchor are joined to a shard, whole anchors together, and the shard's suffix array
   is made by induced sorting: suffixes are classified, the leftmost-smaller substrings named and sorted, by
   recursion where names repeat, and all other suffixes induced from them in two linear scans. Permuted common
   prefixes tell which windows equal another's.
4. An anchor whose different segments take more than ``GROUP`` bytes would not fit a task. Its windows are spread
   by their own digests and counted instead.

Texts are UTF-8 bytes; a null text is empty. Texts shorter than ``LENGTH`` keep everything. Repeated rows are
copies of each other. Texts are told apart by two 64-bit hashes, segments by the anchor and two more.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citetide.session import pin

from .membership import build, sift
from .textblocks import U64, SpanHasher, blocks

LENGTH, GRAM = 400, 32
#: Bytes of the different segments of an anchor that one task sorts, and of a shard that holds several anchors.
GROUP, SHARD = 1 << 21, 1 << 18
#: Contexts of an anchor, an even number. With eight a context is ``LENGTH`` / 9 or so shorter than a window.
CONTEXTS = 8
#: Text bytes that are cut into segments at once; a longer text is worked on alone.
BLOCK = 1 << 19
_TEXT = ["t1", "t2"]
_AROUND = ["behind", "before", *(f"context{j}" for j in range(CONTEXTS))]


# ---- suffix arrays -------------------------------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by induced sorting of an array of non-negative integers that ends in a unique 0."""
    size = len(text)
    if size == 1:
        return np.zeros(1, np.int64)
    step = np.sign(np.diff(text.astype(np.int64)))
    decided = np.where(step != 0, np.arange(size - 1), size - 2)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    smaller = np.append(step[decided] > 0, True)  # whether a suffix is smaller than the next one
    leftmost = smaller.copy()
    leftmost[0] = False
    leftmost[1:] &= ~smaller[:-1]
    places = np.flatnonzero(leftmost)
    ends = np.cumsum(np.bincount(text))
    order = _induce(text, smaller, places, ends)
    # name the leftmost-smaller substrings in the order found
    ranked = order[leftmost[order]]
    stop = np.append(places[1:], size - 1)[np.searchsorted(places, ranked)]
    raw, width = text.tobytes(), text.itemsize
    names, name, last = np.zeros(size, np.int64), -1, None
    for place, end in zip(array("q", ranked.tobytes()), array("q", stop.tobytes())):
        substring = raw[place * width : (end + 1) * width]
        if substring != last:
            name, last = name + 1, substring
        names[place] = name
    if name + 1 < len(places):
        places = places[suffix_array(names[places])]
    else:
        places = ranked
    return _induce(text, smaller, places, ends)


def _induce(text: np.ndarray, smaller: np.ndarray, places: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from the order of the leftmost-smaller ones."""
    size = len(text)
    # the smaller-type places stand at the end of their letter's bucket, in the given order
    letters = text[places]
    rank = np.argsort(letters, kind="stable")
    grouped = letters[rank]
    behind = np.searchsorted(grouped, grouped, side="right") - np.arange(len(grouped))
    start = np.full(size, -1, np.int64)
    start[ends[grouped] - behind] = places[rank]
    found = array("q", start.tobytes())
    letter, kind = text.tolist(), smaller.tobytes()
    head = np.concatenate([[0], ends[:-1]]).tolist()
    for place in found:  # grows behind the scan
        if place > 0:
            place -= 1
            if not kind[place]:
                at = head[letter[place]]
                head[letter[place]] = at + 1
                found[at] = place
    tail = ends.tolist()
    for i in range(size - 1, -1, -1):
        place = found[i] - 1
        if place >= 0 and kind[place]:
            at = tail[letter[place]] - 1
            tail[letter[place]] = at
            found[at] = place
    found[0] = size - 1
    return np.frombuffer(found, np.int64)


def repeated(text: bytes, order: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes from each place on also start at another place. ``order`` is the suffix array
    of ``text`` with an end sign; common prefixes are found in text order, each from its predecessor's."""
    order = order[1:]
    before = np.full(len(text), -1, np.int64)
    before[order[1:]] = order[:-1]
    flags = bytearray(len(text))
    size = len(text)
    common = 0
    for i, k in enumerate(array("q", before.tobytes())):
        if k < 0:
            common = 0
            continue
        most = min(length, size - max(i, k))
        while common < most:
            if common + 32 <= most and text[i + common : i + common + 32] == text[k + common : k + common + 32]:
                common += 32
            elif text[i + common] == text[k + common]:
                common += 1
            else:
                break
        if common >= length:
            flags[i] = flags[k] = 1
        if common:
            common -= 1
    return np.frombuffer(flags, bool)


def shard_flags(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each window of each segment, whether it equals another window of the shard."""
    text = b"\xff".join(segments) + b"\xff"
    order = suffix_array(np.append(np.frombuffer(text, np.uint8).astype(np.int16) + 1, np.int16(0)))
    flags = repeated(text, order, length)
    out, at = [], 0
    for segment in segments:
        out.append(flags[at : at + len(segment) - length + 1])
        at += len(segment) + 1
    return out


# ---- segments ------------------------------------------------------------------------------------------------


def segments_of(data: np.ndarray, offsets: np.ndarray, hasher: SpanHasher, length: int, gram: int):
    """Row, first window (within the row), number of windows, anchor hash and anchor (within the block) of the
    segments of a block."""
    count = len(data) - length + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U64), none
    at = np.arange(len(data) - gram + 1)
    grams = hasher.of(at, at + gram)
    least = (grams & U64(0xFFFFFFFF00000000)) | at.astype(U64)
    width, wide = 1, length - gram + 1
    while width * 2 <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wide:
        least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
    row = np.searchsorted(offsets, np.arange(count), side="right") - 1
    starts = np.flatnonzero(np.arange(count) + length <= offsets[row + 1])
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U64), none
    anchor = (least[starts] & U64(0xFFFFFFFF)).astype(np.int64)
    head = np.ones(len(starts), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (row[starts[1:]] != row[starts[:-1]])
    first = np.flatnonzero(head)
    rows = row[starts[first]]
    return rows, starts[first] - offsets[rows], np.diff(np.append(first, len(starts))), grams[anchor[first]], anchor[first]


def contexts(length: int, gram: int) -> list[tuple[int, int]]:
    """Bytes before and behind the anchor that each context takes: an anchor with at least the former before it in
    its window, but less than the next context's, has at least the latter behind it."""
    places = length - gram + 1
    cuts = [j * places // CONTEXTS for j in range(CONTEXTS + 1)]
    return [(here, places - after) for here, after in zip(cuts, cuts[1:])]


def _segments(length: int, gram: int):
    reaches = contexts(length, gram)
    # what the contexts of the first half share, and those of the second
    reaches = [(0, min(x[1] for x in reaches[: CONTEXTS // 2])), (reaches[CONTEXTS // 2][0], 0), *reaches]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = SpanHasher(1), SpanHasher(2)
        for batch in batches:
            for part, data, offsets in blocks(batch, "text", BLOCK):
                rows, first, n, anchor, place = segments_of(data, offsets, one.load(data), length, gram)
                begin = offsets[rows] + first
                end = begin + n + length - 1
                around = []
                for before, behind in reaches:
                    left, right = place - before, place + gram + behind
                    hashes = one.of(np.maximum(left, begin), np.minimum(right, end)) >> U64(32)
                    # contexts that reach beyond the segment are in none of its windows
                    around.append(pa.array(hashes.astype(np.uint32).view(np.int32), mask=(left < begin) | (right > end)))
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.astype(np.int64)),
                        pa.array(one.of(begin, end).astype(np.int64)),
                        pa.array(two.load(data).of(begin, end).astype(np.int64)),
                        part.column("t1").take(take),
                        part.column("t2").take(take),
                        pa.array(first.astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                        *around,
                    ],
                    ["anchor", "s1", "s2", "t1", "t2", "first", "n", *_AROUND],
                )

    return run


def _cut(length: int):
    """The bytes of the wanted segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "text", BLOCK):
                wanted = part.column("wanted").to_pylist()
                held = data.tobytes()
                rows = [(i, w) for i, ws in enumerate(wanted) for w in ws]
                take = pa.array([i for i, _ in rows], pa.int64())
                base = offsets.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([w["anchor"] for _, w in rows], pa.int64()),
                        part.column("t1").take(take),
                        part.column("t2").take(take),
                        pa.array([w["first"] for _, w in rows], pa.int32()),
                        pa.array([held[base[i] + w["first"] : base[i] + w["first"] + w["n"] + length - 1] for i, w in rows], pa.binary()),
                        pa.array([w["crowded"] for _, w in rows], pa.bool_()),
                    ],
                    ["anchor", "t1", "t2", "first", "bytes", "crowded"],
                )

    return run


_RANGES = "t1 long, t2 long, first int, n int"


def _ranges(where: list[tuple[int, int, int]], flags: list[np.ndarray]) -> pa.RecordBatch:
    t1, t2, first, n = [], [], [], []
    for (a, b, begin), flag in zip(where, flags):
        padded = np.concatenate([[False], flag, [False]])
        edges = np.flatnonzero(padded[1:] != padded[:-1]).tolist()
        for x, y in zip(edges[0::2], edges[1::2]):
            t1.append(a)
            t2.append(b)
            first.append(begin + x)
            n.append(y - x)
    return pa.RecordBatch.from_arrays(
        [pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(first, pa.int32()), pa.array(n, pa.int32())], ["t1", "t2", "first", "n"]
    )


def _sorted_shards(length: int, most: int):
    """Ranges of repeated windows; the rows of an anchor come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, key = 0, None

        def done() -> pa.RecordBatch:
            return _ranges([x[:3] for x in held], shard_flags([x[3] for x in held], length))

        for batch in batches:
            for anchor, *row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "t1", "t2", "first", "bytes"))):
                if anchor != key and size >= most:
                    yield done()
                    held, size = [], 0
                key = anchor
                held.append(tuple(row))
                size += len(row[3])
        if held:
            yield done()

    return run


def _window_digests(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = SpanHasher(1), SpanHasher(2)
        for batch in batches:
            for t1, t2, first, held in zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "first", "bytes"))):
                data = np.frombuffer(held, np.uint8)
                at = np.arange(len(data) - length + 1)
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(one.load(data).of(at, at + length).astype(np.int64)),
                        pa.array(two.load(data).of(at, at + length).astype(np.int64)),
                        pa.array(np.full(n, t1)),
                        pa.array(np.full(n, t2)),
                        pa.array((at + first).astype(np.int32)),
                    ],
                    ["w1", "w2", "t1", "t2", "first"],
                )

    return run


def _meeting(segments: DataFrame) -> DataFrame:
    """``anchor``, ``s1`` and ``s2`` of the different segments that have a context in common with another.

    A segment travels twice: with what its first contexts share, and with what the others share. Segments that have
    one of their contexts in common meet there, where the contexts themselves are counted without moving again."""
    half = CONTEXTS // 2
    sides = [
        F.struct(F.lit(i).alias("side"), F.col(_AROUND[i]).alias("shared"), F.array(*_AROUND[2 + i * half : 2 + (i + 1) * half]).alias("contexts"))
        for i in (0, 1)
    ]
    met = segments.select("anchor", "s1", "s2", F.explode(F.array(*sides)).alias("at")).select("anchor", "s1", "s2", "at.*")
    met = met.where("shared is not null").repartition("anchor", "side", "shared")
    met = met.select("anchor", "s1", "s2", "side", "shared", F.posexplode("contexts").alias("number", "context")).where("context is not null")
    same = Window.partitionBy("anchor", "side", "shared", "number", "context")
    return met.withColumn("count", F.count("*").over(same)).where("count > 1").select("anchor", "s1", "s2").distinct()


def repeated_ranges(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, shard: int = SHARD) -> DataFrame:
    """``t1``, ``t2`` (hashes of the text), ``first`` and ``n``: runs of windows that occur elsewhere as well."""
    texts = documents.select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text").where("text is not null")
    around = ", ".join(f"{c} int" for c in _AROUND)
    found = texts.mapInArrow(_segments(length, gram), f"anchor long, s1 long, s2 long, {_RANGES}, {around}")
    found = pin(found)
    several = found.groupBy("anchor").agg(F.count("*").alias("count")).where("count > 1").select("anchor")
    shared = pin(found.join(several, "anchor", "left_semi"))
    unique = pin(
        shared.groupBy("anchor", "s1", "s2").agg(F.count("*").alias("count"), F.min(F.struct("t1", "t2", "first", "n", *_AROUND)).alias("at"))
    )
    copied = unique.where("count > 1").select("anchor", "s1", "s2")
    whole = shared.join(copied, ["anchor", "s1", "s2"], "left_semi").select("t1", "t2", "first", "n")
    near = _meeting(unique.select("anchor", "s1", "s2", "at.*"))
    unique = pin(unique.join(near, ["anchor", "s1", "s2"], "left_semi"))
    groups = unique.groupBy("anchor").agg(F.count("*").alias("different"), F.sum(F.col("at.n") + length - 1).alias("size")).where("different > 1")
    wanted = (
        unique.join(groups, "anchor")
        .groupBy("at.t1", "at.t2")
        .agg(F.collect_list(F.struct("anchor", "at.first", "at.n", (F.col("size") > group).alias("crowded"))).alias("wanted"))
    )
    wanted = pin(wanted)
    likely = sift(texts, "t1", build(wanted, "t1"))
    one_each = likely.join(wanted.select(*_TEXT), _TEXT, "left_semi").groupBy(*_TEXT).agg(F.first("text").alias("text"))
    cut = one_each.join(wanted, _TEXT).mapInArrow(_cut(length), "anchor long, t1 long, t2 long, first int, bytes binary, crowded boolean")
    cut = pin(cut)
    shards = cut.where("not crowded").repartition("anchor").sortWithinPartitions("anchor")
    ranges = whole.unionByName(shards.mapInArrow(_sorted_shards(length, shard), _RANGES))
    windows = cut.where("crowded").mapInArrow(_window_digests(length), "w1 long, w2 long, t1 long, t2 long, first int")
    again = windows.groupBy("w1", "w2").agg(F.count("*").alias("count")).where("count > 1").select("w1", "w2")
    single = windows.join(again, ["w1", "w2"], "left_semi").select("t1", "t2", "first", F.lit(1).alias("n"))
    return ranges.unionByName(single)


def _strip(length: int, digest: bool, name: str):
    """The bytes that are left (``digest``: their hash), and the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "text", BLOCK):
                ranges = part.column("_ranges").to_pylist()
                null = part.column("text").is_null().to_pylist()
                removed, runs, left = [], [], []
                for i, found in enumerate(ranges):
                    own = data[offsets[i] : offsets[i + 1]]
                    n_removed = n_runs = 0
                    if found:
                        flags = np.zeros(len(own) + 1, np.int32)
                        for r in found:
                            flags[r["first"]] += 1
                            flags[r["first"] + r["n"] + length - 1] -= 1
                        gone = np.cumsum(flags[:-1]) > 0
                        n_removed = int(gone.sum())
                        n_runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        own = own[~gone]
                    removed.append(n_removed)
                    runs.append(n_runs)
                    left.append(None if null[i] and not digest else own.tobytes())
                out = pa.array([hashlib.sha256(x).hexdigest() for x in left]) if digest else pa.array(left, pa.binary())
                keep = [c for c in part.schema.names if c not in ("_ranges", "t1", "t2")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), out],
                    [*keep, "n_bytes", "n_removed", "n_spans", name],
                )

    return run


def _joined(documents: DataFrame, **sizes: int) -> DataFrame:
    """``doc_id``, ``text`` and the ranges of each document; texts without any are not shuffled."""
    ranges = repeated_ranges(documents, **sizes).groupBy(*_TEXT).agg(F.collect_set(F.struct("first", "n")).alias("_ranges"))
    ranges = pin(ranges)
    known = documents.where("text is not null").withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    held = build(ranges, "t1")
    none = F.lit(None).cast(ranges.schema["_ranges"].dataType).alias("_ranges")
    return (
        sift(known, "t1", held).join(ranges, _TEXT, "left").select("doc_id", "text", "_ranges")
        .unionByName(sift(known, "t1", held, inside=False).select("doc_id", "text", none))
        .unionByName(documents.where("text is null").select("doc_id", "text", none))
    )


def remove_repeats(documents: DataFrame, **sizes: int) -> DataFrame:
    """``doc_id``, ``text``, the counts, and ``kept``: the remaining bytes (they may end within a character)."""
    rows = _joined(documents.select("doc_id", "text"), **sizes)
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, n_bytes long, n_removed long, n_spans long, kept binary"
    return rows.mapInArrow(_strip(sizes.get("length", LENGTH), False, "kept"), schema)


def report(documents: DataFrame, **sizes: int) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``repeated`` (whether anything was
    removed) of every document."""
    rows = _joined(documents.select("doc_id", "text"), **sizes)
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    found = rows.mapInArrow(_strip(sizes.get("length", LENGTH), True, "kept_sha256"), schema).drop("text")
    return found.withColumn("repeated", F.col("n_removed") > 0)

"""Near-duplicate documents: ProbMinHash sketches, banding, verification.

Words are the runs of ASCII letters (lower-cased), ASCII digits and characters beyond ASCII. A text's elements are
its shingles of ``SHINGLE`` words; a text of fewer words, but not none, is one shingle. The similarity of two texts is
the probability Jaccard of weighted shingles; the weight of a shingle is its number of occurrences, or 1 for each
without ``counted``, which makes it the ordinary Jaccard of the sets. Texts are linked if it is ``SIMILARITY`` or more;
a class is what links join.

1. Sketch: every shingle sends arrivals of a Poisson process whose rate is its weight to random registers, each of
   which keeps its first arrival. A shingle stops once its next arrival comes after the latest of all registers'
   first arrivals, so that long texts send little more than one arrival for a shingle. Two sketches agree in a
   register with probability equal to the similarity.
2. Bands of ``ROWS`` registers give ``BANDS`` bucket keys; a pair of similarity 0.8 shares one with probability
   0.99998. Equal texts are one node from here on.
3. In each bucket every text is compared with the one that meets most texts in its buckets (the centre of a group of
   copies), over the shingles themselves, and components are formed. Buckets that still hold several components then
   have all their pairs across components compared by their bands, in blocks of bounded size, and those that share
   a band over the shingles. So links that do not touch a bucket's centre are found as well, pairs within a
   component are left out, and no bucket is gathered in one task.

Equal texts are always one class, also texts without words, which link with nothing else. A null text is a class
of its own. Rows with equal ``doc_id`` and text share their class; null ids are never the class id unless the class
has no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetide.session import pin

from .components import components
from .membership import build, may_contain, sift
from .rows import fresh
from .textblocks import U64, SpanHasher, blocks, bound_batches, fold_table, frugal, mix, spans, uniform, windows, word_table

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 36, 6
REGISTERS = BANDS * ROWS
#: Texts of one side in a block of comparisons.
SIDE = 256
_GOLDEN = U64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray, hasher: SpanHasher, size: int = SHINGLE):
    """Distinct shingles of a block: hash, row and count, ordered by row and hash."""
    low = fold_table()[data]
    starts, ends, rows = spans(word_table()[low], offsets)
    words = hasher.load(low).of(starts, ends)
    count = len(offsets) - 1
    grams, begin = windows(words, rows, size)
    of = rows[begin]
    per_row = np.bincount(rows, minlength=count)
    for row in np.flatnonzero((per_row > 0) & (per_row < size)).tolist():
        first = int(np.searchsorted(rows, row))
        whole, _ = windows(words[first : first + per_row[row]], np.zeros(per_row[row], np.int64), int(per_row[row]))
        grams, of = np.append(grams, whole), np.append(of, row)
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    head = np.ones(len(grams), bool)
    head[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(head)
    return grams[at], of[at], np.diff(np.append(at, len(grams)))


def sketch(grams: np.ndarray, rows: np.ndarray, weights: np.ndarray, count: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers of ``count`` rows: the shingle whose arrival is the first in each."""
    first = np.full(count * registers, np.inf)
    owner = np.zeros(count * registers, U64)
    live = np.arange(len(grams))
    clock = np.zeros(len(grams))
    rounds = 0
    while len(live):
        rounds += 1
        seed = mix(grams[live] + mix(np.array([rounds], U64)))
        clock[live] -= np.log(uniform(seed)) / weights[live]
        place = rows[live] * registers + (mix(seed + _GOLDEN) % U64(registers)).astype(np.int64)
        time = clock[live]
        better = np.flatnonzero(time < first[place])
        np.minimum.at(first, place[better], time[better])
        won = better[first[place[better]] == time[better]]
        owner[place[won]] = grams[live[won]]
        latest = first.reshape(count, registers).max(axis=1)
        live = live[clock[live] < latest[rows[live]]]
    return owner.reshape(count, registers)


def _banded(counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        salt = mix(np.arange(1, BANDS + 1, dtype=U64))
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                grams, rows, weights = shingles(data, offsets, hasher)
                weights = weights.astype(float) if counted else np.ones(len(grams))
                held = sketch(grams, rows, weights, part.num_rows).reshape(part.num_rows, BANDS, ROWS)
                keys = np.zeros((part.num_rows, BANDS), U64) + salt
                for i in range(ROWS):
                    keys = mix(keys * _GOLDEN + held[:, :, i])
                some = np.bincount(rows, minlength=part.num_rows) > 0
                ends = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].ravel().astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), lists], ["doc_id", "node", "bands"])

    return run


def _weights(counted: bool, wanted: np.ndarray):
    """Shingles and weights (none: all 1) of the texts whose node may be in the filter ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in batches:
            batch = batch.filter(pa.array(may_contain(wanted, batch.column("node").to_numpy())))
            for part, data, offsets in blocks(batch, "text"):
                grams, rows, weights = shingles(data, offsets, hasher)
                cuts = np.searchsorted(rows, np.arange(part.num_rows + 1)).tolist()
                weights = weights.astype(np.uint32) if counted else np.ones(len(grams), np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("node"),
                        pa.array([grams[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                        pa.array([b"" if (weights[a:b] == 1).all() else weights[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    ],
                    ["node", "grams", "weights"],
                )

    return run


def similarity(a: np.ndarray, wa: np.ndarray | None, b: np.ndarray, wb: np.ndarray | None) -> float:
    """Probability Jaccard of two sorted arrays of shingles with weights (None: all 1)."""
    common, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if wa is None and wb is None:
        return len(common) / (len(a) + len(b) - len(common))
    wa = np.ones(len(a)) if wa is None else wa.astype(float)
    wb = np.ones(len(b)) if wb is None else wb.astype(float)
    x, y = wa[ia], wb[ib]
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    below = np.concatenate([[0], np.cumsum(y)])[np.searchsorted(ratio, ratio, side="left")]
    above = x.sum() - np.concatenate([[0], np.cumsum(x)])[np.searchsorted(ratio, ratio, side="left")]
    return float((x / (above + only_a + ratio * (below + only_b))).sum())


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        hit = []
        columns = [batch.column(c) for c in ("grams_a", "weights_a", "grams_b", "weights_b")]
        for i in range(batch.num_rows):
            ga, wa, gb, wb = (np.frombuffer(c[i].as_buffer(), t) if c[i].as_buffer().size else None for c, t in zip(columns, (U64, np.uint32) * 2))
            hit.append(ga is not None and gb is not None and similarity(ga, wa, gb, wb) >= SIMILARITY - 1e-12)
        kept = [i for i, h in enumerate(hit) if h]
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in kept], pa.int64()), pa.array([b[i] for i in kept], pa.int64())], ["a", "b"])


def weights_of(nodes: DataFrame, texts: DataFrame, counted: bool = True) -> DataFrame:
    """``node``, ``grams`` and ``weights`` of the ``nodes``; ``texts`` has ``node`` and ``text``, copies included."""
    # copies of a text make the same row, of which one is kept
    return pin(
        texts.mapInArrow(frugal(_weights(counted, build(nodes, "node"))), "node long, grams binary, weights binary")
        .groupBy("node")
        .agg(F.first("grams").alias("grams"), F.first("weights").alias("weights"))
    )


def verify(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) that are linked."""
    left = weights.select(F.col("node").alias("a"), F.col("grams").alias("grams_a"), F.col("weights").alias("weights_a"))
    right = weights.select(F.col("node").alias("b"), F.col("grams").alias("grams_b"), F.col("weights").alias("weights_b"))
    return pairs.join(right, "b").join(left, "a").mapInArrow(frugal(_compare), "a long, b long")


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Jaccard of a sorted set with each of several."""
    ends = np.cumsum([len(x) for x in others])
    joined = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, joined), len(one) - 1)
    common = np.diff(np.concatenate([[0], np.cumsum(one[at] == joined)[ends - 1]]))
    return common / (len(one) + np.diff(np.concatenate([[0], ends])) - common)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One link of each outer text to each other component in its block (rows of a block come together)."""
    held: list[tuple] = []
    key = None

    def links() -> pa.RecordBatch:
        inner, outer = ([x for x in held if x[0] is side] for side in (False, True))
        found = []
        if inner and outer:
            bands = np.array([x[3] for x in inner])
            component = np.array([x[2] for x in inner])
            grams = [np.frombuffer(x[4], U64) for x in inner]
            weights = [np.frombuffer(x[5], np.uint32) if x[5] else None for x in inner]
            for _, node, own, keys, held_grams, held_weights in outer:
                near = np.flatnonzero((bands == keys).any(axis=1) & (component != own))
                if not len(near):
                    continue
                mine = np.frombuffer(held_grams, U64)
                counts = np.frombuffer(held_weights, np.uint32) if held_weights else None
                if counts is None and all(weights[i] is None for i in near.tolist()):
                    alike = overlaps(mine, [grams[i] for i in near.tolist()])
                else:
                    alike = np.array([similarity(mine, counts, grams[i], weights[i]) for i in near.tolist()])
                near = near[alike >= SIMILARITY - 1e-12]
                for i in near[np.unique(component[near], return_index=True)[1]].tolist():
                    found.append((node, inner[i][1]))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        names = ("main", "i", "j", "outer", "node", "component", "bands", "grams", "weights")
        for main, i, j, *row in zip(*(batch.column(c).to_pylist() for c in names)):
            if (main, i, j) != key and held:
                yield links()
                held = []
            key = main, i, j
            held.append(tuple(row))
    if held:
        yield links()


def links_across(members: DataFrame, labels: DataFrame, nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """Links between components that share buckets, at least one for each two that are linked by texts with a
    common band. ``members``: ``bucket``, ``node``; ``labels``: ``node``, ``component``; ``nodes``: ``node``,
    ``bands``.

    The texts of a bucket outside its largest component (outer) are compared with all its texts. Buckets with the
    same largest component are worked on together, in blocks of texts, so that two texts meet once."""
    rows = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = rows.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    buckets = sizes.groupBy("bucket").agg(
        F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("largest")
    )
    # with two members both have been compared already
    open_ = buckets.where("parts > 1 and n > 2").select("bucket", F.col("largest.component").alias("main"))
    met = pin(rows.join(open_, "bucket").select("main", "node", "component").distinct())
    blocks_of = met.groupBy("main").agg(
        F.ceil(F.count("*") / SIDE).alias("ni"), F.ceil(F.sum((F.col("component") != F.col("main")).cast("long")) / SIDE).alias("nj")
    )
    met = met.join(blocks_of, "main").join(nodes.select("node", "bands"), "node").join(weights, "node")
    rest, spot = ["node", "component", "bands", "grams", "weights"], F.xxhash64("node")
    inner = met.select(
        "main", F.pmod(spot, F.col("ni")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nj") - 1)).alias("j"),
        F.lit(False).alias("outer"), *rest,
    )
    outer = met.where("component != main").select(
        "main", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ni") - 1)).alias("i"), F.pmod(spot, F.col("nj")).alias("j"),
        F.lit(True).alias("outer"), *rest,
    )
    both = inner.unionByName(outer).repartition("main", "i", "j").sortWithinPartitions("main", "i", "j")
    return both.mapInArrow(frugal(_across), "a long, b long")


def centres(members: DataFrame) -> DataFrame:
    """``bucket`` and ``centre``: of its nodes the one whose buckets hold most texts together. ``members``:
    ``bucket``, ``node``, ``n`` (texts in the bucket)."""
    meets = members.groupBy("node").agg(F.sum("n").alias("meets"))
    best = members.join(meets, "node").groupBy("bucket").agg(F.max(F.struct("meets", "node")).alias("best"))
    return best.select("bucket", F.col("best.node").alias("centre"))


def classes(documents: DataFrame, counted: bool = True) -> DataFrame:
    """``doc_id``, ``node`` (hash of the text), ``component`` (smallest node of the class; null for a null text) and
    ``class_id`` (smallest id of the class) of every document."""
    bound_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select("doc_id", F.xxhash64("text").alias("node"), "text")
    known = texts.where("text is not null")
    rows = pin(known.mapInArrow(frugal(_banded(counted)), f"doc_id {kind}, node long, bands array<long>"))
    nodes = pin(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")))
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = pin(banded.join(shared, "bucket"))
    pairs = members.join(centres(members), "bucket").where("centre != node")
    pairs = pin(pairs.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct())
    weights = weights_of(members.select("node").distinct(), known.select("node", "text"), counted)
    links = pin(verify(pairs, weights))
    labels = components(links)
    more = pin(links_across(members.select("bucket", "node"), labels, nodes, weights))
    if more.take(1):
        labels = components(links.unionByName(more))
    joined = nodes.select("node", "doc_id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = joined.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    of_node = pin(joined.join(smallest, "component").select("node", "component", "class_id"))
    found = rows.select("doc_id", "node").join(of_node, "node")
    none = F.lit(None).cast("long")
    alone = texts.where("text is null").select("doc_id", none.alias("node"), none.alias("component"), F.col("doc_id").alias("class_id"))
    return found.select("doc_id", "node", "component", "class_id").unionByName(alone)


def report(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``class_id`` and ``kept`` (whether the document stands for its class) of every document."""
    return classes(documents).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest id, with its columns; repeated rows of it count once."""
    node, known, chosen = (fresh(documents, name) for name in ("node", "known_node", "kept_doc"))
    columns = [F.col(f"`{c}`") for c in documents.columns]
    found = pin(classes(documents).where("node is not null"))
    # of the rows with the smallest id, which may have several texts, one with the smallest node stands for the class
    sizes = found.groupBy("component").agg(
        F.count("*").alias("rows"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("first")
    )
    crowd = pin(found.select("node", "component").distinct().join(sizes.where("rows > 1"), "component"))
    texts = documents.where("text is not null").withColumn(node, F.xxhash64("text"))
    wanted = build(crowd, "node")
    kept = F.when(F.col("node") == F.col("first.node"), F.struct(F.col("first.doc_id").alias("doc_id")))
    joined = sift(texts, node, wanted).join(crowd.select(F.col("node").alias(known), kept.alias(chosen)), F.col(node) == F.col(known), "left")
    joined = joined.where(F.col(known).isNull() | (F.col(chosen).isNotNull() & F.col("doc_id").eqNullSafe(F.col(f"{chosen}.doc_id"))))
    return (
        sift(texts, node, wanted, inside=False).select(*columns)
        .unionByName(joined.where(F.col(known).isNull()).select(*columns))
        .unionByName(joined.where(F.col(known).isNotNull()).dropDuplicates([node]).select(*columns))
        .unionByName(documents.where("text is null").select(*columns))
    )

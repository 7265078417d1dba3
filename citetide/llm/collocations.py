"""Phrase collocations by HAT-trie counting, one language at a time (null: ``und``).

Texts (null: empty) are lower-cased in A-Z, split into pieces at ``. , ; : ! ?`` and line ends, and those into words
at blanks and tabs. A phrase is a run of up to ``LONGEST`` words of a piece. Candidates have two words or more and
occur ``LEAST`` times or more. A cut of a candidate into two scores ``floor(2000000 a / (l + r))`` from the counts of
the whole and the two parts; the lowest cut counts. A candidate inside a longer one that occurs at least four fifths
as often is dropped.

Counting: a task numbers its words and counts phrases in a burstable trie: under a first word a hash container holds
the rest of its phrases, and one that grows beyond ``BURST`` becomes a node with a container for each next word. At
``ENTRIES`` phrases the largest subtrees are spilled whole, as sorted runs. A row of the shuffle is the
part of a run that belongs to one prefix partition: a bucket for the language and first word, moved by one of
``SUBKEYS`` steps for the rest of the phrase, so that a very common first word is spread. There the runs are merged.

A phrase as frequent as ``LEAST`` consists of phrases that are as frequent, so lengths are counted one after the
other, and a phrase whose two longest parts are not both frequent is never inserted. Tasks know the frequent parts by
a Bloom filter of fixed size: what passes it wrongly is counted in full and then found to be rare. So no step holds
more than a fixed amount, however many phrases there are.

Repeated documents count as often as they occur; very long words and texts are treated like others; other columns are
not read; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetide.operators.topk import top_per_group
from citetide.session import pin

from .membership import build, may_contain
from .textblocks import U64, SpanHasher, blocks, fold_table, mix, spans

LONGEST, LEAST, TOP = 4, 30, 2000
#: Parts of a score, and the share (in hundredths) of a longer phrase that hides the ones inside it.
SCALE, HIDES = 2_000_000, 80
#: Phrases of a container before it bursts, and of a task before it spills.
BURST, ENTRIES = 4096, 240_000
#: Different words that a task numbers before it spills all and begins again; bits of a number.
WORDS, ID_BITS = 200_000, 21
#: Prefix partitions: so many, or four for each partition of a shuffle if these are more. Steps over which the phrases
#: of a first word are spread. Rows of a batch that are worked on at once.
BUCKETS, SUBKEYS, ROWS = 1024, 128, 512
UNKNOWN = "und"
WORD, BLANK, BREAK = 0, 1, 2
RUNS = "lang string, bucket int, phrases array<string>, counts array<bigint>"


def letter_classes() -> np.ndarray:
    table = np.zeros(256, np.int8)
    table[[32, 9]] = BLANK
    table[list(b".,;:!?\x0a\x0b\x0c\x0d")] = BREAK
    return table


class Inner(dict):
    """A trie node: a child for each next word."""


class HatTrie:
    """Counts of phrases given as a first word and the numbers of the others, packed with the nearest on top."""

    def __init__(self, others: int, burst: int = BURST):
        self.others, self.burst = others, burst
        self.root, self.size = Inner(), 0

    def add(self, first: np.ndarray, rest: np.ndarray, counts: np.ndarray) -> None:
        """Add counts of different phrases, sorted by ``first``."""
        self._split(self.root, first, rest, counts, self.others)

    def _split(self, node: Inner, lead: np.ndarray, rest: np.ndarray, counts: np.ndarray, left: int) -> None:
        if len(lead):
            begins = np.concatenate([[0], np.flatnonzero(np.diff(lead)) + 1])
            bounds, keys = [*begins.tolist(), len(lead)], lead[begins].tolist()
            rests, numbers = rest.tolist(), counts.tolist()
            for key, begin, end in zip(keys, bounds, bounds[1:]):
                if key in node:
                    self._fill(node, key, rests[begin:end], numbers[begin:end], left)
                elif end - begin == 1:
                    node[key] = {rests[begin]: numbers[begin]}
                    self.size += 1
                else:
                    self._fill(node, key, rests[begin:end], numbers[begin:end], left)

    def _fill(self, parent: Inner, key: int, rests: list[int], numbers: list[int], left: int) -> None:
        node = parent.get(key)
        if node is None:
            parent[key] = node = dict(zip(rests, numbers))
            self.size += len(node)
        elif type(node) is Inner:
            shift = ID_BITS * (left - 1)
            rest, counts = np.array(rests, np.int64), np.array(numbers, np.int64)
            lead = rest >> shift
            order = np.argsort(lead, kind="stable")
            self._split(node, lead[order], (rest & ((1 << shift) - 1))[order], counts[order], left - 1)
        else:
            before, held = len(node), node.get
            for k, n in zip(rests, numbers):
                node[k] = held(k, 0) + n
            self.size += len(node) - before
        if left > 1 and type(node) is dict and len(node) > self.burst:
            parent[key] = self._burst(node, left)

    def _burst(self, container: dict, left: int) -> Inner:
        shift = ID_BITS * (left - 1)
        mask = (1 << shift) - 1
        out = Inner()
        for k, n in container.items():
            out.setdefault(k >> shift, {})[k & mask] = n
        return out

    @staticmethod
    def _walk(node, head: int, left: int) -> Iterator[tuple[int, dict]]:
        """Containers below a node, each with the packed words that lead to it, moved to their place."""
        if type(node) is Inner:
            for key, child in node.items():
                yield from HatTrie._walk(child, head | key << ID_BITS * (left - 1), left - 1)
        else:
            yield head, node

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Take out whole subtrees, the largest first, until at most ``keep`` phrases are left: first word, packed
        others and count of each phrase."""
        if keep:
            sizes = {
                key: len(node) if type(node) is dict else sum(len(c) for _, c in self._walk(node, 0, self.others))
                for key, node in self.root.items()
            }
            order = sorted(sizes, key=sizes.get, reverse=True)
        else:
            order = list(self.root)
        firsts, heads, containers = [], [], []
        for key in order:
            if self.size <= keep:
                break
            node = self.root.pop(key)
            for head, container in [(0, node)] if type(node) is dict else self._walk(node, 0, self.others):
                firsts.append(key)
                heads.append(head)
                containers.append(container)
                self.size -= len(container)
        sizes = np.fromiter(map(len, containers), np.int64, len(containers))
        first, head = (np.repeat(np.array(x, np.int64), sizes) for x in (firsts, heads))
        total = int(sizes.sum())
        rest = np.fromiter(chain.from_iterable(containers), np.int64, total)
        counts = np.fromiter(chain.from_iterable(map(dict.values, containers)), np.int64, total)
        return first, rest | head, counts


class Words:
    """Numbers of the words of a task, each language's apart."""

    def __init__(self):
        self.numbers: dict[str, dict[bytes, int]] = {}
        self.langs: list[str] = []
        self.words: list[bytes] = []
        self.hashes: list[np.ndarray] = []

    def number(self, lang: str, words: list[bytes], hashes: np.ndarray) -> np.ndarray:
        out, numbers, new = np.empty(len(words), np.int64), self.numbers.setdefault(lang, {}), []
        for i, word in enumerate(words):
            found = numbers.get(word)
            if found is None:
                found = numbers[word] = len(self.words)
                self.langs.append(lang)
                self.words.append(word)
                new.append(i)
            out[i] = found
        self.hashes.append(hashes[new])
        return out


class Tokens:
    """The words of a block: a code for each, the different words and their hashes, and the piece each is in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hasher: SpanHasher, fold: np.ndarray, classes: np.ndarray):
        low = fold[data]
        kind = classes[low]
        inside = kind == WORD
        starts, ends, rows = spans(inside, offsets)
        self.count = len(starts)
        sizes = ends - starts
        breaks = np.cumsum(kind == BREAK) if len(kind) else np.zeros(0, np.int64)
        self.piece = (breaks[starts] + rows) if self.count else np.zeros(0, np.int64)
        letters = low[inside]
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), self.count, [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
        coded = column.dictionary_encode()
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.words = coded.dictionary
        some = np.zeros(len(self.words), np.int64)
        some[self.codes] = np.arange(self.count)
        self.hashes = hasher.load(low).of(starts[some], ends[some])


@lru_cache(maxsize=4096)
def seeded(lang: str) -> np.uint64:
    held = np.frombuffer(lang.encode() + b"\x01", np.uint8)
    return SpanHasher().load(held).of(np.array([0]), np.array([len(held)]))[0]


def chained(hashes: list[np.ndarray], seed: np.uint64) -> np.ndarray:
    """Hash of the sequences that take one word from each array."""
    out = np.full(len(hashes[0]), seed, U64)
    for h in hashes:
        out = mix(out * U64(0xD6E8FEB86659FD93) + h)
    return out


def phrase_starts(tokens: Tokens, size: int, table: np.ndarray | None, seed: np.uint64) -> np.ndarray:
    """Where phrases of ``size`` words begin whose two parts of one word less may be frequent."""
    count = tokens.count - size + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    if size == 1:
        return np.arange(count)
    at = np.arange(count + 1)
    parts = chained([tokens.hashes[tokens.codes[at + i]] for i in range(size - 1)], seed)
    known = may_contain(table, parts.view(np.int64))
    return np.flatnonzero(known[:-1] & known[1:] & (tokens.piece[:count] == tokens.piece[size - 1 :]))


def distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of the columns, sorted by the first column, and how often each occurs."""
    span = [int(c.max(initial=0)) + 1 for c in columns]
    if np.prod(np.array(span, float)) < 2.0**62:
        key = columns[0]
        for c, size in zip(columns[1:], span[1:]):
            key = key * size + c
        key = np.sort(key)
        first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
        found, rows = key[first], []
        for size in reversed(span[1:]):
            found, row = np.divmod(found, size)
            rows.append(row)
        return [found, *reversed(rows)], np.diff(np.append(first, len(key)))
    order = np.lexsort(columns[::-1])
    held = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[1:] != c[:-1] for c in held], axis=0)
    first = np.flatnonzero(new)
    return [c[first] for c in held], np.diff(np.append(first, len(order)))


class Counter:
    """Counts the phrases of one length in a partition and gives them out as sorted runs."""

    def __init__(self, size: int, table: np.ndarray | None, buckets: int, entries: int, burst: int):
        self.size, self.table, self.buckets, self.entries = size, table, buckets, entries
        self.trie, self.names = HatTrie(max(1, size - 1), burst), Words()

    def take(self, lang: str, tokens: Tokens) -> Iterator[pa.RecordBatch]:
        at = phrase_starts(tokens, self.size, self.table, seeded(lang))
        if not len(at):
            return
        columns = [tokens.codes[at + i] for i in range(self.size)]
        used = np.unique(np.concatenate(columns))
        if self.names.words and len(self.names.words) + len(used) > WORDS:
            yield from self.runs(0)
            self.names = Words()
        number = np.zeros(len(tokens.words), np.int64)
        number[used] = self.names.number(lang, tokens.words.take(pa.array(used)).to_pylist(), tokens.hashes[used])
        columns = [number[c] for c in columns]
        if self.size == 1:
            columns.insert(0, np.zeros(len(at), np.int64))  # all words are in one container
        columns, counts = distinct(columns)
        rest = np.zeros(len(counts), np.int64)
        for c in columns[1:]:
            rest = rest << ID_BITS | c
        self.trie.add(columns[0], rest, counts)
        if self.trie.size > self.entries:
            yield from self.runs(self.entries // 4)

    def runs(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Spilled subtrees: a row for each language and bucket, its phrases sorted by the hashes of the first word and of
        the whole."""
        first, rest, counts = self.trie.spill(keep)
        if not len(counts):
            return
        words, hashes = pa.array(self.names.words, pa.large_binary()), np.concatenate(self.names.hashes)
        mask = (1 << ID_BITS) - 1
        others = [rest >> ID_BITS * i & mask for i in reversed(range(self.trie.others))]
        columns = others if self.size == 1 else [first, *others]
        langs, lang = np.unique(np.array(self.names.langs, object), return_inverse=True)
        seeds = np.array([seeded(x) for x in langs], U64)
        lang = lang[columns[0]]
        head, whole = hashes[columns[0]], chained([hashes[c] for c in columns], U64(0))
        bucket = ((mix(head + seeds[lang]) + whole % U64(SUBKEYS)) % U64(self.buckets)).astype(np.int32)
        order = np.lexsort([whole, head, lang * self.buckets + bucket])
        lang, bucket = lang[order], bucket[order]
        begin = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (bucket[1:] != bucket[:-1])]))
        bounds = pa.array(np.append(begin, len(order)), pa.int32())
        names = [words.take(pa.array(c[order])).cast(pa.large_string()) for c in columns]
        phrase = names[0] if self.size == 1 else pc.binary_join_element_wise(*names, pa.scalar(" ", pa.large_string()))
        out = [
            pa.array(langs[lang[begin]], pa.string()),
            pa.array(bucket[begin]),
            pa.ListArray.from_arrays(bounds, phrase.cast(pa.string())),
            pa.ListArray.from_arrays(bounds, pa.array(counts[order])),
        ]
        yield pa.RecordBatch.from_arrays(out, ["lang", "bucket", "phrases", "counts"])
        del out, phrase, names, first, rest, counts, order
        pa.default_memory_pool().release_unused()


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """The rows of each language, some at a time."""
    for first in range(0, batch.num_rows, ROWS):
        part = batch.slice(first, ROWS)
        for lang in pc.unique(part.column("lang")).to_pylist():
            yield lang, part.filter(pc.equal(part.column("lang"), lang))


def _counted(size: int, table: np.ndarray | None, buckets: int = BUCKETS, entries: int = ENTRIES, burst: int = BURST):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, fold, classes = SpanHasher(), fold_table(), letter_classes()
        counter = Counter(size, table, buckets, entries, burst)
        totals: dict[str, int] = {}
        for batch in batches:
            for lang, part in _by_lang(batch):
                for _, data, offsets in blocks(part, "text"):
                    tokens = Tokens(data, offsets, hasher, fold, classes)
                    totals[lang] = totals.get(lang, 0) + tokens.count
                    yield from counter.take(lang, tokens)
        yield from counter.runs(0)
        if size == 1 and totals:
            none = pa.array([[None]] * len(totals), pa.list_(pa.string()))
            sums = pa.array([[n] for n in totals.values()], pa.list_(pa.int64()))
            zero = pa.array([0] * len(totals), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(totals)), zero, none, sums], ["lang", "bucket", "phrases", "counts"])

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of every phrase, as :func:`phrase_starts` makes it."""
    hasher, fold, classes = SpanHasher(), fold_table(), letter_classes()
    for batch in batches:
        for lang, mine in _by_lang(batch):
            for part, data, offsets in blocks(mine, "phrase"):
                tokens = Tokens(data, offsets, hasher, fold, classes)
                size = tokens.count // part.num_rows
                found = tokens.hashes[tokens.codes].reshape(part.num_rows, size)
                keys = chained([found[:, i] for i in range(size)], seeded(lang))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])


def merged(runs: DataFrame) -> DataFrame:
    """``lang, phrase, n``: phrases with the sum of their runs, merged in each prefix partition."""
    rows = runs.repartition("bucket").select("bucket", "lang", F.inline(F.arrays_zip(F.col("phrases").alias("phrase"), F.col("counts").alias("n"))))
    rows = rows.toDF("bucket", "lang", "phrase", "n")
    return rows.groupBy("bucket", "lang", "phrase").agg(F.sum("n").alias("n")).drop("bucket")


def phrase_counts(
    documents: DataFrame, least: int = LEAST, longest: int = LONGEST, entries: int = ENTRIES, burst: int = BURST
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, n, words`` of all phrases that occur ``least`` times, and ``lang, n`` with the number of words."""
    rows = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text")
    buckets = max(BUCKETS, 4 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    levels, totals, table = [], None, None
    for size in range(1, longest + 1):
        found = merged(rows.mapInArrow(_counted(size, table, buckets, entries, burst), RUNS))
        held = pin(found.where((F.col("n") >= least) | F.col("phrase").isNull()))
        if size == 1:
            totals = held.where("phrase is null").select("lang", "n")
        level = held.where("phrase is not null")
        levels.append(level.withColumn("words", F.lit(size)))
        if size < longest:
            table = build(level.select("lang", "phrase").mapInArrow(_hashed, "key long"), "key")
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.unionByName(level)
    return counts, totals


def _joined(words, first, size):
    return F.array_join(F.slice(words, first, size), " ")


def scored(counts: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, score`` of every candidate, by its lowest cut. Exact in decimals."""
    split = F.split("phrase", " ")
    cuts = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.withColumns({"head": _joined(split, F.lit(1), F.col("cut")), "tail": _joined(split, F.col("cut") + 1, F.col("words") - F.col("cut"))})
    for part, name in (("head", "l"), ("tail", "r")):
        held = counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
        # the counts hold a phrase once, so adaptive execution can split a part that very many cuts share
        cuts = cuts.join(held, ["lang", part])
    wide = [F.col(c).cast("decimal(20,0)") for c in ("a", "l", "r")]
    cuts = cuts.withColumns({"top": wide[0] * SCALE, "bottom": wide[1] + wide[2]}).withColumn("score", F.expr("top div bottom"))
    lowest = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("lowest"))
    return lowest.select("lang", "phrase", "words", "a", "lowest.l", "lowest.r", "lowest.score")


def hidden(counts: DataFrame) -> DataFrame:
    """``lang, phrase, cover``: the most frequent longer phrase around each phrase of two words or more."""
    split = F.split("phrase", " ")
    inner = F.expr("flatten(transform(sequence(2, words - 1), k -> transform(sequence(1, words - k + 1), i -> array_join(slice(w, i, k), ' '))))")
    longer = counts.where("words > 2").withColumn("w", split).select("lang", "n", F.explode(F.array_distinct(inner)).alias("phrase"))
    return longer.groupBy("lang", "phrase").agg(F.max("n").alias("cover"))


def report(documents: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The ``top`` candidates of each language by score, count and phrase."""
    counts, totals = phrase_counts(documents, least)
    found = scored(counts).join(hidden(counts), ["lang", "phrase"], "left")
    wide = {c: F.col(c).cast("decimal(20,0)") for c in ("a", "cover")}
    shown = found.where(F.col("cover").isNull() | (wide["cover"] * 100 < wide["a"] * HIDES))
    ranked = top_per_group(shown, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    rank = (F.col("pos") + 1).cast("long").alias("rank")
    return ranked.join(totals, "lang").select("lang", rank, "phrase", "a", "l", "r", "n", "score")

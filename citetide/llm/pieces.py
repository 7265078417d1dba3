"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A segmentation of a text into vocabulary pieces is drawn with probability proportional to the product of its
pieces' probabilities. The lattice holds every piece at every place where it matches. Forward filtering gives each
place the total weight of the ways to reach it; backward sampling walks from the end and draws the last piece in
proportion to weight. As no piece holds a blank after another character, the lattice falls apart at blanks (and at
line breaks where no longer piece holds one), so words are filtered and drawn independently; a word's filtered
lattice is kept for its later occurrences. The draws come from a hash of (seed, row key, place in the text), so
they do not depend on partitions, batches or retries.

The vocabulary is the file of a SentencePiece model with byte fallback, whose path is a parameter. Scores of BPE
models are negative merge ranks; piece probabilities follow from them by Zipf's law with exponent ``alpha``: a large
one approaches the most probable segmentation, 0 makes all pieces equally likely. A blank is put before each
non-empty text and removed by decoding; characters without a piece, and the blank sign U+2581 itself, become their
UTF-8 byte pieces. Decoding gives back every text exactly.

A null text has null pieces and decodes to null, an empty one has none and decodes to the empty string. Repeated
rows with equal keys get equal pieces. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import fresh, with_fields
from .textblocks import U64, SpanHasher, blocks, bound_batches, frugal, mix, uniform

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED, ALPHA = 2, 2.0
#: Bytes of lattices that a task keeps before it starts afresh; this bounds memory, not results.
KEPT_BYTES = 64 << 20
#: Text bytes encoded at once.
PART_BYTES = 1 << 17
_GOLDEN = U64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces, their log probabilities, and a trie in an open-addressed table of (state, character).

    It is built once, on the driver; tasks receive the finished arrays.
    """

    BITS, EMPTY = 19, np.uint64((1 << 64) - 1)

    def __init__(self, model: bytes, alpha: float = ALPHA):
        import sentencepiece

        loaded = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = loaded.get_piece_size()
        names = [loaded.id_to_piece(i) for i in range(size)]
        self.bytes_of = [b""] * size
        self.byte_ids = np.full(256, -1, np.int64)
        plain = []
        for i, name in enumerate(names):
            if loaded.is_byte(i):
                self.byte_ids[int(name[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(name[1:-1], 16)])
            elif not (loaded.is_control(i) or loaded.is_unknown(i) or loaded.is_unused(i)):
                text = name.replace("▁", " ")
                if " " in text.lstrip(" "):
                    raise ValueError(f"piece {i} holds a blank after another character")
                self.bytes_of[i] = text.encode()
                plain.append((i, text))
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary has no byte fallback")
        ranks = np.arange(len(plain)) + 2.0
        weights = ranks**-alpha
        floor = weights[-1] if len(plain) else 1.0
        total = np.log(weights.sum() + 256 * floor)
        self.log_byte = float(np.log(floor) - total)
        self.log_of = np.full(size, self.log_byte)
        self.log_of[[i for i, _ in plain]] = np.log(weights) - total
        self.splits_lines = not any("\n" in text and len(text) > 1 for _, text in plain)
        self.longest = max(len(text) for _, text in plain)
        states: dict[tuple[int, str], int] = {}
        self.ends = [-1]
        for i, text in plain:
            state = 0
            for letter in text:
                nxt = states.get((state, letter))
                if nxt is None:
                    nxt = states[state, letter] = len(self.ends)
                    self.ends.append(-1)
                state = nxt
            self.ends[state] = i
        self.ends = np.array(self.ends, np.int32)
        while len(states) * 3 > 1 << self.BITS:
            self.BITS += 1
        self.keys = np.full(1 << self.BITS, self.EMPTY, U64)
        self.next = np.zeros(1 << self.BITS, np.int32)
        keys = np.array([(s << 21) | ord(c) for s, c in states], U64)
        for slot, key, state in zip(self.slot(keys).tolist(), keys, states.values()):
            while self.keys[slot] != self.EMPTY:
                slot = (slot + 1) & ((1 << self.BITS) - 1)
            self.keys[slot], self.next[slot] = key, state
        # pieces as bytes, for decoding
        self.size_of = np.array([len(b) for b in self.bytes_of])
        self.at = np.concatenate([[0], np.cumsum(self.size_of)])[:-1]
        self.letters = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def __getstate__(self) -> dict:
        """The arrays; the pieces one by one are not sent."""
        return {name: value for name, value in vars(self).items() if name != "bytes_of"}

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _GOLDEN) >> U64(64 - self.BITS)).astype(np.int64)

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The next states, -1 where the trie has none."""
        keys = (states.astype(U64) << U64(21)) | letters.astype(U64)
        slot = self.slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.next[slot], -1)
        open_ = np.flatnonzero((held != keys) & (held != self.EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.BITS) - 1)
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.next[slot[open_[hit]]]
            open_ = open_[~hit & (held != self.EMPTY)]
        return out

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and row offsets of the texts with so many of the ``ids`` each."""
        size = self.size_of[ids]
        place = np.repeat(self.at[ids] - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(size.sum())
        data = self.letters[place]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        keep = np.ones(len(data), bool)
        keep[ends[:-1][counts > 0]] = False  # the blank put in front
        return data[keep], ends - np.concatenate([[0], np.cumsum(counts > 0)])


class Lattices:
    """Filtered lattices of words: for each place the edges that end there, with cumulative probabilities.

    The places of the words added together are numbered by their distance from the word's begin, then by word, with
    longer words first; so an order by place is also an order in which weights can be carried on.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.words = self.places = self.edges = 0
        # the hashes of the words in order, and the word's number for each
        self.keys, self.numbers = np.zeros(0, U64), np.zeros(0, np.int32)
        self.end, self.length = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.first = np.zeros(1, np.int64)
        self.cum, self.back = np.zeros(0, np.float32), np.zeros(0, np.int16)
        self.piece, self.before = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def nbytes(self) -> int:
        return sum(value.nbytes for value in vars(self).values() if isinstance(value, np.ndarray))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the words with these hashes, -1 for those not held."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.numbers[at], -1)

    def _put(self, name: str, used: int, values: np.ndarray) -> None:
        """Write ``values`` behind the ``used`` first entries of an array, which grows in place by a quarter or more."""
        held = getattr(self, name)
        if used + len(values) > len(held):
            held.resize(max(used + len(values), len(held) * 5 // 4), refcheck=False)
        held[used : used + len(values)] = values

    def add(self, words: list[str], keys: np.ndarray) -> None:
        """Filter ``words``, whose hashes ``keys`` are in order and not held yet."""
        v = self.v
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        length = size[order]
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        longest = int(length[0])
        # words of at least n letters, and the first place at distance n
        alive = np.searchsorted(-length, -np.arange(longest + 1), side="right")
        base = np.concatenate([[0], np.cumsum(alive)])
        spot = np.repeat(np.arange(longest, dtype=np.int32), alive[1:])
        word = (np.arange(len(text)) - (base[1:-1] - alive[0])[spot]).astype(np.int32)
        letters = text[(np.cumsum(size) - size)[order][word] + spot].astype(np.int32)
        shift = base - alive[0]  # letter n of word w is letters[shift[n + 1] + w]
        begin, target, piece, back = [], [], [], []
        state, on, w = np.zeros(len(letters), np.int32), spot, word
        for n in range(1, v.longest + 1):
            state = v.step(state, letters[shift[on + n] + w] if n > 1 else letters)
            ends = np.where(state >= 0, v.ends[state], -1)
            if n == 1:
                bare = ends < 0
                code = letters[bare]
                ends[bare] = np.where(code < 128, v.byte_ids[np.minimum(code, 255)], -code - 2)
                full = np.arange(len(ends))
            else:
                full = np.flatnonzero(ends >= 0)
            begin.append((base[on[full]] + w[full]).astype(np.int32))
            target.append((base[on[full] + n] + w[full]).astype(np.int32))
            piece.append(ends[full])
            back.append(np.full(len(full), n, np.int16))
            going = np.flatnonzero((state >= 0) & (on + n < length[w]))
            state, on, w = state[going], on[going], w[going]
            if not len(on):
                break
        begin, target, piece, back = (np.concatenate(x) for x in (begin, target, piece, back))
        by_place = np.argsort(target, kind="stable")
        begin, target, piece, back = begin[by_place], target[by_place], piece[by_place], back[by_place]
        log = v.log_of[np.maximum(piece, 0)]
        wide = np.flatnonzero(piece < 0)
        code = -piece[wide] - 2
        log[wide] = v.log_byte * (2 + (code >= 0x800) + (code >= 0x10000))
        counts = np.bincount(target, minlength=base[-1])
        first = np.concatenate([[0], np.cumsum(counts)])
        reach = np.zeros(base[-1])
        share = np.empty(len(log))
        for n in range(1, longest + 1):
            a, b = first[base[n]], first[base[n + 1]]
            heads = first[base[n] : base[n + 1]] - a
            value = reach[begin[a:b]] + log[a:b]
            top = np.maximum.reduceat(value, heads)
            count = counts[base[n] : base[n + 1]]
            value = np.exp(value - np.repeat(top, count))
            total = np.add.reduceat(value, heads)
            reach[base[n] : base[n + 1]] = top + np.log(total)
            share[a:b] = value / np.repeat(total, count)
        places, r = np.flatnonzero(counts > 1), 1
        while len(places):
            here = first[places] + r
            share[here] += share[here - 1]
            r += 1
            places = places[counts[places] > r]
        ends = np.empty(len(words), np.int64)
        ends[order] = base[length] + np.arange(len(words))
        spots = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, spots, keys)
        self.numbers = np.insert(self.numbers, spots, np.arange(self.words, self.words + len(words)))
        self._put("end", self.words, self.places + ends)
        self._put("length", self.words, size)
        self._put("first", self.places + 1, self.edges + first[1:])
        self._put("cum", self.edges, share)
        self._put("back", self.edges, back)
        self._put("piece", self.edges, piece)
        self._put("before", self.edges, begin + self.places)
        self.words, self.places, self.edges = self.words + len(words), self.places + len(counts), self.edges + len(share)

    def draw(self, words: np.ndarray, seeds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the words in order, and the number of each; ``at`` is where a word begins in its text."""
        who, here, left = np.arange(len(words)), self.end[words], self.length[words]
        start = seeds + at.astype(U64) * _GOLDEN
        steps = []
        counts = np.zeros(len(words), np.int64)
        while len(who):
            u = uniform(start[who] + left.astype(U64) * _GOLDEN).astype(np.float32)
            edge, last = self.first[here], self.first[here + 1] - 1
            more = np.flatnonzero((self.cum[edge] < u) & (edge < last))
            while len(more):
                edge[more] += 1
                more = more[(self.cum[edge[more]] < u[more]) & (edge[more] < last[more])]
            steps.append((who, self.piece[edge]))
            counts[who] += 1
            left = left - self.back[edge]
            going = np.flatnonzero(left)
            who, here, left = who[going], self.before[edge[going]].astype(np.int64), left[going]
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        for i, (who, piece) in enumerate(steps):
            out[ends[who] - 1 - i] = piece
        return out, counts


def expand(ids: np.ndarray, counts: np.ndarray, byte_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace negative entries (characters of several bytes without a piece) by their byte pieces."""
    wide = np.flatnonzero(ids < 0)
    if not len(wide):
        return ids, counts
    encoded = [byte_ids[list(chr(-i - 2).encode())] for i in ids[wide].tolist()]
    size = np.ones(len(ids), np.int64)
    size[wide] = [len(e) for e in encoded]
    out = np.repeat(ids, size)
    at = (np.cumsum(size) - size)[wide]
    out[np.repeat(at - (np.cumsum(size[wide]) - size[wide]), size[wide]) + np.arange(size[wide].sum())] = np.concatenate(encoded)
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    return out, np.diff(ends)


def split(data: np.ndarray, offsets: np.ndarray, lines: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block with a blank before each non-empty row, its row offsets, and where words start and end in it."""
    full = np.diff(offsets) > 0
    bounds = offsets + np.concatenate([[0], np.cumsum(full)])
    out = np.full(int(bounds[-1]), 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.cumsum(full), np.diff(offsets))] = data
    blank = out == 32
    start = blank.copy()
    start[1:] &= ~blank[:-1]
    if lines:
        line = out == 10
        start |= line
        start[1:] |= line[:-1]
    start[bounds[:-1][full]] = True
    starts = np.flatnonzero(start)
    return out, bounds, starts, np.append(starts[1:], len(out))


def sample(lattices: Lattices, hasher: SpanHasher, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, exact: bool = False):
    """Pieces of the rows of a block, and the number of each row. Words are told apart by 64-bit hashes, or with
    ``exact`` by their place, so that none can be taken for another."""
    text, bounds, starts, ends = split(data, offsets, lattices.v.splits_lines)
    if exact:
        lattices = Lattices(lattices.v)
        keys, index, inverse = np.arange(len(starts), dtype=U64), np.arange(len(starts)), np.arange(len(starts))
    else:
        keys, index, inverse = np.unique(hasher.load(text).of(starts, ends), return_index=True, return_inverse=True)
    missing = np.flatnonzero(lattices.find(keys) < 0)
    if len(missing):
        held = text.tobytes()
        begin, end = starts[index[missing]].tolist(), ends[index[missing]].tolist()
        lattices.add([held[a:b].decode() for a, b in zip(begin, end)], keys[missing])
    words = lattices.find(keys)[inverse]
    of = np.searchsorted(bounds, starts, side="right") - 1
    ids, counts = lattices.draw(words, seeds[of], starts - bounds[of])
    cuts = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, bounds)]
    return expand(ids, np.diff(cuts), lattices.v.byte_ids)


def _encoder(vocabulary: Vocabulary, seed: int, names: list[str]):
    """Arrow function that adds pieces, and with a second name whether they decode to the text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices, hasher = Lattices(vocabulary), SpanHasher()
        for batch in batches:
            for part, data, offsets in blocks(batch, "text", PART_BYTES):
                keys = mix(part.column(part.num_columns - 1).to_numpy().astype(U64) ^ mix(np.array([seed], U64)))
                if lattices.nbytes() > KEPT_BYTES:
                    lattices.clear()
                ids, counts = sample(lattices, hasher, data, offsets, keys)
                decoded, bounds = vocabulary.decode(ids, counts)
                if not (np.array_equal(bounds, offsets) and np.array_equal(decoded, data)):
                    ids, counts = sample(lattices, hasher, data, offsets, keys, exact=True)
                    decoded, bounds = vocabulary.decode(ids, counts)
                texts = part.column(part.schema.get_field_index("text"))
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=_mask(texts))
                more = [pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))]
                if len(names) > 1:
                    same = [np.array_equal(decoded[a:b], data[c:d]) for a, b, c, d in zip(bounds, bounds[1:], offsets, offsets[1:])]
                    more.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *more], [*part.schema.names[:-1], *names])

    return encode


def _mask(texts: pa.Array) -> np.ndarray | None:
    """Null offsets make null lists."""
    if not texts.null_count:
        return None
    return np.append(pc.is_null(texts).to_numpy(zero_copy_only=False), False)


def encode(
    documents: DataFrame,
    keys: list[str],
    model: str = MODEL,
    alpha: float = ALPHA,
    seed: int = SEED,
    check: bool = False,
) -> DataFrame:
    """The documents with ``pieces`` (array of ids), drawn by a hash of the columns ``keys``. With ``check`` each
    text is decoded again at once and ``lossless`` tells whether that gave the same bytes."""
    bound_batches(documents.sparkSession)
    with open(model, "rb") as file:
        held = file.read()
    names = [fresh(documents, "pieces")] + [fresh(documents, "lossless")] * check
    keyed = documents.withColumn(fresh(documents, "row_key"), F.xxhash64(*(F.col(f"`{k}`") for k in keys)))
    schema = with_fields(documents, ", ".join(f"`{n}` {t}" for n, t in zip(names, ("array<int>", "boolean"))))
    return keyed.mapInArrow(frugal(_encoder(Vocabulary(held, alpha), seed, names)), schema)


def decode(encoded: DataFrame, column: str = "pieces", model: str = MODEL) -> DataFrame:
    """The rows with ``decoded``, the text that the pieces in ``column`` spell."""
    with open(model, "rb") as file:
        vocabulary = Vocabulary(file.read())
    name = fresh(encoded, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(column)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, bounds = vocabulary.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            held_bytes = data.tobytes()
            texts = [None if null else held_bytes[a:b].decode() for null, a, b in zip(pc.is_null(lists).to_pylist(), bounds.tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return encoded.mapInArrow(frugal(run), with_fields(encoded, f"`{name}` string"))


def encode_report(documents: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``n_pieces``, ``pieces`` and ``lossless`` of every document."""
    found = encode(documents.select("doc_id", "text"), ["doc_id"], check=True, **options)
    n = F.when(F.col("pieces").isNull(), 0).otherwise(F.size("pieces")).cast("long")
    return found.select("doc_id", n.alias("n_pieces"), "pieces", "lossless")

"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative per group.

Vectors are linked if their cosine, in double precision, is ``COSINE`` or more. Null and zero vectors and those that
hold null or non-finite components link with nothing; nor do vectors of different length link. Repeated rows are
vectors of their own. A null ``vec_id`` is a vector, but never names a component that has another id.

1. Centres are fitted on a sample of about ``SAMPLE`` vectors; every vector is assigned to its nearest centre.
   There is a cell for about a sixteenth of ``BLOCK`` vectors, up to ``CELLS`` of them. Neighbouring cells are shuffled
   together once, and written as blocks of at most ``BLOCK`` vectors; a cell with more is dealt out by a hash.
2. Pairs of blocks meet by a Cartesian product that reads the written table again for each of its parts, so a vector
   is stored once however many others it has to be compared with. Block pairs without cells in reach are left out.
3. Two vectors are compared unless the geometry rules a link out: for any two centres, linked vectors cannot differ by
   more than their distance along the line between them, and the angle of either to the other's centre must be within
   reach of the other cell's ring. So no link is lost between cells. Tight groups are compared with their own cell
   and few others; vectors without any structure have to be compared with a good part of all.
4. Products are made in single precision of the main directions of the sample, where the lengths of what is left bound
   the rest; what comes within rounding error of the limit is decided in double over all of the vector. A task adds up
   each row's number of links and keeps a spanning forest of the links, never the links themselves. Forests are joined
   by stars.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citetide.session import pin, unpin

from .components import components
from .textblocks import bound_batches, frugal, mix

COSINE = 0.95
#: Vectors of a block at most, rows of one product, vectors and bytes that fit the centres, rounds of fitting.
BLOCK, TILE, SAMPLE, SAMPLE_BYTES, ROUNDS = 16_384, 128, 16_384, 64 << 20, 8
#: Most cells, and cells that are dealt together.
CELLS, GROUP = 2048, 16
#: Bytes of blocks that a task of the product holds, tasks for each core, bytes of prepared blocks in a Python worker.
PART_BYTES, TASKS, HELD_BYTES = 32 << 20, 8, 48 << 20
#: Numbers of main directions to choose from, the share of unlinked pairs that may pass them, rows to find it out, and
#: pairs of a product that are decided one by one.
DIRECTIONS, PASSING, TRIED, FEW = (8, 12, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256), 1e-8, 2048, 64
#: Values gathered at once where links are decided in double, and bytes of a block.
GATHER, BLOCK_BYTES = 1 << 21, 8 << 20


def usable_rows(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row ends (one more than rows), all values (singles as they are, doubles scaled to length 1) and which rows are
    usable vectors."""
    ends = column.offsets.to_numpy()
    flat = column.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    some = np.concatenate([[0], np.cumsum(flat != 0)])
    usable = column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends[1:]] == bad[ends[:-1]]) & (some[ends[1:]] > some[ends[:-1]])
    if kind == "f8":
        flat = flat.copy()
        for i in np.flatnonzero(usable).tolist():
            x = flat[ends[i] : ends[i + 1]]
            x /= np.abs(x).max()  # so that squares neither vanish nor overflow
            x /= math.sqrt(x @ x)
    return ends, flat, usable


def _packed(kind: str):
    """Rows with the length of their vector and its values as bytes; both null if it is not usable."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, flat, usable = usable_rows(batch.column("embedding"), kind)
            with np.errstate(over="ignore", invalid="ignore"):
                data = flat[ends[0] : ends[-1]].astype(kind)
            mask = pa.array(usable).buffers()[1]
            offsets = ((ends - ends[0]) * data.itemsize).astype(np.int32)
            vectors = pa.Array.from_buffers(pa.binary(), len(usable), [mask, pa.py_buffer(offsets), pa.py_buffer(data)])
            sizes = pa.array(np.diff(ends).astype(np.int32), mask=~usable)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), sizes, vectors], ["row", "vec_id", "size", "vector"])

    return packed


def unit_rows(held: list[bytes] | pa.Buffer, rows: int, kind: str) -> np.ndarray:
    """Packed vectors of one length as rows of doubles of length 1."""
    x = np.frombuffer(b"".join(held) if isinstance(held, list) else held, kind).reshape(rows, -1).astype(np.float64)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def fit_centres(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means: centres of length 1, started from rows spread over the sample; neighbours follow each other."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        total = np.zeros_like(centres)
        for start in range(0, len(sample), 2048):
            part = sample[start : start + 2048]
            np.add.at(total, (part @ centres.T).argmax(axis=1), part)
        length = np.sqrt(np.einsum("ij,ij->i", total, total))
        centres[length > 0] = total[length > 0] / length[length > 0, None]
    near, order = centres @ centres.T, [0]
    left = np.ones(k, bool)
    for _ in range(k - 1):
        left[order[-1]] = False
        order.append(int(np.where(left, near[order[-1]], -np.inf).argmax()))
    return centres[order]


class Geometry:
    """What rules a link out between rows of two cells, from products in single precision."""

    def __init__(self, centres: np.ndarray, cosine: float, sample: np.ndarray | None = None):
        self.centres, self.cosine, self.basis = centres.astype(np.float32), cosine, None
        width = centres.shape[1]
        #: More than a product of two vectors, and more than a sum of four such products, can be off by.
        self.margin, self.slack = (width + 8) * 2.0**-23, 8 * (width + 8) * 2.0**-23
        self.chord, self.angle = math.sqrt(max(2 - 2 * cosine, 0)) + 1e-9, math.acos(max(-1.0, min(1.0, cosine))) + 1e-9

        if sample is not None:
            self.basis = self.directions(sample)

    def directions(self, sample: np.ndarray) -> np.ndarray | None:
        """The fewest main directions, up to half of all, whose bounds let hardly any unlinked pair pass."""
        most = min(sample.shape[1] // 2, DIRECTIONS[-1])
        if most < DIRECTIONS[0]:
            return None
        basis = np.random.default_rng(0).normal(size=(sample.shape[1], most)).astype(np.float32)
        for _ in range(ROUNDS // 2):
            basis = np.linalg.qr((sample.T @ (sample @ basis)).astype(np.float64))[0].astype(np.float32)
        spread = (sample @ basis).astype(np.float64)
        basis = np.linalg.qr(basis @ np.linalg.eigh(spread.T @ spread)[1][:, ::-1])[0].astype(np.float32)
        some = sample[np.linspace(0, len(sample) - 1, min(len(sample), TRIED)).astype(int)]
        linked = some @ some.T >= self.cosine
        for m in (m for m in DIRECTIONS if m <= most):
            self.basis = np.ascontiguousarray(basis[:, :m])
            low = self.bounds(some)
            if np.count_nonzero((low @ low.T >= self.floor()) & ~linked) <= PASSING * linked.size:
                return self.basis
        return None

    def loose(self) -> float:
        """More than the squared length of a row's main part, and a product of two such parts, can be off by."""
        return 4 * math.sqrt(self.basis.shape[1] + 1) * (len(self.basis) + 8) * 2.0**-24

    def bounds(self, units: np.ndarray) -> np.ndarray:
        """Rows whose products are no less than those of ``units``: the main part and the length of the rest."""
        if self.basis is None:
            return units
        main = units @ self.basis
        rest = np.sqrt(np.maximum(1 + self.loose() - np.einsum("ij,ij->i", main, main), 0))
        return np.concatenate([main, rest[:, None].astype(np.float32)], axis=1)

    def floor(self) -> np.float32:
        """What the product of linked rows' bounds is at least."""
        return np.float32(self.cosine - self.margin - (0 if self.basis is None else self.loose()))

    def assign(self, units: np.ndarray) -> np.ndarray:
        return (units @ self.centres.T).argmax(axis=1).astype(np.int32)

    def limits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What linked rows' shifts (product with the own centre less that with the other's) add up to at most, for each
        of the cells ``a`` and each of ``b``."""
        x, y = self.centres[a].astype(np.float64), self.centres[b].astype(np.float64)
        squares = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None] - 2 * (x @ y.T)
        return self.chord * (np.sqrt(np.maximum(squares, 0)) + 1e-7) + self.slack

    def ring(self, low: np.ndarray) -> np.ndarray:
        """Least product with a cell's centre of rows that link to its members, whose least product is ``low``."""
        widest = np.arccos(np.clip(low - self.slack, -1, 1)) + self.angle
        return np.where(widest >= math.pi, -np.inf, np.cos(np.minimum(widest, math.pi)) - self.slack)


def _dealt(geometry: Geometry, deals: np.ndarray, kind: str):
    """The cell of each row, and the deal that it is shuffled by."""
    first = np.concatenate([[0], np.cumsum(deals)])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = geometry.assign(unit_rows(batch.column("vector").to_pylist(), batch.num_rows, kind).astype(np.float32))
                group = cell // GROUP
                spot = mix(batch.column("row").to_numpy().astype(np.uint64)) % deals[group].astype(np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vector"), pa.array(cell), pa.array(first[group] + spot.astype(np.int64))], ["row", "vector", "cell", "deal"])

    return dealt


def _blocks(geometry: Geometry, block: int, kind: str):
    """Rows sorted by deal and cell, cut into blocks of rows sorted by cell. ``least`` holds, for each cell of the block
    and each other cell, the least shift of a row towards it."""

    def made(deal: list[tuple]) -> pa.RecordBatch:
        deal.sort(key=lambda x: x[0])
        units = unit_rows([x[2] for x in deal], len(deal), kind).astype(np.float32)
        own = np.array([x[0] for x in deal], np.int32)
        cells, starts = np.unique(own, return_index=True)
        least = np.empty((len(cells), len(geometry.centres)), np.float32)
        for i, (start, end) in enumerate(zip(starts, [*starts[1:], len(own)])):
            dots = units[start:end] @ geometry.centres.T
            least[i] = (dots[:, cells[i]][:, None] - dots).min(axis=0)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([deal[0][1]], pa.int64()),
                pa.array([cells.tolist()], pa.list_(pa.int32())),
                pa.array([[x.tobytes() for x in least]], pa.list_(pa.binary())),
                pa.array([np.array([x[1] for x in deal], np.int64).tobytes()]),
                pa.array([own.tobytes()]),
                pa.array([b"".join(x[2] for x in deal)]),
            ],
            ["block", "cells", "least", "rows", "cell", "vectors"],
        )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for batch in batches:
            rows = zip(batch.column("cell").to_pylist(), batch.column("row").to_pylist(), batch.column("vector").to_pylist())
            for deal, row in zip(batch.column("deal").to_pylist(), rows):
                if len(held) >= block or deal != last and 2 * len(held) >= block:
                    yield made(held)
                    held = []
                held.append(row)
                last = deal
        if held:
            yield made(held)

    return frugal(blocks)


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least shifts of each cell over its blocks."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for cell, least in zip(batch.column("cell").to_pylist(), batch.column("least").to_pylist()):
            least = np.frombuffer(least, np.float32)
            found[cell] = np.minimum(found[cell], least) if cell in found else least
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["cell", "least"])


class Block:
    """A block ready to be compared: unit rows in single precision, sorted by cell."""

    def __init__(self, block: int, rows: pa.Buffer, cell: pa.Buffer, vectors: pa.Buffer, kind: str, geometry: Geometry):
        self.block, self.rows, own = block, np.frombuffer(rows, np.int64).copy(), np.frombuffer(cell, np.int32)
        x = unit_rows(vectors, len(own), kind)
        self.raw = np.frombuffer(vectors, kind).reshape(len(own), -1).copy()
        self.units = x.astype(np.float32)
        self.bounds = geometry.bounds(self.units)
        self.cells, self.starts = np.unique(own, return_index=True)
        self.ends = np.append(self.starts[1:], len(own))
        self.own = np.einsum("ij,ij->i", self.units, geometry.centres[own])
        self.ring = geometry.ring(np.minimum.reduceat(self.own, self.starts).astype(np.float64))
        self.doubles: np.ndarray | None = None

    def exact(self, at: np.ndarray, many: bool = False) -> np.ndarray:
        """Rows as doubles of length 1; ``many``: all of them are kept for the next time."""
        if many and self.doubles is None:
            self.doubles = unit_rows(pa.py_buffer(self.raw), len(self.raw), self.raw.dtype.str)
        return unit_rows(pa.py_buffer(self.raw[at]), len(at), self.raw.dtype.str) if self.doubles is None else self.doubles[at]

    @property
    def nbytes(self) -> int:
        return self.raw.nbytes + self.units.nbytes + self.bounds.nbytes + 20 * len(self.rows) + (0 if self.doubles is None else self.doubles.nbytes)


class Forest:
    """Numbers of links, and a spanning forest of the links, of the rows of all blocks that a task compares."""

    def __init__(self):
        self.first: dict[int, int] = {}
        self.rows: list[np.ndarray] = []
        self.counts, self.root = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, block: Block) -> None:
        if block.block not in self.first:
            size = len(self.root)
            self.first[block.block] = size
            self.rows.append(block.rows)
            self.counts = np.append(self.counts, np.zeros(len(block.rows), np.int64))
            self.root = np.append(self.root, np.arange(size, size + len(block.rows)))

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links between rows ``a`` and ``b``, each pair once."""
        np.add.at(self.counts, a, 1)
        np.add.at(self.counts, b, 1)
        self.join(a, b)

    def link_many(self, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> None:
        """Links between different rows ``a`` and different rows ``b``."""
        self.counts[a] += linked.sum(axis=1)
        self.counts[b] += linked.sum(axis=0)
        some = linked.any(axis=1)
        self.join(a[some], b[linked[some].argmax(axis=1)])
        some = linked.any(axis=0)
        self.join(a[linked[:, some].argmax(axis=0)], b[some])
        i, j = np.nonzero(linked & (self.find(a)[:, None] != self.find(b)[None]))
        self.join(a[i], b[j])

    def find(self, at: np.ndarray) -> np.ndarray:
        root = self.root[at]
        while True:
            above = self.root[root]
            if (above == root).all():
                break
            root = above
        self.root[at] = root
        return root

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.find(a), self.find(b)
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))

    def found(self) -> pa.RecordBatch:
        rows = np.concatenate([np.zeros(0, np.int64), *self.rows])
        some = np.flatnonzero(self.counts)
        root = self.find(some)
        return pa.RecordBatch.from_arrays([pa.array(rows[some]), pa.array(self.counts[some]), pa.array(rows[root])], ["row", "n", "root"])


def _decide(first: Block, a: np.ndarray, second: Block, b: np.ndarray, near: np.ndarray, cosine: float, forest: Forest) -> None:
    """Link those of rows ``a`` and ``b`` that are marked in ``near``, if their products in double say so."""
    at, to = forest.first[first.block], forest.first[second.block]
    if np.count_nonzero(near) * 8 > near.size:
        near &= first.exact(a, True) @ second.exact(b, True).T >= cosine
        forest.link_many(a + at, b + to, near)
        return
    i, j = np.nonzero(near)
    step = max(1, GATHER // first.raw.shape[1])
    for start in range(0, len(i), step):
        x, y = a[i[start : start + step]], b[j[start : start + step]]
        linked = np.einsum("ij,ij->i", first.exact(x), second.exact(y)) >= cosine
        if linked.any():
            forest.link(x[linked] + at, y[linked] + to)


class Scratch:
    """Arrays that are written again and again; fresh ones of this size would be given back to the system each time."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def get(self, name: str, rows: int, columns: int) -> np.ndarray:
        if name not in self.held or len(self.held[name]) < rows * columns:
            self.held[name] = np.empty(rows * columns, np.float32)
        return self.held[name][: rows * columns].reshape(rows, columns)

    def take(self, name: str, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.take(rows, at, axis=0, out=self.get(name, len(at), rows.shape[1]), mode="clip")


def compare(first: Block, second: Block, geometry: Geometry, forest: Forest, scratch: Scratch) -> None:
    """Find the links between the rows of two blocks, or within one."""
    forest.add(first)
    forest.add(second)
    same = first.block == second.block
    towards = first.own[None] - geometry.centres[second.cells] @ first.units.T
    back = second.own[None] - geometry.centres[first.cells] @ second.units.T
    limits = geometry.limits(first.cells, second.cells)
    closest = np.minimum.reduceat(towards, first.starts, axis=1).T, np.minimum.reduceat(back, second.starts, axis=1)
    floor = geometry.floor()
    for p, q in np.argwhere(closest[0] + closest[1] <= limits).tolist():
        if same and p > q:
            continue
        inside = same and p == q
        shift, other = towards[q, first.starts[p] : first.ends[p]], back[p, second.starts[q] : second.ends[q]]
        limit = np.float32(limits[p, q])
        if inside:
            a = b = np.arange(len(shift))
        else:
            a = np.flatnonzero((shift <= limit - closest[1][p, q]) & (first.own[first.starts[p] : first.ends[p]] - shift >= second.ring[q]))
            b = np.flatnonzero((other <= limit - closest[0][p, q]) & (second.own[second.starts[q] : second.ends[q]] - other >= first.ring[p]))
            if not len(a) or not len(b):
                continue
            a, b = a[np.argsort(shift[a])], b[np.argsort(other[b])]
            far = np.searchsorted(other[b], limit - shift[a[::TILE]] + np.float32(geometry.slack), side="right").tolist()
            if not far[0]:
                continue
        a, b = a + first.starts[p], b + second.starts[q]
        x, y = scratch.take("x", first.bounds, a), scratch.take("y", second.bounds, b if inside else b[: far[0]])
        for k, start in enumerate(range(0, len(a), TILE)):
            i, j = a[start : start + TILE], b[start:] if inside else b[: far[k]]
            if not len(j):
                break  # the rows that follow are farther still
            product = np.matmul(x[start : start + TILE], (y[start:] if inside else y[: far[k]]).T, out=scratch.get("product", len(i), len(j)))
            if inside:
                product[np.tril_indices(len(i), 0, len(j))] = -2
            if product.max() >= floor:
                near = product >= floor
                if geometry.basis is not None and np.count_nonzero(near) > FEW:
                    near &= first.units[i] @ second.units[j].T >= np.float32(geometry.cosine - geometry.margin)
                _decide(first, i, second, j, near, geometry.cosine, forest)


def _links(geometry: Geometry, kind: str):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, scratch, held = Forest(), Scratch(), {}

        def block(batch: pa.RecordBatch, i: int, side: str) -> Block:
            name = batch.column(f"{side}_block")[i].as_py()
            if name not in held:
                if sum(x.nbytes for x in held.values()) > HELD_BYTES:
                    held.clear()
                held[name] = Block(name, *(batch.column(f"{side}_{c}")[i].as_buffer() for c in ("rows", "cell", "vectors")), kind, geometry)
            return held[name]

        for batch in batches:
            for i in range(batch.num_rows):
                first = block(batch, i, "a")
                compare(first, block(batch, i, "b"), geometry, forest, scratch)
        yield forest.found()

    return frugal(links)


def _reach(blocks: DataFrame, geometry: Geometry) -> DataFrame:
    """``block`` and ``reach``: a bit for each cell that holds rows to which rows of the block may link."""
    k = len(geometry.centres)
    least = np.full((k, k), np.inf, np.float32)
    pairs = blocks.select(F.explode(F.arrays_zip(F.col("cells").alias("cell"), "least")).alias("x")).select("x.cell", "x.least")
    for r in pairs.repartition("cell").mapInArrow(_least, "cell int, least binary").collect():
        least[r.cell] = np.frombuffer(r.least, np.float32)
    near = np.zeros((k, k + -k % 64), bool)
    for start in range(0, k, 256):
        cells = np.arange(start, min(start + 256, k))
        near[cells, :k] = least[cells] + least[:, cells].T <= geometry.limits(cells, np.arange(k))
    held = blocks.select("block", "cells").collect()
    reach = [np.packbits(near[r.cells].any(axis=0), bitorder="little").view(np.int64).tolist() for r in held]
    return blocks.sparkSession.createDataFrame(pa.table({"block": pa.array([r.block for r in held], pa.int64()), "reach": pa.array(reach, pa.list_(pa.int64()))}))


def _linked(vectors: DataFrame, n: int, width: int, kind: str, cosine: float, block: int) -> tuple[DataFrame, DataFrame]:
    """``row``, ``n`` and ``root`` for rows with links, by task; and the table of blocks that they are read from.
    ``vectors`` (``n`` of one length): ``row``, ``vector``."""
    block = max(1, min(block, BLOCK_BYTES // (width * np.dtype(kind).itemsize)))
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    spot = F.pmod(F.xxhash64("row"), F.lit(1 << 40))
    picked = vectors.where(spot < min(1 << 40, (most << 40) // n)).select("row", "vector") if n > most else vectors
    held = [r.vector for r in sorted(picked.collect(), key=lambda r: r.row)] or [vectors.first().vector]
    sample = unit_rows(list(map(bytes, held)), len(held), kind).astype(np.float32)
    geometry = Geometry(fit_centres(sample, max(1, min(CELLS, len(sample) // 8, math.ceil(GROUP * n / block)))), cosine, sample)
    share = np.bincount(geometry.assign(sample) // GROUP, minlength=-(-len(geometry.centres) // GROUP)) / len(sample)
    deals = np.maximum(1, np.ceil(share * n / block)).astype(np.int64)
    dealt = vectors.mapInArrow(_dealt(geometry, deals, kind), "row long, vector binary, cell int, deal long")
    dealt = dealt.repartition(max(8, min(int(deals.sum()) // 4, 10_000)), "deal").sortWithinPartitions("deal")
    blocks = pin(dealt.mapInArrow(_blocks(geometry, block, kind), "block long, cells array<int>, least array<binary>, rows binary, cell binary, vectors binary"))
    parts = max(math.ceil(n * width * np.dtype(kind).itemsize / PART_BYTES), math.ceil(math.sqrt(TASKS * blocks.sparkSession.sparkContext.defaultParallelism)))
    sides = [blocks.select(*(F.col(c).alias(f"{s}_{c}") for c in ("block", "cells", "rows", "cell", "vectors"))).coalesce(parts) for s in "ab"]
    first = sides[0].join(F.broadcast(_reach(blocks, geometry).withColumnRenamed("block", "a_block")), "a_block").drop("a_cells")
    # of the two orders of a pair one is taken, either as often as the other
    once = "a_block = b_block or ((a_block ^ b_block) & 1 = 0) = (a_block < b_block)"
    near = "exists(b_cells, c -> getbit(reach[cast(c div 64 as int)], c % 64) = 1)"
    pairs = first.hint("shuffle_replicate_nl").join(sides[1], F.expr(f"({once}) and {near}")).drop("reach", "b_cells")
    return pairs.mapInArrow(_links(geometry, kind), "row long, n long, root long"), blocks


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` (smallest id reachable by links) and ``kept`` of every vector."""
    bound_batches(embeddings.sparkSession)
    held = embeddings.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding")
    kind = "f4" if held.schema["embedding"].dataType.elementType == T.FloatType() else "f8"
    schema = T.StructType([*held.schema.fields[:2], T.StructField("size", T.IntegerType()), T.StructField("vector", T.BinaryType())])
    rows = pin(held.mapInArrow(_packed(kind), schema))
    sizes = rows.where("size is not null").groupBy("size").count().orderBy("size").collect()
    found, blocks = rows.sparkSession.createDataFrame(pa.table({c: pa.array([], pa.int64()) for c in ("row", "n", "root")})), []
    for r in (r for r in sizes if r["count"] > 1):
        part, table = _linked(rows.where(F.col("size") == r["size"]).select("row", "vector"), r["count"], r["size"], kind, cosine, block)
        found = found.unionByName(part)
        blocks.append(table)
    found = pin(found)
    unpin(*blocks)
    counts = found.groupBy("row").agg(F.sum("n").alias("n_links"))
    labels = components(found.select(F.col("row").alias("a"), F.col("root").alias("b")))
    ids = rows.select("row", "vec_id").join(labels, rows.row == labels.node, "left").drop("node")
    ids = ids.withColumn("component", F.coalesce("component", "row"))
    smallest = ids.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    joined = ids.join(counts, "row", "left").join(smallest, "component")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        "component_id",
        F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )

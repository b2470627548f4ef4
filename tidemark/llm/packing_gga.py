"""Packing of documents into sequences: grouping genetic algorithm over islands.

Documents of over ``capacity`` ids are cut into pieces of ``capacity`` ids, the
first of which may be shorter.  Full pieces fill a sequence alone; all others
are items to pack into as few sequences as possible.

Items are dealt to cells of bounded size.  For every cell several islands evolve
populations of packings: crossover injects the best-filled bins of one parent
whole into the other, drops the bins that hold items twice, and puts the
displaced items back by best fit.  After each epoch the best packing of each
island migrates to the next island of its cell.  Bins that a cell leaves badly
filled are opened again and packed in a second round, across cells.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize, operator
from .vbyte_ids import END_ID, VOCAB_FILE
from .wordsplit import hf_coder

CAPACITY = 1024
#: Items a cell holds on average.
CELL_ITEMS = 8192
ISLANDS = 3
EPOCHS = 2
#: Crossovers of an island in an epoch.
CROSSOVERS = 12


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(a, capacity) for a in range(first, n, capacity)]


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, vocab: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(row, doc_id, piece, start, length, ids_crc32[, ids])`` of all documents.

    ``row`` tells rows of equal ``doc_id`` apart.  Null text: the end id alone.
    """
    path = vocab or public_tokenizers.path(VOCAB_FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = hf_coder(path)
        for b in batches:
            rows, doc_ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            out: list[tuple] = []
            held = 0
            for k, ids in coder.ids([t or "" for t in b.column(2).to_pylist()]):
                raw = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(raw), capacity)):
                    part = raw[start : start + length].tobytes()
                    out.append((rows[k], doc_ids[k], piece, start, length, zlib.crc32(part), part if with_ids else None))
                    held += len(part) if with_ids else 64
                if held > 8 << 20:
                    yield batch(out)
                    out, held = [], 0
            if out:
                yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["row", "doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = keyed.mapInArrow(run, "row long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    return -(-int(sizes.sum()) // capacity)


class Packing:
    """Bins as lists of items, with open bins by the room they have left."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0  # bit r: some bin has exactly r left

    def add_bin(self, items: list[int], room: int) -> None:
        self.bins.append(items)
        self.room.append(room)
        if room:
            self.by_room[room].append(len(self.bins) - 1)
            self.rooms |= 1 << room

    def best_fit(self, item: int) -> None:
        size = self.sizes[item]
        fits = self.rooms >> size
        if not fits:
            self.add_bin([item], self.capacity - size)
            return
        r = size + (fits & -fits).bit_length() - 1
        row = self.by_room[r]
        k = row.pop()
        if not row:
            self.rooms ^= 1 << r
        self.bins[k].append(item)
        self.room[k] = left = r - size
        if left:
            self.by_room[left].append(k)
            self.rooms |= 1 << left

    def labels(self) -> np.ndarray:
        out = np.zeros(len(self.sizes), np.int32)
        for k, items in enumerate(self.bins):
            out[items] = k
        return out

    def fitness(self) -> tuple[int, float]:
        """Fewer bins, then fuller ones (Falkenauer's mean of squares)."""
        return -len(self.bins), sum((1 - r / self.capacity) ** 2 for r in self.room) / max(1, len(self.bins))


def from_labels(sizes: list[int], capacity: int, labels: np.ndarray) -> Packing:
    p = Packing(sizes, capacity)
    groups: dict[int, list[int]] = {}
    for item, k in enumerate(labels.tolist()):
        groups.setdefault(k, []).append(item)
    for items in groups.values():
        p.add_bin(items, capacity - sum(sizes[i] for i in items))
    return p


def by_order(sizes: list[int], capacity: int, order: list[int]) -> Packing:
    p = Packing(sizes, capacity)
    for item in order:
        p.best_fit(item)
    return p


def crossover(a: Packing, b: Packing, rng: np.random.Generator) -> Packing:
    """Inject well-filled bins of ``b`` whole into ``a``."""
    full = sorted(range(len(b.bins)), key=lambda k: (b.room[k], k))
    take = full[: max(1, int(len(full) * rng.uniform(0.2, 0.6)))]
    taken = {i for k in take for i in b.bins[k]}
    child = Packing(a.sizes, a.capacity)
    for k in take:
        child.add_bin(list(b.bins[k]), b.room[k])
    displaced = []
    for k, items in enumerate(a.bins):
        if taken.isdisjoint(items):
            child.add_bin(list(items), a.room[k])
        else:
            displaced += [i for i in items if i not in taken]
    for i in sorted(displaced, key=lambda i: (-a.sizes[i], i)):
        child.best_fit(i)
    return child


def mutate(p: Packing, rng: np.random.Generator) -> Packing:
    """Open the emptiest bins and a few others, and best-fit their items."""
    n = len(p.bins)
    drop = set(sorted(range(n), key=lambda k: (-p.room[k], k))[: max(1, n // 50)]) | set(rng.integers(0, n, max(1, n // 50)).tolist())
    child = Packing(p.sizes, p.capacity)
    loose = []
    for k, items in enumerate(p.bins):
        if k in drop:
            loose += items
        else:
            child.add_bin(list(items), p.room[k])
    for i in sorted(loose, key=lambda i: (-p.sizes[i], i)):
        child.best_fit(i)
    return child


def evolve(sizes: np.ndarray, capacity: int, seed: int, crossovers: int, elites: list[np.ndarray]) -> Packing:
    """The best packing an island finds; it stops at the lower bound."""
    rng = np.random.default_rng(seed)
    items = sizes.tolist()
    least = lower_bound(sizes, capacity)
    down = np.argsort(-sizes, kind="stable")
    people = [from_labels(items, capacity, e) for e in elites] or [by_order(items, capacity, down.tolist())]
    best = max(people, key=Packing.fitness)
    while len(people) < 4 and len(best.bins) > least:
        noisy = np.argsort(-sizes * rng.uniform(0.8, 1.25, len(sizes)), kind="stable")
        people.append(by_order(items, capacity, noisy.tolist()))
        best = max(best, people[-1], key=Packing.fitness)
    for _ in range(crossovers):
        if len(best.bins) <= least:
            break
        i, j = rng.choice(len(people), 2, replace=False)
        child = mutate(crossover(people[i], people[j], rng), rng)
        worst = min(range(len(people)), key=lambda k: people[k].fitness())
        if child.fitness() > people[worst].fitness():
            people[worst] = child
        best = max(best, child, key=Packing.fitness)
    return best


_OUT = "cell long, island int, n_bins int, fill double, labels binary"


def _pack_cells(cells: DataFrame, capacity: int, islands: int, epochs: int, crossovers: int) -> DataFrame:
    """``cells``: (cell, items, sizes) with packed arrays. Best ``labels`` of each cell."""
    spread = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    best = None
    tasks = min(10_000, max(1, cells.count() * islands))
    for epoch in range(epochs):

        def run(batches: Iterator[pa.RecordBatch], epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    sizes = np.frombuffer(r["sizes"], "<i4")
                    elites = [np.frombuffer(x, "<i4") for x in r.get("elites") or []]
                    p = evolve(sizes, capacity, zlib.crc32(f"{r['cell']}/{r['island']}/{epoch}".encode()), crossovers, elites)
                    bins, fill = p.fitness()
                    found = (r["cell"], r["island"], -bins, fill, p.labels().astype("<i4").tobytes())
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary())
                    yield pa.record_batch([pa.array([x], t) for x, t in zip(found, kinds, strict=True)], names=["cell", "island", "n_bins", "fill", "labels"])

        if best is None:
            given = spread.select("cell", "island", "sizes")
        else:
            # An island starts with its own best and that of the island before it.
            own = best.select("cell", "island", "labels")
            moved = own.select("cell", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), "labels")
            elites = own.union(moved).groupBy("cell", "island").agg(F.collect_list("labels").alias("elites"))
            given = spread.select("cell", "island", "sizes").join(elites, ["cell", "island"])
        # The work is large and the rows are few, so their number is given: Spark
        # would else merge them into a few tasks.
        best = materialize(given.repartition(tasks, "cell", "island").mapInArrow(run, _OUT), f"islands-{epoch}")
    return best.groupBy("cell").agg(F.max_by("labels", F.struct(-F.col("n_bins"), "fill", -F.col("island"))).alias("labels"))


def _cells_of(items: DataFrame, cell_items: int) -> DataFrame:
    """Deal (item, size) rows to cells; each cell is one row of packed arrays."""
    n = items.count()
    k = max(1, -(-n // cell_items))
    # An item is its row and piece, both integers, so the deal is even.
    dealt = items.withColumn("cell", F.pmod(F.xxhash64("item"), F.lit(k)))
    schema = "cell long, items binary, sizes binary"

    def gather(key, table):
        order = np.argsort(table["item"].to_numpy())
        ids, sizes = table["item"].to_numpy()[order], table["size"].to_numpy()[order]
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([ids.astype("<i8").tobytes()]), pa.array([sizes.astype("<i4").tobytes()])], names=["cell", "items", "sizes"])

    return dealt.groupBy("cell").applyInArrow(gather, schema)


def _assignments(cells: DataFrame, best: DataFrame, capacity: int, level: int) -> DataFrame:
    """(item, size, level, cell, bin, offset, room) of all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                items, sizes, labels = np.frombuffer(r["items"], "<i8"), np.frombuffer(r["sizes"], "<i4"), np.frombuffer(r["labels"], "<i4")
                order = np.lexsort((items, labels))
                items, sizes, labels = items[order], sizes[order].astype(np.int64), labels[order]
                upto = np.cumsum(sizes) - sizes
                heads = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
                group = np.cumsum(np.r_[True, labels[1:] != labels[:-1]]) - 1
                used = np.add.reduceat(sizes, heads)
                yield pa.record_batch(
                    [pa.array(items), pa.array(sizes), pa.array(np.full(len(items), r["cell"], np.int64)), pa.array(labels.astype(np.int64)), pa.array(upto - upto[heads][group]), pa.array(capacity - used[group])],
                    names=["item", "size", "cell", "bin", "offset", "room"],
                )

    out = cells.join(best, "cell").mapInArrow(run, "item long, size long, cell long, bin long, offset long, room long")
    return out.withColumn("level", F.lit(level))


def pack(pieces: DataFrame, capacity: int = CAPACITY, cell_items: int = CELL_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, crossovers: int = CROSSOVERS) -> DataFrame:
    """Give every row of ``pieces`` (a written table with ``row``, ``piece``,
    ``length``) a ``sequence_id`` and its ``offset`` there.

    Sequences are gapless from offset 0.  Empty table: no rows.
    """
    full = pieces.where(F.col("length") == capacity)
    small = pieces.where(F.col("length") < capacity)
    # A document has at most one piece of under capacity, so its row names it.
    items = small.select(F.col("row").alias("item"), F.col("length").cast("int").alias("size"))
    cells = materialize(_cells_of(items, cell_items), "cells")
    first = materialize(_assignments(cells, _pack_cells(cells, capacity, islands, epochs, crossovers), capacity, 0), "packed")
    # Bins with much room left are opened and packed again, across cells.
    loose = F.col("room") > capacity // 16
    again = _cells_of(first.where(loose).select("item", F.col("size").cast("int").alias("size")), cell_items)
    cells2 = materialize(again, "cells-again")
    second = _assignments(cells2, _pack_cells(cells2, capacity, islands, epochs, crossovers), capacity, 1)
    placed = first.where(~loose).unionByName(second)
    # level, cell and bin side by side in one number: 1 + 31 + 31 bits
    seq = F.shiftleft(F.col("level").cast("long"), 61) + F.shiftleft(F.col("cell"), 24) + F.col("bin")
    where = placed.select(F.col("item").alias("row"), seq.alias("sequence_id"), "offset")
    # Full pieces are numbered below zero.
    alone = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return small.join(where, "row").unionByName(alone)


@operator
def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, vocab: str | None = None, with_ids: bool = False, **kw) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset`` and, on request, ``ids`` (little-endian 32-bit).

    Null or empty text is one end id; null and repeated ``doc_id`` rows are
    documents of their own; other columns are ignored; an empty table gives no
    rows.  Ties go to the smaller row number.
    """
    pieces = materialize(pieces_of(docs, capacity, vocab, with_ids=with_ids), "pieces")
    out = pack(pieces, capacity, **kw)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))

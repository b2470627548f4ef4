"""Exact top-k inner products over vectors in order of descending length.

Components are turned into integers, so scores are exact.  Vectors are
range-partitioned by length, longest first, and rotated by the singular vectors
of a sample, which gathers most of an inner product in the first coordinates.
The partial sum over these plus the product of the two residual lengths bounds
the score (Cauchy-Schwarz).  A residual length is one more column, so that the
bounds of a tile of queries and vectors are one product of float32 matrices; how
many columns go before it is chosen on a sample of each block, and where the
rotation gathers nothing, all do.  Only vectors whose bound reaches the query's
k-th best score so far are scored, from the integers.  A first pass over the block
of the longest vectors gives every query a threshold, which a task raises with
each block that it reads.  The length of a block's longest vector stands beside it
as a column, so that the search leaves out the pairs of blocks in which no vector can
reach a threshold.  Blocks are sorted and rotated once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vector_cells as cells
from .scratch import materialize, operator

FIT_ROWS = 4096
#: Rows of a block of vectors, and the blocks of a range of lengths where there are many.
BLOCK_ROWS, PART_BLOCKS = 4096, 8
#: Fewer, but 512 at least, where they would hold more components than QUERY_SIZE.
QUERY_ROWS, QUERY_SIZE = 8192, 1 << 19
SCALE = 256


def rotation_of(sample: np.ndarray) -> np.ndarray:
    """Right singular vectors of the sample, largest first; any sample is right."""
    dim = sample.shape[1]
    if not len(sample):
        return np.eye(dim)
    return np.linalg.svd(sample.T @ sample)[0]


def prepare(ids: np.ndarray, x: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and rotated vectors (as float32), longest first; rows that
    repeat the first of their id go."""
    _, first, which = np.unique(ids, return_index=True, return_inverse=True)
    if len(first) < len(ids):
        once = (x != x[first[which]]).any(1) | (first[which] == np.arange(len(ids)))
        ids, x = ids[once], x[once]
    order = np.argsort(-(x.astype(np.float64) ** 2).sum(1), kind="stable")
    return ids[order], x[order], (x[order] @ rotation).astype("<f4")


#: The most that rounding a component, or one step of a sum, in float32 can change.
ROUNDING = 2.0**-24
#: Queries and vectors that are bounded together, and pairs that are scored together.
TILE, PAIRS = 1024, 1 << 16
#: Nanoseconds a pair for one column of partial sums, for finding those that may
#: count in a row with any, and for a score; they only decide how many columns to sum.
COLUMN_NS, ROW_NS, SCORE_NS = 0.012, 0.6, 150.0
LEAST = np.iinfo(np.int64).min


def shortened(rx: np.ndarray, cut: int) -> np.ndarray:
    """The first ``cut`` columns and the length of the rest, rounded up: the product
    of two such rows is the bound of Cauchy and Schwarz."""
    if cut >= rx.shape[1]:
        return rx
    rest = np.sqrt((rx[:, cut:].astype(np.float64) ** 2).sum(1)) * (1 + 1e-6)
    return np.column_stack([rx[:, :cut], rest.astype("f4")])


class Best:
    """The ``k`` best distinct ids so far of each query of a block.

    ``floor`` holds a score that ``k`` other ids are known to reach.
    """

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, rotation: np.ndarray, k: int, floor: np.ndarray):
        self.q_ids, self.q, self.k, self.floor = q_ids, q, k, floor.astype(np.float64)
        self.rq, self.length = (q @ rotation).astype("f4"), np.sqrt((q.astype(np.float64) ** 2).sum(1))
        self.scores, self.ids = np.full((len(q), k), LEAST), np.full((len(q), k), -1)
        self.short = (q.shape[1], self.rq)

    def reach(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1].astype(np.float64), self.floor)

    def add(self, ids: np.ndarray, x: np.ndarray, rx: np.ndarray) -> None:
        """Take in a prepared block of vectors."""
        dim = x.shape[1]
        length = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        exact = float(self.length.max(initial=0.0)) * float(length.max(initial=0.0)) < 2.0**52
        slack = (dim + 16) * 1.1 * ROUNDING
        sums = np.empty((TILE, TILE), "f4")
        known = False
        for a in range(0, len(ids), TILE):
            part = slice(a, a + TILE)
            if not known:
                known = np.isfinite(self.reach()).all() or a > 0
                cut = self.columns(rx) if known else dim
                if cut != self.short[0]:
                    self.short = (cut, shortened(self.rq, cut))
                short, rq = shortened(rx, cut), self.short[1]
            most = self.length * length[a]  # the longest of the part
            live = np.flatnonzero(most * (1 + 1e-9) + 1e-3 >= self.reach())
            if not len(live):
                break  # what follows is shorter
            for b in range(0, len(live), TILE):
                own = live[b : b + TILE]
                with np.errstate(over="ignore"):
                    reach = np.nextafter((self.reach()[own] - slack * most[own] - 1e-3).astype("f4"), np.float32(-np.inf))
                rows = slice(own[0], own[-1] + 1) if own[-1] - own[0] + 1 == len(own) else own
                out = np.matmul(rq[rows], short[part].T, out=sums[: len(own), : len(ids[part])])
                hit = np.flatnonzero(out.max(axis=1) >= reach)
                if not len(hit):
                    continue
                may = out[hit] >= reach[hit, None]
                if exact and 32 * np.count_nonzero(may) > out.size:
                    # So many that all are scored: integers below 2**53, so that their sums are exact.
                    score = (self.q[own[hit]].astype(np.float64) @ x[part].T.astype(np.float64)).astype(np.int64)
                    last, last_id = self.scores[own[hit], -1][:, None], self.ids[own[hit], -1][:, None]
                    may &= (score > last) | (score == last) & (ids[part] < last_id)
                    if (last == LEAST).any() and score.shape[1] > self.k and len(np.unique(ids[part])) == score.shape[1]:
                        # The best k + 1 of different ids hold k besides the query's own.
                        may &= score >= -np.partition(-score, self.k, axis=1)[:, self.k, None]
                    at, col = np.nonzero(may)
                    self.merge(own[hit[at]], ids[part][col], score[at, col])
                    continue
                at, col = np.nonzero(may)
                for c in range(0, len(at), PAIRS):
                    n, v = own[hit[at[c : c + PAIRS]]], col[c : c + PAIRS] + a
                    self.merge(n, ids[v], np.einsum("ij,ij->i", self.q[n].astype(np.int64), x[v].astype(np.int64)))

    def columns(self, rx: np.ndarray) -> int:
        """How many columns to sum before a bound is tried: the cheapest on a sample."""
        dim = rx.shape[1]
        q, v = self.rq[:: -(-len(self.rq) // 32)], rx[:: -(-len(rx) // 256)]
        reach = self.reach()[:: -(-len(self.rq) // 32)][:, None]

        def cost(cut: int) -> float:
            part = (np.count_nonzero(shortened(q, cut) @ shortened(v, cut).T >= reach) + 1) / (len(q) * len(v))
            return cut * COLUMN_NS + min(1.0, part * TILE) * ROW_NS + part * SCORE_NS

        return min(sorted({dim * n // 8 for n in (1, 2, 4, 5, 6, 7, 8)} - {0}), key=cost) if len(q) and len(v) else dim

    def merge(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Take in pairs; a repeated id counts once, with its best score, and a query's own not at all."""
        fine = (ids != self.q_ids[rows]) & (scores >= self.scores[rows, -1])
        rows, ids, scores = rows[fine], ids[fine], scores[fine]
        if not len(rows):
            return
        old = np.unique(rows)
        had = self.scores[old] > LEAST
        rows = np.concatenate([rows, np.repeat(old, had.sum(1))])
        ids, scores = np.concatenate([ids, self.ids[old][had]]), np.concatenate([scores, self.scores[old][had]])
        top = np.lexsort((~scores, ids, rows))  # ~: descending, and defined for the least long too
        first = np.ones(len(top), bool)
        first[1:] = (rows[top[1:]] != rows[top[:-1]]) | (ids[top[1:]] != ids[top[:-1]])
        top = top[first]
        top = top[np.lexsort((ids[top], ~scores[top], rows[top]))]
        begin = np.searchsorted(rows[top], old)
        rank = np.arange(len(top)) - np.repeat(begin, np.diff(np.append(begin, len(top))))
        top, rank = top[rank < self.k], rank[rank < self.k]
        self.scores[old], self.ids[old] = LEAST, -1
        self.scores[rows[top], rank], self.ids[rows[top], rank] = scores[top], ids[top]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, ids and scores that can be among the best overall."""
        real = (self.scores > LEAST) & (self.scores >= self.floor[:, None])
        return np.repeat(self.q_ids, real.sum(1)), self.ids[real], self.scores[real]


class Work:
    """What a task does with its pairs of blocks: it keeps the best of each query
    until the last pair, so that each block finds a higher threshold."""

    def __init__(self, dim: int, rotation: np.ndarray, k: int):
        self.dim, self.rotation, self.k = dim, rotation, k
        self.held: dict[int, Best] = {}

    def opened(self, ids, vecs, rotated) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.frombuffer(ids, "<i8")
        return own, np.frombuffer(vecs, "<i4").reshape(len(own), self.dim), np.frombuffer(rotated, "<f4").reshape(len(own), self.dim)

    def asked(self, q_ids, q_vecs, floor=None) -> Best:
        own = np.frombuffer(q_ids, "<i8")
        q = np.frombuffer(q_vecs, "<i4").reshape(len(own), self.dim)
        return Best(own, q, self.rotation, self.k, np.full(len(own), -np.inf) if floor is None else np.frombuffer(floor, "<f8"))

    def __call__(self, row: dict) -> tuple:
        block = row["q_block"]
        if block not in self.held:
            self.held[block] = self.asked(row["q_ids"], row["q_vecs"], row["q_floor"])
        self.held[block].add(*self.opened(row["ids"], row["vecs"], row["rotated"]))
        return (), (), ()

    def rest(self) -> Iterator[tuple]:
        while self.held:
            yield self.held.popitem()[1].rows()


@operator
def top_k(vectors: DataFrame, k: int = 5, query_step: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest integer inner products
    of ``floor(256 * x)`` for every row whose id is divisible by ``query_step``.

    Exact.  Rows with a null id or vector, or null or non-finite components take
    no part; vectors shorter than the longest are filled up with zeros, so an
    empty vector scores zero.  A query never finds its own id; rows that repeat
    an id count once, with the highest score.  Ties go to the smaller id.
    Components have to stay within 2**31 / 256, and scores within a long.
    """
    fine = cells.usable(vectors, id_col, vec_col)
    vecs = fine.select("vec_id", F.transform("vec", lambda x: F.floor(x * SCALE).cast("double")).alias("vec"))
    dim, n = fine.agg(F.max(F.size("vec")), F.count("*")).first()
    dim = dim or 1
    length = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)
    parts = -(-n // BLOCK_ROWS)
    parts = max(1, min(parts, 4 * vecs.sparkSession.sparkContext.defaultParallelism), -(-parts // PART_BLOCKS))
    # The id breaks ties of length, so that no range grows with equal vectors.
    by_length = vecs.withColumn("length", length).repartitionByRange(parts, F.desc("length"), F.xxhash64("vec_id")).sortWithinPartitions(F.desc("length")).drop("length")
    sample = fine.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).select("vec").collect()
    fit = np.zeros((len(sample), dim))
    for row, r in zip(fit, sample, strict=True):
        row[: len(r.vec)] = np.floor(np.array(r.vec) * SCALE)
    rotation = rotation_of(fit)

    def sort(ids: np.ndarray, x: np.ndarray) -> tuple:
        ids, x, rx = prepare(ids, x, rotation)
        return ids, x, rx.tobytes(), float(np.sqrt((x[0] ** 2).sum()))

    held = cells.blocks(by_length, dim, BLOCK_ROWS, "mips-blocks", "<i4", "rotated binary, longest double", sort)
    asked = cells.blocks(vecs.where(F.pmod("vec_id", F.lit(query_step)) == 0).repartition(F.col("vec_id")), dim, max(512, min(QUERY_ROWS, QUERY_SIZE // dim)), "mips-queries", "<i4")

    work = Work(dim, rotation, k)

    # The longest vectors first: their k-th best score is a floor for all others.
    # 1/64 of the blocks, as many as may go to all queries at once.
    some = max(1, min(held.count() // 64, cells.TURN_BYTES // (8 * dim * BLOCK_ROWS)))
    tops = [r.block for r in held.select("block", "longest").orderBy(F.desc("longest"), "block").limit(some).collect()]
    longest = held.where(F.col("block").isin(tops)).select(F.lit(0).alias("one"), *[F.col(c).alias(f"t_{c}") for c in ("ids", "vecs", "rotated")])

    def seed(batches):
        def floors(block, q_ids, q_vecs, own: Best) -> pa.RecordBatch:
            last, length = own.scores[:, -1], own.length
            floor = np.where(last == LEAST, -np.inf, last.astype(np.float64))
            # The length that a vector needs for a score of the floor of some query.
            need = np.where(floor <= 0, 0.0, (floor - 1e-3) / np.maximum(length, 1e-9))
            given = [pa.array([x.as_py()], x.type) for x in (block, q_ids, q_vecs)]
            return pa.record_batch([*given, pa.array([floor.astype("<f8").tobytes()], pa.binary()), pa.array([float(need.min()) * (1 - 1e-9)], pa.float64())], names=["block", "ids", "vecs", "floor", "reach"])

        asked_of = ()
        for b in batches:
            # A query block's rows follow each other, one for each of the longest blocks.
            for block, q_ids, q_vecs, *top in zip(*b.columns, strict=True):
                if not asked_of or asked_of[0] != block:
                    if asked_of:
                        yield floors(*asked_of)
                    asked_of = (block, q_ids, q_vecs, work.asked(q_ids.as_buffer(), q_vecs.as_buffer()))
                asked_of[-1].add(*work.opened(*(t.as_buffer() for t in top)))
        if asked_of:
            yield floors(*asked_of)

    # These blocks, of bounded size, go to all queries.
    first = asked.withColumn("one", F.lit(0)).join(F.broadcast(longest), "one").drop("one")
    with cells.small_batches(vecs.sparkSession):
        seeded = materialize(first.mapInArrow(seed, cells.BLOCK + ", floor binary, reach double"), "mips-seeded")
    found = cells.search(seeded, held, work, "long", lambda q: F.col("longest") >= q["reach"])
    return cells.best(found, k, False)

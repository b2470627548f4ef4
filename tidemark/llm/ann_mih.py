"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes by a learned rotation (iterative quantisation; with
more bits than dimensions, several rotations side by side).  A code is split
into substrings of eight bits, and each block of vectors holds an index of every
substring.  By the pigeonhole principle a code within Hamming distance
``m * (s + 1) - 1`` of the query has a substring within ``s`` bits of the
query's, so probing all values of up to ``s`` flipped bits in all ``m`` indexes
retrieves every code within that radius.  ``s`` grows until the radius holds
enough codes, and these are reranked by their exact distance.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vector_cells as cells
from .scratch import operator

#: Vectors the rotation is fitted on: those with the smallest id hashes.
FIT_ROWS = 4096
BITS = 128
BLOCK_ROWS = 8192
QUERY_ROWS = 512
#: Least part of a block that the radius has to hold, and least times k.
PART, TIMES = 0.08, 12

_VALUES = np.arange(256, dtype=np.uint8)
#: Flips of a substring by the number of bits that they change.
FLIPS = [_VALUES[np.bitwise_count(_VALUES) == s] for s in range(9)]


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = 25, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, rotation with ``bits`` columns) by iterative quantisation."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    mean = sample.mean(0) if len(sample) else np.zeros(dim)
    x = sample - mean
    parts = []
    for _ in range(-(-bits // dim)):
        r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(rounds if len(sample) else 0):
            u, _, vt = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
            r = (u @ vt).T
        parts.append(r)
    return mean, np.hstack(parts)[:, :bits]


def codes_of(vecs: np.ndarray, mean: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """One row of bytes (substrings) per vector."""
    return np.packbits((vecs - mean) @ rotation > 0, axis=1)


class MultiIndex:
    """For every substring, the rows of a block in order of its value.

    ``ids`` are those of the rows, where some repeat.
    """

    def __init__(self, codes: np.ndarray, ids: np.ndarray | None = None):
        n, self.m = codes.shape
        if n > 1 << 16:
            raise ValueError("a block has 65,536 rows at most")
        self.codes = codes
        self.rows = np.argsort(codes, axis=0, kind="stable").T.astype("<u2")
        counts = np.array([np.bincount(codes[:, j], minlength=256) for j in range(self.m)])
        self.stop = np.cumsum(counts, axis=1)
        self.start = self.stop - counts
        self._own(ids)

    def _own(self, ids: np.ndarray | None) -> None:
        self.owner = None
        if ids is not None:
            known, owner = np.unique(ids, return_inverse=True)
            if len(known) < len(ids):
                self.owner, self.owners = owner, len(known)

    def stored(self) -> tuple[bytes, bytes, bytes]:
        return self.codes.tobytes(), self.rows.tobytes(), self.stop.astype("<i4").tobytes()

    @classmethod
    def opened(cls, codes, rows, stop, ids: np.ndarray) -> MultiIndex:
        """An index as it was stored."""
        out = cls.__new__(cls)
        out.codes = np.frombuffer(codes, np.uint8).reshape(len(ids), -1)
        out.m = out.codes.shape[1]
        out.rows = np.frombuffer(rows, "<u2").reshape(out.m, -1)
        out.stop = np.frombuffer(stop, "<i4").reshape(out.m, 256).astype(np.int64)
        out.start = np.concatenate([np.zeros((out.m, 1), np.int64), out.stop[:, :-1]], axis=1)
        out._own(ids)
        return out

    def _by_id(self, distance: np.ndarray) -> np.ndarray:
        """The least distance of each id."""
        if self.owner is None:
            return distance
        out = np.full(self.owners, 255 * self.m, np.int32)
        np.minimum.at(out, self.owner, distance)
        return out

    def within(self, code: np.ndarray, least: int) -> np.ndarray:
        """Rows of all codes within the smallest radius that holds ``least`` rows,
        those of one id counted once."""
        n = len(self.codes)
        distance = np.full(n, 255 * self.m, np.int32)
        for s in range(9):
            values = code[:, None] ^ FLIPS[s]
            index = np.arange(self.m)[:, None]
            starts, stops = self.start[index, values], self.stop[index, values]
            size = (stops - starts).ravel()
            base = (starts + index * n).ravel()
            upto = np.cumsum(size)
            if upto[-1]:
                at = np.repeat(base - (upto - size), size) + np.arange(upto[-1])
                new = np.zeros(n, bool)
                new[self.rows.ravel()[at]] = True
                new &= distance == 255 * self.m
                hit = np.flatnonzero(new)
                distance[hit] = np.bitwise_count(self.codes[hit] ^ code).sum(1)
            radius = self.m * (s + 1) - 1
            each = self._by_id(distance)
            want = min(least, len(each))
            if np.count_nonzero(each <= radius) >= want:
                kth = np.partition(each, want - 1)[want - 1]
                return np.flatnonzero(distance <= kth)
        return np.arange(n)


@operator
def nearest(vectors: DataFrame, k: int = 10, query_step: int = 100, bits: int = BITS, id_col: str = "vec_id", vec_col: str = "embedding", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found by Euclidean
    distance for every row whose id is divisible by ``query_step``.

    Every usable row is indexed.  Rows with a null id, a null or empty vector,
    null or non-finite components, or all zeros take no part; vectors shorter
    than the longest are filled up with zeros.  A query never finds its own id;
    rows that repeat an id count once, with the smallest distance.  Ties go to
    the smaller id; fewer than ``k`` candidates give all.
    """
    vecs = cells.usable(vectors, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    dim = cells.largest_dim(vecs)
    bits = -(-bits // 8) * 8
    sample = vecs.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).select("vec").collect()
    fit = np.zeros((len(sample), dim))
    for row, r in zip(fit, sample, strict=True):
        row[: len(r.vec)] = r.vec
    mean, rotation = learn_rotation(fit, bits)
    kind = cells.stored_as(vectors, vec_col)

    def index(ids: np.ndarray, x: np.ndarray) -> tuple:
        return ids, x, *MultiIndex(codes_of(x, mean, rotation), ids).stored()

    held = cells.blocks(vecs, dim, BLOCK_ROWS, "mih-blocks", kind, "codes binary, rows binary, stops binary", index)
    asked = cells.blocks(vecs.where(F.pmod("vec_id", F.lit(query_step)) == 0).repartition(F.col("vec_id")), dim, QUERY_ROWS, "mih-queries", kind)

    def work(row: dict) -> tuple:
        ids = np.frombuffer(row["ids"], "<i8")
        x = np.frombuffer(row["vecs"], kind).reshape(len(ids), dim)
        q_ids = np.frombuffer(row["q_ids"], "<i8")
        q = np.frombuffer(row["q_vecs"], kind).reshape(len(q_ids), dim).astype(np.float64)
        multi = MultiIndex.opened(row["codes"], row["rows"], row["stops"], ids)
        out: list[tuple] = []
        for qid, qv, code in zip(q_ids, q, codes_of(q, mean, rotation), strict=True):
            rows = multi.within(code, max(TIMES * k, int(PART * len(ids))) + 1)
            rows = rows[ids[rows] != qid]
            score = np.sqrt(((x[rows] - qv) ** 2).sum(1))
            top = np.lexsort((ids[rows], score))
            top = top[np.sort(np.unique(ids[rows][top], return_index=True)[1])][:k]  # a repeated id counts once
            out.append((np.full(len(top), qid), ids[rows][top], score[top]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else ((), (), ())

    return cells.best(cells.search(asked, held, work, "double"), k, True)

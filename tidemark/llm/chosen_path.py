"""N-gram Jaccard join by chosen paths.

A document is the set of its word n-grams.  Equal sets are joined first, by a
digest, and one of each goes on.  Their sets are then split recursively: a node
of the tree samples one or two of the min-hash positions, and a set goes to the
child of each token that it has there, so sets meet with a probability that
grows with their similarity.  Nodes of few sets are compared by brute force;
larger ones are split again; at the last depth they are compared in blocks,
whatever their size.  Several runs with other samples repeat this until the
target recall.

A pair that meets in several nodes is counted in the first of them only, which
each set's list of nodes tells; so neither pairs nor candidates are ever written
out, only each document's number of links and its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .quality_ftrl import _mix as mix
from .quality_ftrl import quoted
from .scratch import materialize, operator
from .skew import HEAVY, join_groups
from .wordsplit import SPACE, char_classes, chunks, code_points, span_hashes

N, SIMILARITY = 5, 0.8
SLOTS = 64
#: Runs of the recursion, its depth, and the sets a node holds to be compared at once.
RUNS, DEPTH, SMALL = 10, 4, 48
#: Sets of a block of a node that is compared in blocks, at most and at least, and
#: the n-grams that a block holds about: long sets stand in smaller blocks.
BLOCK, LEAST_BLOCK, BLOCK_GRAMS = 512, 64, 1 << 18
_ORDER = np.array([0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_rng = np.random.default_rng(20240501)
_A = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64)
#: Positions that the root of each run samples, all different.
_ROOTS = _rng.permutation(SLOTS)


def word_hashes(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, hashes of its words); words are lower case and parted by white space."""
    held: list[np.ndarray] = []
    open_at = -1
    for owners, parts in chunks([t.lower() for t in texts]):
        lens = np.fromiter(map(len, parts), np.int64, len(parts))
        heads = np.cumsum(lens) - lens
        c = code_points("".join(parts))
        blank = char_classes()[c] == SPACE
        first = np.zeros(len(c) + 1, bool)
        first[heads] = True
        start = ~blank
        start[1:] &= blank[:-1] | first[1 : len(c)]
        stop = ~blank
        stop[:-1] &= blank[1:] | first[1 : len(c)]
        starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
        h = mix(span_hashes(c, starts, ends)) if len(starts) else np.zeros(0, np.uint64)
        bounds = np.searchsorted(starts, np.append(heads, len(c)))
        for owner, a, b in zip(owners, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if owner != open_at:
                if open_at >= 0:
                    yield open_at, held[0] if len(held) == 1 else np.concatenate(held)
                open_at, held = owner, []
            held.append(h[a:b])
    if open_at >= 0:
        yield open_at, np.concatenate(held)


def shingles(words: np.ndarray, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``n`` words; of a shorter text, of all its words."""
    if not len(words):
        return words
    k = min(n, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out += words[i : len(words) - k + 1 + i] * (_ORDER[i % len(_ORDER)] + np.uint64(2 * (i // len(_ORDER))))
    return np.unique(mix(out ^ np.uint64(k)))


def set_digest(s: np.ndarray) -> bytes:
    return np.array([mix(s).sum(dtype=np.uint64), mix(s * _ORDER[1] + _ORDER[2]).sum(dtype=np.uint64)]).tobytes()


def min_hashes(s: np.ndarray) -> np.ndarray:
    if len(s) <= 4096:
        return ((s * _A[:, None] + _B[:, None]) >> np.uint64(32)).min(1).astype(np.uint32)
    return np.array([((s * a + b) >> np.uint64(32)).min() for a, b in zip(_A, _B, strict=True)]).astype(np.uint32)


def children(node: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) for each node and the min-hashes of a set in it: one sampled
    position, and a second one in a quarter of the nodes (1.25 on average)."""
    h = mix(node)
    one = (h % np.uint64(SLOTS)).astype(np.int64)
    two = np.flatnonzero((h >> np.uint64(32)) % np.uint64(4) == 0)
    step = ((h[two] >> np.uint64(40)) % np.uint64(SLOTS - 1)).astype(np.int64) + 1
    row = np.concatenate([np.arange(len(node)), two])
    slot = np.concatenate([one, (one[two] + step) % SLOTS])
    return row, mix(node[row] * _ORDER[3] + slot.astype(np.uint64) * _ORDER[4] + low[row, slot])


def roots(low: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) of the roots of all runs."""
    rows, nodes = [], []
    for r in range(runs):
        for slot in {int(_ROOTS[r % SLOTS])} | ({int(_ROOTS[-1 - r // 4])} if r % 4 == 0 else set()):
            rows.append(np.arange(len(low)))
            root = ((r + 1) * int(_ORDER[3]) + slot * int(_ORDER[4])) % (1 << 64)
            nodes.append(mix(low[:, slot] + np.uint64(root)))
    return np.concatenate(rows), np.concatenate(nodes)


def sketches(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text_hash, size, sig, low)``: hash of each text; size, digest and min-hashes of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            size, sig, low = [0] * len(texts), [None] * len(texts), [None] * len(texts)
            for k, words in word_hashes(texts):
                if len(words):
                    s = shingles(words, n)
                    size[k], sig[k], low[k] = len(s), set_digest(s), min_hashes(s).tobytes()
            yield pa.record_batch([b.column(0), b.column(2), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), pa.array(low, pa.binary())], names=["doc_id", "text_hash", "size", "sig", "low"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, size long, sig binary, low binary")


def _low(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, SLOTS).astype(np.uint64)


def _paths(sets: DataFrame, runs: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, size = b.column(0).to_numpy(), b.column(2).to_numpy()
            row, node = roots(_low(b.column(1)), runs) if len(ids) else (np.zeros(0, int), np.zeros(0, np.uint64))
            yield pa.record_batch([pa.array(node.view(np.int64)), pa.array(ids[row]), pa.array(size[row])], names=["node", "vid", "size"])

    return sets.select("vid", "low", "size").mapInArrow(run, "node long, vid long, size long")


def _extend(members: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, node = children(b.column(0).to_numpy().view(np.uint64), _low(b.column(2)))
                yield pa.record_batch([pa.array(node.view(np.int64)), *[pa.array(b.column(k).to_numpy()[row]) for k in (1, 3)]], names=["node", "vid", "size"])

    return members.select("node", "vid", "low", "size").mapInArrow(run, "node long, vid long, size long").distinct()


def candidate_nodes(sets: DataFrame, runs: int, depth: int, small: int) -> DataFrame:
    """``(node, n, top, vid)`` of all nodes to compare by brute force; ``top`` is the
    size of a node's largest set."""
    level = materialize(_paths(sets, runs), "paths-1")
    found = None
    for d in range(1, depth + 1):
        total = level.count()
        # Nodes with the same members give the same pairs, so one of them is enough to
        # compare; all are split, as each samples other positions.
        members = (F.expr("bit_xor(xxhash64(vid))").alias("x"), F.expr("bit_xor(xxhash64(vid, 1L))").alias("y"))
        stats = materialize(level.groupBy("node").agg(F.count("*").alias("n"), F.max("size").alias("top"), *members).where("n > 1"), f"nodes-{d}")
        once = stats.groupBy("x", "y", "n", "top").agg(F.min("node").alias("node")).select("node", "n", "top")
        ends = once if d == depth else once.where(F.col("n") <= small)
        ends = materialize(ends, f"ends-{d}")
        part = join_groups(level, ends, "node", "n", total).select("node", "n", "top", "vid")
        found = part if found is None else found.unionByName(part)
        if d == depth or stats.where(F.col("n") > small).isEmpty():
            break
        more = materialize(stats.where(F.col("n") > small).select("node", "n"), f"split-{d}")
        inside = join_groups(level, more, "node", "n", total).select("node", "vid")
        level = materialize(_extend(inside.join(sets.select("vid", "low", "size"), "vid")), f"paths-{d + 1}")
    return materialize(found, "nodes")


def _in_blocks(nodes: DataFrame, block: int) -> DataFrame:
    """``(cell, node, vid, lo, same)``: one row for each pair of blocks of a
    node that a set belongs to; ``lo``: it is of the first, ``same``: both are one."""
    width = F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(block), F.floor(F.lit(BLOCK_GRAMS) / F.col("top"))))
    parts = F.ceil(F.col("n") / width).cast("int")
    own = nodes.withColumn("own", F.pmod(F.xxhash64("vid", "node"), parts.cast("long")).cast("int"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    return each.select(F.xxhash64("node", lo, hi).alias("cell"), "node", "vid", (F.col("own") == lo).alias("lo"), (lo == hi).alias("same"))


def similar_pairs(sets: list[np.ndarray], nodes: list[set[int]], node: int, first: np.ndarray, same: bool, threshold: float) -> list[tuple[int, int]]:
    """Pairs of at least ``threshold`` whose first common node is ``node``."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    i, j = np.triu_indices(m, 1)
    keep = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
    if not same:
        keep &= first[i] != first[j]
    i, j = i[keep], j[keep]
    if m > 16:
        before = sorted({x for s in nodes for x in s if x < node})
        if before and len(i):
            place = {x: k for k, x in enumerate(before)}
            has = np.zeros((m, len(before)), np.float32)
            for k, s in enumerate(nodes):
                has[k, [place[x] for x in s if x < node]] = 1
            fresh = (has @ has.T)[i, j] == 0
            i, j = i[fresh], j[fresh]
    else:
        fresh = np.fromiter((min(nodes[a] & nodes[b]) == node for a, b in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
        i, j = i[fresh], j[fresh]
    if not len(i):
        return []
    if len(i) <= 4 * m:
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    else:
        common = _common_counts(sets)[i, j]
    good = common >= threshold * (size[i] + size[j] - common) - 1e-9
    return list(zip(i[good].tolist(), j[good].tolist(), strict=True))


def _common_counts(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections, over the tokens that two sets or more have."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    use = count[code] > 1
    col, row = shared[code[use]], owner[use]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        s, e = np.searchsorted(col, [a, a + width])
        x = np.zeros((len(sets), width), np.float32)
        x[row[s:e], col[s:e] - a] = 1
        total += x @ x.T
    return total.astype(np.int64)


def _verify(threshold: float):
    def group(rows: list[tuple]) -> tuple[list[int], list[int], list[int]]:
        node, same = rows[0][1], rows[0][4]
        rows = list({r[2]: r for r in rows}.values())
        sets = [np.frombuffer(r[7], "<u8") for r in rows]
        nodes = [set(np.frombuffer(r[6], "<i8").tolist()) for r in rows]
        pairs = similar_pairs(sets, nodes, node, np.array([r[3] for r in rows]), same, threshold)
        links: dict[int, int] = {}
        root = list(range(len(rows)))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for a, b in pairs:
            links[a] = links.get(a, 0) + rows[b][5]
            links[b] = links.get(b, 0) + rows[a][5]
            x, y = find(a), find(b)
            if x != y:
                x, y = (x, y) if rows[x][2] < rows[y][2] else (y, x)
                root[y] = x
        own = list(links)
        return [rows[k][2] for k in own], [links[k] for k in own], [rows[find(k)][2] for k in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: tuple[list, list, list] = ([], [], [])

        def flush() -> Iterator[pa.RecordBatch]:
            if out[0]:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["vid", "links", "root"])
                for c in out:
                    c.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][0] != row[0]:
                    for c, got in zip(out, group(held), strict=True):
                        c.extend(got)
                    held = []
                    if len(out[0]) > 10_000:
                        yield from flush()
                held.append(row)
        if held:
            for c, got in zip(out, group(held), strict=True):
                c.extend(got)
        yield from flush()

    return run


@operator
def ngram_jaccard_join(docs: DataFrame, n: int = N, threshold: float = SIMILARITY, runs: int = RUNS, depth: int = DEPTH, small: int = SMALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, n_links`` for every row of ``docs``.

    ``n_links`` counts the other documents whose Jaccard similarity is found to
    be at least ``threshold``; links are never wrong, and with the given runs a
    pair at the threshold is missed with a probability below one in a hundred.
    ``class_id`` is the smallest ``doc_id`` of the component of links.

    Words are lower case and parted by white space; a text of fewer than ``n``
    words has one n-gram, all its words.  Null, empty and blank texts have no
    links and are their own class; so are rows with a null id, whose class is
    null.  Repeated rows are copies of each other; rows that share an id with
    other texts are documents of their own.  Other columns are ignored; an empty
    table gives no rows.
    """
    return _classes(docs, n, threshold, runs, depth, small, id_col, text_col).select("doc_id", "class_id", "n_links")


def _classes(docs: DataFrame, n: int, threshold: float, runs: int, depth: int, small: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_hash, root, class_id, n_links`` for every row; ``root`` is the
    number of the class, as two classes may begin with the same id, or null where
    a row isn't compared."""
    sk = materialize(sketches(docs, n, id_col, text_col), "sketches")
    compared = (F.col("size") > 0) & F.col("doc_id").isNotNull()
    apart = sk.where(~compared).select("doc_id", "text_hash", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    rows = sk.where(compared)
    firsts = rows.groupBy("sig").agg(F.min(F.struct("doc_id", "low", "size")).alias("f"), F.count("*").alias("copies"))
    sets = materialize(firsts.select("sig", F.col("f.doc_id").alias("rep"), F.col("f.low").alias("low"), F.col("f.size").alias("size"), "copies"), "sets")
    sets = materialize(sets.withColumn("vid", F.monotonically_increasing_id()), "numbered-sets")
    nodes = candidate_nodes(sets, runs, depth, small)
    cells = _in_blocks(nodes, BLOCK)
    jobs = cells.groupBy("vid").agg(F.collect_list(F.struct("cell", "node", "lo", "same")).alias("cells"))
    jobs = jobs.join(sets.select("vid", "rep", "sig", "copies"), "vid")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cell", "node", "vid", "lo", "same", "copies", "nodes", "set"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
        for b in batches:
            vid, sig, copies, at = (b.column(k).to_pylist() for k in (1, 2, 3, 4))
            out: list[tuple] = []
            size = 0
            for k, words in word_hashes([t or "" for t in b.column(0).to_pylist()]):
                s = shingles(words, n)
                if set_digest(s) != sig[k]:  # another text with the same id
                    continue
                raw = s.astype("<u8").tobytes()
                nodes = np.array(sorted({c["node"] for c in at[k]}), "<i8").tobytes()
                out += [(c["cell"], c["node"], vid[k], c["lo"], c["same"], copies[k], nodes, raw) for c in at[k]]
                size += len(at[k]) * (len(raw) + len(nodes))
                if size > 8 << 20:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, size = [], 0
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    work = texts.join(jobs, "rep").select("text", "vid", "sig", "copies", "cells")
    dealt = work.mapInArrow(deal, "cell long, node long, vid long, lo boolean, same boolean, copies long, nodes binary, set binary")
    found = materialize(dealt.repartition(F.col("cell")).sortWithinPartitions("cell").mapInArrow(_verify(threshold), "vid long, links long, root long"), "links")
    linked = found.groupBy("vid").agg(F.sum("links").alias("links"))
    roots_ = connected_components(found.select(F.col("vid").alias("u"), F.col("root").alias("v")))
    known = sets.select("vid", "sig", "rep", "copies").join(linked, "vid", "left").join(roots_.withColumnRenamed("node", "vid"), "vid", "left")
    known = materialize(known.withColumn("root", F.coalesce("root", "vid")), "set-links")
    # Roots are numbers of sets; the class is named by its smallest document.
    names = known.where("links is not null").groupBy("root").agg(F.min("rep").alias("first"), F.count("*").alias("size"))
    single = known.where("links is null").select("sig", "copies", "root", F.col("rep").alias("class_id"), (F.col("copies") - 1).alias("n_links"))
    inside = known.where("links is not null")
    joined = join_groups(inside, materialize(names, "class-names"), "root", "size", max(1, inside.count()))
    info = single.unionByName(joined.select("sig", "copies", "root", F.col("first").alias("class_id"), (F.col("links") + F.col("copies") - 1).alias("n_links")))
    info = materialize(info, "set-classes")
    out = join_groups(rows.select("doc_id", "text_hash", "sig"), info, "sig", "copies", rows.count())
    return out.select("doc_id", "text_hash", "root", "class_id", "n_links").unionByName(apart)


@operator
def keep_one(docs: DataFrame, n: int = N, threshold: float = SIMILARITY, runs: int = RUNS, depth: int = DEPTH, small: int = SMALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each class, all columns kept: of the rows with the
    smallest id one of those with the smallest text hash.

    Texts decide, not ids: a text whose id has another text that goes may stay.
    Null, empty and blank texts are no copies of others, so only repeats of both
    id and text go; rows with a null id all stay.
    """
    found = _classes(docs, n, threshold, runs, depth, small, id_col, text_col).where("doc_id is not null")
    # An id and a text belong to one class.
    texts = found.groupBy("doc_id", "text_hash").agg(F.min("root").alias("root"), F.min("class_id").alias("class_id"), F.count("*").alias("n"))
    texts = materialize(texts, "class-texts")
    later = texts.where("doc_id <> class_id").select("doc_id", "text_hash", "n", F.lit(False).alias("stays"))
    first = texts.where("doc_id = class_id")
    several = first.where("root is not null").groupBy("root").agg(F.min("text_hash").alias("least"), F.count("*").alias("size")).where("size > 1")
    others = join_groups(first, materialize(several, "class-several"), "root", "size", max(1, first.count())).where("text_hash <> least")
    others = materialize(others.select("doc_id", "text_hash", "n", F.lit(False).alias("stays")), "class-others")
    again = first.where("n > 1").select("doc_id", "text_hash", "n").join(others, ["doc_id", "text_hash"], "left_anti").withColumn("stays", F.lit(True))
    # What is not one row to keep: copies, and repeats of a row of which one stays.
    marked = materialize(later.unionByName(others).unionByName(again).withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"}), "copies")
    keys = ["_doc", "_hash"]
    # Rows travel as one structure, so that no name of a column can clash.
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("row"), F.col(id_col).cast("long").alias("_doc"), F.xxhash64(text_col).alias("_hash"))
    is_heavy = F.col("n") > texts.agg(F.sum("n")).first()[0] / HEAVY if not marked.isEmpty() else F.lit(False)
    heavy = marked.where(is_heavy).select(*keys, "stays")
    light = marked.where(~is_heavy).select(*keys, "stays")
    some_heavy = not heavy.isEmpty()
    cold = rows.join(F.broadcast(heavy), keys, "left_anti") if some_heavy else rows
    out = cold.join(light, keys, "left_anti").select("row")
    repeated = [rows.join(F.broadcast(heavy.where("stays")), keys)] if some_heavy else []
    if not light.where("stays").isEmpty():
        repeated.append(rows.join(light.where("stays"), keys))
    for part in repeated:
        out = out.unionByName(part.groupBy(*keys).agg(F.any_value("row").alias("row")).select("row"))
    return out.select("row.*")

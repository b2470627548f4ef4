"""A stated set of query vectors against all vectors, in blocks.

Vectors are packed into blocks of bounded size, one row each, and so are the
queries.  What a search needs of a block (an index, an order, a rotation) is made
once, when the block is, and stored with it.  Every pair of a query block and a
vector block that can matter is one unit of work of bounded memory; it returns its
best few rows a query, and these are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .scratch import materialize

BLOCK = "block long, ids binary, vecs binary"
#: Bytes of blocks that go to all others at a time, and the most vector blocks
#: of a task, where there are so many that each core gets over two tasks.
TURN_BYTES, TASK_BLOCKS = 16 << 20, 128
#: Bytes of blocks that go to Python at a time; a batch has one block at least.
BATCH_BYTES = 4 << 20


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, vec array<double>)`` without null, NaN or infinite components."""
    vec = F.col(vec_col).cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & vec.isNotNull() & fine)


def matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of ``dim`` numbers; shorter vectors are filled up with zeros."""
    lens = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(lens) and (lens == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lens), dim))
    rows = np.repeat(np.arange(len(lens)), lens)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def largest_dim(vectors: DataFrame) -> int:
    return vectors.agg(F.max(F.size("vec"))).first()[0] or 1


def stored_as(df: DataFrame, vec_col: str) -> str:
    """The type that holds the components of ``vec_col`` exactly."""
    return "<f4" if isinstance(df.select(vec_col).schema[0].dataType.elementType, FloatType) else "<f8"


def blocks(vectors: DataFrame, dim: int, size: int, name: str, kind: str, more: str = "", make: Callable | None = None) -> DataFrame:
    """Written table of ``(block, ids, vecs)``; a block holds up to ``size``
    vectors in the order of its partition, ids as int64 and vectors as ``kind``.

    ``make(ids, vecs)`` may put them in another order; it returns both and the
    values of the columns ``more`` (a schema)."""
    schema = BLOCK + (f", {more}" if more else "")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        ids, vecs, held = [], [], 0

        def flush(n: int, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal ids, vecs, held, part
            if not held:
                return
            i, v = np.concatenate(ids), np.concatenate(vecs)
            at = 0
            while len(i) - at >= n or last and at < len(i):
                own_ids, own, *extra = make(i[at : at + n], v[at : at + n]) if make else (i[at : at + n], v[at : at + n])
                row = [pa.array([own_ids.astype("<i8").tobytes()]), pa.array([own.astype(kind).tobytes()]), *[pa.array([x]) for x in extra]]
                yield pa.record_batch([pa.array([part], pa.int64()), *row], names=names)
                part, at = part + 1, at + n
            ids, vecs = ([i[at:]], [v[at:]]) if at < len(i) else ([], [])
            held = max(0, len(i) - at)

        for b in batches:
            ids.append(b.column(0).to_numpy())
            vecs.append(matrix(b.column(1), dim))
            held += b.num_rows
            if held >= size:
                yield from flush(size, False)
        yield from flush(size, True)

    return materialize(vectors.mapInArrow(run, schema), name)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside sends few blocks to Python at a time: each is a batch's worth."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def search(queries: DataFrame, vectors: DataFrame, work: Callable, kind: str, reach: Callable[[Column], Column] | None = None) -> DataFrame:
    """Run ``work(row)`` for every pair of a query block, whose columns but ``block``
    are ``q_`` and their name, and a vector block, and, if ``reach`` is given, only
    for pairs for which it is true (of a struct of the query block's columns that
    aren't binary, beside the vector block's columns); it returns ``(query ids,
    vector ids, scores)``.

    With ``reach``, vector blocks stay where they lie and a bounded number of query
    blocks at a time goes to all of them; a row then has ``q_block``, what ``work``
    holds lasts for a task, and ``work.rest()``, if there is one, gives more rows
    after the task's last pair."""
    schema = f"query_id long, vec_id long, score {kind}"
    spark = vectors.sparkSession

    def rows(q, v, s) -> Iterator[pa.RecordBatch]:
        if len(q):
            yield pa.record_batch([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s)], names=["query_id", "vec_id", "score"])

    def values(b: pa.RecordBatch, k: int) -> dict:
        return {n: x.as_buffer() if pa.types.is_binary((x := b.column(i)[k]).type) else x.as_py() for i, n in enumerate(b.schema.names)}

    if reach is None:
        cells = max(1, vectors.count())
        each = F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell")
        asked = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns if c != "block"], each)
        held = vectors.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int")).drop("block")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    yield from rows(*work(values(b, k)))

        return asked.join(held, "cell").drop("cell").mapInArrow(run, schema)

    turns, size = [], TURN_BYTES + 1
    for r in queries.select("block", F.length("vecs").alias("n")).orderBy("block").collect():
        if size + r.n > TURN_BYTES:
            turns, size = [*turns, []], 0
        turns[-1].append(r.block)
        size += r.n
    cores = max(1, spark.sparkContext.defaultParallelism)
    tasks = cores * max(2, -(-vectors.count() // (TASK_BLOCKS * cores)))  # as many for each core

    def search_turn(turn: list[int]) -> DataFrame:
        asked = [r.asDict() for r in queries.where(F.col("block").isin(turn)).collect()]
        facts = F.array(*[F.struct(F.lit(n).alias("at"), *[F.lit(v).alias(c) for c, v in r.items() if not isinstance(v, bytearray)]) for n, r in enumerate(asked)])
        known = spark.sparkContext.broadcast([{f"q_{c}": bytes(v) if isinstance(v, bytearray) else v for c, v in r.items()} for r in asked])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    row = values(b, k)
                    for n in row["asked"]:
                        yield from rows(*work(row | known.value[n]))
            for more in work.rest() if hasattr(work, "rest") else ():
                yield from rows(*more)

        pairs = vectors.coalesce(tasks).withColumn("asked", F.transform(F.filter(facts, reach), lambda q: q["at"]))
        with small_batches(spark):
            return materialize(pairs.where(F.size("asked") > 0).mapInArrow(run, schema), "cells-found")

    return reduce(DataFrame.unionByName, [search_turn(turn) for turn in turns]) if turns else spark.createDataFrame([], schema)


def best(found: DataFrame, k: int, nearest_first: bool) -> DataFrame:
    """The ``k`` best rows of each query with ranks; ties to the smaller id, and
    a repeated id counts once with its best score."""
    order: list[Column] = [F.col("score").asc() if nearest_first else F.col("score").desc(), F.col("vec_id").asc()]
    once = found.groupBy("query_id", "vec_id").agg((F.min if nearest_first else F.max)("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

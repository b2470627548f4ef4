"""Upserts, deletes, flushes and rewrites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import read


def upsert(rows: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """Last write wins: of each key the values with the greatest ``order``."""
    return rows.groupBy(key).agg(F.max(order).alias(order), *[F.max_by(v, order).alias(v) for v in values])


def delete_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Physical delete: rows whose key isn't in ``keys``."""
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def missing_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Keys to delete that don't exist."""
    return keys.select(key).distinct().join(rows.select(key), key, "left_anti")


def tombstones(keys: DataFrame, seq: int, level: int = 0, file_num: int = 0) -> DataFrame:
    """Logical delete: entries of the deleted kind, to append to a log."""
    return keys.select(
        F.lit(level).alias("level"), F.lit(file_num).cast("long").alias("file_num"), "ukey", F.lit(seq).cast("long").alias("seq"),
        F.lit(read.DELETED).cast("byte").alias("kind"), F.lit(None).cast("double").alias("value"),
    )


def memory_stats(log: DataFrame, group: str, value_bytes: int = 8) -> DataFrame:
    """Entries and bytes (keys and values) of each memtable."""
    return log.groupBy(group).agg(F.count("*").alias("entries"), F.sum(F.octet_length("ukey") + value_bytes).cast("long").alias("bytes"))


def reset(rows: DataFrame) -> DataFrame:
    """A memtable emptied: the same columns, no rows."""
    return rows.limit(0)


def flush(log: DataFrame, path: str, partitions: int | None = None) -> DataFrame:
    """Write sorted tables and return their metadata.

    Keys are range-partitioned, so files are disjoint; within a file rows are
    sorted by key and newest first, which gives Parquet narrow min/max ranges.
    """
    order = [F.col("ukey").asc(), F.col("seq").desc(), F.col("kind").desc()]
    parts = log.repartitionByRange(partitions, "ukey") if partitions else log.repartitionByRange("ukey")
    parts.sortWithinPartitions(*order).write.mode("errorifexists").parquet(path)
    written = log.sparkSession.read.parquet(path)
    return written.groupBy(F.input_file_name().alias("file")).agg(F.min("ukey").alias("imin_k"), F.max("ukey").alias("imax_k"), F.count("*").alias("entries"))


def out_of_order(rows: DataFrame, group: str, key: str, seq: str, place: str) -> DataFrame:
    """Rows that don't follow the one before them in (key, newest first), where
    ``place`` is the position that a row has in its group."""
    w = Window.partitionBy(group).orderBy(place)
    before_key, before_seq = F.lag(key).over(w), F.lag(seq).over(w)
    wrong = (before_key > F.col(key)) | ((before_key == F.col(key)) & (before_seq <= F.col(seq)))
    return rows.withColumn("_bad", F.coalesce(wrong, F.lit(False))).where("_bad").drop("_bad")


def compact(log: DataFrame, inputs: DataFrame, bottom: bool, pins: Sequence[int] = ()) -> DataFrame:
    """What a compaction of the files ``inputs.file_num`` writes.

    Of each key stays what a read finds now or at a pinned sequence number.  An
    entry is found by reads from its own number up to that of the first entry that
    hides it: a newer one of its level, or any of a smaller level.

    A tombstone goes only at the bottom level, where nothing can lie below, and
    only if it hides no older value that stays for a snapshot.
    """
    chosen = log.join(inputs.select("file_num").distinct(), "file_num", "left_semi")
    # At equal numbers in a level the live kind counts, as in reads.
    same = Window.partitionBy("ukey", "level", "seq").orderBy(F.desc("kind"), F.desc("file_num"))
    once = chosen.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    newer = F.lead("seq").over(Window.partitionBy("ukey", "level").orderBy("seq"))
    above = F.min("seq").over(Window.partitionBy("ukey").orderBy("level").rangeBetween(Window.unboundedPreceding, -1))
    until = F.least(newer, above)  # null: never hidden
    pinned = F.lit(False)
    if pins:
        pinned = F.exists(F.array(*[F.lit(p).cast("long") for p in sorted(set(pins))]), lambda p: (p >= F.col("seq")) & (p < F.col("_until")))
    kept = once.withColumn("_until", until).where(F.col("_until").isNull() | pinned).drop("_until")
    if not bottom:
        return kept
    oldest = F.min(F.when(F.col("kind") == read.LIVE, F.col("seq"))).over(Window.partitionBy("ukey"))
    return kept.withColumn("_o", oldest).where((F.col("kind") == read.LIVE) | (F.col("_o") < F.col("seq"))).drop("_o")

"""Point reads, as-of reads and the resolution of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranges import as_of as as_of_keys
from ..plans.ranges import overlap_join

LIVE, DELETED = 1, 0


def as_of(log: DataFrame, seq: int | None) -> DataFrame:
    """Entries that a read at ``seq`` sees; both kinds at ``seq`` itself."""
    return log if seq is None else log.where(F.col("seq") <= seq)


def resolve(log: DataFrame, seq: int | None = None) -> DataFrame:
    """The entry of each key that a read finds, tombstones included.

    A hit in a smaller level hides deeper ones, whatever their sequence numbers.
    Levels of at most 0 overlap, so there the newest of all files counts; equal
    numbers go to the live kind.  Key predicates may stand before this; those on
    values must follow, or older versions come back to life.
    """
    newest = Window.partitionBy("ukey").orderBy("level", F.desc("seq"), F.desc("kind"), F.desc("file_num"))
    return as_of(log, seq).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def live(resolved: DataFrame) -> DataFrame:
    """Tombstones drop out after resolution, never before."""
    return resolved.where(F.col("kind") == LIVE)


def scan_latest(log: DataFrame, seq: int | None = None) -> DataFrame:
    """All live keys as of ``seq``, one row each."""
    return live(resolve(log, seq))


def get(log: DataFrame, key: str, seq: int | None = None) -> DataFrame:
    """The live entry of one key, or no row."""
    return scan_latest(log.where(F.col("ukey") == key), seq)


def get_key(log: DataFrame, key: str, seq: int | None = None) -> DataFrame:
    """Existence only: no value is read."""
    return get(log.drop("value"), key, seq).select("ukey", "seq")


def scan_keys(log: DataFrame, seq: int | None = None) -> DataFrame:
    """All live keys without values, which are never read."""
    return scan_latest(log.select("level", "file_num", "ukey", "seq", "kind"), seq).select("ukey", "seq")


def multi_get(log: DataFrame, keys: DataFrame, seq: int | None = None) -> DataFrame:
    """Live entries of the keys in ``keys.ukey``; a semi join, whose side Spark
    broadcasts if its size allows."""
    return scan_latest(log.join(keys.select("ukey").distinct(), "ukey", "left_semi"), seq)


def staged_multi_get(log: DataFrame, keys: DataFrame, levels: list[int], seq: int | None = None) -> DataFrame:
    """:func:`multi_get` level by level: keys that a level answers, with a value
    or a tombstone, aren't looked for below.  Worth it where hot levels answer
    most keys and deep ones are large; each level is one more join."""
    todo, out = keys.select("ukey").distinct(), None
    for level in levels:
        hit = resolve(log.where(F.col("level") == level).join(todo, "ukey", "left_semi"), seq)
        out = hit if out is None else out.unionByName(hit)
        todo = todo.join(hit.select("ukey"), "ukey", "left_anti")
    return live(out)


def history(log: DataFrame) -> DataFrame:
    """Every version with its neighbours in time."""
    w = Window.partitionBy("ukey").orderBy("seq")
    return log.select(
        "ukey", "seq", "kind", F.lag("seq").over(w).alias("prev_seq"), F.lead("seq").over(w).alias("next_seq"),
        F.row_number().over(Window.partitionBy("ukey").orderBy(F.desc("seq"))).alias("age"),
    )


def files_for_keys(meta: DataFrame, keys: DataFrame, more: list[str] = ()) -> DataFrame:
    """Files to look into for each key, in the order of the walk: level, then
    newer files first.  ``meta`` has one row per file; ``more`` columns of ``keys``
    tell equal keys apart."""
    order = Window.partitionBy("ukey", *more).orderBy("level", F.desc("num"))
    hit = overlap_join(keys.select("ukey", *more), meta.select("level", "num", "imin_k", "imax_k"), ("ukey", "ukey"), ("imin_k", "imax_k"))
    return hit.select("ukey", *more, "level", "num", F.row_number().over(order).alias("step"))


def find_ge(rows: DataFrame, key: Column | str | int, column: str = "ukey") -> DataFrame:
    """First entry at or after ``key``."""
    return rows.where(F.col(column) >= key).orderBy(column).limit(1)


def find_lt(rows: DataFrame, key: Column | str | int, column: str = "ukey") -> DataFrame:
    """Last entry before ``key``."""
    return rows.where(F.col(column) < key).orderBy(F.desc(column)).limit(1)


def find_last(rows: DataFrame, column: str = "ukey") -> DataFrame:
    return rows.orderBy(F.desc(column)).limit(1)


def neighbours(probes: DataFrame, keys: DataFrame, probe: str, key: str) -> DataFrame:
    """As-of join of many probes: the greatest key below and the least key at or
    above each one.  Keys and probes are merged in ranges, within which two windows
    carry the neighbour along; the ends of the ranges, one row each, carry it across."""
    return as_of_keys(probes, keys, probe, key)

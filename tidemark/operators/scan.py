"""Range, prefix and merged scans."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranges import with_neighbours
from . import read


@dataclass(frozen=True)
class Range:
    """Keys from ``start`` up to, not including, ``limit``; None is unbounded."""

    start: Any = None
    limit: Any = None

    @property
    def is_empty(self) -> bool:
        """No key can lie in it.  A range without bounds is not empty."""
        return self.limit is not None and self.start is not None and self.start >= self.limit or self.limit in (b"", "")

    def clamp(self, key: Any) -> Any:
        """Where a seek to ``key`` starts."""
        return key if self.start is None or key is not None and key > self.start else self.start


def prefix_range(prefix: bytes | str) -> Range:
    """All keys that begin with ``prefix``: its last byte below 0xff is raised and
    the rest dropped; without such a byte there is no limit."""
    raw = prefix.encode() if isinstance(prefix, str) else prefix
    head = raw.rstrip(b"\xff")
    limit = head[:-1] + bytes([head[-1] + 1]) if head else None
    if isinstance(prefix, str) and limit is not None:
        last = ord(prefix[-1])
        return Range(prefix, prefix[:-1] + chr(last + 1 if last + 1 != 0xD800 else 0xE000) if last < 0x10FFFF else None)
    return Range(prefix, limit)


def in_range(rows: DataFrame, keys: Range, column: str = "ukey") -> DataFrame:
    """Plain comparisons, which reach the Parquet scan as pushed filters."""
    if keys.start is not None:
        rows = rows.where(F.col(column) >= F.lit(keys.start))
    if keys.limit is not None:
        rows = rows.where(F.col(column) < F.lit(keys.limit))
    return rows.limit(0) if keys.is_empty else rows


def prune_files(meta: DataFrame, keys: Range) -> DataFrame:
    """Files of ``meta`` that can hold keys of the range."""
    if keys.start is not None:
        meta = meta.where(F.col("imax_k") >= F.lit(keys.start))
    if keys.limit is not None:
        meta = meta.where(F.col("imin_k") < F.lit(keys.limit))
    return meta.limit(0) if keys.is_empty else meta


def merged_scan(log: DataFrame, keys: Range = Range(), seq: int | None = None) -> DataFrame:
    """Live keys of a range as of ``seq``, all levels merged.  Not sorted: sort
    the result where order matters, which costs a range exchange."""
    return read.scan_latest(in_range(log, keys), seq)


def level_scan(log: DataFrame, level: int, keys: Range = Range()) -> DataFrame:
    """Entries of one level, versions and tombstones included."""
    return in_range(log.where(F.col("level") == level), keys)


def positions(rows: DataFrame, group: str, key: str = "ukey") -> DataFrame:
    """Cursor view: position, previous and next key within each ``group``."""
    return with_neighbours(rows, group, key)


def reversed_scan(rows: DataFrame, key: str = "ukey") -> DataFrame:
    """``key, pos``: all keys from the last to the first with their position."""
    counted = with_neighbours(rows.select(F.lit(0).alias("_g"), key), "_g", key)
    n = rows.count()
    return counted.select(key, (F.lit(n + 1) - F.col("pos")).cast("int").alias("pos"))


def of_array(lists: DataFrame, column: str, name: str) -> DataFrame:
    """Rows of an array column with their index from 0; null or empty: none."""
    kept = [c for c in lists.columns if c != column]
    return lists.select(*kept, F.posexplode(column).alias("pos", name)).withColumn("pos", F.col("pos").cast("long"))


def ends(rows: DataFrame, key: str = "ukey") -> DataFrame:
    """First and last key and the number of rows, one row."""
    return rows.agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count("*").alias("entries"))


def empty(rows: DataFrame, error: Exception | None = None) -> DataFrame:
    """No rows of the same columns; with ``error`` it is raised instead, at once."""
    if error is not None:
        raise error
    return rows.limit(0)

"""Joins, running sums and neighbours over ordered keys, in bounded ranges.

The key space is cut into segments.  Within a segment joins are equi-joins and
windows see its rows only; what a segment has to know of those before it, one row a
segment and group, is carried across.  So no task holds more than a segment of a
group, whatever the size of the group.

Segments of metadata, one row a file, are cut at a bounded sample of its keys, which
is part of the plan.  Those of the data itself are Spark's own ranges, as many as
there are shuffle partitions; a written table keeps what was dealt where.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workdir import unused_path

#: Cuts of the key space at most; they are part of the plan.
CUTS = 256


def cuts_of(rows: DataFrame, key: str, n: int = CUTS) -> list:
    """Up to ``n`` keys, those with the smallest hashes, sorted."""
    found = rows.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(n).collect()
    return sorted(r[0] for r in found)


def segment(key: Column, cuts: list) -> Column:
    """Number of cuts at or before ``key``."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= key)) if cuts else F.lit(0)


def in_segments(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` in ranges of ``key``, with the number of the range as ``_segment``; equal
    keys lie in one."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = unused_path(spark, "segments")
    ranged = rows.repartitionByRange(n, key).withColumn("_segment", F.spark_partition_id())
    ranged.write.parquet(path)
    return spark.read.schema(ranged.schema).parquet(path)


def overlap_join(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], cuts: list | None = None) -> DataFrame:
    """Inner join of rows whose closed ranges share a key.

    Columns of the two sides must have different names.  A key is a range that
    starts and ends at it.  Each range goes to the segments that it meets, and a
    pair is kept in the first segment that both meet; so the work is linear in
    ranges and hits.
    """
    (a, b), (c, d) = left_range, right_range
    cuts = cuts_of(right, c) if cuts is None else cuts

    def spread(df: DataFrame, low: str, high: str, first: str) -> DataFrame:
        at = df.withColumn(first, segment(F.col(low), cuts))
        last = F.col(first) if low == high else F.greatest(F.col(first), segment(F.col(high), cuts))
        return at.withColumn("_segment", F.explode(F.sequence(F.col(first), last)))

    usable = lambda df, low, high: df.where(F.col(low) <= F.col(high))
    both = spread(usable(left, a, b), a, b, "_left").join(spread(usable(right, c, d), c, d, "_right"), "_segment")
    hit = both.where((F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & (F.col("_segment") == F.greatest("_left", "_right")))
    return hit.drop("_segment", "_left", "_right")


def _before(order: str = "_segment", *groups: str) -> Window:
    return Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def running_totals(probes: DataFrame, points: DataFrame, key: str, value: str, name: str, groups: list[str], inclusive: bool, cuts: list | None = None) -> DataFrame:
    """``probes`` (``groups``, ``key``; distinct) with ``name``, the sum of ``value`` over
    the ``points`` of the group whose key is below the probe's, or at it if
    ``inclusive``."""
    cuts = cuts_of(points, key) if cuts is None else cuts
    cols = [*groups, key]
    # At equal keys points come before the probes that count them.
    both = points.select(*cols, F.col(value).cast("long").alias("_v"), F.lit(0 if inclusive else 1).alias("_o"), F.lit(False).alias("_probe")).unionByName(
        probes.select(*cols, F.lit(None).cast("long").alias("_v"), F.lit(1 if inclusive else 0).alias("_o"), F.lit(True).alias("_probe"))
    )
    rows = both.withColumn("_segment", segment(F.col(key), cuts))
    within = Window.partitionBy(*groups, "_segment").orderBy(key, "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.groupBy(*groups, "_segment").agg(F.sum("_v").alias("_t"))
    carried = totals.select(*groups, "_segment", F.sum("_t").over(_before("_segment", *groups)).alias("_c"))
    summed = rows.withColumn("_s", F.sum("_v").over(within)).where("_probe")
    out = summed.join(carried, [*groups, "_segment"])
    return out.select(*cols, (F.coalesce("_s", F.lit(0)) + F.coalesce("_c", F.lit(0))).cast("long").alias(name))


def numbered(rows: DataFrame, groups: list[str], key: str, order: list[Column], name: str = "pos", cuts: list | None = None) -> DataFrame:
    """``rows`` with their number from 1 within ``groups`` by ``order``, which begins
    with ``key``."""
    cuts = cuts_of(rows, key) if cuts is None else cuts
    at = rows.withColumn("_segment", segment(F.col(key), cuts))
    counts = at.groupBy(*groups, "_segment").agg(F.count("*").alias("_n"))
    carried = counts.select(*groups, "_segment", F.coalesce(F.sum("_n").over(_before("_segment", *groups)), F.lit(0)).alias("_c"))
    own = F.row_number().over(Window.partitionBy(*groups, "_segment").orderBy(*order))
    joined = at.withColumn("_own", own).join(carried, [*groups, "_segment"])
    return joined.withColumn(name, (F.col("_own") + F.col("_c")).cast("long")).drop("_own", "_c", "_segment")


def with_neighbours(rows: DataFrame, group: str, key: str) -> DataFrame:
    """``group, key, pos, prev_key, next_key``: number, and the keys before and after."""
    at = in_segments(rows.select(group, key), key)
    ends = at.groupBy(group, "_segment").agg(F.count("*").alias("_n"), F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    w = Window.partitionBy(group).orderBy("_segment")
    carried = ends.select(group, "_segment", F.coalesce(F.sum("_n").over(_before("_segment", group)), F.lit(0)).alias("_c"), F.lag("_hi").over(w).alias("_prev"), F.lead("_lo").over(w).alias("_next"))
    own = Window.partitionBy(group, "_segment").orderBy(key)
    inside = at.select("*", F.row_number().over(own).alias("_own"), F.lag(key).over(own).alias("_lag"), F.lead(key).over(own).alias("_lead"))
    out = inside.join(carried, [group, "_segment"])
    return out.select(group, key, (F.col("_own") + F.col("_c")).cast("int").alias("pos"), F.coalesce("_lag", "_prev").alias("prev_key"), F.coalesce("_lead", "_next").alias("next_key"))


def as_of(probes: DataFrame, keys: DataFrame, probe: str, key: str) -> DataFrame:
    """``probe, below, at_or_above``: of each distinct probe the greatest key below it
    and the least key at or above it, or null."""
    both = keys.select(F.col(key).alias("k"), F.lit(1).alias("is_key")).union(probes.select(F.col(probe).alias("k"), F.lit(0).alias("is_key"))).distinct()
    rows = in_segments(both, "k")
    own = F.when(F.col("is_key") == 1, F.col("k"))
    ends = rows.groupBy("_segment").agg(F.min(own).alias("lo"), F.max(own).alias("hi"))
    # One row a segment: the nearest keys of the segments before and behind.
    up, down = Window.orderBy("_segment"), Window.orderBy(F.desc("_segment"))
    edges = ends.select(
        "_segment", F.last("hi", True).over(up.rowsBetween(Window.unboundedPreceding, -1)).alias("edge_lt"),
        F.last("lo", True).over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("edge_ge"),
    )
    w = Window.partitionBy("_segment")
    lt = F.last(own, True).over(w.orderBy("k", "is_key").rowsBetween(Window.unboundedPreceding, -1))
    # Descending, as a frame up to the end of a partition takes quadratic time.
    ge = F.last(own, True).over(w.orderBy(F.desc("k"), F.desc("is_key")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = rows.withColumn("lt", lt).withColumn("ge", ge).where("is_key = 0").join(F.broadcast(edges), "_segment")
    return out.select(F.col("k").alias(probe), F.coalesce("lt", "edge_lt").alias("below"), F.coalesce("ge", "edge_ge").alias("at_or_above"))

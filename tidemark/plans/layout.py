"""Files in levels: overlaps, offsets, seek budgets and compaction scores.

Level 0 may hold overlapping files; in deeper levels they are disjoint.  Key
ranges of files are closed at both ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..options import Options
from .ranges import cuts_of, overlap_join, running_totals, segment


def overlapping(meta: DataFrame, low, high) -> DataFrame:
    """Files that share a key with the closed range; None is unbounded."""
    if low is not None:
        meta = meta.where(F.col("imax_k") >= F.lit(low))
    if high is not None:
        meta = meta.where(F.col("imin_k") <= F.lit(high))
    return meta


def overlap_pairs(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """(num, other) of files of two levels that share a key."""
    a = upper.select("num", "imin_k", "imax_k")
    b = lower.select(F.col("num").alias("other"), F.col("imin_k").alias("lo"), F.col("imax_k").alias("hi"))
    return overlap_join(a, b, ("imin_k", "imax_k"), ("lo", "hi")).select("num", "other")


def islands(meta: DataFrame, group: str = "level", cuts: list | None = None) -> DataFrame:
    """``meta`` with the number of its island: files that overlap or touch, also
    through others.  A file begins an island if it begins behind the greatest end
    so far; that and the number of islands are carried from segment to segment."""
    cuts = cuts_of(meta, "imin_k") if cuts is None else cuts
    at = meta.withColumn("_segment", segment(F.col("imin_k"), cuts))
    before = Window.partitionBy(group).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    ends = at.groupBy(group, "_segment").agg(F.max("imax_k").alias("_hi"))
    ends = ends.select(group, "_segment", F.max("_hi").over(before).alias("_carried"))
    own = Window.partitionBy(group, "_segment").orderBy("imin_k", "imax_k", "num")
    reach = F.greatest(F.max("imax_k").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carried"))  # nulls are skipped
    begun = at.join(ends, [group, "_segment"]).withColumn("_b", F.when(reach.isNull() | (F.col("imin_k") > reach), 1).otherwise(0))
    counts = begun.groupBy(group, "_segment").agg(F.sum("_b").alias("_n"))
    counts = counts.select(group, "_segment", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c"))
    out = begun.join(counts, [group, "_segment"])
    island = F.sum("_b").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_c")
    return out.withColumn("island", island).drop("_b", "_c", "_carried", "_segment")


def closure(meta: DataFrame, low, high, group: str = "level") -> DataFrame:
    """All files that a compaction of the closed range in an overlapping level
    takes with it: whole islands whose hull meets the range."""
    numbered = islands(meta, group)
    hulls = numbered.groupBy(group, "island").agg(F.min("imin_k").alias("lo"), F.max("imax_k").alias("hi"))
    if low is not None:
        hulls = hulls.where(F.col("hi") >= F.lit(low))
    if high is not None:
        hulls = hulls.where(F.col("lo") <= F.lit(high))
    return numbered.join(hulls.select(group, "island"), [group, "island"], "left_semi")


def level_stats(meta: DataFrame) -> DataFrame:
    return meta.groupBy("level").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.min("imin_k").alias("imin_k"), F.max("imax_k").alias("imax_k"))


def scores(meta: DataFrame, options: Options = Options()) -> DataFrame:
    """``level, files, bytes, score``: files of level 0 by their number, deeper
    levels by their bytes."""
    limit = F.lit(float(options.total_size)) * F.pow(F.lit(float(options.total_multiplier)), F.col("level"))
    for level, m in options.total_per_level.items():
        limit = F.when(F.col("level") == level, float(int(options.total_size * m))).otherwise(limit)
    score = F.when(F.col("level") == 0, F.col("files") / F.lit(float(options.l0_trigger))).otherwise(F.col("bytes") / F.floor(limit))
    return meta.groupBy("level").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).withColumn("score", score)


def next_compaction(meta: DataFrame, options: Options = Options()) -> DataFrame:
    """The level to compact next (highest score, ties to the smaller level) and
    whether it has to be."""
    return scores(meta, options).orderBy(F.desc("score"), "level").limit(1).withColumn("needed", F.col("score") >= 1)


def approximate_offsets(meta: DataFrame, blocks: DataFrame, keys: DataFrame, key: str = "ukey") -> DataFrame:
    """``key, offset``: bytes before each distinct key.

    Whole files that end at or before it count with their size: a running sum in
    order of their ends.  A file around it counts up to the block that a seek finds.
    ``meta`` has ``num, size, imin_k, imax_k``, ``blocks`` those of
    :func:`~tidemark.sources.table_file.block_index`.
    """
    asked = keys.select(F.col(key).alias("k")).distinct()
    whole = running_totals(asked, meta.select(F.col("imax_k").alias("k"), "size"), "k", "size", "whole", [], True)
    # A block is found by the keys behind the index key before it, up to its own; the
    # first one by all from the file's first key on.
    before = F.lag("top_key").over(Window.partitionBy("file_num").orderBy("block"))
    spans = blocks.select(F.col("file_num").alias("num"), "offset", "top_key", before.alias("behind"))
    spans = spans.join(meta.select("num", "imin_k", "imax_k"), "num").withColumn("lo", F.greatest("imin_k", "behind")).withColumn("hi", F.least("top_key", "imax_k"))
    hit = overlap_join(asked, spans, ("k", "k"), ("lo", "hi")).where((F.col("k") < F.col("imax_k")) & (F.col("behind").isNull() | (F.col("k") > F.col("behind"))))
    inside = hit.groupBy("k").agg(F.sum("offset").alias("inside"))
    return whole.join(inside, "k", "left").select(F.col("k").alias(key), (F.col("whole") + F.coalesce("inside", F.lit(0))).cast("long").alias("offset"))


def seek_budgets(meta: DataFrame, options: Options = Options()) -> DataFrame:
    return meta.withColumn("seek_left", F.greatest(F.lit(options.min_seeks), F.floor(F.col("size") / options.seek_bytes)).cast("int"))


def carried_budgets(before: DataFrame, meta: DataFrame, options: Options = Options()) -> DataFrame:
    """Budgets of the files of a new version: what is left from the version before,
    or a fresh one for a new file."""
    left = before.select("num", F.col("seek_left").alias("_left"))
    return seek_budgets(meta, options).join(left, "num", "left").withColumn("seek_left", F.coalesce("_left", "seek_left").cast("int")).drop("_left")


def seek_exhausted(meta: DataFrame, probes: DataFrame, options: Options = Options()) -> DataFrame:
    """``num, level, seeks, seek_left`` for the first file of each probe that had
    to touch two files or more; ``probes`` has ``ukey, step, level, num``.

    ``meta`` may carry ``seek_left`` from versions before."""
    touched = Window.partitionBy("ukey")
    first = probes.withColumn("n", F.count("*").over(touched)).where("n >= 2 and step = 1")
    used = first.groupBy("level", "num").agg(F.count("*").alias("seeks"))
    budget = (meta if "seek_left" in meta.columns else seek_budgets(meta, options)).select("num", "seek_left")
    return used.join(budget, "num").select("level", "num", "seeks", (F.col("seek_left") - F.col("seeks")).alias("seek_left"))


def seek_nominee(used: DataFrame) -> DataFrame:
    """The file to compact because its seeks are used up: of several the one that
    overdrew most, then that with the smaller number; or no row."""
    return used.where("seek_left <= 0").orderBy("seek_left", "num").limit(1)


def memtable_level(meta: DataFrame, low, high, max_level: int, options: Options = Options()) -> int:
    """The deepest level up to ``max_level`` that a new table of the closed range
    may go to: nothing overlaps it above or there, and it overlaps few bytes two
    levels below.  Metadata is aggregated by level, so little is collected."""
    if max_level <= 0:
        return 0
    hit = overlapping(meta, low, high).groupBy("level").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    found = {r.level: (r.n, r.bytes) for r in hit.collect()}
    deepest = meta.agg(F.max("level")).first()[0]
    if deepest is None:
        return max_level
    if 0 in found:
        return 0
    level = 0
    while level < max_level:
        if level + 1 > deepest:
            return max_level
        if level + 1 in found or found.get(level + 2, (0, 0))[1] > options.grandparent_limit(level):
            break
        level += 1
    return level


def compaction_inputs(meta: DataFrame, level: int, low, high) -> DataFrame:
    """Files of ``level`` (with all that overlap them at level 0) and of the next
    level that overlap these."""
    own = meta.where(F.col("level") == level)
    source = closure(own, low, high).select(*meta.columns) if level == 0 else overlapping(own, low, high)
    hull = source.agg(F.min("imin_k").alias("lo"), F.max("imax_k").alias("hi")).first()
    below = meta.where(F.col("level") == level + 1)
    below = overlapping(below, hull.lo, hull.hi) if hull.lo is not None else below.limit(0)
    return source.unionByName(below)


def search_positions(meta: DataFrame, keys: DataFrame, key: str = "ukey") -> DataFrame:
    """Per level and key, positions from 0 in the files ordered by key: the first
    file that begins at or after it, and the first that ends at or after it.
    Behind the last file: the number of files.  Running counts of both ends."""
    levels = [r.level for r in meta.select("level").distinct().collect()]  # a handful
    asked = keys.select(F.col(key).alias("k")).distinct().withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels]) if levels else F.array().cast("array<int>")))
    ends = {}
    for name, column in (("begins_at", "imin_k"), ("ends_at", "imax_k")):
        points = meta.select("level", F.col(column).alias("k"), F.lit(1).alias("one"))
        ends[name] = running_totals(asked, points, "k", "one", name, ["level"], False)
    both = ends["begins_at"].join(ends["ends_at"], ["level", "k"])
    return both.select(F.col("k").alias(key), "level", F.col("begins_at").cast("int").alias("begins_at"), F.col("ends_at").cast("int").alias("ends_at"))


def numbered_below(meta: DataFrame, nums: DataFrame, num: str = "num") -> DataFrame:
    """Per level and number, how many files have a smaller one: the position from 0
    of a search in files ordered by number."""
    levels = [r.level for r in meta.select("level").distinct().collect()]
    asked = nums.select(F.col(num).alias("k")).distinct().withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels]) if levels else F.array().cast("array<int>")))
    points = meta.select("level", F.col("num").alias("k"), F.lit(1).alias("one"))
    return running_totals(asked, points, "k", "one", "below", ["level"], False).select("level", F.col("k").alias(num), F.col("below").cast("int").alias("below"))

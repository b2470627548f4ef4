"""Versions as a fold of manifest edits, and collection of dead files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Corrupted
from .ranges import numbered

#: One row per edit; numbers are null where an edit doesn't set them.
EDIT = (
    "edit_no long, comparer string, journal_num long, prev_journal_num long, next_file_num long, seq_num long, "
    "comp_ptrs array<struct<level:int,ikey:binary>>, deleted array<struct<level:int,num:long>>, "
    "added array<struct<level:int,num:long,size:long,imin:binary,imax:binary>>"
)
SCALARS = ["comparer", "journal_num", "prev_journal_num", "next_file_num", "seq_num"]


def operations(edits: DataFrame) -> DataFrame:
    """``edit_no, op, level, num, ...``: op 0 deletes, 1 adds."""
    gone = edits.select("edit_no", F.explode("deleted").alias("t")).select("edit_no", F.lit(0).alias("op"), "t.level", "t.num")
    come = edits.select("edit_no", F.explode("added").alias("t")).select("edit_no", F.lit(1).alias("op"), "t.*")
    return come.unionByName(gone, allowMissingColumns=True)


def fold(ops: DataFrame) -> DataFrame:
    """Files that live after all operations: of each (level, num) the last one
    counts, and within an edit adds come after deletes."""
    w = Window.partitionBy("level", "num").orderBy(F.desc("edit_no"), F.desc("op"))
    return ops.withColumn("_n", F.row_number().over(w)).where("_n = 1 and op = 1").drop("_n", "op")


def apply_edits(base: DataFrame, ops: DataFrame) -> DataFrame:
    """A version and later operations give the next version."""
    first = base.withColumn("edit_no", F.lit(-1).cast("long")).withColumn("op", F.lit(1))
    return fold(first.unionByName(ops, allowMissingColumns=True))


def ordered(files: DataFrame) -> DataFrame:
    """Files with their place in their level: newest first in level 0, by key below."""
    top, deep = files.where("level = 0").withColumn("_z", -F.col("num")), files.where("level <> 0")
    first = numbered(top, ["level"], "_z", [F.col("_z")], "place").drop("_z")
    return first.unionByName(numbered(deep, ["level"], "imin_k", [F.col("imin_k"), F.col("num")], "place")).withColumn("place", F.col("place").cast("int"))


def scalars(edits: DataFrame) -> DataFrame:
    """Last value of every number, one row."""
    return edits.agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("edit_no"))).alias(c) for c in SCALARS])


def compaction_pointers(pointers: DataFrame) -> DataFrame:
    """Last pointer of each level, from ``edit_no, level, ikey``."""
    return pointers.groupBy("level").agg(F.max_by("ikey", "edit_no").alias("ikey"))


def recover(edits: DataFrame, comparer: str) -> tuple[DataFrame, dict]:
    """(files of the newest version, its numbers); raises if one is missing or
    the comparer is another one."""
    state = scalars(edits).first().asDict()
    for name in ("comparer", "next_file_num", "journal_num", "seq_num"):
        if state[name] is None:
            raise Corrupted("missing", name)
    if state["comparer"] != comparer:
        raise Corrupted(f"made with {state['comparer']}, not {comparer}", "comparer")
    return fold(operations(edits)), state


def snapshot_edit(files: DataFrame) -> DataFrame:
    """A version as rows of one edit that adds all its files, one row a level, with
    all that a file needs to be found again: what a rotated manifest begins with.
    :func:`operations` and :func:`fold` give the version back."""
    whole = F.struct("level", "num", "size", F.col("imin_k").alias("imin"), F.col("imax_k").alias("imax"))
    return files.groupBy("level").agg(F.sort_array(F.collect_list(whole)).alias("added")).select(F.lit(0).cast("long").alias("edit_no"), "level", "added")


def restored(snapshot: DataFrame) -> DataFrame:
    """The files of a :func:`snapshot_edit`."""
    return snapshot.select(F.explode("added").alias("t")).select("t.level", "t.num", "t.size", F.col("t.imin").alias("imin_k"), F.col("t.imax").alias("imax_k"))


def reference_counts(versions: DataFrame) -> DataFrame:
    """``num, refs`` from ``version_id, num`` of the pinned versions."""
    return versions.groupBy("num").agg(F.countDistinct("version_id").alias("refs"))


def garbage(all_files: DataFrame, pinned: DataFrame) -> DataFrame:
    """Files that no pinned version holds."""
    return all_files.select("num").distinct().join(pinned.select("num").distinct(), "num", "left_anti")


def next_file_number(files: DataFrame) -> int:
    return (files.agg(F.max("num")).first()[0] or 0) + 1

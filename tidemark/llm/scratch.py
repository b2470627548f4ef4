"""Written intermediate tables in the cluster's shared folder.

Lineage is cut with tables written below ``spark.checkpoint.dir``.  A lost
executor then costs the tasks it ran, never the stages before the table.

Tables that nothing reads any more are deleted: an :func:`operator` removes at
its end what its result doesn't read, and a :func:`scope` removes all that is
left, once its results are written.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.workdir import shared_dir, unused_path

__all__ = ["delete", "materialize", "new_path", "operator", "read_by", "scope", "shared_dir"]

#: Paths written in each open operator or scope, innermost last.
_open: list[list[str]] = []


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A path not used yet; what is written there is deleted in time unless ``keep``."""
    path = unused_path(spark, name)
    if _open and not keep:
        _open[-1].append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Leaves of a plan that read no files.
_NO_FILES = {"LogicalRDD", "LocalRelation", "Range", "OneRowRelation"}


def read_by(df: DataFrame) -> set[str] | None:
    """Folders that the plan of ``df`` reads; None if it has sources that don't tell."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    out: set[str] = set()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        kind = leaf.getClass().getSimpleName()
        if kind == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            out |= {roots.apply(i).toUri().getPath().rstrip("/") for i in range(roots.size())}
        elif kind not in _NO_FILES:
            return None
    return out


def _bare(spark: SparkSession, path: str) -> str:
    """A path without scheme and authority."""
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/")


def operator(f: Callable) -> Callable:
    """An operator's tables live as long as its result reads them."""

    @functools.wraps(f)
    def run(*args, **kw):
        _open.append([])
        try:
            out = f(*args, **kw)
        finally:
            made = _open.pop()
        held = read_by(out) if isinstance(out, DataFrame) else set()
        spark = next(a for a in (*args, *kw.values()) if isinstance(a, DataFrame | SparkSession))
        spark = spark.sparkSession if isinstance(spark, DataFrame) else spark
        for path in made:
            if held is not None and _bare(spark, path) not in held:
                delete(spark, path)
            elif _open:
                _open[-1].append(path)
        return out

    return run


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """All tables written inside are deleted at its end."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)

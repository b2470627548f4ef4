"""Joins of rows to per-key facts, safe when one key holds much of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy with over 1/HEAVY of the rows, so there are fewer than HEAVY heavy keys.
HEAVY = 400


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` to ``groups``, which has one row per ``key`` and in
    ``count`` the number of rows of that key.

    Heavy keys (fewer than :data:`HEAVY` by the pigeonhole principle, whatever
    the size of the data) are known to the driver by name: their rows are joined
    by broadcast where they lie.  The others, each at most 1/HEAVY of all rows,
    are joined by a shuffle.  ``rows`` is read twice, so it should be a written
    table.  Null keys match nothing.
    """
    is_heavy = F.col(count) > total / HEAVY
    heavy = groups.where(is_heavy).limit(HEAVY)
    names = [r[0] for r in heavy.select(key).collect()]
    if not names:
        return rows.join(groups, key)
    hot = rows.where(F.col(key).isin(names)).join(F.broadcast(heavy), key)
    cold = rows.where(~F.col(key).isin(names)).join(groups.where(~is_heavy), key)
    return hot.unionByName(cold)

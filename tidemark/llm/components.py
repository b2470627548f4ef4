"""Connected components by alternating large and small stars, fully distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize, operator
from .skew import join_groups


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation over ``(u, v)`` edges with u > v.

    Large star: every node links its larger neighbours to its least neighbour.
    Small star: every node links its smaller neighbours and itself to the least.
    """
    if large:
        sides = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges
    least = sides.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("deg"))
    least = materialize(least.withColumn("m", F.least("u", "m")), "star-least")
    total = 2 * edges.count() if large else edges.count()
    joined = join_groups(sides, least, "u", "deg", total)
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


@operator
def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(u, v)`` long edges in; ``(node, root)`` out for every node that is not
    its own root, root being the least node of its component.

    Self edges and repeats are ignored; null ends are dropped.  Each star is
    linear in the edges and rounds grow with the logarithm of the diameter.
    """
    e = edges.where("u is not null and v is not null and u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        e = materialize(_star(e, True), "large-star")
        e = materialize(_star(e, False), "small-star")
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1L))")).first()
        if tuple(now) == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(now)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

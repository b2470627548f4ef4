"""Running sums over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize


def prefix_sums(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over all rows before in ``order``,
    whose values are distinct.

    Rows are dealt to ranges; a window sums within each range, and only the totals
    of the ranges, one row for each shuffle partition, meet in one task.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionByRange(n, order).withColumn("_range", F.spark_partition_id())
    ranges = materialize(ranges, "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("_range").agg(F.sum(value).alias("_total"))
    totals = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranges.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0))).join(totals, "_range")
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")

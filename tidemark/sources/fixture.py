"""The driver's tables as versioned logs and table metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table's bytes are estimated from its entries: key and a fixed share for the rest.
ENTRY_BYTES = 16


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``level, file_num, ukey, seq, kind, value`` from ``events``.

    Newer entries lie in smaller levels.  Level 0 is cut by time, so its files
    overlap; deeper levels are cut by key, so theirs are disjoint.
    """
    events = read(spark, sf_dir, "events")
    top = events.agg(F.max("event_id").alias("e"), F.max("user_id").alias("u")).first()
    n, m = (top.e or 0) + 1, (top.u or 0) + 1
    seq, user = F.col("event_id"), F.col("user_id")
    level = F.when(seq * 10 >= 9 * n, 0).when(seq * 10 >= 6 * n, 1).otherwise(2)
    number = F.when(level == 0, F.floor(seq * 40 / n)).otherwise(F.floor(user * 8 / m)).cast("long")
    return events.select(
        level.alias("level"), (level * 1000 + number).cast("long").alias("file_num"), F.lpad(user.cast("string"), 8, "0").alias("ukey"),
        seq.alias("seq"), F.when(F.col("event_type") == "error", 0).otherwise(1).cast("byte").alias("kind"), F.col("value"),
    )


#: The same log in DuckDB SQL, for oracle queries.
KV_SQL = """
kv_n AS (SELECT max(event_id) + 1 AS n, max(user_id) + 1 AS m FROM events),
kv_l AS (SELECT *, CASE WHEN event_id * 10 >= 9 * n THEN 0 WHEN event_id * 10 >= 6 * n THEN 1 ELSE 2 END AS level FROM events, kv_n),
kv AS (
  SELECT level, CAST(level * 1000 + CASE WHEN level = 0 THEN event_id * 40 // n ELSE user_id * 8 // m END AS BIGINT) AS file_num,
    lpad(CAST(user_id AS VARCHAR), 8, '0') AS ukey, event_id AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS kind, value
  FROM kv_l
)
"""


def table_meta(log: DataFrame) -> DataFrame:
    """``level, num, entries, size, imin_k, imax_k, min_seq, max_seq`` per file."""
    return log.groupBy("level", F.col("file_num").alias("num")).agg(
        F.count("*").alias("entries"), F.sum(F.length("ukey") + ENTRY_BYTES).alias("size"),
        F.min("ukey").alias("imin_k"), F.max("ukey").alias("imax_k"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"),
    )


META_SQL = """
meta AS (
  SELECT level, file_num AS num, count(*) AS entries, CAST(sum(length(ukey) + 16) AS BIGINT) AS size,
    min(ukey) AS imin_k, max(ukey) AS imax_k, min(seq) AS min_seq, max(seq) AS max_seq
  FROM kv GROUP BY ALL
)
"""

"""A journal of entries as a stream that keeps the newest version of each key.

Entries may arrive in any order and more than once: the merge keeps the greatest
sequence number, so it is idempotent and late entries do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

LATEST = "ukey string, seq long, kind byte, value double"


def read_log_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Entries appended to a directory of Parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def latest_by_key(entries: DataFrame) -> DataFrame:
    """Stateful operator: emits a key whenever a newer version of it arrives."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        changed = False
        for f in frames:
            top = f.sort_values(["seq", "kind"]).iloc[-1]
            found = (int(top.seq), int(top.kind), None if pd.isna(top.value) else float(top.value))
            if best is None or found[:2] > tuple(best)[:2]:
                best, changed = found, True
        if changed:
            state.update(best)
            yield pd.DataFrame({"ukey": [key[0]], "seq": [best[0]], "kind": [best[1]], "value": [best[2]]}).astype({"kind": "int8", "value": "float64"})

    return entries.select("ukey", "seq", "kind", "value").groupBy("ukey").applyInPandasWithState(step, LATEST, "seq long, kind byte, value double", "append", GroupStateTimeout.NoTimeout)


def newest(entries: DataFrame) -> DataFrame:
    """The same as a built-in aggregate, for complete or update output."""
    return entries.groupBy("ukey").agg(F.max_by(F.struct("seq", "kind", "value"), F.struct("seq", "kind")).alias("e")).select("ukey", "e.seq", "e.kind", "e.value")


def windowed_counts(events: DataFrame, time: str, width: str, delay: str) -> DataFrame:
    """Entries and tombstones per time window, late ones up to ``delay``."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("entries"), F.sum((F.col("kind") == 0).cast("int")).alias("deleted"))


def merge_into(entries: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch, reduced to the newest version of its keys, goes to ``merge``."""
    return entries.writeStream.foreachBatch(lambda batch, n: merge(newest(batch), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

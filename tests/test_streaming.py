"""Streams give the same newest versions as batches, in any order of arrival."""

import random

from pyspark.sql import functions as F

from tidemark.streaming import journal_stream as js

SCHEMA = "ukey string, seq long, kind byte, value double"


def test_latest_by_key(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"k{rng.randrange(20)}", n, rng.randrange(2), float(n)) for n in range(400)]
    shuffled = rng.sample(rows, len(rows)) + rng.sample(rows, 50)
    for n in range(3):
        spark.createDataFrame(shuffled[n::3], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {k: max(r[1] for r in rows if r[0] == k) for k in {r[0] for r in rows}}
    stream = js.read_log_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema)
    q = js.latest_by_key(stream).writeStream.format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("latest").groupBy("ukey").agg(F.max("seq").alias("s")).collect()
    assert {r.ukey: r.s for r in got} == want

    seen = {}

    def merge(batch, n):
        for r in batch.collect():
            seen[r.ukey] = max(seen.get(r.ukey, -1), r.seq)

    js.merge_into(js.read_log_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema), merge, str(tmp_path / "c2")).awaitTermination(120)
    assert seen == want

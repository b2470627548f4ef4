"""Registered queries of the engine's operators, and their SQL for DuckDB.

Every entry of :data:`QUERIES` is ``name: (query, SQL or None)``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bloom, hashing, keys, names
from .operators import read, scan, write
from .options import Options
from .plans import cache, layout, manifest
from .sources import fixture, journal, manifest_codec, storage, table_file
from .sources.workdir import unused_path
from .store import Store
from .streaming import journal_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}
KV = "WITH " + fixture.KV_SQL
META = KV + ", " + fixture.META_SQL


def query(sql: str | None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.kv_log(spark, sf_dir)


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.table_meta(_log(spark, sf_dir))


def _rounded(name: str = "value"):
    return F.round(name, 4).alias(name)


RESOLVED = """
, rs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ukey ORDER BY level, seq DESC, kind DESC, file_num DESC) AS rn FROM kv {where}) WHERE rn = 1)
"""


def _resolved(where: str = "") -> str:
    return KV + RESOLVED.format(where=where)


# Point reads and versions


@query(_resolved() + "SELECT ukey, level, seq, round(value, 4) AS value FROM rs WHERE kind = 1")
def get_latest(spark, sf_dir):
    return read.scan_latest(_log(spark, sf_dir)).select("ukey", "level", "seq", _rounded())


@query(_resolved("WHERE seq <= 500") + "SELECT ukey, seq, round(value, 4) AS value FROM rs WHERE kind = 1")
def get_as_of(spark, sf_dir):
    return read.scan_latest(_log(spark, sf_dir), 500).select("ukey", "seq", _rounded())


@query(_resolved() + "SELECT ukey, seq FROM rs WHERE kind = 1")
def get_key_only(spark, sf_dir):
    return read.scan_keys(_log(spark, sf_dir))


@query(_resolved("WHERE ukey = '00000007'") + "SELECT ukey, seq, round(value, 4) AS value FROM rs WHERE kind = 1")
def get_one(spark, sf_dir):
    return read.get(_log(spark, sf_dir), "00000007").select("ukey", "seq", _rounded())


def _wanted(spark, sf_dir):
    return fixture.read(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("ukey"))


@query(_resolved("WHERE ukey IN (SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') FROM customer)") + "SELECT ukey, seq, round(value, 4) AS value FROM rs WHERE kind = 1")
def multi_get(spark, sf_dir):
    return read.multi_get(_log(spark, sf_dir), _wanted(spark, sf_dir)).select("ukey", "seq", _rounded())


@query(_resolved("WHERE ukey IN (SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') FROM customer)") + "SELECT ukey, level, seq FROM rs WHERE kind = 1")
def staged_multi_get(spark, sf_dir):
    return read.staged_multi_get(_log(spark, sf_dir), _wanted(spark, sf_dir), [0, 1, 2]).select("ukey", "level", "seq")


@query(_resolved() + "SELECT ukey, level, seq FROM rs WHERE kind = 0")
def tombstoned_keys(spark, sf_dir):
    return read.resolve(_log(spark, sf_dir)).where("kind = 0").select("ukey", "level", "seq")


@query(
    KV
    + """SELECT ukey, seq, kind, lag(seq) OVER w AS prev_seq, lead(seq) OVER w AS next_seq,
  CAST(row_number() OVER (PARTITION BY ukey ORDER BY seq DESC) AS INTEGER) AS age FROM kv WINDOW w AS (PARTITION BY ukey ORDER BY seq)"""
)
def version_history(spark, sf_dir):
    return read.history(_log(spark, sf_dir)).withColumn("kind", F.col("kind").cast("int"))


# Seeks


@query("SELECT min(o_orderkey) AS found FROM orders WHERE o_orderkey >= 1000")
def find_ge(spark, sf_dir):
    return read.find_ge(fixture.read(spark, sf_dir, "orders"), 1000, "o_orderkey").select(F.col("o_orderkey").alias("found"))


@query("SELECT max(o_orderkey) AS found FROM orders WHERE o_orderkey < 1000")
def find_lt(spark, sf_dir):
    return read.find_lt(fixture.read(spark, sf_dir, "orders"), 1000, "o_orderkey").select(F.col("o_orderkey").alias("found"))


@query("SELECT min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(*) AS entries FROM orders")
def find_first_last(spark, sf_dir):
    return scan.ends(fixture.read(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT max(o_orderkey) AS found FROM orders")
def find_last(spark, sf_dir):
    return read.find_last(fixture.read(spark, sf_dir, "orders"), "o_orderkey").select(F.col("o_orderkey").alias("found"))


@query("""
WITH p AS (SELECT DISTINCT l_partkey * 3 AS probe FROM lineitem), a AS (
  SELECT p.probe, o.o_orderkey AS below FROM p ASOF LEFT JOIN orders o ON p.probe > o.o_orderkey
), b AS (SELECT p.probe, o.o_orderkey AS at_or_above FROM p ASOF LEFT JOIN orders o ON p.probe <= o.o_orderkey)
SELECT a.probe, a.below, b.at_or_above FROM a JOIN b ON a.probe = b.probe
""")
def batched_seeks(spark, sf_dir):
    probes = fixture.read(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 3).alias("probe"))
    return read.neighbours(probes, fixture.read(spark, sf_dir, "orders"), "probe", "o_orderkey")


# Scans


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 200 AND o_orderkey < 1200")
def range_scan(spark, sf_dir):
    rows = fixture.read(spark, sf_dir, "orders")
    return scan.in_range(rows, scan.Range(200, 1200), "o_orderkey").select("o_orderkey", "o_orderstatus")


PART_KEY = "p_name || '#' || lpad(CAST(p_partkey AS VARCHAR), 8, '0')"


def _part_keys(spark, sf_dir):
    return fixture.read(spark, sf_dir, "part").select(F.concat("p_name", F.lit("#"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("ukey"), "p_size")


@query(f"SELECT {PART_KEY} AS ukey, p_size FROM part WHERE starts_with(p_name, 'small ')")
def prefix_scan(spark, sf_dir):
    return scan.in_range(_part_keys(spark, sf_dir), scan.prefix_range("small "))


@query(f"SELECT k AS ukey, CAST(row_number() OVER (ORDER BY k DESC) AS INTEGER) AS pos FROM (SELECT {PART_KEY} AS k FROM part)")
def key_scan_reverse(spark, sf_dir):
    return scan.reversed_scan(_part_keys(spark, sf_dir))


@query(_resolved("WHERE ukey >= '00000010' AND ukey < '00000100'") + "SELECT ukey, level, seq, round(value, 4) AS value FROM rs WHERE kind = 1")
def merged_scan(spark, sf_dir):
    return scan.merged_scan(_log(spark, sf_dir), scan.Range("00000010", "00000100")).select("ukey", "level", "seq", _rounded())


@query(KV + "SELECT file_num, ukey, seq FROM kv WHERE level = 1 AND ukey >= '00000020'")
def level_scan(spark, sf_dir):
    return scan.level_scan(_log(spark, sf_dir), 1, scan.Range("00000020")).select("file_num", "ukey", "seq")


@query("""
SELECT o_orderstatus AS grp, o_orderkey AS ukey, CAST(row_number() OVER w AS INTEGER) AS pos, lag(o_orderkey) OVER w AS prev_key, lead(o_orderkey) OVER w AS next_key
FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey)
""")
def cursor_positions(spark, sf_dir):
    rows = fixture.read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("grp"), F.col("o_orderkey").alias("ukey"))
    return scan.positions(rows, "grp")


@query(META + "SELECT level, num FROM meta WHERE imax_k >= '00000030' AND imin_k < '00000060'")
def pruned_files(spark, sf_dir):
    return scan.prune_files(_meta(spark, sf_dir), scan.Range("00000030", "00000060")).select("level", "num")


@query(META + "SELECT level, num, i - 1 AS pos FROM (SELECT level, nums, unnest(range(1, len(nums) + 1)) AS i, unnest(nums) AS num FROM (SELECT level, list(num ORDER BY num) AS nums FROM meta GROUP BY level))")
def array_index_scan(spark, sf_dir):
    lists = _meta(spark, sf_dir).groupBy("level").agg(F.sort_array(F.collect_list("num")).alias("nums"))
    return scan.of_array(lists, "nums", "num")


@query(KV + "SELECT max(ukey) AS last_key, min(ukey) AS first_key, count(*) AS entries FROM kv WHERE ukey >= greatest('00000005', '00000020') AND ukey < '00000100'")
def seek_clamped(spark, sf_dir):
    """A seek before a range starts at the range."""
    keys_ = scan.Range("00000020", "00000100")
    rows = scan.in_range(_log(spark, sf_dir), scan.Range(keys_.clamp("00000005"), keys_.limit))
    return rows.agg(F.max("ukey").alias("last_key"), F.min("ukey").alias("first_key"), F.count("*").alias("entries"))


# Writes


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type, round(max_by(value, event_id), 4) AS value FROM events GROUP BY user_id")
def upsert_last_write(spark, sf_dir):
    rows = fixture.read(spark, sf_dir, "events")
    return write.upsert(rows, "user_id", "event_id", "event_type", "value").withColumn("value", F.round("value", 4))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def delete_keys(spark, sf_dir):
    gone = fixture.read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return write.delete_keys(fixture.read(spark, sf_dir, "orders"), gone, "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_keys(spark, sf_dir):
    lines = fixture.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return write.missing_keys(lines, fixture.read(spark, sf_dir, "orders"), "o_orderkey")


@query(KV + ", d AS (SELECT DISTINCT ukey FROM kv WHERE level = 0 AND seq % 20 = 0), a AS (SELECT ukey, seq, kind FROM kv UNION ALL SELECT ukey, 1000000000, 0 FROM d) SELECT ukey, max(seq) AS seq FROM a GROUP BY ukey HAVING max_by(kind, seq) = 1")
def delete_by_tombstone(spark, sf_dir):
    log = _log(spark, sf_dir)
    gone = write.tombstones(log.where("level = 0 and seq % 20 = 0").select("ukey").distinct(), 1_000_000_000, level=-1)
    return read.scan_latest(log.unionByName(gone)).select("ukey", "seq")


@query(KV + "SELECT file_num, count(*) AS entries, CAST(sum(octet_length(encode(ukey)) + 8) AS BIGINT) AS bytes FROM kv WHERE level = 0 GROUP BY file_num")
def memtable_stats(spark, sf_dir):
    return write.memory_stats(_log(spark, sf_dir).where("level = 0"), "file_num")


#: The blocks of each file's table, cut as its writer does: an entry takes three
#: lengths, the part of its key that the entry before doesn't share (none is shared
#: every 16 entries) and its value; a block ends at 4 KiB, restarts included.  Files
#: hold internal keys, plain blocks and no filter.
BLOCKS_SQL = KV.replace("WITH ", "WITH RECURSIVE ", 1) + """
, h AS (
  SELECT file_num, ukey, seq, kind, length(CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR)) AS vlen, printf('%016x', (CAST(seq AS UBIGINT) << 8) + kind) AS t,
    row_number() OVER (PARTITION BY file_num ORDER BY ukey, seq DESC, kind DESC) AS i FROM kv
), e AS (
  SELECT *, hex(encode(ukey)) || upper(substr(t, 15, 2) || substr(t, 13, 2) || substr(t, 11, 2) || substr(t, 9, 2) || substr(t, 7, 2) || substr(t, 5, 2) || substr(t, 3, 2) || substr(t, 1, 2)) AS k FROM h
), x AS (
  SELECT *, lag(k) OVER (PARTITION BY file_num ORDER BY i) AS p FROM e
), r AS (
  SELECT file_num, i, ukey, 19 + vlen AS whole, coalesce(list_min(list_filter(range(0, 16), lambda b: substr(k, CAST(2 * b + 1 AS INTEGER), 2) <> substr(p, CAST(2 * b + 1 AS INTEGER), 2))), 16) AS shared FROM x
), cut AS (
  SELECT file_num, i, CAST(0 AS BIGINT) AS block, CAST(1 AS BIGINT) AS n, CAST(whole AS BIGINT) AS bytes FROM r WHERE i = 1
  UNION ALL
  SELECT r.file_num, r.i, c.block + c.closed, CASE WHEN c.closed = 1 THEN 1 ELSE c.n + 1 END, CASE WHEN c.closed = 1 THEN r.whole ELSE c.bytes + r.whole - CASE WHEN c.n % 16 = 0 THEN 0 ELSE r.shared END END
  FROM (SELECT *, CASE WHEN bytes + 4 * ((n + 15) // 16) + 4 >= 4096 THEN 1 ELSE 0 END AS closed FROM cut) c JOIN r ON r.file_num = c.file_num AND r.i = c.i + 1
), b AS (
  SELECT file_num, block, count(*) AS entries, max(bytes) + 4 * ((count(*) + 15) // 16) + 4 AS length, min_by(ukey, cut.i) AS first_key, max_by(ukey, cut.i) AS last_key
  FROM cut JOIN r USING (file_num, i) GROUP BY ALL
), o AS (
  SELECT *, coalesce(sum(length + 5) OVER (PARTITION BY file_num ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset", lead(first_key) OVER (PARTITION BY file_num ORDER BY block) AS nxt FROM b
), s AS (
  SELECT *, coalesce(list_min(list_filter(range(0, 8), lambda j: last_key[CAST(j + 1 AS INTEGER)] <> nxt[CAST(j + 1 AS INTEGER)])), 8) AS same FROM o
), blocks AS (
  SELECT file_num, block, CAST("offset" AS BIGINT) AS "offset", length, entries, first_key, last_key, CASE WHEN nxt IS NULL THEN chr(ascii(last_key[1]) + 1)
    WHEN same < 7 AND ascii(last_key[CAST(same + 1 AS INTEGER)]) + 1 < ascii(nxt[CAST(same + 1 AS INTEGER)]) THEN substr(last_key, 1, CAST(same AS INTEGER)) || chr(ascii(last_key[CAST(same + 1 AS INTEGER)]) + 1) ELSE last_key END AS top_key FROM s
), files AS (
  SELECT file_num, count(*) AS blocks, CAST(sum(entries) AS BIGINT) AS entries, CAST(sum(length + 5) AS BIGINT) AS data_end, min(first_key) AS first_key, max(last_key) AS last_key,
    CAST(sum(length + 5) + 13 + sum(11 + length(top_key) + CASE WHEN "offset" < 128 THEN 1 WHEN "offset" < 16384 THEN 2 WHEN "offset" < 2097152 THEN 3 ELSE 4 END + CASE WHEN length < 128 THEN 1 WHEN length < 16384 THEN 2 ELSE 3 END + 4) + 4 + 5 + 48 AS BIGINT) AS bytes
  FROM blocks GROUP BY file_num
)
"""
#: What the tables of these queries are written with.
PLAIN = Options(compression="none", filter=None)


def _valued(spark, sf_dir):
    """The log with values whose text is the same everywhere."""
    return _log(spark, sf_dir).withColumn("value", F.floor(F.col("value") * 100))


def _files(spark, sf_dir):
    return table_file.write_files(_valued(spark, sf_dir), PLAIN)


@query(BLOCKS_SQL + "SELECT file_num, first_key, last_key, entries, blocks, data_end, bytes FROM files")
def flush_meta(spark, sf_dir):
    """Every file of the log written as a table, and what its writer counted."""
    return _files(spark, sf_dir).drop("content")


@query(KV + "SELECT count(*) AS entries, min(ukey) AS first_key, max(ukey) AS last_key, CAST(0 AS BIGINT) AS overlaps FROM kv")
def flush_sorted(spark, sf_dir):
    """The log flushed as sorted Parquet files, no two of which share a key."""
    made = write.flush(_log(spark, sf_dir), unused_path(spark, "flush"), 4).withColumn("num", F.xxhash64("file"))
    pairs = layout.overlap_pairs(made, made).where("num < other").count()
    return made.agg(F.sum("entries").alias("entries"), F.min("imin_k").alias("first_key"), F.max("imax_k").alias("last_key"), F.lit(pairs).cast("long").alias("overlaps"))


@query(KV + """, p AS (SELECT *, lag(ukey) OVER w AS k, lag(seq) OVER w AS s FROM kv WINDOW w AS (PARTITION BY file_num ORDER BY seq))
SELECT file_num, count(*) AS out_of_order FROM p WHERE k > ukey OR k = ukey AND s <= seq GROUP BY file_num""")
def order_check(spark, sf_dir):
    """Entries as they arrive that could not be appended to a table."""
    wrong = write.out_of_order(_log(spark, sf_dir).withColumn("place", F.col("seq")), "file_num", "ukey", "seq", "place")
    return wrong.groupBy("file_num").agg(F.count("*").alias("out_of_order"))


#: Where a new table of a range goes, by the files of some levels on.
LEVEL_SQL = """, t(id, lo, hi, least) AS (VALUES (1, '00000000', '00000010', 0), (2, '00000000', '00000010', 1), (3, '00000000', '00000010', 2), (4, '99999998', '99999999', 0), (5, '00000000', '00000010', 3)),
l AS (
  SELECT id, count(num) AS n, count(num) FILTER (imax_k >= lo AND imin_k <= hi AND level = 0) AS h0, count(num) FILTER (imax_k >= lo AND imin_k <= hi AND level = 1) AS h1,
    count(num) FILTER (imax_k >= lo AND imin_k <= hi AND level = 2) AS h2, coalesce(sum(size) FILTER (imax_k >= lo AND imin_k <= hi AND level = 2), 0) AS s2
  FROM t LEFT JOIN meta ON level >= least GROUP BY id
) SELECT id, CAST(CASE WHEN n = 0 THEN 2 WHEN h0 > 0 OR h1 > 0 OR s2 > 20971520 THEN 0 WHEN h2 > 0 THEN 1 ELSE 2 END AS INTEGER) AS level FROM l"""


@query(META + LEVEL_SQL)
def flush_level(spark, sf_dir):
    meta = _meta(spark, sf_dir)
    asked = [(1, "00000000", "00000010", 0), (2, "00000000", "00000010", 1), (3, "00000000", "00000010", 2), (4, "99999998", "99999999", 0), (5, "00000000", "00000010", 3)]
    rows = [(n, layout.memtable_level(meta.where(F.col("level") >= least), lo, hi, 2)) for n, lo, hi, least in asked]
    return spark.createDataFrame(rows, "id int, level int")


# Versions and layout

#: Edits derived from the file metadata: each file is added by the edit of its
#: number, every third file is deleted later, and every ninth comes back.
OPS_SQL = """
, ops AS (
  SELECT num AS edit_no, 1 AS op, level, num, size, imin_k, imax_k FROM meta
  UNION ALL SELECT num + 5000, 0, level, num, NULL, NULL, NULL FROM meta WHERE num % 3 = 0
  UNION ALL SELECT num + 5000, 1, level, num, size + 1, imin_k, imax_k FROM meta WHERE num % 9 = 0
), live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY level, num ORDER BY edit_no DESC, op DESC) AS rn FROM ops) WHERE rn = 1 AND op = 1)
"""


def _ops(spark, sf_dir):
    meta = _meta(spark, sf_dir)
    add = meta.select(F.col("num").alias("edit_no"), F.lit(1).alias("op"), "level", "num", "size", "imin_k", "imax_k")
    gone = meta.where("num % 3 = 0").select((F.col("num") + 5000).alias("edit_no"), F.lit(0).alias("op"), "level", "num")
    back = meta.where("num % 9 = 0").select((F.col("num") + 5000).alias("edit_no"), F.lit(1).alias("op"), "level", "num", (F.col("size") + 1).alias("size"), "imin_k", "imax_k")
    return add.unionByName(gone, allowMissingColumns=True).unionByName(back)


@query(META + OPS_SQL + "SELECT level, num, size, edit_no FROM live")
def manifest_fold(spark, sf_dir):
    return manifest.fold(_ops(spark, sf_dir)).select("level", "num", "size", "edit_no")


@query(META + OPS_SQL + ", b AS (SELECT level, num, size FROM meta WHERE level = 2) SELECT level, num, size FROM live WHERE level < 2 UNION ALL SELECT level, num, size FROM b WHERE num NOT IN (SELECT num FROM ops WHERE level = 2 AND op = 0) OR num % 9 = 0 AND false UNION ALL SELECT level, num, size FROM live WHERE level = 2 AND num % 9 = 0")
def version_apply(spark, sf_dir):
    base = _meta(spark, sf_dir).where("level = 2").select("level", "num", "size")
    return manifest.apply_edits(base, _ops(spark, sf_dir)).select("level", "num", "size")


@query(META + ", o AS (SELECT *, CASE WHEN level = 0 THEN -num ELSE 0 END AS z FROM meta) SELECT level, num, CAST(row_number() OVER (PARTITION BY level ORDER BY z, imin_k, num) AS INTEGER) AS place FROM o")
def version_order(spark, sf_dir):
    return manifest.ordered(_meta(spark, sf_dir)).select("level", "num", "place")


@query("""
SELECT max_by(event_type, event_id) FILTER (event_id % 7 = 0) AS comparer, max_by(user_id, event_id) FILTER (event_id % 11 = 0) AS journal_num,
  max_by(user_id, event_id) FILTER (event_id % 13 = 0) AS prev_journal_num, max(event_id) FILTER (event_id % 5 = 0) AS next_file_num, max(event_id) AS seq_num FROM events
""")
def manifest_scalars(spark, sf_dir):
    e = fixture.read(spark, sf_dir, "events")
    some = lambda c, n: F.when(F.col("event_id") % n == 0, F.col(c))
    edits = e.select(
        F.col("event_id").alias("edit_no"), some("event_type", 7).alias("comparer"), some("user_id", 11).alias("journal_num"),
        some("user_id", 13).alias("prev_journal_num"), some("event_id", 5).alias("next_file_num"), F.col("event_id").alias("seq_num"),
    )
    return manifest.scalars(edits)


@query(META + OPS_SQL + "SELECT level, num, size, imin_k, imax_k FROM live")
def manifest_snapshot(spark, sf_dir):
    """A version as one edit, and what that edit restores."""
    return manifest.restored(manifest.snapshot_edit(manifest.fold(_ops(spark, sf_dir))))


@query(META + OPS_SQL + "SELECT level, num, size, imin_k AS imin, imax_k AS imax FROM live")
def manifest_recover(spark, sf_dir):
    """A version from edits and the numbers that they set."""
    ops = _ops(spark, sf_dir)
    table = F.struct("level", "num", "size", F.encode("imin_k", "UTF-8").alias("imin"), F.encode("imax_k", "UTF-8").alias("imax"))
    edits = ops.groupBy("edit_no").agg(F.collect_list(F.when(F.col("op") == 0, F.struct("level", "num"))).alias("deleted"), F.collect_list(F.when(F.col("op") == 1, table)).alias("added"))
    edits = edits.select(
        "edit_no", F.when(F.col("edit_no") < 1000, "own").alias("comparer"), F.col("edit_no").alias("journal_num"), F.lit(None).cast("long").alias("prev_journal_num"),
        (F.col("edit_no") + 1).alias("next_file_num"), F.col("edit_no").alias("seq_num"), F.array().cast("array<struct<level:int,ikey:binary>>").alias("comp_ptrs"), "deleted", "added",
    )
    files, _ = manifest.recover(edits, "own")
    return files.select("level", "num", "size", F.decode("imin", "UTF-8").alias("imin"), F.decode("imax", "UTF-8").alias("imax"))


@query(KV + "SELECT level, max_by(ukey, seq) AS ikey FROM kv GROUP BY level")
def compaction_pointers(spark, sf_dir):
    return manifest.compaction_pointers(_log(spark, sf_dir).select(F.col("seq").alias("edit_no"), "level", F.col("ukey").alias("ikey")))


@query(META + "SELECT a.num, b.num AS other FROM meta a JOIN meta b ON a.level = 1 AND b.level = 2 AND a.imin_k <= b.imax_k AND b.imin_k <= a.imax_k")
def file_overlap(spark, sf_dir):
    meta = _meta(spark, sf_dir)
    return layout.overlap_pairs(meta.where("level = 1"), meta.where("level = 2"))


#: Narrow overlapping files: one for every order, up to 120 keys wide, in steps of 60
#: within a level.
SPANS_SQL = """
WITH RECURSIVE spans AS (
  SELECT CAST(o_orderkey % 3 AS INTEGER) AS level, o_orderkey AS num, o_orderkey * 20 AS imin_k, o_orderkey * 20 + o_custkey % 13 * 10 AS imax_k FROM orders
)
"""


def _spans(spark, sf_dir):
    o = fixture.read(spark, sf_dir, "orders")
    low = F.col("o_orderkey") * 20
    return o.select((F.col("o_orderkey") % 3).cast("int").alias("level"), F.col("o_orderkey").alias("num"), low.alias("imin_k"), (low + F.col("o_custkey") % 13 * 10).alias("imax_k"))


@query(SPANS_SQL + ", c AS (SELECT num, imin_k, imax_k FROM spans WHERE level = 0 AND imax_k >= 5000 AND imin_k <= 5300 UNION SELECT s.num, s.imin_k, s.imax_k FROM spans s JOIN c ON s.level = 0 AND s.imin_k <= c.imax_k AND c.imin_k <= s.imax_k) SELECT num, imin_k, imax_k FROM c")
def l0_closure(spark, sf_dir):
    own = _spans(spark, sf_dir).where("level = 0")
    return layout.closure(own, 5000, 5300).select("num", "imin_k", "imax_k")


@query(SPANS_SQL + ", m AS (SELECT *, max(imax_k) OVER (PARTITION BY level ORDER BY imin_k, imax_k, num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM spans) SELECT level, num, CAST(sum(CASE WHEN b IS NULL OR imin_k > b THEN 1 ELSE 0 END) OVER (PARTITION BY level ORDER BY imin_k, imax_k, num) AS BIGINT) AS island FROM m")
def file_islands(spark, sf_dir):
    return layout.islands(_spans(spark, sf_dir)).select("level", "num", "island")


@query(META + ", k AS (SELECT DISTINCT ukey FROM kv) SELECT k.ukey, level, num, CAST(row_number() OVER (PARTITION BY k.ukey ORDER BY level, num DESC) AS INTEGER) AS step FROM k JOIN meta ON imin_k <= k.ukey AND k.ukey <= imax_k")
def files_for_key(spark, sf_dir):
    log = _log(spark, sf_dir)
    return read.files_for_keys(fixture.table_meta(log), log.select("ukey").distinct())


@query(META + ", k AS (SELECT DISTINCT ukey FROM kv) SELECT k.ukey, level, CAST(count(*) FILTER (imin_k < k.ukey) AS INTEGER) AS begins_at, CAST(count(*) FILTER (imax_k < k.ukey) AS INTEGER) AS ends_at FROM k, meta GROUP BY k.ukey, level")
def file_search(spark, sf_dir):
    log = _log(spark, sf_dir)
    return layout.search_positions(fixture.table_meta(log), log.select("ukey"))


@query(META + "SELECT l.level, m.num, CAST(count(*) FILTER (o.num < m.num) AS INTEGER) AS below FROM meta m, (SELECT DISTINCT level FROM meta) l, meta o WHERE o.level = l.level GROUP BY l.level, m.num")
def file_search_by_number(spark, sf_dir):
    meta = _meta(spark, sf_dir)
    return layout.numbered_below(meta, meta.select("num"))


@query(META + "SELECT level, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, min(imin_k) AS imin_k, max(imax_k) AS imax_k FROM meta GROUP BY level")
def level_files(spark, sf_dir):
    return layout.level_stats(_meta(spark, sf_dir))


#: Bytes before each key: whole files that end at or before it, and of one around it
#: those before the first block whose index key is not below it.
OFFSET_SQL = """
, k AS (SELECT DISTINCT ukey FROM kv), ofs AS (
  SELECT k.ukey, CAST(sum(CASE WHEN f.last_key <= k.ukey THEN f.bytes WHEN f.first_key > k.ukey THEN 0
    ELSE coalesce((SELECT min(x."offset") FROM blocks x WHERE x.file_num = f.file_num AND x.top_key >= k.ukey), f.data_end) END) AS BIGINT) AS "offset" FROM k, files f GROUP BY k.ukey
)
"""


@query(BLOCKS_SQL + OFFSET_SQL + "SELECT ukey, \"offset\" FROM ofs")
def approx_offset(spark, sf_dir):
    path = unused_path(spark, "table-files")
    _files(spark, sf_dir).write.parquet(path)  # encoded once, read twice
    files = spark.read.parquet(path)
    meta = files.select(F.col("file_num").alias("num"), F.col("bytes").alias("size"), F.col("first_key").alias("imin_k"), F.col("last_key").alias("imax_k"))
    return layout.approximate_offsets(meta, table_file.block_index(files, PLAIN), _log(spark, sf_dir))


@query(BLOCKS_SQL + OFFSET_SQL + "SELECT file_num, z.\"offset\" - a.\"offset\" AS bytes FROM files f JOIN ofs a ON a.ukey = f.first_key JOIN ofs z ON z.ukey = f.last_key")
def range_size(spark, sf_dir):
    """Bytes of all files between the first and the last key of each file."""
    at = approx_offset(spark, sf_dir)
    ends = _log(spark, sf_dir).groupBy("file_num").agg(F.min("ukey").alias("lo"), F.max("ukey").alias("hi"))
    low = ends.join(at.select(F.col("ukey").alias("lo"), F.col("offset").alias("a")), "lo")
    return low.join(at.select(F.col("ukey").alias("hi"), F.col("offset").alias("z")), "hi").select("file_num", (F.col("z") - F.col("a")).alias("bytes"))


SCORE_SQL = ", s AS (SELECT level, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, round(CASE WHEN level = 0 THEN count(*) / 4.0 ELSE sum(size) / (10485760 * pow(10, level)) END, 9) AS score FROM meta GROUP BY level)"


@query(META + SCORE_SQL + "SELECT * FROM s")
def compaction_score(spark, sf_dir):
    return layout.scores(_meta(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query(META + SCORE_SQL + "SELECT *, score >= 1 AS needed FROM s ORDER BY score DESC, level LIMIT 1")
def compaction_pick(spark, sf_dir):
    return layout.next_compaction(_meta(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query("SELECT CAST(l AS INTEGER) AS level, 2097152 AS table_limit, CAST(10485760 * pow(10, l) AS BIGINT) AS total_limit, 52428800 AS expand_limit, 20971520 AS grandparent_limit, 2097152 AS source_limit FROM range(0, 7) t(l)")
def compaction_limits(spark, sf_dir):
    o = Options()
    rows = [(k, o.table_limit(k), o.total_limit(k), o.expand_limit(k), o.grandparent_limit(k), o.source_limit(k)) for k in range(7)]
    return spark.createDataFrame(rows, "level int, table_limit int, total_limit long, expand_limit int, grandparent_limit int, source_limit int")


@query(META + "SELECT level, num, CAST(greatest(100, size // 16384) AS INTEGER) AS seek_left FROM meta")
def seek_budget(spark, sf_dir):
    return layout.seek_budgets(_meta(spark, sf_dir)).select("level", "num", "seek_left")


@query(META + """, k AS (SELECT DISTINCT ukey FROM kv), p AS (SELECT k.ukey, level, num, size, row_number() OVER (PARTITION BY k.ukey ORDER BY level, num DESC) AS step, count(*) OVER (PARTITION BY k.ukey) AS n FROM k JOIN meta ON imin_k <= k.ukey AND k.ukey <= imax_k)
SELECT level, num, count(*) AS seeks, greatest(100, any_value(size) // 16384) - count(*) AS seek_left FROM p WHERE n >= 2 AND step = 1 GROUP BY level, num""")
def seek_usage(spark, sf_dir):
    log = _log(spark, sf_dir)
    meta = fixture.table_meta(log)
    return layout.seek_exhausted(meta, read.files_for_keys(meta, log.select("ukey").distinct()))


@query(KV + RESOLVED.format(where="WHERE level >= 1") + "SELECT ukey, seq, kind FROM rs WHERE kind = 1")
def compact_output(spark, sf_dir):
    log = _log(spark, sf_dir)
    out = write.compact(log, log.where("level >= 1").select("file_num"), bottom=True)
    return out.select("ukey", "seq", F.col("kind").cast("int").alias("kind"))


#: What a read at each pin, or at the end, finds.
PINNED_SQL = """
, pins(p) AS (VALUES (100), (500), (700), (900), (7000), (8200), (9500), (9223372036854775807)), w AS (
  SELECT ukey, seq, kind FROM (SELECT kv.*, row_number() OVER (PARTITION BY ukey, p ORDER BY level, seq DESC, kind DESC, file_num DESC) AS rn FROM kv JOIN pins ON seq <= p WHERE level {levels}) WHERE rn = 1
), u AS (SELECT DISTINCT ukey, seq, kind FROM w)
"""
PINS = [100, 500, 700, 900, 7000, 8200, 9500]


@query(KV + PINNED_SQL.format(levels="<= 1") + "SELECT ukey, seq, kind FROM u")
def compact_pinned(spark, sf_dir):
    log = _log(spark, sf_dir)
    out = write.compact(log, log.where("level <= 1").select("file_num"), bottom=False, pins=PINS)
    return out.select("ukey", "seq", F.col("kind").cast("int").alias("kind"))


@query(KV + PINNED_SQL.format(levels=">= 0") + "SELECT ukey, seq, kind FROM u WHERE kind = 1 OR EXISTS (SELECT 1 FROM u o WHERE o.ukey = u.ukey AND o.kind = 1 AND o.seq < u.seq)")
def compact_pinned_bottom(spark, sf_dir):
    log = _log(spark, sf_dir)
    out = write.compact(log, log.select("file_num"), bottom=True, pins=PINS)
    return out.select("ukey", "seq", F.col("kind").cast("int").alias("kind"))


def _store(spark, sf_dir, upto: int | None = None) -> tuple[Store, object]:
    """A store of all events in three batches, compacted in between; after the second
    a snapshot is taken."""
    log = _log(spark, sf_dir)
    n = (log.agg(F.max("seq")).first()[0] or 0) + 1
    store = Store(spark, unused_path(spark, "store"), Options(l0_trigger=2))
    snapshot = None
    for k in range(3):
        part = log.where((F.col("seq") * 3 >= k * n) & (F.col("seq") * 3 < (k + 1) * n))
        begin = store.state().last_seq + 1  # numbers go on from there
        store.write(part.select("ukey", "value", "kind", (F.col("seq") + 1 - begin).alias("o")), order="o")
        if k == 1:
            snapshot = store.snapshot()
        store.compact()
    return store, snapshot


@query(KV + ", m AS (SELECT ukey, max(seq) AS s, max_by(kind, seq) AS k, max_by(value, seq) AS v FROM kv GROUP BY ukey) SELECT ukey, s + 1 AS seq, round(v, 4) AS value FROM m WHERE k = 1")
def store_latest(spark, sf_dir):
    """What a store holds after batches and compactions; its numbers begin at 1."""
    return _store(spark, sf_dir)[0].scan().withColumn("value", F.round("value", 4))


@query(KV + ", n AS (SELECT max(seq) + 1 AS n FROM kv), m AS (SELECT ukey, max(seq) AS s, max_by(kind, seq) AS k FROM kv, n WHERE seq * 3 < 2 * n GROUP BY ukey) SELECT ukey, s + 1 AS seq FROM m WHERE k = 1")
def store_snapshot(spark, sf_dir):
    """What a snapshot sees, although all was compacted since."""
    return _store(spark, sf_dir)[1].scan().select("ukey", "seq")


@query(META + ", s AS (SELECT num, imin_k, imax_k FROM meta WHERE level = 1 AND imax_k >= '00000010' AND imin_k <= '00000040'), h AS (SELECT min(imin_k) AS lo, max(imax_k) AS hi FROM s) SELECT num FROM s UNION ALL SELECT num FROM meta, h WHERE level = 2 AND imax_k >= lo AND imin_k <= hi")
def compaction_inputs(spark, sf_dir):
    return layout.compaction_inputs(_meta(spark, sf_dir), 1, "00000010", "00000040").select("num")


# Collection, names, pointers

#: Ten versions; version v holds the files whose number isn't divisible by v + 2.
VERSIONS_SQL = ", v AS (SELECT CAST(r AS BIGINT) AS version_id, num FROM meta, range(0, 10) t(r) WHERE num % (r + 2) <> 0)"


def _versions(spark, sf_dir):
    nums = _meta(spark, sf_dir).select("num")
    spread = nums.select("num", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("v"))
    return spread.select("num", F.col("v").cast("long").alias("version_id")).where(F.col("num") % (F.col("version_id") + 2) != 0)


@query(META + "SELECT max(num) + 1 AS next_file_num FROM meta")
def next_file_number(spark, sf_dir):
    return spark.createDataFrame([(manifest.next_file_number(_meta(spark, sf_dir)),)], "next_file_num long")


@query(META + VERSIONS_SQL + "SELECT num, count(DISTINCT version_id) AS refs FROM v GROUP BY num")
def file_refcount(spark, sf_dir):
    return manifest.reference_counts(_versions(spark, sf_dir))


@query(META + VERSIONS_SQL + "SELECT num FROM meta WHERE num NOT IN (SELECT num FROM v WHERE version_id IN (0, 1))")
def file_garbage(spark, sf_dir):
    return manifest.garbage(_meta(spark, sf_dir), _versions(spark, sf_dir).where("version_id in (0, 1)"))


NAMES_SQL = "n AS (SELECT num, CAST(1 << (num % 5) AS INTEGER) AS kind FROM meta), f AS (SELECT num, kind, CASE kind WHEN 1 THEN printf('MANIFEST-%06d', num) WHEN 2 THEN printf('%06d.log', num) WHEN 4 THEN printf('%06d.ldb', num) WHEN 8 THEN printf('%06d.tmp', num) END AS name FROM n)"


def _names(spark, sf_dir):
    n = _meta(spark, sf_dir).select("num", F.expr("cast(shiftleft(1, cast(num % 5 as int)) as int)").alias("kind"))
    return n.withColumn("name", names.file_name(F.col("kind"), F.col("num")))


@query(META + ", " + NAMES_SQL + " SELECT num, kind, name FROM f")
def file_names(spark, sf_dir):
    return _names(spark, sf_dir).select("num", "kind", "name")


@query(META + ", " + NAMES_SQL + " SELECT name, kind AS type, num AS number FROM f WHERE kind & 6 <> 0 UNION ALL SELECT lpad(CAST(num AS VARCHAR), 6, '0') || '.sst', 4, num FROM meta")
def parse_filenames(spark, sf_dir):
    found = _names(spark, sf_dir).select("name").union(_meta(spark, sf_dir).select(F.format_string("%06d.sst", "num")))
    found = found.union(_meta(spark, sf_dir).select(F.format_string("%06d.txt", "num"))).where(names.of_types(F.col("name"), names.JOURNAL | names.TABLE))
    return found.select("name", names.file_type(F.col("name")).alias("type"), names.file_number(F.col("name")).alias("number"))


@query("SELECT o_orderkey, CASE WHEN b <= 1024 THEN b || 'B' WHEN b // 1024 <= 1024 THEN (b // 1024) || 'KiB' WHEN b // 1048576 <= 1024 THEN (b // 1048576) || 'MiB' WHEN b // 1073741824 <= 1024 THEN (b // 1073741824) || 'GiB' ELSE (b // 1099511627776) || 'TiB' END AS shown FROM (SELECT o_orderkey, o_orderkey * o_orderkey * o_custkey AS b FROM orders)")
def human_size(spark, sf_dir):
    """The sizes are products of three keys, which a long doesn't hold from some
    millions on; decimals do, to 38 digits."""
    key, customer = (F.col(c).cast("decimal(20,0)") for c in ("o_orderkey", "o_custkey"))
    return fixture.read(spark, sf_dir, "orders").select("o_orderkey", names.short_bytes(key * key * customer).alias("shown"))


#: Each customer's orders as pointer files of a directory: the newest of the fifth kind
#: is CURRENT, the newest of the sixth its backup, all others are pending; a manifest
#: exists if its number isn't divisible by 3.
@query("""WITH p AS (SELECT o_custkey, o_orderkey AS n, o_orderkey % 5 AS k, o_orderkey * 7 % 101 AS t FROM orders),
g AS (SELECT o_custkey, max_by(t, n) FILTER (k = 0) AS cur, max_by(t, n) FILTER (k = 1) AS bak, max_by(t, n) FILTER (k > 1 AND t % 3 <> 0) AS own FROM p GROUP BY o_custkey),
s AS (SELECT o_custkey, own, CASE WHEN cur % 3 <> 0 THEN cur WHEN bak % 3 <> 0 THEN bak END AS settled FROM g)
SELECT o_custkey, CASE WHEN own IS NOT NULL AND (settled IS NULL OR own > settled) THEN own ELSE settled END AS picked FROM s""")
def current_pick(spark, sf_dir):
    o = fixture.read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("n"))
    name = F.when(F.col("n") % 5 == 0, "CURRENT").when(F.col("n") % 5 == 1, "CURRENT.bak").otherwise(F.concat(F.lit("CURRENT."), F.col("n").cast("string")))
    files = o.groupBy("o_custkey", name.alias("name")).agg((F.max("n") * 7 % 101).alias("target"))

    def pick(frames):
        for f in frames:
            out = [(c, storage.pick_current(dict(p), {k for k in range(101) if k % 3})) for c, p in zip(f.o_custkey, f.pointers, strict=True)]
            yield pd.DataFrame({"o_custkey": [c for c, _ in out], "picked": pd.array([p for _, p in out], "Int64")})

    pointers = files.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("name", "target"))).alias("pointers"))
    return pointers.mapInPandas(pick, "o_custkey long, picked long")


# Journals and blocks

CHUNK_SQL = """
c AS (
  SELECT user_id, event_id, i AS part, n, CASE WHEN n = 1 THEN 1 WHEN i = 0 THEN 2 WHEN i = n - 1 THEN 4 ELSE 3 END AS type,
    substr(props, CAST(i * 7 + 1 AS INTEGER), CASE WHEN i = n - 1 THEN 1000000 ELSE 7 END) AS payload
  FROM (SELECT *, unnest(range(0, n)) AS i FROM (SELECT *, 1 + event_id % 3 AS n FROM events))
)
"""


def _chunks(spark, sf_dir):
    n = (F.col("event_id") % 3 + 1).cast("int")
    parts = fixture.read(spark, sf_dir, "events").withColumn("n", n).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    kind = F.when(F.col("n") == 1, 1).when(F.col("part") == 0, 2).when(F.col("part") == F.col("n") - 1, 4).otherwise(3)
    payload = F.substr("props", F.col("part") * 7 + 1, F.when(F.col("part") == F.col("n") - 1, 1_000_000).otherwise(7))
    return parts.select("user_id", "event_id", "part", kind.alias("type"), payload.alias("payload"))


#: Journals of 500 records, and their chunks: a record is cut where a block of 32 KiB
#: ends, and a header of seven bytes is never cut.
JOURNAL_SQL = """
WITH RECURSIVE r AS (
  SELECT CAST(event_id // 500 AS VARCHAR) AS path, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) AS i, repeat(props, CAST(1 + event_id % 40 AS INTEGER)) AS record FROM events
), z AS (SELECT path, i, CAST(octet_length(encode(record)) AS BIGINT) AS n FROM r
), c AS (
  SELECT path, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS chunk_no, CAST(0 AS BIGINT) AS block_no, CAST(0 AS BIGINT) AS "at", CAST(0 AS BIGINT) AS type, CAST(0 AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS rest, CAST(0 AS BIGINT) AS pos FROM z WHERE i = 1
  UNION ALL
  SELECT path, i, chunk_no, start // 32768, start % 32768, CASE WHEN first AND n = part THEN 1 WHEN first THEN 2 WHEN n = part THEN 4 ELSE 3 END, part, n - part, start + 7 + part FROM (
    SELECT *, least(n, 32768 - start % 32768 - 7) AS part FROM (
      SELECT c.path, z.i, c.chunk_no + 1 AS chunk_no, c.rest = 0 AS first, CASE WHEN c.rest = 0 THEN z.n ELSE c.rest END AS n, CASE WHEN 32768 - c.pos % 32768 < 7 THEN (c.pos // 32768 + 1) * 32768 ELSE c.pos END AS start
      FROM c JOIN z ON z.path = c.path AND z.i = CASE WHEN c.rest = 0 THEN c.i + 1 ELSE c.i END
    )
  )
), ch AS (SELECT * FROM c WHERE chunk_no >= 0)
"""


def _journals(spark, sf_dir):
    e = fixture.read(spark, sf_dir, "events")
    rows = e.select(F.floor(F.col("event_id") / 500).alias("journal"), "event_id", F.expr("repeat(props, cast(1 + event_id % 40 as int))").alias("record"))
    return journal.in_order(rows, "journal", "event_id", "record")


def _damaged(batches):
    """The journals with a wrong checksum at the beginning of their second block."""

    def flip(blocks):
        for k, block in enumerate(blocks):
            yield bytes([block[0] ^ 1]) + block[1:] if k == 1 else block

    for name, blocks in journal.encoded(batches):
        yield name, flip(blocks)


@query(JOURNAL_SQL + "SELECT path, chunk_no, block_no, \"at\", type, bytes FROM ch")
def journal_chunks(spark, sf_dir):
    return journal.chunk_rows(_journals(spark, sf_dir), source=journal.encoded)


@query(JOURNAL_SQL + ", lost AS (SELECT DISTINCT path, i FROM ch WHERE block_no = 1) SELECT path, row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS record_no, md5(record) AS record FROM r WHERE (path, i) NOT IN (SELECT path, i FROM lost)")
def journal_corruption(spark, sf_dir):
    """Records that a damaged block leaves: those with no part in it."""
    return journal.records(_journals(spark, sf_dir), source=_damaged).select("path", "record_no", F.md5("record").alias("record"))


@query(JOURNAL_SQL + """, size AS (SELECT path, max(pos) AS n FROM ch GROUP BY path)
SELECT path, 'checksum-differs' AS reason, least(n - 32768, 32768) AS bytes FROM size WHERE n > 32768
UNION ALL SELECT path, 'part-without-start', bytes + 7 FROM ch WHERE block_no = 2 AND "at" = 0 AND type IN (3, 4)""")
def journal_dropped(spark, sf_dir):
    """What is reported of a damaged block: its bytes, and the part behind it."""
    return journal.dropped(_journals(spark, sf_dir), source=_damaged)


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS record_no, 1 + event_id % 3 AS chunks, props AS record FROM events")
def journal_reassemble(spark, sf_dir):
    return journal.reassemble(_chunks(spark, sf_dir), "user_id", ["event_id", "part"])


@query(BLOCKS_SQL + "SELECT file_num, block, \"offset\", length, entries, first_key, last_key, top_key FROM blocks")
def block_cut(spark, sf_dir):
    """The blocks of each file's table, read back from its index."""
    return table_file.block_index(_files(spark, sf_dir), PLAIN)


def _key_pairs(spark, sf_dir):
    rows = _part_keys(spark, sf_dir).select(F.col("ukey"), F.substring("ukey", 1, 1).alias("grp"))
    pairs = scan.positions(rows, "grp")
    return pairs.select("ukey", F.hex(F.encode("ukey", "UTF-8")).alias("a"), F.hex(F.encode("next_key", "UTF-8")).alias("b"))


PAIRS_SQL = f"""
WITH p AS (SELECT {PART_KEY} AS ukey FROM part), q AS (SELECT ukey, lead(ukey) OVER (PARTITION BY substr(ukey, 1, 1) ORDER BY ukey) AS nxt FROM p),
s AS (
  SELECT ukey, nxt, CAST(coalesce(list_min(list_filter(range(0, least(length(ukey), length(nxt))), lambda i: ukey[i + 1] <> nxt[i + 1])), least(length(ukey), length(nxt))) AS INTEGER) AS n FROM q
)
"""


@query(PAIRS_SQL + "SELECT ukey, n AS shared FROM s WHERE nxt IS NOT NULL")
def shared_prefix(spark, sf_dir):
    return _key_pairs(spark, sf_dir).where("b is not null").select("ukey", keys.shared_prefix(F.col("a"), F.col("b")).alias("shared"))


@query(PAIRS_SQL + "SELECT ukey, CASE WHEN n < least(length(ukey), length(nxt)) AND ascii(ukey[n + 1]) + 1 < ascii(nxt[n + 1]) THEN hex(encode(substr(ukey, 1, n) || chr(ascii(ukey[n + 1]) + 1))) END AS sep FROM s WHERE nxt IS NOT NULL")
def separator(spark, sf_dir):
    return _key_pairs(spark, sf_dir).where("b is not null").select("ukey", keys.separator_hex(F.col("a"), F.col("b")).alias("sep"))


@query(f"SELECT ukey, hex(encode(chr(ascii(ukey[1]) + 1))) AS suc FROM (SELECT {PART_KEY} AS ukey FROM part)")
def successor(spark, sf_dir):
    return _key_pairs(spark, sf_dir).select("ukey", keys.successor_hex(F.col("a")).alias("suc"))


@query(KV + ", n AS (SELECT ukey, seq, kind, printf('%016x', (CAST(seq AS UBIGINT) << 8) + kind) AS h FROM kv) SELECT ukey, seq, hex(encode(ukey)) || upper(substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) AS ikey FROM n")
def internal_keys(spark, sf_dir):
    return _log(spark, sf_dir).select("ukey", "seq", keys.internal_key_hex(F.col("ukey"), F.col("seq"), F.col("kind")).alias("ikey"))


@query(BLOCKS_SQL + "SELECT file_num, blocks, entries, bytes FROM files")
def writer_counters(spark, sf_dir):
    return _files(spark, sf_dir).select("file_num", "blocks", "entries", "bytes")


@query(KV + "SELECT file_num, ukey, seq, CAST(kind AS INTEGER) AS kind FROM (SELECT *, row_number() OVER (PARTITION BY file_num ORDER BY ukey, seq DESC) AS i FROM kv WHERE ukey > '00000009' OR ukey = '00000009' AND seq <= 700) WHERE i = 1")
def find_in_files(spark, sf_dir):
    """A seek in each file's table, which holds internal keys."""
    return table_file.find_in_files(_files(spark, sf_dir), "00000009", 700, PLAIN)


@query(KV + "SELECT file_num, ukey, seq, CAST(kind AS INTEGER) AS kind, row_number() OVER (PARTITION BY file_num ORDER BY ukey DESC, seq) - 1 AS pos FROM kv WHERE ukey >= '00000005' AND ukey < '00000100'")
def cursor_walk(spark, sf_dir):
    """A cursor from the last row of a range to its first, in each file's table."""
    return table_file.walk(_files(spark, sf_dir), "00000005", "00000100", True, PLAIN)


#: A filter is cut where a block's end passes a multiple of 2 KiB, once for each.
@query(BLOCKS_SQL + """, ends AS (SELECT file_num, block, ("offset" + length + 5) // 2048 AS upto FROM blocks),
g AS (SELECT file_num, max(upto) AS n, max_by(upto, block) AS last, coalesce(max(upto) FILTER (block < nb), 0) AS before FROM ends JOIN (SELECT file_num AS f, max(block) AS nb FROM ends GROUP BY ALL) ON f = file_num GROUP BY file_num)
SELECT file_num, CAST(n + CASE WHEN last <= before THEN 1 ELSE 0 END AS BIGINT) AS segments, CAST(0 AS BIGINT) AS lost FROM g""")
def filter_partition(spark, sf_dir):
    """Segments of each table's filter, and keys that their own segment denies."""
    options = Options(compression="none")
    return table_file.filter_segments(table_file.write_files(_valued(spark, sf_dir), options), options)


# Byte formats, written and read back


@query("SELECT CAST(event_id // 500 AS VARCHAR) AS path, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) - 1 AS record_no, repeat(props, CAST(1 + event_id % 40 AS INTEGER)) AS record FROM events")
def journal_round_trip(spark, sf_dir):
    """Journals of 500 records, some over several blocks, encoded and decoded."""
    return journal.records(_journals(spark, sf_dir), strict=True, source=journal.encoded).select("path", "record_no", F.decode("record", "UTF-8").alias("record"))


@query("SELECT o_orderkey // 1000 AS tbl, printf('%08d', o_orderkey) AS key, o_orderpriority AS value FROM orders WHERE o_orderkey % 1000 BETWEEN 100 AND 899")
def table_round_trip(spark, sf_dir):
    """Sorted tables of 1,000 keys, encoded, then scanned over a range of each."""
    o = fixture.read(spark, sf_dir, "orders")
    rows = o.select(F.floor(F.col("o_orderkey") / 1000).alias("tbl"), F.format_string("%08d", "o_orderkey").alias("key"), F.col("o_orderpriority").alias("value"))

    def encode(key, part):
        part = part.sort_values("key")
        return pd.DataFrame({"tbl": [key[0]], "content": [table_file.encode([(k.encode(), v.encode()) for k, v in zip(part.key, part.value, strict=True)])]})

    def decode(frames):
        for f in frames:
            for n, content in zip(f.tbl, f.content, strict=True):
                found = list(table_file.Table(bytes(content)).entries(b"%08d" % (n * 1000 + 100), b"%08d" % (n * 1000 + 900)))
                yield pd.DataFrame({"tbl": n, "key": [k.decode() for k, _ in found], "value": [v.decode() for _, v in found]})

    return rows.groupBy("tbl").applyInPandas(encode, "tbl long, content binary").mapInPandas(decode, "tbl long, key string, value string")


@query(META + OPS_SQL + "SELECT level, num, coalesce(size, 0) AS size, op FROM ops")
def manifest_round_trip(spark, sf_dir):
    """Every operation as an encoded edit, decoded again."""
    ops = _ops(spark, sf_dir)

    def both(frames):
        for f in frames:
            out = []
            for op, level, num, size in zip(f.op, f.level, f["num"], f["size"], strict=True):
                edit = manifest_codec.Edit(added=[(level, num, int(size), b"a", b"z")]) if op else manifest_codec.Edit(deleted=[(level, num)])
                back = manifest_codec.decode(manifest_codec.encode(edit))
                out += [(a, b, c, 1) for a, b, c, *_ in back.added] + [(a, b, 0, 0) for a, b in back.deleted]
            yield pd.DataFrame(out, columns=["level", "num", "size", "op"])

    return ops.mapInPandas(both, "level int, num long, size long, op int")


def _entry_stream(spark, sf_dir):
    """The log's entries as they would come in, file by file."""
    path = unused_path(spark, "entries")
    log = _log(spark, sf_dir).select("ukey", "seq", "kind", "value")
    log.repartition(4, "seq").write.parquet(path)
    return journal_stream.read_log_stream(spark, path, log.schema)


NEWEST_SQL = KV + "SELECT ukey, max(seq) AS seq, max_by(kind, seq) AS kind FROM kv GROUP BY ukey"


@query(NEWEST_SQL)
def stream_newest(spark, sf_dir):
    """A streamed journal merged batch by batch; each batch gives its newest entries."""
    out = unused_path(spark, "merged")
    journal_stream.merge_into(_entry_stream(spark, sf_dir), lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"), unused_path(spark, "progress")).awaitTermination()
    return journal_stream.newest(spark.read.parquet(out)).select("ukey", "seq", F.col("kind").cast("int").alias("kind"))


@query(NEWEST_SQL)
def stream_latest_by_key(spark, sf_dir):
    """The stateful operator over a streamed journal: the last that it emits of a key."""
    out = unused_path(spark, "latest")
    latest = journal_stream.latest_by_key(_entry_stream(spark, sf_dir))
    latest.writeStream.format("parquet").option("path", out).option("checkpointLocation", unused_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(journal_stream.LATEST).parquet(out)
    return found.groupBy("ukey").agg(F.max(F.struct("seq", "kind")).alias("e")).select("ukey", "e.seq", F.col("e.kind").cast("int").alias("kind"))


@query(KV + "SELECT ukey, seq, CAST(kind AS INTEGER) AS kind FROM kv")
def parse_internal_keys(spark, sf_dir):
    coded = _log(spark, sf_dir).select(keys.internal_key_hex(F.col("ukey"), F.col("seq"), F.col("kind")).alias("ikey"))
    return coded.select(keys.parse_key_hex(F.col("ikey")).alias("k")).select("k.*")


# Hashes and filters

#: The 32-bit hash of keys of eight bytes: two rounds.
HASH_SQL = """
, w AS (SELECT DISTINCT file_num, ukey, ascii(ukey[1]) + 256 * ascii(ukey[2]) + 65536 * ascii(ukey[3]) + 16777216 * CAST(ascii(ukey[4]) AS HUGEINT) AS w0,
  ascii(ukey[5]) + 256 * ascii(ukey[6]) + 65536 * ascii(ukey[7]) + 16777216 * CAST(ascii(ukey[8]) AS HUGEINT) AS w1 FROM kv),
h0 AS (SELECT *, CAST((xor(3164544308, CAST((8 * CAST(3332679571 AS HUGEINT)) % 4294967296 AS BIGINT)) + w0) * 3332679571 % 4294967296 AS BIGINT) AS x FROM w),
h1 AS (SELECT *, CAST((CAST(xor(x, x >> 16) AS HUGEINT) + w1) % 4294967296 * 3332679571 % 4294967296 AS BIGINT) AS y FROM h0),
hashed AS (SELECT file_num, ukey, xor(y, y >> 16) AS h FROM h1)
"""


@query(KV + HASH_SQL + "SELECT DISTINCT ukey, h FROM hashed")
def hash32(spark, sf_dir):
    return _log(spark, sf_dir).select("ukey").distinct().select("ukey", hashing.hash32_column(F.col("ukey")).alias("h"))


def _pair_sql() -> str:
    m, full = hashing.PAIR_MULTIPLIER, 0xFFFFFFFF
    steps, last = [], "CAST(0 AS BIGINT)"
    for n, word in enumerate(("(ns >> 32) & 4294967295", "ns & 4294967295", "(key >> 32) & 4294967295", "key & 4294967295")):
        steps.append(f"a{n} AS (SELECT *, (({word}) * {m}) & {full} AS k{n} FROM {f'b{n - 1}' if n else 'a'})")
        steps.append(f"b{n} AS (SELECT *, xor(({last} * {m}) & {full}, (xor(k{n}, k{n} >> 24) * {m}) & {full}) AS h{n} FROM a{n})")
        last = f"h{n}"
    steps.append(f"c AS (SELECT *, (xor(h3, h3 >> 13) * {m}) & {full} AS x FROM b3)")
    return "WITH a AS (SELECT o_custkey AS ns, o_orderkey * 1000000007 AS key FROM orders), " + ", ".join(steps) + " SELECT ns, key, xor(x, x >> 15) AS h FROM c"


@query(_pair_sql())
def pair_hash(spark, sf_dir):
    o = fixture.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ns"), (F.col("o_orderkey") * 1_000_000_007).alias("key"))
    return o.select("ns", "key", hashing.pair_hash(F.col("ns"), F.col("key")).alias("h"))


CRC_SQL = """
, b AS (SELECT DISTINCT ukey, list_transform(range(1, length(ukey) + 1), lambda i: CAST(ascii(ukey[i]) AS BIGINT)) AS bytes FROM kv),
r AS (SELECT ukey, list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, list_reduce(list_prepend(xor(c, x) & 255, range(0, 8)), lambda t, i: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 2197175160) ELSE t >> 1 END))) AS c FROM b),
f AS (SELECT ukey, xor(c, 4294967295) AS c FROM r)
SELECT ukey, (((c >> 15) | ((c << 17) & 4294967295)) + 2726488792) & 4294967295 AS crc FROM f
"""


@query(KV + CRC_SQL)
def crc32c_masked(spark, sf_dir):
    return _log(spark, sf_dir).select("ukey").distinct().select("ukey", hashing.masked_crc_column(F.col("ukey")).alias("crc"))


BLOOM_SQL = HASH_SQL + """
, z AS (SELECT file_num, count(*) AS n_keys, (greatest(count(*) * 10, 64) + 7) // 8 * 8 AS n_bits FROM hashed GROUP BY file_num),
bits AS (
  SELECT DISTINCT file_num, n_keys, n_bits, ((h + j * ((h >> 17) | ((h << 15) & 4294967295))) % 4294967296) % n_bits AS bit FROM hashed JOIN z USING (file_num), range(0, 6) t(j)
)
"""


@query(KV + BLOOM_SQL + "SELECT file_num, n_keys, CAST(n_bits AS BIGINT) AS n_bits, CAST(bit AS BIGINT) AS bit FROM bits")
def bloom_build(spark, sf_dir):
    return bloom.table_filters(_log(spark, sf_dir))


@query(META + BLOOM_SQL + """, a AS (SELECT num AS file_num, k.ukey FROM meta JOIN (SELECT DISTINCT ukey FROM kv) k ON imin_k <= k.ukey AND k.ukey <= imax_k),
ph AS (SELECT a.file_num, a.ukey, h.h, n_bits FROM a JOIN (SELECT DISTINCT ukey, h FROM hashed) h USING (ukey) JOIN z ON z.file_num = a.file_num),
pb AS (SELECT DISTINCT file_num, ukey, ((h + j * ((h >> 17) | ((h << 15) & 4294967295))) % 4294967296) % n_bits AS bit FROM ph, range(0, 6) t(j))
SELECT pb.file_num, pb.ukey FROM pb LEFT JOIN bits USING (file_num, bit) GROUP BY ALL HAVING count(bits.n_keys) = count(*)""")
def bloom_probe(spark, sf_dir):
    """Of the files whose range holds a key, those whose filter doesn't rule it out."""
    log = _log(spark, sf_dir)
    probes = read.files_for_keys(fixture.table_meta(log), log.select("ukey").distinct()).select(F.col("num").alias("file_num"), "ukey")
    return bloom.probe(bloom.table_filters(log), probes)


# Caches

ACCESS_SQL = "WITH a AS (SELECT user_id % 4 AS ns, user_id AS key, CAST(100 + user_id % 50 AS BIGINT) AS size, event_id AS t FROM events), m AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY ns, key ORDER BY t) = 1 THEN 1 ELSE 0 END AS miss FROM a)"


def _accesses(spark, sf_dir):
    e = fixture.read(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 4).alias("ns"), F.col("user_id").alias("key"), (F.col("user_id") % 50 + 100).alias("size"), F.col("event_id").alias("t"))


@query(ACCESS_SQL + "SELECT ns, count(*) AS gets, CAST(sum(miss) AS BIGINT) AS misses, CAST(count(*) - sum(miss) AS BIGINT) AS hits, CAST(sum(miss * size) AS BIGINT) AS bytes FROM m GROUP BY ns")
def cache_hit_stats(spark, sf_dir):
    return cache.hit_stats(_accesses(spark, sf_dir))


#: Each shard's accesses in order; the state lists what is held, least recent first.
LRU_SQL = ACCESS_SQL.replace("WITH a", "WITH RECURSIVE a", 1) + """, n AS (SELECT ns, key // 4 % 4 AS shard, key, size, row_number() OVER (PARTITION BY ns, key // 4 % 4 ORDER BY t) AS i FROM a),
s AS (
  SELECT ns, shard, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ks, CAST([] AS BIGINT[]) AS zs, CAST(0 AS BIGINT) AS hits, CAST(0 AS BIGINT) AS misses, CAST(0 AS BIGINT) AS evictions FROM n WHERE i = 1
  UNION ALL
  SELECT ns, shard, i, ks[d + 1:], zs[d + 1:], hits, misses, evictions + d FROM (
    SELECT *, list_min(list_filter(range(0, len(zs) + 1), lambda x: coalesce(list_sum(zs[x + 1:]), 0) <= 2000)) AS d FROM (
      SELECT n.ns, n.shard, n.i, s.hits + CASE WHEN p > 0 THEN 1 ELSE 0 END AS hits, s.misses + CASE WHEN p > 0 THEN 0 ELSE 1 END AS misses, s.evictions,
        CASE WHEN p > 0 THEN list_append(list_concat(ks[:p - 1], ks[p + 1:]), n.key) WHEN n.size <= 2000 THEN list_append(ks, n.key) ELSE ks END AS ks,
        CASE WHEN p > 0 THEN list_append(list_concat(zs[:p - 1], zs[p + 1:]), n.size) WHEN n.size <= 2000 THEN list_append(zs, n.size) ELSE zs END AS zs
      FROM (SELECT s.*, n.key AS want, coalesce(list_position(ks, n.key), 0) AS p FROM s JOIN n ON n.ns = s.ns AND n.shard = s.shard AND n.i = s.i + 1) s JOIN n ON n.ns = s.ns AND n.shard = s.shard AND n.i = s.i + 1
    )
  )
)
SELECT ns, shard, hits, misses, evictions, CAST(coalesce(list_sum(zs), 0) AS BIGINT) AS bytes FROM s QUALIFY row_number() OVER (PARTITION BY ns, shard ORDER BY i DESC) = 1"""


@query(LRU_SQL)
def lru_sim(spark, sf_dir):
    return cache.lru_stats(_accesses(spark, sf_dir), 2000, 4, F.floor(F.col("key") / 4))


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}

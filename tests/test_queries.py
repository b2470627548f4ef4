"""Every registered query with SQL against DuckDB, at the smallest scale."""

import os

import duckdb
import pyarrow as pa
import pytest

from tidemark import queries
from tidemark.sources import journal

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


def shown(n: int) -> str:
    for unit in ("", "Ki", "Mi", "Gi"):
        if n <= 1024:
            return f"{n}{unit}B"
        n >>= 10
    return f"{n}TiB"


def test_human_size_beyond_a_long(spark, tmp_path):
    keys = [(0, 5), (1, 1024), (1, 1025), (1024, 1), (1025, 1), (32_768, 1024), (9_000_000, 900_000), (10**9, 10**9), (4 * 10**12, 6 * 10**12), (2**20 - 1, 2**40 - 1), (None, 1), (3, -4)]
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = queries.QUERIES["human_size"][0](spark, str(tmp_path)).collect()
    want = [(a, None if a is None else shown(a * a * b)) for a, b in keys]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["journal_chunks", "journal_corruption", "journal_dropped", "journal_round_trip"])
def test_journals_stay_in_one_python_step(spark, name):
    df = queries.QUERIES[name][0](spark, SF)
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_damage_block_by_block():
    texts = {"a": ["x" * 900] * 40, "b": ["y" * 500], "c": ["z" * 70_000, "w"]}
    rows = [(name, x) for name, own in texts.items() for x in own]
    batches = (pa.record_batch([pa.array([r[0] for r in rows[k : k + 7]]), pa.array([r[1] for r in rows[k : k + 7]])], names=["path", "record"]) for k in range(0, len(rows), 7))
    got = {name: list(journal.decode(blocks)) for name, blocks in queries._damaged(batches)}
    for name, own in texts.items():
        whole = bytearray(journal.encode(x.encode() for x in own))
        if len(whole) > journal.BLOCK:
            whole[journal.BLOCK] ^= 1
        assert got[name] == list(journal.decode(bytes(whole)))
    assert len(got["a"]) < 40 and len(got["b"]) == 1 and got["c"] == [b"w"]


def test_lru_sim_streams_and_takes_nulls(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT event_id, CASE WHEN event_id % 7 > 0 THEN user_id END AS user_id FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet'")
    query, sql = queries.QUERIES["lru_sim"]
    df = query(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan  # a group in one frame grows with the table
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, con.execute(sql).fetchall()))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    query, sql = queries.QUERIES[name]
    df = query(spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if sql is None:
        return
    result = duck.execute(sql)
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    assert rows == sorted(repr(tuple(dict(zip(found, r, strict=True))[c] for c in columns)) for r in result.fetchall())

"""Vector searches against brute force."""

import duckdb
import numpy as np
import pytest

from tidemark.llm import ann_mih, mips_norm, queries

SF = "/root/testdata/sf0.001"
ODD = [(None, [1.0, 2.0]), (7, None), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (10, [None, 1.0]), (11, [0.0, 0.0])]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 5, 1.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")


def test_multi_index_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (500, 8), dtype=np.uint8)
    index = ann_mih.MultiIndex(codes)
    for q in codes[:20] ^ rng.integers(0, 4, (20, 8), dtype=np.uint8):
        far = np.bitwise_count(codes ^ q).sum(1)
        for least in (1, 10, 200, 500, 900):
            got = index.within(q, least)
            radius = np.sort(far)[min(least, 500) - 1]
            assert set(got) == set(np.flatnonzero(far <= radius))


def test_an_index_is_stored_and_opened():
    rng = np.random.default_rng(4)
    codes, ids = rng.integers(0, 256, (300, 4), dtype=np.uint8), rng.integers(0, 200, 300)
    made = ann_mih.MultiIndex(codes, ids)
    again = ann_mih.MultiIndex.opened(*made.stored(), ids)
    for q in codes[:10]:
        assert made.within(q, 30).tolist() == again.within(q, 30).tolist()


def test_blocks_that_cannot_reach_are_left_out(spark, monkeypatch):
    """Short vectors stand in blocks of their own, which no pair then holds."""
    monkeypatch.setattr(mips_norm, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 6)) * np.where(np.arange(800) % 8 == 0, 4.0, 0.01)[:, None]
    df = vectors(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)])
    seen = []
    real = mips_norm.cells.search

    def spy(queries, held, work, kind, reach):
        seen.append((real(queries, held, lambda row: ([0], [0], [0]), kind, reach).count(), real(queries, held, lambda row: ([0], [0], [0]), kind).count()))
        return real(queries, held, work, kind, reach)

    monkeypatch.setattr(mips_norm.cells, "search", spy)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in mips_norm.top_k(df, query_step=80).collect()}
    ints = np.floor(256 * x.astype(np.float32).astype(float)).astype(np.int64)
    for q in range(0, 800, 80):
        want = sorted((-int(ints[v] @ ints[q]), v) for v in range(800) if v != q)[:5]
        assert [got[q, k] for k in range(1, 6)] == [(v, -n) for n, v in want]
    assert seen[0][0] <= seen[0][1] // 3


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_nearest_recall(spark, sf):
    where = f"/root/testdata/sf{sf}"
    got = queries.op1_multi_index_hashing(spark, where).toPandas()
    x = {r[0]: np.array(r[1], float) for r in duckdb.sql(f"select vec_id, embedding from '{where}/embeddings.parquet'").fetchall()}
    hits = total = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 11)) and list(g["score"]) == sorted(g["score"])
        for v, s in zip(g.vec_id, g.score, strict=True):
            assert s == pytest.approx(np.linalg.norm(x[q] - x[v]), rel=1e-12)
        true = sorted((np.linalg.norm(x[q] - x[v]), v) for v in x if v != q)[:10]
        hits += len({v for _, v in true} & set(g.vec_id))
        total += 10
    assert set(got.query_id) == {v for v in x if v % 100 == 0} and hits >= 0.9 * total


def test_nearest_odd_rows(spark):
    rows = [(0, [1.0, 1.0]), (100, [1.0, 1.0]), (3, [2.0, 1.0]), (4, [2.0, 1.0]), (3, [2.0, 1.0]), (5, [5.0])]
    got = ann_mih.nearest(vectors(spark, rows + ODD)).collect()
    found = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 6)) for r in got}
    assert [found[0, k] for k in range(1, 5)] == [(100, 0.0), (3, 1.0), (4, 1.0), (5, round(17**0.5, 6))]
    assert {q for q, _ in found} == {0, 100} and len(found) == 8
    assert ann_mih.nearest(vectors(spark, [])).count() == 0
    assert ann_mih.nearest(vectors(spark, [(100, [1.0])])).count() == 0


def test_inner_products_are_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 12)) * rng.gamma(1, 1, (700, 1))
    x[50:60] = x[40]  # ties
    df = vectors(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)])
    got = {}
    for r in mips_norm.top_k(df).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    ints = np.floor(256 * x.astype(np.float32).astype(float)).astype(np.int64)
    for q in range(0, 700, 50):
        s = ints @ ints[q]
        want = sorted(((-s[v], v) for v in range(700) if v != q))[:5]
        assert [got[q][k] for k in range(1, 6)] == [(v, -n) for n, v in want]


def test_inner_products_odd_rows(spark):
    rows = [(0, [1.0, -1.0]), (50, []), (-3, [0.001]), (4, [-2.0, 1.0])]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in mips_norm.top_k(vectors(spark, rows + ODD)).collect()}
    assert [got[0, k] for k in range(1, 5)] == [(-3, 0), (11, 0), (50, 0), (4, -3 * 65536)]
    assert mips_norm.top_k(vectors(spark, [])).count() == 0


def test_an_id_repeated_often_counts_once(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 8))
    x[7] = 3 * x[0]  # the best and longest for query 0, and the last to be near it
    x[9] = x[0] + 0.001
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(7, [float(c) for c in x[7]])] * 20 + [(9, [float(c) for c in x[9]])] * 150
    ints = np.floor(256 * x.astype(np.float32).astype(float)).astype(np.int64)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in mips_norm.top_k(vectors(spark, rows)).collect()}
    for q in range(0, 300, 50):
        want = sorted((-int(ints[v] @ ints[q]), v) for v in range(300) if v != q)[:5]
        assert [got[q, k] for k in range(1, 6)] == [(v, -n) for n, v in want]
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann_mih.nearest(vectors(spark, rows)).collect()}
    assert set(found) == {(q, k) for q in (0, 100, 200) for k in range(1, 11)} and found[0, 1][0] == 9
    hits = sum(len({found[q, k][0] for k in range(1, 11)} & {v for _, v in sorted((np.linalg.norm(x[q] - x[v]), v) for v in range(300) if v != q)[:10]}) for q in (0, 100, 200))
    assert hits >= 27


def test_a_task_gives_a_query_its_best_only(spark, monkeypatch):
    """What leaves the search grows with tasks, not with pairs of blocks (F1), and no vector is shuffled there."""
    monkeypatch.setattr(mips_norm, "BLOCK_ROWS", 100)
    x = np.random.default_rng(12).normal(size=(6000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)  # no length rules out any pair
    df = vectors(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)])
    seen, real = [], mips_norm.cells.best

    def spy(found, k, nearest_first):
        seen.append((found.count(), found._jdf.queryExecution().executedPlan().toString()))
        return real(found, k, nearest_first)

    monkeypatch.setattr(mips_norm.cells, "best", spy)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in mips_norm.top_k(df, query_step=100).collect()}
    ints = np.floor(256 * x.astype(np.float32).astype(float)).astype(np.int64)
    for q in range(0, 6000, 100):
        want = sorted((-int(s), v) for v, s in enumerate(ints @ ints[q]) if v != q)[:5]
        assert [got[q, k] for k in range(1, 6)] == [(v, -n) for n, v in want]
    assert seen[0][0] <= 60 * 5 * 4 * spark.sparkContext.defaultParallelism
    assert "Exchange hashpartitioning" not in seen[0][1]


@pytest.mark.parametrize("kind", ["even", "few directions", "copies", "large"])
def test_best_of_blocks(monkeypatch, kind):
    """Partial sums of any number of columns, crowded tiles and copies change no result."""
    monkeypatch.setattr(mips_norm, "TILE", 64)
    monkeypatch.setattr(mips_norm, "PAIRS", 50)
    rng = np.random.default_rng(13)
    x = rng.normal(size=(1500, 24)) * (0.6 ** np.arange(24) if kind == "few directions" else 1.0)
    if kind == "copies":
        x[rng.choice(1500, 700)] = x[3]
    x = np.floor(x * (2**26 if kind == "large" else 256)).astype(np.int64)
    ids = rng.permutation(1500) - 700
    if kind == "copies":
        ids[rng.choice(1500, 100)] = 5  # one id, other vectors
    rotation = mips_norm.rotation_of(x[:300].astype(float))
    q, q_ids = x[::10], ids[::10]
    best = mips_norm.Best(q_ids, q.astype("<i4"), rotation, 5, np.full(len(q), -np.inf))
    for a in range(0, 1500, 400):
        best.add(*mips_norm.prepare(ids[a : a + 400], x[a : a + 400].astype("<i4"), rotation))
    for n in range(len(q)):
        score = {}
        for v, s in zip(ids.tolist(), (x @ q[n]).tolist(), strict=True):
            score[v] = max(s, score.get(v, s))
        want = sorted((-s, v) for v, s in score.items() if v != q_ids[n])[:5]
        assert list(zip((-best.scores[n]).tolist(), best.ids[n].tolist(), strict=True)) == want


def test_query_blocks_take_turns(spark, monkeypatch):
    """Queries that are too many to go to all vectors at once go in turns."""
    monkeypatch.setattr(mips_norm, "QUERY_ROWS", 512)
    monkeypatch.setattr(mips_norm.cells, "TURN_BYTES", 1)
    x = np.random.default_rng(14).normal(size=(1200, 6))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in mips_norm.top_k(vectors(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)]), query_step=1).collect()}
    ints = np.floor(256 * x.astype(np.float32).astype(float)).astype(np.int64)
    for q in range(1200):
        want = sorted((-int(s), v) for v, s in enumerate(ints @ ints[q]) if v != q)[:5]
        assert [got[q, k] for k in range(1, 6)] == [(v, -n) for n, v in want]

"""Reads, layout and folds against plain Python models on random inputs."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tidemark.errors import NotFound
from tidemark.functions import keys
from tidemark.operators import read, scan, write
from tidemark.options import Options, Strict
from tidemark.plans import cache, layout, manifest, ranges

LOG = "level int, file_num long, ukey string, seq long, kind byte, value double"


def model_get(rows, key, seq):
    """Walk levels from the smallest; the newest of a level counts and ends the walk."""
    for level in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == level and r[2] == key and (seq is None or r[3] <= seq)]
        if own:
            top = max(own, key=lambda r: (r[3], r[4], r[1]))
            return top if top[4] == 1 else None
    return None


def test_resolve_breaks_no_rule(spark):
    rng = random.Random(3)
    for invariant in (True, False):
        seqs = rng.sample(range(1000), 300)
        rows = [((0 if s > 700 else 1 if s > 300 else 2) if invariant else rng.randrange(-1, 4), rng.randrange(5), rng.choice("abcdefgh"), s, rng.randrange(2), float(s)) for s in seqs]
        log = spark.createDataFrame(rows, LOG)
        for seq in (None, 500, 0, seqs[0]):
            got = {r.ukey: r.seq for r in read.scan_latest(log, seq).collect()}
            want = {k: m[3] for k in "abcdefgh" if (m := model_get(rows, k, seq))}
            assert got == want


def test_tombstones_and_equal_seq(spark):
    log = spark.createDataFrame([(0, 1, "a", 5, 0, None), (1, 2, "a", 3, 1, 3.0), (0, 1, "b", 7, 1, 7.0), (0, 1, "b", 7, 0, None)], LOG)
    assert read.get(log, "a").count() == 0
    assert [r.seq for r in read.get(log, "a", 4).collect()] == [3]
    assert read.get(log, "b").count() == 1  # at equal numbers the live kind comes first
    assert read.get(log, "absent").count() == 0
    assert read.get_key(log, "b").columns == ["ukey", "seq"]


def test_neighbours(spark):
    rng = random.Random(5)
    have = rng.sample(range(1000), 100)
    ask = list(range(-5, 1010, 7)) + have[:5]
    got = read.neighbours(spark.createDataFrame([(p,) for p in ask], "p long"), spark.createDataFrame([(k,) for k in have], "k long"), "p", "k")
    assert {(r.p, r.below, r.at_or_above) for r in got.collect()} == {
        (p, max((k for k in have if k < p), default=None), min((k for k in have if k >= p), default=None)) for p in ask
    }
    empty = spark.createDataFrame([], "k long")
    assert [tuple(r) for r in read.neighbours(spark.createDataFrame([(1,)], "p long"), empty, "p", "k").collect()] == [(1, None, None)]


def test_ranges(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("ba",), ("c",)], "ukey string")
    found = lambda r: sorted(x.ukey for x in scan.in_range(rows, r).collect())
    assert found(scan.Range("b", "c")) == ["b", "ba"]
    assert found(scan.Range()) == ["a", "b", "ba", "c"] and not scan.Range().is_empty
    assert found(scan.Range("b", "b")) == [] and scan.Range("b", "b").is_empty
    assert found(scan.prefix_range("b")) == ["b", "ba"]
    assert scan.prefix_range(b"a\xff\xff") == scan.Range(b"a\xff\xff", b"b")
    assert scan.prefix_range(b"\xff\xff").limit is None and scan.prefix_range(b"").limit is None
    assert scan.Range("b").clamp("a") == "b" and scan.Range("b").clamp("c") == "c"


def test_range_is_pushed_to_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("lpad(cast(id as string), 8, '0') as ukey", "id as seq").write.parquet(str(tmp_path / "t"))
    df = scan.in_range(spark.read.parquet(str(tmp_path / "t")), scan.Range("00000100", "00000200")).select("ukey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ukey,00000100)" in plan and "LessThan(ukey,00000200)" in plan and "seq" not in plan.split("ReadSchema")[1]


def test_overlap_join(spark):
    rng = random.Random(13)
    spans = lambda n: [(k, a, a + rng.randrange(-1, 15)) for k, a in enumerate(rng.choices(range(100), k=n))]
    for cuts in (None, [], [10, 50]):
        left, right = spans(40), spans(40)
        a, b = spark.createDataFrame(left, "i long, a long, b long"), spark.createDataFrame(right, "j long, c long, d long")
        got = sorted((r.i, r.j) for r in ranges.overlap_join(a, b, ("a", "b"), ("c", "d"), cuts).collect())
        assert got == sorted((i, j) for i, a_, b_ in left for j, c, d in right if max(a_, c) <= min(b_, d))
        got = sorted((r.i, r.j) for r in ranges.overlap_join(a, b, ("a", "a"), ("c", "d"), cuts).collect())
        assert got == sorted((i, j) for i, a_, _ in left for j, c, d in right if c <= a_ <= d)


def model_closure(files, lo, hi):
    while True:
        hit = [f for f in files if f[1] <= hi and lo <= f[2]]
        new = (min([lo, *(f[1] for f in hit)]), max([hi, *(f[2] for f in hit)]))
        if new == (lo, hi):
            return {f[0] for f in hit}
        lo, hi = new


def test_closure(spark):
    rng = random.Random(11)
    for _ in range(8):
        files = [(k, a, a + rng.randrange(6)) for k, a in enumerate(rng.choices(range(60), k=14))]
        meta = spark.createDataFrame([(0, *f) for f in files], "level int, num long, imin_k long, imax_k long")
        lo = rng.randrange(60)
        got = {r.num for r in layout.closure(meta, lo, lo + 3).collect()}
        assert got == model_closure(files, lo, lo + 3)


def test_fold(spark):
    rng = random.Random(7)
    ops, live = [], {}
    for edit in range(40):
        gone = rng.sample(range(10), 3)
        come = rng.sample(range(10), 3)
        for n in gone:
            live.pop(n, None)
            ops.append((edit, 0, 1, n, None))
        for n in come:
            live[n] = edit
            ops.append((edit, 1, 1, n, edit))
    df = spark.createDataFrame(ops, "edit_no long, op int, level int, num long, size long")
    assert {r.num: r.size for r in manifest.fold(df).collect()} == live


def test_scalars_and_recover(spark):
    rows = [(0, "c", 1, None, 5, 9, [], [], []), (1, None, None, 2, 6, None, [], [], [])]
    edits = spark.createDataFrame(rows, manifest.EDIT)
    files, state = manifest.recover(edits, "c")
    assert state == {"comparer": "c", "journal_num": 1, "prev_journal_num": 2, "next_file_num": 6, "seq_num": 9} and files.count() == 0
    for bad in ("d",):
        try:
            manifest.recover(edits, bad)
            raise AssertionError
        except Exception as e:
            assert "comparer" in str(e)


def test_compaction(spark):
    rows = [(1, 1, "a", 9, 0, None), (2, 2, "a", 4, 1, 4.0), (1, 1, "b", 8, 1, 8.0), (2, 2, "b", 3, 1, 3.0), (1, 1, "c", 7, 0, None)]
    log = spark.createDataFrame(rows, LOG)
    inputs = log.select("file_num")
    found = lambda df: sorted((r.ukey, r.seq) for r in df.collect())
    assert found(write.compact(log, inputs, bottom=False)) == [("a", 9), ("b", 8), ("c", 7)]
    assert found(write.compact(log, inputs, bottom=True)) == [("b", 8)]
    assert found(write.compact(log, inputs, bottom=False, pins=[5])) == [("a", 4), ("a", 9), ("b", 3), ("b", 8), ("c", 7)]
    # With a pin below it, the tombstone still hides the value that the pin sees.
    kept = write.compact(log, inputs, bottom=True, pins=[5])
    assert read.get(kept, "a").count() == 0 and [r.seq for r in read.get(kept, "a", 5).collect()] == [4]


def test_compaction_keeps_what_snapshots_read(spark):
    rng = random.Random(21)
    for invariant in (True, False):
        seqs = rng.sample(range(400), 150)
        rows = [((0 if s > 250 else 1) if invariant else rng.randrange(3), rng.randrange(4), rng.choice("abcdef"), s, rng.randrange(2), float(s)) for s in seqs]
        log, pins = spark.createDataFrame(rows, LOG), sorted(rng.sample(range(400), 4))
        for bottom in (False, True):
            kept = [tuple(r) for r in write.compact(log, log.select("file_num"), bottom, pins).select(*log.columns).collect()]
            merged = [(1, *r[1:]) for r in kept]  # all go to one level
            for pin in [*pins, None]:
                for k in "abcdef":
                    a, b = model_get(rows, k, pin), model_get(merged, k, pin)
                    assert (a and a[3]) == (b and b[3])
            needed = {m[3] for pin in [*pins, None] for k in "abcdef" if (m := model_get([(*r[:4], 1, r[5]) for r in rows], k, pin))}
            assert {r[3] for r in kept} <= needed and (bottom or {r[3] for r in kept} == needed)


def test_only_one_version_a_key_is_shuffled(spark, tmp_path):
    spark.range(1000).selectExpr("0 as level", "0L as file_num", "cast(id % 5 as string) as ukey", "id as seq", "cast(1 as byte) as kind", "1.0 as value").write.parquet(str(tmp_path / "t"))
    plan = read.resolve(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    exchange, partial = plan.index("Exchange hashpartitioning"), plan.rindex("WindowGroupLimit")
    assert partial > exchange and "Partial" in plan[partial : partial + 200]  # versions drop out before the exchange


def test_ordered_plans_in_segments(spark):
    rng = random.Random(31)
    rows = [(rng.randrange(3), k, rng.randrange(500)) for k in range(400)]
    df = spark.createDataFrame(rows, "g int, num long, k long")
    groups = {g: sorted([(k, n) for h, n, k in rows if h == g]) for g in range(3)}
    for cuts in (None, [], [100, 200]):
        got = {(r.g, r.num): r.pos for r in ranges.numbered(df, ["g"], "k", [F.col("k"), F.col("num")], cuts=cuts).collect()}
        assert got == {(g, n): i + 1 for g, own in groups.items() for i, (_, n) in enumerate(own)}
        asked = spark.createDataFrame([(g, k) for g in range(4) for k in range(-1, 502, 7)], "g int, k long")
        for inclusive in (True, False):
            found = ranges.running_totals(asked, df, "k", "num", "t", ["g"], inclusive, cuts).collect()
            assert len(found) == 4 * 72 and all(r.t == sum(n for k, n in groups.get(r.g, []) if k < r.k or inclusive and k == r.k) for r in found)
        once = df.dropDuplicates(["g", "k"])
        near = {(r.g, r.k): (r.pos, r.prev_key, r.next_key) for r in ranges.with_neighbours(once, "g", "k").collect()}
        for g, own in groups.items():
            ks = sorted({k for k, _ in own})
            assert all(near[g, k] == (i + 1, ks[i - 1] if i else None, ks[i + 1] if i + 1 < len(ks) else None) for i, k in enumerate(ks))
        spans = [(g, n, k, k + n % 4) for g, n, k in rows]
        meta = spark.createDataFrame(spans, "level int, num long, imin_k long, imax_k long")
        numbers = {(r.level, r.num): r.island for r in layout.islands(meta, cuts=cuts).collect()}
        for g in range(3):
            reach, island = -1, 0
            for lo, hi, n in sorted((a, b, n) for h, n, a, b in spans if h == g):
                island += lo > reach
                reach = max(reach, hi)
                assert numbers[g, n] == island


def test_seek_budgets_are_carried(spark):
    old = spark.createDataFrame([(1, 7), (2, -3)], "num long, seek_left int")
    new = spark.createDataFrame([(0, 1, 10), (0, 2, 10), (1, 3, 16384 * 200)], "level int, num long, size long")
    left = layout.carried_budgets(old, new)
    assert {r.num: r.seek_left for r in left.collect()} == {1: 7, 2: -3, 3: 200}
    used = spark.createDataFrame([(1, 0, 3, 0), (2, 0, 9, -2), (3, 1, 1, 5)], "num long, level int, seeks long, seek_left int")
    assert layout.seek_nominee(used).first().num == 2 and layout.seek_nominee(used.where("num = 3")).first() is None


def test_snapshot_restores_a_version(spark):
    files = spark.createDataFrame([(0, 1, 10, "a", "c"), (1, 2, 20, "b", "d"), (1, 3, 5, "e", "f")], "level int, num long, size long, imin_k string, imax_k string")
    edit = manifest.snapshot_edit(files)
    assert sorted(map(tuple, manifest.restored(edit).collect())) == sorted(map(tuple, files.collect()))
    folded = manifest.fold(edit.select("edit_no", F.explode("added").alias("t")).select("edit_no", F.lit(1).alias("op"), "t.*"))
    assert folded.count() == 3 and manifest.ordered(files).where("level = 1").orderBy("place").first().num == 2


def test_scan_helpers(spark):
    rows = spark.createDataFrame([(k,) for k in "badc"], "ukey string")
    assert [(r.ukey, r.pos) for r in scan.reversed_scan(rows).orderBy("pos").collect()] == [("d", 1), ("c", 2), ("b", 3), ("a", 4)]
    assert tuple(scan.ends(rows).first()) == ("a", "d", 4) and write.reset(rows).count() == 0 and scan.empty(rows).columns == ["ukey"]
    lists = spark.createDataFrame([(1, [5, 6]), (2, []), (3, None)], "g int, xs array<int>")
    assert [tuple(r) for r in scan.of_array(lists, "xs", "x").collect()] == [(1, 0, 5), (1, 1, 6)]
    try:
        scan.empty(rows, NotFound("gone"))
        raise AssertionError
    except NotFound:
        pass


def test_memtable_level(spark):
    meta = spark.createDataFrame([(0, 1, 10, 0, 9), (1, 2, 10, 20, 29), (2, 3, 10, 40, 49), (3, 4, 10**9, 60, 69)], "level int, num long, size long, imin_k long, imax_k long")
    assert layout.memtable_level(meta, 5, 6, 2) == 0
    assert layout.memtable_level(meta, 25, 26, 2) == 0
    assert layout.memtable_level(meta, 45, 46, 2) == 1
    assert layout.memtable_level(meta, 65, 66, 3) == 1  # too many bytes two levels below
    assert layout.memtable_level(meta, 80, 81, 9) == 9
    assert layout.memtable_level(meta, 80, 81, 0) == 0


def test_flush(spark, tmp_path):
    log = spark.createDataFrame([(0, 1, f"{k % 50:03d}", k, 1, float(k)) for k in range(500)], LOG)
    meta = write.flush(log, str(tmp_path / "flush"), 3).orderBy("imin_k").collect()
    assert sum(m.entries for m in meta) == 500
    assert all(a.imax_k < b.imin_k for a, b in zip(meta, meta[1:], strict=False))


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=6), st.binary(max_size=6), st.integers(0, keys.MAX_SEQ), st.integers(0, 1))
def test_key_functions(a, b, seq, kind):
    assert keys.parse_internal_key(keys.internal_key(a, seq, kind)) == (a, seq, kind)
    x = keys.separator(a, b)
    if x is not None and a < b:
        assert a <= x < b
    y = keys.successor(a)
    assert y is None or y >= a


def test_key_columns(spark):
    rng = random.Random(2)
    pairs = [(bytes(rng.choices([0, 1, 254, 255, 97], k=rng.randrange(5))), bytes(rng.choices([0, 1, 254, 255, 97], k=rng.randrange(5)))) for _ in range(300)]
    df = spark.createDataFrame([(a.hex().upper(), b.hex().upper()) for a, b in pairs], "a string, b string")
    from pyspark.sql import functions as F

    rows = df.select("a", "b", keys.separator_hex(F.col("a"), F.col("b")).alias("s"), keys.successor_hex(F.col("a")).alias("u")).collect()
    for r in rows:
        s, u = keys.separator(bytes.fromhex(r.a), bytes.fromhex(r.b)), keys.successor(bytes.fromhex(r.a))
        assert (r.s, r.u) == (s and s.hex().upper(), u and u.hex().upper())


def test_options():
    o = Options()
    assert (o.table_limit(3), o.total_limit(2), o.expand_limit(0), o.grandparent_limit(0), o.source_limit(0)) == (2 << 20, 1000 << 20, 50 << 20, 20 << 20, 2 << 20)
    assert Options(total_per_level={1: 2.0}).total_limit(1) == 20 << 20
    assert o.is_strict(Strict.JOURNAL_CHECKSUM) and not o.is_strict(Strict.JOURNAL)
    assert not o.is_strict(Strict.READER, Strict.OVERRIDE) and o.is_strict(Strict.JOURNAL, Strict.JOURNAL)


def test_cache_moves():
    c = cache.Lru(10)
    for ns, key, size in ((1, "a", 4), (2, "b", 4), (1, "c", 2)):
        assert not c.get((ns, key), size)
    assert c.get((1, "a"), 4) and c.evict((2, "b")) and not c.evict((2, "b")) and c.used == 6
    c.set_capacity(4)
    assert list(c.held) == [(1, "a")] and c.evictions == 1
    assert c.delete((1, "a")) and not c.get((1, "a"), 4) and c.used == 0  # deleted for good
    c.get((3, "x"), 1), c.get((3, "y"), 1), c.get((4, "z"), 1)
    assert c.evict_namespace(3) == 2 and c.evict_all() == 1 and c.used == 0


def test_lru():
    assert cache.lru([("a", 4), ("b", 4), ("a", 4), ("c", 4), ("b", 4), ("x", 99)], 8) == (1, 5, 2, 8)

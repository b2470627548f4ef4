"""The store and the session against a dictionary."""

import random

import pytest

from tidemark.errors import Corrupted, NotFound, ReadOnly, Released
from tidemark.functions import hashing, names
from tidemark.functions.comparer import Mapped
from tidemark.operators import scan
from tidemark.options import Options
from tidemark.plans import compaction
from tidemark.sources.manifest_codec import Edit
from tidemark.sources.session import Session
from tidemark.sources.storage import Directory
from tidemark.store import Store


def test_store(spark, tmp_path):
    rng = random.Random(6)
    store = Store(spark, str(tmp_path / "db"), Options(l0_trigger=3))
    model, past = {}, {}
    for n in range(7):
        batch = {f"k{rng.randrange(30):02d}": (float(n), rng.random() < 0.7) for _ in range(12)}
        v = store.write(spark.createDataFrame([(k, x, int(live)) for k, (x, live) in batch.items()], "ukey string, value double, kind int"))
        for k, (x, live) in batch.items():
            model.pop(k, None)
            if live:
                model[k] = x
        past[v] = dict(model)
        if n == 3:
            assert store.compact() is not None
    found = lambda df: {r.ukey: r.value for r in df.collect()}
    assert found(store.scan()) == model
    for v, want in past.items():
        assert found(store.scan(version=v)) == want
    assert found(store.scan(scan.Range("k05", "k15"))) == {k: x for k, x in model.items() if "k05" <= k < "k15"}
    some = next(iter(model))
    assert found(store.get(some)) == {some: model[some]} and store.get("absent").count() == 0
    assert store.compact(0) and found(store.scan()) == model
    assert store.meta().count() == 1 and "0" not in {str(r.level) for r in store.meta().collect()}
    pin = min(past)
    assert store.collect_garbage([pin]) and found(store.scan(version=pin)) == past[pin] and found(store.scan()) == model
    store.delete(spark.createDataFrame([(k,) for k in model], "ukey string"))
    assert found(store.scan()) == {} and store.compact(0) and store.meta().count() == 0
    store.write(spark.createDataFrame([("new", 1.0, 1)], "ukey string, value double, kind int"))
    assert found(store.scan()) == {"new": 1.0}
    with pytest.raises(NotFound):
        store.meta(999)


def test_store_against_a_dictionary(spark, tmp_path):
    """Writes, deletes, compactions, garbage and snapshots in any order."""
    rng = random.Random(17)
    store = Store(spark, str(tmp_path / "db"), Options(l0_trigger=2, table_size=1500, total_size=4000, total_multiplier=2.0))
    model, snapshots, nums = {}, [], set()
    found = lambda df: {r.ukey: r.value for r in df.collect()}
    for step in range(18):
        what = rng.choices(["write", "batch", "delete", "compact", "range", "gc", "snapshot", "release"], [5, 3, 2, 4, 2, 2, 3, 2])[0]
        before = store.state()
        if what == "write":
            batch = {f"k{rng.randrange(60):02d}": float(step) for _ in range(25)}
            store.write(spark.createDataFrame([(k, v, 1) for k, v in batch.items()], "ukey string, value double, kind int"))
            model |= batch
        elif what == "batch":  # in order, also several of one key
            ops = [(f"k{rng.randrange(60):02d}", float(step * 100 + n), int(rng.random() < 0.7), n) for n in range(20)]
            store.write(spark.createDataFrame(ops, "ukey string, value double, kind int, n long"), order="n")
            for k, v, kind, _ in ops:
                model.pop(k, None)
                if kind:
                    model[k] = v
        elif what == "delete":
            gone = rng.sample(sorted(model), min(len(model), 8))
            store.delete(spark.createDataFrame([(k,) for k in gone] or [("none",)], "ukey string"))
            for k in gone:
                del model[k]
        elif what == "compact":
            store.compact()
        elif what == "range":
            store.compact(rng.choice([0, 1]), "k10", "k30")
        elif what == "gc":
            store.collect_garbage()
        elif what == "snapshot":
            snapshots.append((store.snapshot(), dict(model)))
        elif snapshots:
            snapshots.pop(rng.randrange(len(snapshots)))[0].release()
        after = store.state()
        assert after.next_num >= before.next_num and after.last_seq >= before.last_seq
        new = {f.num for f in after.files} - {f.num for f in before.files}
        assert not new & nums  # no number is used twice
        nums |= {f.num for f in after.files}
        for level in {f.level for f in after.files} - {0}:
            own = sorted((f.low, f.high) for f in after.files if f.level == level)
            assert all(a[1] < b[0] for a, b in zip(own, own[1:]))
    assert found(store.scan()) == model
    for s, want in snapshots:
        assert found(s.scan()) == want
    assert max(f.level for f in store.state().files) >= 1


def test_locks_and_snapshots(spark, tmp_path):
    store, other = Store(spark, str(tmp_path / "db")), Store(spark, str(tmp_path / "db"))
    one = spark.createDataFrame([("a", 1.0, 1)], "ukey string, value double, kind int")
    with store._writing(), pytest.raises(ReadOnly):
        other.write(one)
    other.write(one)
    s = store.snapshot()
    store.delete(one.select("ukey"))
    assert s.scan().count() == 1 and store.scan().count() == 0
    s.release()
    with pytest.raises(Released):
        s.scan()
    assert +store.pins == {}


def test_what_is_compacted():
    o = Options(l0_trigger=2, table_size=100, total_size=300, expand_factor=5, grandparent_factor=1)
    f = compaction.File
    top = [f(0, 1, 50, "a", "f"), f(0, 2, 50, "e", "k"), f(0, 3, 50, "x", "z")]
    one = [f(1, 4, 100, "a", "c"), f(1, 5, 100, "d", "h"), f(1, 6, 100, "i", "m"), f(1, 7, 100, "n", "z")]
    two = [f(2, 8, 90, "a", "b"), f(2, 9, 90, "c", "e"), f(2, 10, 90, "f", "j"), f(2, 11, 90, "k", "p")]
    assert compaction.best_level(top + one + two, o) == (0, 1.5)
    p = compaction.pick(top + one + two, o, {})
    assert (p.level, [x.num for x in p.source], [x.num for x in p.target]) == (0, [1, 2], [4, 5, 6])
    assert [x.num for x in p.grandparents] == [8, 9, 10, 11] and p.cuts == ["e", "p"] and not p.bottom and p.pointer == "k"
    o = Options(l0_trigger=2, table_size=100, total_size=30, expand_factor=5, grandparent_factor=1)  # level 1: 300 bytes
    p = compaction.pick(one + two, o, {1: "c"})  # round robin: behind the pointer
    assert (p.level, p.source[0].num, p.bottom) == (1, 5, True)
    assert compaction.pick(one + two, o, {1: "z"}).source[0].num == 4  # from the beginning again
    assert compaction.pick(one[:2], o, {}) is None and o.total_limit(1) == 300
    assert compaction.pick(one[:2], o, {}, exhausted=5).source == [one[1]]
    assert compaction.plan([one[0]], 1, [one[0]], o).is_move(o) and not compaction.plan(one[:1] + two, 1, one[:1], o).is_move(o)
    # More files of the level come along if that needs nothing further below.
    wide = [f(1, 1, 100, "a", "b"), f(1, 2, 100, "c", "d"), f(2, 3, 100, "a", "e")]
    assert [x.num for x in compaction.plan(wide, 1, wide[:1], o).source] == [1, 2]
    assert [x.num for x in compaction.plan(wide, 1, wide[:1], Options(table_size=100, expand_factor=2)).source] == [1]
    assert len(compaction.in_range(one, 1, "a", "z", o)) == 1 and len(compaction.in_range(one, 1, "a", "z", Options(table_size=300))) == 3
    assert compaction.in_range(top, 0, "a", "e", o) == top[:2]


def test_seeks_nominate_a_file(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"), Options(min_seeks=5, seek_bytes=1 << 30))
    for v in range(2):
        store.write(spark.createDataFrame([(k, float(v), 1) for k in "az"], "ukey string, value double, kind int"))
    probes = lambda n: spark.createDataFrame([("m",)] * n, "ukey string")
    assert store.exhausted(probes(4)) is None and store.exhausted(probes(5)) == 2
    assert store.compact(exhausted=2) and [x.level for x in store.state().files] == [1]


def test_session_commits_what_is_durable(tmp_path):
    d = Directory(tmp_path)
    s = Session(d)
    s.create()
    sizes = []
    for k in range(5):
        s.commit(Edit(seq_num=k, journal_num=1, added=[(0, 100 + k, 10, b"a", b"b")]))
        sizes.append(len(d.read(names.MANIFEST, s.manifest_num)))
    grown = [b - a for a, b in zip(sizes, sizes[1:])]
    assert max(grown) - min(grown) <= 1 and grown[0] < 60  # a commit writes its edit, not the whole manifest
    real, d.files.append = d.files.append, lambda name, data: (_ for _ in ()).throw(OSError("full"))
    before = (dict(s.files), s.seq_num, s.version_id)
    with pytest.raises(OSError):
        s.commit(Edit(seq_num=99, added=[(0, 999, 1, b"a", b"b")]))
    assert (s.files, s.seq_num, s.version_id) == before
    d.files.append = real
    s.commit(Edit(seq_num=50, added=[(1, 500, 1, b"a", b"b")]))  # begins a new manifest
    again = Session(d)
    again.recover()
    assert again.files == s.files and again.seq_num == 50 and (0, 999) not in again.files
    d.close()


def test_session(tmp_path):
    d = Directory(tmp_path)
    s = Session(d, Options(max_manifest=400))
    s.create()
    n = s.allocate()
    s.reuse(n)
    assert s.allocate() == n
    s.commit(Edit(journal_num=4, seq_num=9, added=[(0, n, 10, b"a", b"c")]))
    pin = s.pin()
    for k in range(20):
        m = s.allocate()
        s.commit(Edit(seq_num=10 + k, comp_ptrs=[(1, b"%d" % k)], deleted=[(0, n)], added=[(0, m, 10, b"a", b"z")]))
        n = m
    assert len(d.list(names.MANIFEST)) == 1 and s.manifest_num > 1  # it was rotated
    assert s.obsolete({n, n - 1, 2}) == {n - 1}
    s.release(pin)
    assert 2 in s.obsolete({n, 2})
    with pytest.raises(NotFound):
        s.release(pin)
    again = Session(d)
    again.recover()
    assert (again.files, again.seq_num, again.journal_num, again.comp_ptrs) == (s.files, 29, 4, {1: b"19"}) and again.next_file > n
    with pytest.raises(Corrupted, match="comparer"):
        Session(d, Options(comparer="other", comparers=(Mapped("other", bytes),))).recover()
    d.close()


def test_pair_hash(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(200)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", hashing.pair_hash(F.col("a"), F.col("b"), 7).alias("h")).collect()
    assert all(r.h == hashing.pair_hash_of(r.a, r.b, 7) for r in got) and len({r.h for r in got}) > 195

"""Known answers, round trips and damage for the byte formats."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.errors import Closed, Corrupted, NotFound, ReadOnly
from tidemark.functions import bloom, comparer, hashing, keys, names
from tidemark.options import Options
from tidemark.sources import journal, manifest_codec, storage, table_file
from tidemark.sources.varint import put, take


@pytest.mark.parametrize(
    ("data", "want"),
    [("", 0xBC9F1D34), ("a", 0x286E9DB0), ("ab", 0x39ACA330), ("abc", 0x855D012F), ("abcd", 0xB9C83353), ("hello world", 0x008DFDDB)],
)
def test_hash_known(data, want):
    assert hashing.hash32(data.encode()) == want
    assert hashing.hash32_batch(pa.array([data.encode(), b"other text"]))[0] == want


def test_hash_spread():
    rng = random.Random(1)
    data = [rng.randbytes(rng.randrange(128)) for _ in range(1000)]
    seeds = [rng.getrandbits(32) for _ in data]
    assert len({hashing.hash32(d, s) for d, s in zip(data, seeds, strict=True)}) >= 950
    assert hashing.hash32_batch(pa.array(data)).tolist() == [hashing.hash32(d) for d in data]


def test_crc_known():
    assert hashing.crc32c(b"123456789") == 0xE3069283
    assert hashing.masked(hashing.crc32c(b"123456789")) == 0xC78AB0E5
    assert hashing.crc32c(b"") == 0
    rng = random.Random(2)
    for n in (1, 3, 100, 6143, 6144, 6145, 10_000, 40_007):
        data = rng.randbytes(n)
        assert hashing.crc32c(data) == int(hashing.crc32c_batch(pa.array([data]))[0])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=20), max_size=50, unique=True), st.integers(1, 50))
def test_bloom(keys, bits):
    f = bloom.build(keys, bits)
    assert all(bloom.may_contain(f, k) for k in keys)
    assert 1 <= f[-1] <= 30
    assert not bloom.may_contain(b"", b"k") and not bloom.may_contain(b"\x06", b"k")
    assert bloom.may_contain(b"\0" * 8 + bytes([31]), b"k")


def test_bloom_skips():
    keys = [f"k{n}".encode() for n in range(2000)]
    f = bloom.build(keys)
    assert sum(bloom.may_contain(f, f"x{n}".encode()) for n in range(2000)) < 60


@given(st.integers(0, 2**64 - 1))
def test_varint(n):
    assert take(put(n), 0) == (n, len(put(n)))


def test_journal_round_trip():
    rng = random.Random(4)
    sizes = [0, 1, 5, journal.BLOCK - 7, journal.BLOCK - 8, journal.BLOCK, 3 * journal.BLOCK + 11, 100, journal.BLOCK - 7 - 7 - 100 - 3, 9]
    records = [rng.randbytes(n) for n in sizes]
    data = journal.encode(records)
    assert list(journal.decode(data, strict=True)) == records
    for cut in range(1, 8):  # a tail of fewer bytes than a header
        first = rng.randbytes(journal.BLOCK - 7 - cut)
        assert list(journal.decode(journal.encode([first, b"next"]), strict=True)) == [first, b"next"]


def test_journal_damage():
    records = [bytes([k]) * 20_000 for k in range(6)]
    data = bytearray(journal.encode(records))
    data[journal.BLOCK + 100] ^= 1
    dropped = []
    kept = list(journal.decode(bytes(data), dropped=lambda r, n: dropped.append(r)))
    assert records[0] in kept and len(kept) < 6 and set(kept) <= set(records)
    assert journal.Fault.CHECKSUM in dropped
    with pytest.raises(Corrupted):
        list(journal.decode(bytes(data), strict=True))
    zero = journal.encode([b"a"]) + bytes(20)
    assert list(journal.decode(zero)) == [b"a"]
    with pytest.raises(Corrupted, match=journal.Fault.EMPTY):
        list(journal.decode(zero, strict=True))


def test_journal_orphan_is_always_skipped():
    data = journal.encode([b"x" * 40_000, b"y"])
    tail = data[journal.BLOCK :]  # begins with a last chunk
    assert list(journal.decode(tail, strict=True)) == [b"y"]


def test_journal_source(spark, tmp_path):
    (tmp_path / "000001.log").write_bytes(journal.encode([b"one", b"two" * 20_000]))
    (tmp_path / "000002.log").write_bytes(journal.encode([b"three"])[:-1])
    rows = journal.read(spark, str(tmp_path)).collect()
    assert sorted((r.record_no, bytes(r.record)) for r in rows) == [(0, b"one"), (1, b"two" * 20_000)]
    assert [r.reason for r in journal.read_dropped(spark, str(tmp_path)).collect()] == [journal.Fault.LENGTH]


def test_manifest_round_trip(spark, tmp_path):
    edits = [
        manifest_codec.Edit("tidemark.bytewise", 3, None, 9, 1 << 55, [(1, b"k\0")], [], [(0, 5, 1000, b"a", b"m"), (1, 6, 2000, b"b", b"z")]),
        manifest_codec.Edit(prev_journal_num=2, next_file_num=12, deleted=[(0, 5)], added=[(1, 7, 1, b"", b"\xff")]),
    ]
    assert [manifest_codec.decode(manifest_codec.encode(e)) for e in edits] == edits
    whole = manifest_codec.encode(edits[0])
    for cut in range(1, len(whole)):
        try:
            manifest_codec.decode(whole[:cut])
        except Corrupted:
            pass
    with pytest.raises(Corrupted):
        manifest_codec.decode(whole[:-1])
    assert manifest_codec.decode(put(40) + manifest_codec.encode(edits[1])) == edits[1]  # an unknown tag
    (tmp_path / "MANIFEST-000001").write_bytes(journal.encode([manifest_codec.encode(e) for e in edits]))
    from tidemark.plans import manifest

    files, state = manifest.recover(manifest_codec.read(spark, str(tmp_path / "MANIFEST-000001")), "tidemark.bytewise")
    assert {(r.level, r.num) for r in files.collect()} == {(1, 6), (1, 7)}
    assert state["next_file_num"] == 12 and state["prev_journal_num"] == 2


def test_journal_goes_on_where_it_ended():
    rng = random.Random(6)
    records = [rng.randbytes(n) for n in (10, journal.BLOCK - 20, 40_000, 0, 3, journal.BLOCK - 14)]
    data = b""
    for r in records:
        data += journal.encode([r], len(data))
    assert data == journal.encode(records) and list(journal.decode(data, strict=True)) == records


def test_journal_batches(spark, tmp_path):
    some = [b"%d" % k for k in range(10_000)]
    (tmp_path / "000001.log").write_bytes(journal.encode(some))
    got = journal.read(spark, str(tmp_path)).collect()
    assert [(r.record_no, bytes(r.record)) for r in got] == list(enumerate(some))


class Frame:
    """Keeps what a reader would run over Arrow batches."""

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.parametrize("read", [journal.records, journal.chunk_rows])
def test_journal_is_never_held_whole(read):
    taken = 0

    def batches():
        nonlocal taken
        for taken in range(1, 31):
            yield pa.record_batch([pa.array(["one"] * 500), pa.array(["x" * 30] * 500)], names=["path", "record"])

    out = read(Frame(), source=journal.encoded)(batches())
    assert next(out).num_rows == journal.BATCH and taken < 15
    assert journal.BATCH + sum(b.num_rows for b in out) >= 15_000 and taken == 30


def test_journal_without_name(spark):
    rows = spark.createDataFrame([(None, 1, "a"), ("x", 2, "b"), (None, 3, "c" * 70_000), ("x", 4, "")], "journal string, o long, record string")
    want = {(None, 0, b"a"), ("x", 0, b"b"), (None, 1, b"c" * 70_000), ("x", 1, b"")}
    read = lambda *a, **k: {(r.path, r.record_no, bytes(r.record)) for r in journal.records(*a, **k).collect()}
    assert read(journal.write(rows, "journal", "o", "record")) == want == read(journal.in_order(rows, "journal", "o", "record"), source=journal.encoded)


def some_rows(n=3000, seed=9):
    rng = random.Random(seed)
    return sorted({f"key{rng.randrange(10**6):07d}".encode(): rng.randbytes(rng.randrange(60)) for _ in range(n)}.items())


def test_table_round_trip(spark, tmp_path):
    rows = some_rows()
    for compression in ("snappy", "none"):
        t = table_file.Table(table_file.encode(rows, Options(compression=compression)))
        assert list(t.entries()) == rows
        assert list(t.entries(rows[100][0], rows[2000][0])) == rows[100:2000]
        assert all(t.get(k) == v for k, v in rows[::50])
        assert t.get(b"absent") is None and t.find(b"key") == rows[0] and t.find(b"z") is None
        assert t.find(rows[7][0] + b"\0") == rows[8] and t.find(rows[7][0] + b"\0", filtered=True) is None
        offsets = [t.offset_of(k) for k, _ in rows]
        assert offsets == sorted(offsets) and offsets[0] == 0 and t.offset_of(b"z") == t.data_end > offsets[-1]
    good = table_file.encode(rows)
    data = bytearray(good)
    data[10] ^= 1
    with pytest.raises(Corrupted):
        list(table_file.Table(bytes(data)).entries())
    # Only the damaged block is left out, and only a damaged file as a whole.
    first = sum(k <= table_file.Table(good).index[0][0] for k, _ in rows)
    (tmp_path / "000001.ldb").write_bytes(good)
    (tmp_path / "000002.ldb").write_bytes(bytes(data))
    (tmp_path / "000003.ldb").write_bytes(good[:-1] + b"?")
    assert table_file.read(spark, str(tmp_path), skip_corrupt=True).count() == 2 * len(rows) - first
    assert sorted((r.path[-5], r.offset, r.reason) for r in table_file.skipped(spark, str(tmp_path)).collect()) == [("2", 0, "checksum"), ("3", -1, "footer")]
    assert table_file.read(spark, str(tmp_path / "000001.ldb"), rows[3][0], rows[9][0]).count() == 6


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=5), st.binary(max_size=12), max_size=60), st.integers(1, 5), st.integers(20, 200), st.lists(st.binary(max_size=5), min_size=3, max_size=3))
def test_seeks_against_a_dictionary(entries, gap, size, probes):
    rows = sorted(entries.items())
    t = table_file.Table(table_file.encode(rows, Options(restart_gap=gap, block_size=size)))
    for p in probes + [k for k, _ in rows[:5]]:
        assert t.find(p) == next((r for r in rows if r[0] >= p), None)
        assert t.before(p) == next((r for r in reversed(rows) if r[0] < p), None)
        assert t.get(p) == entries.get(p)
    lo, hi = sorted(probes[:2])
    inside = [r for r in rows if lo <= r[0] < hi]
    assert list(t.entries(lo, hi)) == inside and t.before() == (rows[-1] if rows else None)
    c = table_file.Cursor(t, lo, hi)
    walked = []
    while c.next():
        walked.append(c.row)
    back = []
    while c.prev():
        back.append(c.row)
    assert walked == inside and back == inside[::-1]
    assert c.seek(probes[2]) == bool(ahead := [r for r in inside if r[0] >= probes[2]]) and (not ahead or c.row == ahead[0])
    assert c.first() == c.last() == bool(inside) and c.valid == bool(inside)
    fresh = table_file.Cursor(t)
    assert not fresh.prev() and fresh.last() == bool(rows) and (not rows or fresh.row == rows[-1])


def test_restarts_are_searched(monkeypatch):
    rows = some_rows(400)
    t = table_file.Table(table_file.encode(rows, Options(block_size=1 << 20)))
    block = t.block(0)
    read = []
    real = table_file.Block._entry
    monkeypatch.setattr(table_file.Block, "_entry", lambda self, at, before: read.append(at) or real(self, at, before))
    assert next(block.entries(rows[333][0])) == rows[333] and len(read) < 30


def test_filters_are_chosen_by_name():
    rows = some_rows(500)
    loose, fine = comparer.Bloom(2, "loose"), comparer.Bloom(20, "fine")
    data = table_file.encode(rows, Options(filter=loose))
    assert table_file.Table(data, Options(filter=fine)).policy is None
    assert table_file.Table(data, Options(filter=fine, alternatives=(comparer.Bloom(5, "other"), loose))).policy is loose
    assert table_file.Table(data, Options(filter=loose)).policy is loose
    none = table_file.Table(table_file.encode(rows, Options(filter=None)), Options(filter=fine))
    assert none.policy is None and none.get(rows[3][0]) == rows[3][1]

    class Nothing:
        name = "nothing"

        def build(self, keys):
            return b"n"

        def may_contain(self, filter_, key):
            return False

    with_own = table_file.Table(table_file.encode(rows, Options(filter=Nothing())), Options(filter=Nothing()))
    assert with_own.get(rows[3][0]) is None and with_own.find(rows[3][0]) == rows[3]  # a plain seek asks no filter


def test_other_collations():
    back = comparer.Mapped("backwards", lambda k: tuple(-x for x in k) + (1,))
    o = Options(comparer="backwards", comparers=(comparer.Bytewise(), back), block_size=64)
    rows = sorted(some_rows(200), key=lambda r: back.key(r[0]))
    t = table_file.Table(table_file.encode(rows, o), o)
    assert list(t.entries(rows[20][0], rows[90][0])) == rows[20:90] and all(t.get(k) == v for k, v in rows)
    with pytest.raises(Corrupted):
        table_file.encode(rows)
    for bad in ({"comparer": "absent"}, {"block_size": 0}, {"compression": "other"}):
        with pytest.raises(ValueError):
            Options(**bad)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=4), st.integers(0, 9), st.integers(0, 1)), max_size=30, unique=True))
def test_internal_keys_in_tables(entries):
    o = Options(block_size=48)
    order = sorted(entries, key=lambda e: (e[0], -e[1], -e[2]))
    rows = [(keys.internal_key(*e), b"%d" % k) for k, e in enumerate(order)]
    t = table_file.Table(table_file.encode(rows, o, o.internal_comparer(), o.internal_filter()), o, o.internal_comparer(), o.internal_filter())
    assert list(t.entries()) == rows
    for user in {e[0] for e in entries}:
        for seq in (0, 4, 9):
            found = t.find(keys.internal_key(user, seq, 1), filtered=True)
            want = next((r for r, e in zip(rows, order, strict=True) if e[0] == user and e[1] <= seq), None)
            assert want is None or found == want


def test_table_edges():
    empty = table_file.Table(table_file.encode([]))
    assert list(empty.entries()) == [] and empty.get(b"a") is None
    with pytest.raises(Corrupted):
        table_file.encode([(b"b", b""), (b"a", b"")])
    with pytest.raises(Corrupted):
        table_file.Table(b"short")


def test_storage(spark, tmp_path):
    d = storage.Directory(tmp_path / "db")
    with pytest.raises(ReadOnly):
        storage.Directory(tmp_path / "db")
    with pytest.raises(NotFound):
        d.current()
    for n in (1, 2, 3):
        d.write(names.MANIFEST, n, b"m")
    d.set_current(1)
    assert d.current() == 1
    d.set_current(2)
    assert d.current() == 2 and (tmp_path / "db/CURRENT.bak").read_text() == "MANIFEST-000001\n"
    (tmp_path / "db/CURRENT.3").write_text("MANIFEST-000003\n")
    assert d.current() == 3  # a pending pointer with a greater number
    (tmp_path / "db/CURRENT.3").write_text("MANIFEST-000009\n")
    assert d.current() == 2  # its target doesn't exist
    (tmp_path / "db/CURRENT").write_text("MANIFEST-0000")
    assert d.current() == 1  # then the backup
    d.write(names.TABLE, 7, b"t")
    (tmp_path / "db/000008.sst").write_bytes(b"old")
    (tmp_path / "db/notes.txt").write_text("")
    assert d.list(names.TABLE) == [(4, 7), (4, 8)] and d.read(names.TABLE, 8) == b"old"
    assert {r.name for r in storage.listing(spark, str(tmp_path / "db"), names.TABLE).collect()} == {"000007.ldb", "000008.sst"}
    d.remove(names.TABLE, 7)
    with pytest.raises(NotFound):
        d.read(names.TABLE, 7)
    d.close()
    with pytest.raises(Closed):
        d.list()
    with pytest.raises(ReadOnly):
        storage.Directory(tmp_path / "db", read_only=True).write(names.TABLE, 1, b"")


def test_a_directory_on_any_file_system(spark, tmp_path):
    d = storage.Directory(storage.HadoopFiles(spark, f"file://{tmp_path}/far"))
    with pytest.raises(ReadOnly):
        storage.Directory(storage.HadoopFiles(spark, f"file://{tmp_path}/far"))
    d.write(names.MANIFEST, 1, b"one")
    d.append(names.MANIFEST, 1, b" two")
    d.set_current(1)
    d.write(names.MANIFEST, 2, b"m")
    d.set_current(2)
    assert d.read(names.MANIFEST, 1) == b"one two" and d.current() == 2 and d.list() == [(names.MANIFEST, 1), (names.MANIFEST, 2)]
    assert (d.bytes_written, d.bytes_read) == (8, 7)
    d.rename((names.MANIFEST, 1), (names.TEMP, 4))
    d.remove(names.MANIFEST, 2)
    with pytest.raises(Corrupted):
        d.current()
    with pytest.raises(NotFound):
        d.read(names.MANIFEST, 2)
    d.close()
    storage.Directory(storage.HadoopFiles(spark, f"file://{tmp_path}/far")).close()


def test_text_log(tmp_path):
    log = storage.text_log(tmp_path, 300)
    for k in range(20):
        log.info("line %d", k)
    text = (tmp_path / "LOG").read_text()
    assert "line 19" in text and (tmp_path / "LOG.1").exists() and len(text) <= 300

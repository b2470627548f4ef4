"""Sorted tables as bytes: blocks with prefix compression, filters, index, footer.

::

    data block* | filter block | metaindex | index | footer

Each block is followed by its compression (one byte) and a masked CRC-32C.
Parquet serves the queries of this engine; this codec is for exchange.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Corrupted
from ..functions.comparer import Comparer, FilterPolicy
from ..functions.hashing import crc32c, masked
from ..functions.keys import MAX_SEQ, internal_key, parse_internal_key
from ..options import Options, Strict
from .varint import put, take

TRAILER, FOOTER = 5, 48
PLAIN, SNAPPY = 0, 1
MAGIC = b"tidemark"
FILTER_PREFIX = "filter."


def shared_prefix_len(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class BlockWriter:
    """Entries with the prefix of the key before left out, save at restarts."""

    def __init__(self, gap: int):
        self.gap, self.data, self.restarts, self.count, self.last = gap, bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count % self.gap == 0:
            self.restarts.append(len(self.data))
        else:
            shared = shared_prefix_len(self.last, key)
        self.data += put(shared) + put(len(key) - shared) + put(len(value)) + key[shared:] + value
        self.last, self.count = key, self.count + 1

    def size(self) -> int:
        return len(self.data) + 4 * max(1, len(self.restarts)) + 4

    def finish(self) -> bytes:
        marks = self.restarts or [0]
        return bytes(self.data) + b"".join(x.to_bytes(4, "little") for x in [*marks, len(marks)])


class Block:
    """A block's entries, found through its restarts."""

    def __init__(self, data: bytes, order: Callable[[bytes], object] = lambda k: k):
        n = int.from_bytes(data[-4:], "little")
        self.data, self.order, self.end = data, order, len(data) - 4 * (n + 1)
        if self.end < 0 or not n:
            raise Corrupted("restarts", "block")
        self.restarts = [int.from_bytes(data[self.end + 4 * i : self.end + 4 * i + 4], "little") for i in range(n)]

    def _entry(self, at: int, before: bytes) -> tuple[bytes, bytes, int]:
        """(key, value, where the next entry begins)."""
        shared, at = take(self.data, at, "entry")
        size, at = take(self.data, at, "entry")
        value, at = take(self.data, at, "entry")
        if at + size + value > self.end or shared > len(before):
            raise Corrupted("entry", "block")
        return before[:shared] + self.data[at : at + size], self.data[at + size : at + size + value], at + size + value

    def _from(self, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < self.end:
            key, value, at = self._entry(at, key)
            yield key, value

    def entries(self, start: bytes | None = None, limit: bytes | None = None) -> Iterator[tuple[bytes, bytes]]:
        """Rows of the half-open range: a binary search over the restarts, whose
        keys are whole, then on from the last one before ``start``."""
        begin = 0
        if start is not None and self.end:
            first = bisect_left(self.restarts, self.order(start), key=lambda at: self.order(self._entry(at, b"")[0]))
            begin = self.restarts[max(0, first - 1)]
        for key, value in self._from(begin):
            if limit is not None and self.order(key) >= self.order(limit):
                return
            if start is None or self.order(key) >= self.order(start):
                yield key, value

    def before(self, key: bytes | None = None) -> tuple[bytes, bytes] | None:
        """The last row before ``key``, or of all: only one restart is read."""
        first = len(self.restarts) if key is None else bisect_left(self.restarts, self.order(key), key=lambda at: self.order(self._entry(at, b"")[0])) if self.end else 0
        found = None
        if first:
            for row in self._from(self.restarts[first - 1]):
                if key is not None and self.order(row[0]) >= self.order(key):
                    break
                found = row
        return found


def seal(block: bytes, compression: str) -> bytes:
    """A block as stored: compressed if that saves an eighth."""
    kind = PLAIN
    if compression == "snappy":
        small = pa.compress(block, "snappy", asbytes=True)
        if len(small) < len(block) - len(block) // 8:
            block, kind = small, SNAPPY
    body = block + bytes([kind])
    return body + masked(crc32c(body)).to_bytes(4, "little")


def unseal(data: bytes, offset: int, length: int, checksum: bool = True) -> bytes:
    body = data[offset : offset + length + 1]
    crc = int.from_bytes(data[offset + length + 1 : offset + length + TRAILER], "little")
    if len(body) != length + 1 or checksum and crc != masked(crc32c(body)):
        raise Corrupted("checksum", f"block at {offset}")
    if body[-1] == PLAIN:
        return body[:-1]
    if body[-1] == SNAPPY:
        size, _ = take(body, 0, "snappy")
        return pa.decompress(body[:-1], size, "snappy", asbytes=True)
    raise Corrupted(f"compression {body[-1]}", f"block at {offset}")


class TableWriter:
    """Appends rows in order of ``comparer`` and counts what it has written."""

    def __init__(self, options: Options = Options(), comparer: Comparer | None = None, policy: FilterPolicy | None = None):
        self.options = options
        self.comparer = comparer or options.user_comparer()
        self.policy = policy or options.filter
        self.out, self.index, self.block = bytearray(), BlockWriter(1), BlockWriter(options.restart_gap)
        self.filters, self.offsets, self.keys = bytearray(), [], []
        self.pending: bytes | None = None
        self.first: bytes | None = None
        self.last: bytes | None = None
        self.entries = 0

    @property
    def blocks(self) -> int:
        return self.index.count + (self.pending is not None)

    @property
    def bytes(self) -> int:
        return len(self.out)

    def _store(self, raw: bytes, compression: str | None = None) -> bytes:
        at = len(self.out)
        self.out.extend(seal(raw, self.options.compression if compression is None else compression))
        return put(at) + put(len(self.out) - at - TRAILER)

    def _cut_filters(self, upto: int) -> None:
        while len(self.offsets) < upto:
            self.offsets.append(len(self.filters))
            if self.keys:
                self.filters.extend(self.policy.build(self.keys))
                self.keys = []

    def _finish_block(self) -> None:
        self.pending, self.block = self._store(self.block.finish()), BlockWriter(self.options.restart_gap)
        if self.policy:
            self._cut_filters(len(self.out) >> self.options.filter_base_lg)

    def add(self, key: bytes, value: bytes) -> None:
        if self.last is not None and self.comparer.key(key) <= self.comparer.key(self.last):
            raise Corrupted("order of keys", repr(key))
        if self.pending is not None:
            self.index.add(self.comparer.separator(self.last, key) or self.last, self.pending)
            self.pending = None
        self.block.add(key, value)
        if self.policy:
            self.keys.append(key)
        self.first = key if self.first is None else self.first
        self.last, self.entries = key, self.entries + 1
        if self.block.size() >= self.options.block_size:
            self._finish_block()

    def finish(self) -> bytes:
        if self.block.count or self.last is None:
            self._finish_block()
        if self.last is not None:
            self.index.add(self.comparer.successor(self.last) or self.last, self.pending)
        self.pending = None
        meta = BlockWriter(1)
        if self.policy:
            if self.keys:
                self._cut_filters(len(self.offsets) + 1)
            self.offsets.append(len(self.filters))
            marks = b"".join(x.to_bytes(4, "little") for x in self.offsets)
            meta.add((FILTER_PREFIX + self.policy.name).encode(), self._store(bytes(self.filters) + marks + bytes([self.options.filter_base_lg]), "none"))
        tail = self._store(meta.finish()) + self._store(self.index.finish())
        return bytes(self.out) + tail.ljust(FOOTER - len(MAGIC), b"\0") + MAGIC


def encode(rows: list[tuple[bytes, bytes]], options: Options = Options(), comparer: Comparer | None = None, policy: FilterPolicy | None = None) -> bytes:
    """A table of strictly increasing keys."""
    out = TableWriter(options, comparer, policy)
    for key, value in rows:
        out.add(key, value)
    return out.finish()


class Table:
    """A table's bytes, opened.

    Of the filters in it that one is used whose name is that of ``policy`` or, if
    there is none, of one of ``alternatives``; without any, nothing is skipped.
    """

    def __init__(self, data: bytes, options: Options = Options(), comparer: Comparer | None = None, policy: FilterPolicy | None = None, alternatives: tuple[FilterPolicy, ...] | None = None, read: Strict | None = None):
        if len(data) < FOOTER or data[-len(MAGIC) :] != MAGIC:
            raise Corrupted("footer", "table")
        self.data, self.checksum = data, options.is_strict(Strict.BLOCK_CHECKSUM, read)
        self.comparer = comparer or options.user_comparer()
        foot = data[-FOOTER:]
        meta, at = self._pointer(foot, 0)
        index, _ = self._pointer(foot, at)
        self.index = [(k, self._pointer(v, 0)[0]) for k, v in Block(self._block(index)).entries()]
        self.tops = [self.comparer.key(k) for k, _ in self.index]
        self.data_end, self.filter, self.policy = meta[0], None, None
        known = [policy or options.filter, *(options.alternatives if alternatives is None else alternatives)]
        for name, value in Block(self._block(meta)).entries():
            found = next((p for p in known if p and (FILTER_PREFIX + p.name).encode() == name), None)
            if found:
                pointer = self._pointer(value, 0)[0]
                self.policy, self.filter, self.data_end = found, self._block(pointer), pointer[0]
                break

    @staticmethod
    def _pointer(data: bytes, at: int) -> tuple[tuple[int, int], int]:
        offset, at = take(data, at, "pointer")
        length, at = take(data, at, "pointer")
        return (offset, length), at

    def _block(self, pointer: tuple[int, int]) -> bytes:
        return unseal(self.data, *pointer, self.checksum)

    def block(self, n: int) -> Block:
        return Block(self._block(self.index[n][1]), self.comparer.key)

    def may_contain(self, offset: int, key: bytes) -> bool:
        """Filter of the data block at ``offset``: no filter matches, an empty one doesn't."""
        if self.filter is None or len(self.filter) < 5:
            return True
        lg, marks = self.filter[-1], self.filter[:-1]
        begin = int.from_bytes(marks[-4:], "little")
        at = begin + 4 * (offset >> lg)
        if at + 8 > len(marks):
            return True
        a, b = int.from_bytes(marks[at : at + 4], "little"), int.from_bytes(marks[at + 4 : at + 8], "little")
        return a < b and self.policy.may_contain(marks[a:b], key)

    def _at(self, key: bytes) -> int:
        """The first block that can hold ``key`` or more."""
        return bisect_left(self.tops, self.comparer.key(key))

    def entries(self, start: bytes | None = None, limit: bytes | None = None, skip: Callable[[int, Corrupted], None] | None = None) -> Iterator[tuple[bytes, bytes]]:
        """Rows of the half-open range.  A damaged block raises, or is told to
        ``skip`` (offset and error) and left out, alone.

        Only the blocks at the edges of the range are searched."""
        first = 0 if start is None else self._at(start)
        for n in range(first, len(self.index)):
            try:
                rows = list(self.block(n).entries(start if n == first else None, limit))
            except Corrupted as e:
                if skip is None:
                    raise
                skip(self.index[n][1][0], e)
                continue
            yield from rows
            if limit is not None and self.tops[n] >= self.comparer.key(limit):
                return

    def find(self, key: bytes, filtered: bool = False) -> tuple[bytes, bytes] | None:
        """First row at or after ``key``; with ``filtered`` None if the filter of its
        block says that ``key`` isn't there."""
        n = self._at(key)
        if n == len(self.index) or filtered and not self.may_contain(self.index[n][1][0], key):
            return None
        return next(self.entries(key), None)

    def before(self, key: bytes | None = None) -> tuple[bytes, bytes] | None:
        """Last row before ``key``, or of all."""
        n = len(self.index) - 1 if key is None else min(self._at(key), len(self.index) - 1)
        while n >= 0:
            found = self.block(n).before(key)
            if found:
                return found
            n -= 1
        return None

    def get(self, key: bytes) -> bytes | None:
        found = self.find(key, filtered=True)
        return found[1] if found and found[0] == key else None

    def offset_of(self, key: bytes) -> int:
        """Where the block of ``key`` begins; behind the last key, where data ends."""
        n = self._at(key)
        return self.index[n][1][0] if n < len(self.index) else self.data_end


class Cursor:
    """A position in a table, moved both ways within a half-open range.

    A fresh cursor stands before the first row.  Moves say whether there is a row.
    The rows of the block that it stands in are kept, so a step within it is cheap."""

    def __init__(self, table: Table, start: bytes | None = None, limit: bytes | None = None):
        self.table, self.start, self.limit = table, start, limit
        self.row: tuple[bytes, bytes] | None = None
        self._side = -1  # where it stands without a row: before the first (-1) or behind the last (1)
        self._n, self._rows, self._at = -1, [], 0

    def _load(self, n: int) -> bool:
        if not 0 <= n < len(self.table.index):
            return False
        if n != self._n:
            self._n, self._rows = n, list(self.table.block(n).entries())
        return True

    def _stand(self, side: int) -> bool:
        """On the row at ``_at``, or at the next block's if it is beyond this one."""
        while self._rows and not 0 <= self._at < len(self._rows):
            step = 1 if self._at > 0 else -1
            if not self._load(self._n + step):
                self.row, self._side = None, side
                return False
            self._at = 0 if step > 0 else len(self._rows) - 1
        row, order = self._rows[self._at] if self._rows else None, self.table.comparer.key
        inside = row is not None and (self.start is None or order(row[0]) >= order(self.start)) and (self.limit is None or order(row[0]) < order(self.limit))
        self.row, self._side = (row, 0) if inside else (None, side)
        return inside

    def _to(self, key: bytes, before: bool, side: int) -> bool:
        """To the first row at or after ``key``, or the last before it."""
        n = self.table._at(key)
        order = self.table.comparer.key
        if not self._load(min(n, len(self.table.index) - 1)):
            return self._stand(side)
        self._at = bisect_left(self._rows, order(key), key=lambda r: order(r[0])) - before
        return self._stand(side)

    def first(self) -> bool:
        if self.start is not None:
            return self._to(self.start, False, 1)
        self._at = 0
        self._load(0)
        return self._stand(1)

    def last(self) -> bool:
        if self.limit is not None:
            return self._to(self.limit, True, -1)
        self._load(len(self.table.index) - 1)
        self._at = len(self._rows) - 1
        return self._stand(-1)

    def seek(self, key: bytes) -> bool:
        """The first row at or after ``key``; not before the range."""
        order = self.table.comparer.key
        return self._to(key if self.start is None or order(key) > order(self.start) else self.start, False, 1)

    def next(self) -> bool:
        if self.row is None:
            return self.first() if self._side < 0 else False
        self._at += 1
        return self._stand(1)

    def prev(self) -> bool:
        if self.row is None:
            return self.last() if self._side > 0 else False
        self._at -= 1
        return self._stand(-1)

    @property
    def valid(self) -> bool:
        return self.row is not None


SKIPPED = "path string, offset long, reason string"


def read(spark: SparkSession, path: str, start: bytes | None = None, limit: bytes | None = None, skip_corrupt: bool = False, options: Options = Options()) -> DataFrame:
    """``path, key, value`` of all tables at ``path``, one task a file.  With
    ``skip_corrupt`` damaged blocks are left out, and files that can't be opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows: list[tuple[bytes, bytes]] = []
                try:
                    for row in Table(content.as_py(), options).entries(start, limit, (lambda at, e: None) if skip_corrupt else None):
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield _rows(name, rows)
                            rows = []
                except Corrupted:
                    if not skip_corrupt:
                        raise
                yield _rows(name, rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, key binary, value binary")


def _rows(name: str, rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([name] * len(rows), pa.string()), pa.array([k for k, _ in rows], pa.binary()), pa.array([v for _, v in rows], pa.binary())], names=["path", "key", "value"])


def skipped(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:
    """:data:`SKIPPED`: the blocks that :func:`read` leaves out; offset -1 is a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found: list[tuple[int, str]] = []
                try:
                    for _ in Table(content.as_py(), options).entries(None, None, lambda at, e, f=found: f.append((at, e.reason))):
                        pass
                except Corrupted as e:
                    found.append((-1, e.reason))
                yield pa.record_batch([pa.array([name] * len(found), pa.string()), pa.array([a for a, _ in found], pa.int64()), pa.array([r for _, r in found], pa.string())], names=["path", "offset", "reason"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SKIPPED)


FILES = "file_num long, first_key string, last_key string, entries long, blocks long, bytes long, data_end long, content binary"


def write_files(log: DataFrame, options: Options = Options()) -> DataFrame:
    """:data:`FILES`: the entries of each file of a log (``file_num, ukey, seq, kind,
    value``) as a table of internal keys, sorted by Spark and encoded in one task a
    file.  A file is of bounded size by what cut it."""
    internal, policy = options.internal_comparer(), options.internal_filter()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_at, out = None, None

        def done() -> pa.RecordBatch:
            blocks = out.blocks + (out.block.count > 0)
            content = out.finish()
            data_end = Table(content, options, internal, policy).data_end
            row = (open_at, out.first[:-8].decode(), out.last[:-8].decode(), out.entries, blocks, len(content), data_end, content)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[part.split()[0] for part in FILES.split(", ")])

        for b in batches:
            for num, ukey, seq, kind, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if num != open_at:
                    if out is not None:
                        yield done()
                    open_at, out = num, TableWriter(options, internal, policy)
                out.add(internal_key(ukey.encode(), seq, kind), b"" if value is None else value.encode())
        if out is not None:
            yield done()

    order = (F.col("file_num"), F.col("ukey"), F.desc("seq"), F.desc("kind"))
    rows = log.select("file_num", "ukey", "seq", "kind", F.col("value").cast("string").alias("value"))
    return rows.repartition("file_num").sortWithinPartitions(*order).mapInArrow(run, FILES)


BLOCKS = "file_num long, block long, offset long, length long, entries long, first_key string, last_key string, top_key string"


def block_index(files: DataFrame, options: Options = Options()) -> DataFrame:
    """:data:`BLOCKS` of tables of internal keys: user keys of the first and last
    entry, and of the index key up to which a seek finds the block."""
    internal, policy = options.internal_comparer(), options.internal_filter()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for num, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                table = Table(content.as_py(), options, internal, policy)
                rows = []
                for n, (top, (offset, length)) in enumerate(table.index):
                    found = [k[:-8].decode() for k, _ in table.block(n).entries()]
                    rows.append((num, n, offset, length, len(found), found[0], found[-1], top[:-8].decode()))
                kinds = [pa.int64()] * 5 + [pa.string()] * 3
                cols = list(zip(*rows, strict=True)) or [()] * 8
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[part.split()[0] for part in BLOCKS.split(", ")])

    return files.select("file_num", "content").mapInArrow(run, BLOCKS)


def filter_segments(files: DataFrame, options: Options = Options()) -> DataFrame:
    """``file_num, segments, lost``: how many pieces the filter of each table has, and
    how many keys the piece of their own block denies, which must be none."""
    internal, policy = options.internal_comparer(), options.internal_filter()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for num, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                table = Table(content.as_py(), options, internal, policy)
                begin = int.from_bytes(table.filter[-5:-1], "little")
                segments = (len(table.filter) - 1 - begin) // 4 - 1
                lost = sum(not table.may_contain(at, k) for n, (_, (at, _)) in enumerate(table.index) for k, _ in table.block(n).entries())
                yield pa.record_batch([pa.array([x], pa.int64()) for x in (num, segments, lost)], names=["file_num", "segments", "lost"])

    return files.select("file_num", "content").mapInArrow(run, "file_num long, segments long, lost long")


def find_in_files(files: DataFrame, ukey: str, seq: int, options: Options = Options()) -> DataFrame:
    """``file_num, ukey, seq, kind``: the first entry of each table at or after the
    version that a read of ``ukey`` at ``seq`` looks for; no row where there is none."""
    internal, policy = options.internal_comparer(), options.internal_filter()
    target = internal_key(ukey.encode(), seq, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for num, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = Table(content.as_py(), options, internal, policy).find(target)
                if found:
                    yield _versions([(num, 0, *parse_internal_key(found[0]))])

    return files.select("file_num", "content").mapInArrow(run, VERSIONS).drop("pos")


def walk(files: DataFrame, start: str | None, limit: str | None, backwards: bool = False, options: Options = Options()) -> DataFrame:
    """:data:`VERSIONS` of a cursor's way through the half-open range of user keys of
    each table, from its first row to its last or back; ``pos`` counts its steps from 0."""
    internal, policy = options.internal_comparer(), options.internal_filter()
    lo, hi = (None if k is None else internal_key(k.encode(), MAX_SEQ, 1) for k in (start, limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for num, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                cursor = Cursor(Table(content.as_py(), options, internal, policy), lo, hi)
                on, rows, pos = cursor.last() if backwards else cursor.first(), [], 0
                while on:
                    rows.append((num, pos, *parse_internal_key(cursor.row[0])))
                    pos += 1
                    if len(rows) == 10_000:
                        yield _versions(rows)
                        rows = []
                    on = cursor.prev() if backwards else cursor.next()
                if rows:
                    yield _versions(rows)

    return files.select("file_num", "content").mapInArrow(run, VERSIONS)


VERSIONS = "file_num long, pos long, ukey string, seq long, kind int"


def _versions(rows: list[tuple]) -> pa.RecordBatch:
    num, pos, ukey, seq, kind = zip(*rows, strict=True)
    cols = [pa.array(num, pa.int64()), pa.array(pos, pa.int64()), pa.array([k.decode() for k in ukey]), pa.array(seq, pa.int64()), pa.array(kind, pa.int32())]
    return pa.record_batch(cols, names=[part.split()[0] for part in VERSIONS.split(", ")])

"""Record logs in blocks of 32 KiB, with checksummed chunks.

A record is one full chunk or a first, any middle and a last one.  A chunk has a
header of seven bytes: masked CRC-32C of type and payload, length (16 bits) and
type, least bytes first.  The rest of a block too short for a header is zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from enum import StrEnum
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import Corrupted
from ..functions.hashing import crc32c, masked

#: Fixed values of the format.
BLOCK, HEADER = 32 * 1024, 7
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4
#: Rows and bytes that a reader hands on together, unless one row has more.
BATCH, BATCH_BYTES = 4096, 4 << 20


class Fault(StrEnum):
    """Why bytes of a journal were dropped."""

    EMPTY = "header-empty"
    TYPE = "type-unknown"
    LENGTH = "length-beyond-block"
    CHECKSUM = "checksum-differs"
    INCOMPLETE = "record-incomplete"
    STRAY = "part-without-start"


def blocks(records: Iterable[bytes], after: int = 0) -> Iterator[bytes]:
    """The journal of some records, to stand behind ``after`` bytes of one, block by block."""
    start, out = after % BLOCK, bytearray()
    for record in records:
        at, first = 0, True
        while True:
            room = BLOCK - start - len(out)
            if room < HEADER:
                yield bytes(out) + bytes(room)
                start, out, room = 0, bytearray(), BLOCK
            part = record[at : at + room - HEADER]
            at += len(part)
            last = at == len(record)
            kind = (FULL if last else FIRST) if first else (LAST if last else MIDDLE)
            body = bytes([kind]) + part
            out += masked(crc32c(body)).to_bytes(4, "little") + len(part).to_bytes(2, "little") + body
            first = False
            if last:
                break
    yield bytes(out)


def encode(records: Iterable[bytes], after: int = 0) -> bytes:
    """The same as one value."""
    return b"".join(blocks(records, after))


def chunks(data: bytes | Iterable[bytes], checksum: bool = True) -> Iterator[tuple[int, int, int, bytes, Fault | None, int]]:
    """(block, offset, type, payload, fault, bytes dropped) of a journal or its blocks; a
    fault drops the rest of its block."""
    for number, block in enumerate(_cut(data) if isinstance(data, bytes | bytearray) else data):
        at = 0
        while at + HEADER <= len(block):
            crc, size, kind = int.from_bytes(block[at : at + 4], "little"), int.from_bytes(block[at + 4 : at + 6], "little"), block[at + 6]
            end = at + HEADER + size
            fault = None
            if not (crc or size or kind):
                fault = Fault.EMPTY
            elif not FULL <= kind <= LAST:
                fault = Fault.TYPE
            elif end > len(block):
                fault = Fault.LENGTH
            elif checksum and crc != masked(crc32c(block[at + 6 : end])):
                fault = Fault.CHECKSUM
            if fault:
                yield number, at, kind, b"", fault, len(block) - at
                break
            yield number, at, kind, block[at + HEADER : end], None, 0
            at = end


def _cut(data: bytes | pa.Buffer) -> Iterator[bytes]:
    whole = memoryview(data)
    for begin in range(0, len(whole), BLOCK):
        yield bytes(whole[begin : begin + BLOCK])


def decode(data: bytes | Iterable[bytes], strict: bool = False, checksum: bool = True, dropped: Callable[[Fault, int], None] | None = None) -> Iterator[bytes]:
    """Records of a journal or its blocks.  What can't be read is dropped and reported; with
    ``strict`` it raises, save for orphan chunks, which are always skipped."""

    def drop(reason: Fault, n: int, skip: bool = False) -> None:
        if dropped:
            dropped(reason, n)
        if strict and not skip:
            raise Corrupted(reason, "journal")

    held: list[bytes] | None = None
    for _, _, kind, payload, fault, n in chunks(data, checksum):
        if fault:
            held = None
            drop(fault, n)
        elif kind in (FULL, FIRST):
            if held is not None:
                drop(Fault.INCOMPLETE, sum(map(len, held)))
            held = [payload]
        elif held is None:
            drop(Fault.STRAY, len(payload) + HEADER, True)
            continue
        else:
            held.append(payload)
        if held is not None and kind in (FULL, LAST):
            yield b"".join(held)
            held = None
    if held is not None:
        drop(Fault.INCOMPLETE, 0)


RECORD = "path string, record_no long, record binary"
DROPPED = "path string, reason string, bytes long"
CHUNK = "path string, chunk_no long, block_no long, at long, type long, bytes long"

#: Journals in Arrow batches: each one's name, and its blocks, to be taken before the next.
Source = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[str, Iterable[bytes]]]]


def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterable[bytes]]]:
    """Journals in rows ``path, content``."""
    for b in batches:
        for name, content in zip(b.column(0), b.column(1), strict=True):
            yield name.as_py(), _cut(content.as_buffer())


def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterable[bytes]]]:
    """Journals of the rows of :func:`in_order`, encoded as their blocks are taken."""
    rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1), strict=True))
    for name, own in groupby(rows, itemgetter(0)):
        yield name, blocks(text.as_py().encode() for _, text in own)


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) if isinstance(row[-1], bytes) else 0
        if len(held) == BATCH or size >= BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _rows_of(files: DataFrame, source: Source, each: Callable[[Iterable[bytes]], Iterable[tuple]], kinds: str) -> DataFrame:
    """``path`` and the columns that ``each`` gives of a journal's blocks.  A task holds a
    block, a record and a batch of rows, however many and long its journals."""
    names, types = zip(*(x.split() for x in kinds.split(", ")), strict=True)
    arrow = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, arrow[k]) for n, k in zip(names, types, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(((name, *row) for name, own in source(batches) for row in each(own)), schema)

    return files.mapInArrow(run, kinds)


def records(files: DataFrame, strict: bool = False, checksum: bool = True, source: Source = stored) -> DataFrame:
    """:data:`RECORD` of journals given as ``path, content``, or as ``source`` takes
    them; one task a file."""
    return _rows_of(files, source, lambda own: enumerate(decode(own, strict, checksum)), RECORD)


def dropped(files: DataFrame, checksum: bool = True, source: Source = stored) -> DataFrame:
    """:data:`DROPPED`: what :func:`records` skips."""

    def each(own: Iterable[bytes]) -> Iterator[tuple[str, int]]:
        found: list[tuple[str, int]] = []
        for _ in decode(own, False, checksum, lambda r, n: found.append((str(r), n))):
            yield from found
            found.clear()
        yield from found

    return _rows_of(files, source, each, DROPPED)


def chunk_rows(files: DataFrame, checksum: bool = True, source: Source = stored) -> DataFrame:
    """:data:`CHUNK`: the chunks of journals in order."""
    return _rows_of(files, source, lambda own: ((k, block, at, kind, len(payload)) for k, (block, at, kind, payload, _, _) in enumerate(chunks(own, checksum))), CHUNK)


def in_order(rows: DataFrame, journal: str, order: str, record: str) -> DataFrame:
    """``path, record``: the text column ``record``, sorted by Spark into one journal for
    each value of ``journal``, in the order of ``order``.  Readers take them from
    :func:`encoded`, so that no whole journal is ever held."""
    named = rows.select(F.col(journal).cast("string").alias("path"), F.col(record).alias("record"), F.col(order).alias("o"))
    return named.repartition("path").sortWithinPartitions("path", "o").select("path", "record")


def write(rows: DataFrame, journal: str, order: str, record: str) -> DataFrame:
    """``path, content``: the journals of :func:`in_order`, each as one value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, own in encoded(batches):
            yield pa.record_batch([pa.array([name], pa.string()), pa.array([b"".join(own)], pa.binary())], names=["path", "content"])

    return in_order(rows, journal, order, record).mapInArrow(run, "path string, content binary")


def read(spark: SparkSession, path: str, strict: bool = False, checksum: bool = True) -> DataFrame:
    """:data:`RECORD` of all journals at ``path``."""
    return records(spark.read.format("binaryFile").load(path).select("path", "content"), strict, checksum)


def read_dropped(spark: SparkSession, path: str, checksum: bool = True) -> DataFrame:
    """:data:`DROPPED` of all journals at ``path``."""
    return dropped(spark.read.format("binaryFile").load(path).select("path", "content"), checksum)


def reassemble(parts: DataFrame, journal: str, order: list[str]) -> DataFrame:
    """Records from chunk rows (``type``, ``payload`` text) as a set operation:
    a record begins at each first or full chunk, and its parts are joined."""
    w = Window.partitionBy(journal).orderBy(*order)
    begins = F.sum(F.col("type").isin(FULL, FIRST).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = parts.withColumn("record_no", begins).where("record_no > 0")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "payload"))), lambda x: x.payload), "")
    return numbered.groupBy(journal, "record_no").agg(F.count("*").alias("chunks"), whole.alias("record"))

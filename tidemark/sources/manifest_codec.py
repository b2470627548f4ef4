"""Manifest edits as bytes: tagged fields of variable-length integers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import Corrupted
from ..plans.manifest import EDIT
from . import journal
from .varint import put, take

#: Field tags.
COMPARER, JOURNAL_NUM, NEXT_FILE_NUM, SEQ_NUM, COMP_PTR, DEL_TABLE, ADD_TABLE, PREV_JOURNAL_NUM = 1, 2, 3, 4, 5, 6, 7, 9
_NUMBERS = {JOURNAL_NUM: "journal_num", NEXT_FILE_NUM: "next_file_num", SEQ_NUM: "seq_num", PREV_JOURNAL_NUM: "prev_journal_num"}


@dataclass
class Edit:
    """One change of the file layout."""

    comparer: str | None = None
    journal_num: int | None = None
    prev_journal_num: int | None = None
    next_file_num: int | None = None
    seq_num: int | None = None
    comp_ptrs: list[tuple[int, bytes]] = field(default_factory=list)
    deleted: list[tuple[int, int]] = field(default_factory=list)
    added: list[tuple[int, int, int, bytes, bytes]] = field(default_factory=list)


def _text(raw: bytes) -> bytes:
    return put(len(raw)) + raw


def encode(edit: Edit) -> bytes:
    out = b"" if edit.comparer is None else put(COMPARER) + _text(edit.comparer.encode())
    for tag, name in _NUMBERS.items():
        if getattr(edit, name) is not None:
            out += put(tag) + put(getattr(edit, name))
    for level, key in edit.comp_ptrs:
        out += put(COMP_PTR) + put(level) + _text(key)
    for level, num in edit.deleted:
        out += put(DEL_TABLE) + put(level) + put(num)
    for level, num, size, low, high in edit.added:
        out += put(ADD_TABLE) + put(level) + put(num) + put(size) + _text(low) + _text(high)
    return out


def decode(data: bytes) -> Edit:
    """Unknown tags are skipped alone; the data may end only between fields."""
    edit, at = Edit(), 0

    def number(name: str) -> int:
        nonlocal at
        n, at = take(data, at, name)
        return n

    def signed(name: str) -> int:
        if (n := number(name)) >> 63:
            raise Corrupted("number beyond 63 bits", name)
        return n

    def raw(name: str) -> bytes:
        nonlocal at
        n = number(name)
        if at + n > len(data):
            raise Corrupted("ends too early", name)
        at += n
        return data[at - n : at]

    while at < len(data):
        tag = number("field-header")
        if tag == COMPARER:
            edit.comparer = raw("comparer").decode()
        elif tag == SEQ_NUM:
            edit.seq_num = number("seq-num")
        elif tag in _NUMBERS:
            setattr(edit, _NUMBERS[tag], signed(_NUMBERS[tag]))
        elif tag == COMP_PTR:
            edit.comp_ptrs.append((number("comp-ptr.level"), raw("comp-ptr.key")))
        elif tag == DEL_TABLE:
            edit.deleted.append((number("del-table.level"), signed("del-table.num")))
        elif tag == ADD_TABLE:
            edit.added.append((number("add-table.level"), signed("add-table.num"), signed("add-table.size"), raw("add-table.min"), raw("add-table.max")))
    return edit


def row(edit_no: int, e: Edit) -> dict:
    """An edit as a row of :data:`EDIT`."""
    return {
        "edit_no": edit_no, "comparer": e.comparer, "journal_num": e.journal_num, "prev_journal_num": e.prev_journal_num, "next_file_num": e.next_file_num, "seq_num": e.seq_num,
        "comp_ptrs": [{"level": a, "ikey": b} for a, b in e.comp_ptrs], "deleted": [{"level": a, "num": b} for a, b in e.deleted],
        "added": [dict(zip(("level", "num", "size", "imin", "imax"), t, strict=True)) for t in e.added],
    }


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Edits of a manifest, which is a journal of them, as rows of :data:`EDIT`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(EDIT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edits = [row(k, decode(r)) for k, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield from pa.Table.from_pylist(edits, schema).to_batches()

    return journal.read(spark, path, strict).mapInArrow(run, EDIT)

"""Key functions: internal keys, separators and successors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidKey

MAX_SEQ = (1 << 56) - 1


def internal_key(ukey: bytes, seq: int, kind: int) -> bytes:
    """User key and eight bytes, least first: kind, then the sequence number."""
    if not 0 <= seq <= MAX_SEQ:
        raise InvalidKey(f"sequence number {seq}")
    if kind not in (0, 1):
        raise InvalidKey(f"kind {kind}")
    return ukey + (seq << 8 | kind).to_bytes(8, "little")


def parse_internal_key(key: bytes) -> tuple[bytes, int, int]:
    if len(key) < 8:
        raise InvalidKey(f"{len(key)} bytes")
    number = int.from_bytes(key[-8:], "little")
    if number & 0xFF > 1:
        raise InvalidKey(f"kind {number & 0xFF}")
    return key[:-8], number >> 8, number & 0xFF


def internal_key_hex(ukey: Column, seq: Column, kind: Column) -> Column:
    """Internal keys in hexadecimal, from columns.  For files only: rows are
    sorted by (ukey, seq descending, kind descending), never by this."""
    number = F.lpad(F.concat(F.hex(seq), F.lpad(F.hex(kind.cast("long")), 2, "0")), 16, "0")
    swapped = F.concat(*[F.substring(number, 15 - 2 * k, 2) for k in range(8)])
    return F.concat(F.hex(F.encode(ukey, "UTF-8")), swapped)


def parse_key_hex(ikey: Column) -> Column:
    """``(ukey, seq, kind)`` of internal keys in hexadecimal; null where one is
    too short or of an unknown kind."""
    n = F.length(ikey)
    tail = F.substr(ikey, n - 15, F.lit(16))
    number = F.concat(*[F.substring(tail, 15 - 2 * k, 2) for k in range(8)])
    kind = F.conv(F.substring(number, 15, 2), 16, 10).cast("int")
    parts = F.struct(
        F.decode(F.unhex(F.substr(ikey, F.lit(1), n - 16)), "UTF-8").alias("ukey"), F.conv(F.substring(number, 1, 14), 16, 10).cast("long").alias("seq"), kind.alias("kind"),
    )
    return F.when((n >= 16) & (kind <= 1), parts)


def sort_key(order: Column, ukey: Column) -> Column:
    """Custom collation: sort and compare by this in place of ``ukey``."""
    return F.struct(order.alias("order"), ukey.alias("ukey"))


def separator(a: bytes, b: bytes) -> bytes | None:
    """A short key x with a <= x < b; None where no shorter one is found."""
    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return a[:i] + bytes([x + 1]) if x < 0xFF and x + 1 < y else None
    return None


def successor(key: bytes) -> bytes | None:
    """A short key at or after ``key``; None if all its bytes are 0xff."""
    for i, x in enumerate(key):
        if x < 0xFF:
            return key[:i] + bytes([x + 1])
    return None


def _byte(hexed: Column, i: Column) -> Column:
    return F.conv(F.substr(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def shared_prefix(a: Column, b: Column) -> Column:
    """Bytes that both keys begin with (both in hexadecimal)."""
    n = (F.least(F.length(a), F.length(b)) / 2).cast("int")
    differs = F.filter(F.sequence(F.lit(0), n), lambda i: (i < n) & (_byte(a, i) != _byte(b, i)))
    return F.coalesce(F.try_element_at(differs, F.lit(1)), n)


def separator_hex(a: Column, b: Column) -> Column:
    """:func:`separator` over columns of hexadecimal keys."""
    i = shared_prefix(a, b)
    inside = i < (F.least(F.length(a), F.length(b)) / 2).cast("int")
    x, y = _byte(a, i), _byte(b, i)
    made = F.concat(F.substr(a, F.lit(1), i * 2), F.lpad(F.hex((x + 1).cast("long")), 2, "0"))
    return F.when(inside & (x < 255) & (x + 1 < y), made)


def successor_hex(key: Column) -> Column:
    """:func:`successor` over a column of hexadecimal keys."""
    lead = F.length(F.regexp_extract(key, "^((?:FF)*)", 1))
    made = F.concat(F.substr(key, F.lit(1), lead), F.lpad(F.hex((_byte(key, lead / 2) + 1).cast("long")), 2, "0"))
    return F.when(lead < F.length(key), made)

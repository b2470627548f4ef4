"""Variable-length integers, seven bits a byte, least first."""

from __future__ import annotations

from ..errors import Corrupted


def put(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def take(data: bytes, at: int, where: str = "varint") -> tuple[int, int]:
    """(number, position behind it)"""
    n = shift = 0
    while True:
        if at >= len(data):
            raise Corrupted("short read", where)
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            if n >> 64:
                raise Corrupted("overflows 64 bits", where)
            return n, at
        shift += 7
        if shift > 63:
            raise Corrupted("overflows 64 bits", where)

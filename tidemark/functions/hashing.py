"""32-bit hashes and checksums, over whole Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiplier and shift of the hash, seed of bloom filters,
#: reversed Castagnoli polynomial, and the constant of masked checksums.
MULTIPLIER, TAIL_SHIFT, BLOOM_SEED = 0xC6A4A793, 24, 0xBC9F1D34
CASTAGNOLI, MASK_DELTA = 0x82F63B78, 0xA282EAD8
_M32 = 0xFFFFFFFF


def hash32(data: bytes, seed: int = BLOOM_SEED) -> int:
    """Hash of one value; words of four bytes, least first."""
    h = (seed ^ (len(data) * MULTIPLIER)) & _M32
    whole = len(data) & ~3
    for i in range(0, whole, 4):
        h = (h + int.from_bytes(data[i : i + 4], "little")) * MULTIPLIER & _M32
        h ^= h >> 16
    if whole < len(data):
        h = (h + int.from_bytes(data[whole:], "little")) * MULTIPLIER & _M32
        h ^= h >> TAIL_SHIFT
    return h


def _padded(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, bytes in rows filled up with zeros)."""
    raw = [v or b"" for v in values.cast(pa.binary()).to_pylist()]
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    width = -(-max(int(lens.max(initial=0)), 1) // 4) * 4
    return lens, np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(len(raw), width)


def hash32_batch(values: pa.Array, seed: int = BLOOM_SEED) -> np.ndarray:
    lens, rows = _padded(values)
    words = rows.view("<u4").astype(np.uint64)
    m, full = np.uint64(MULTIPLIER), np.uint64(_M32)
    h = (np.uint64(seed) ^ (lens.astype(np.uint64) * m)) & full
    for k in range(words.shape[1]):
        whole, tail = lens >= 4 * (k + 1), (lens > 4 * k) & (lens < 4 * (k + 1))
        if not (whole | tail).any():
            break
        x = (h + words[:, k]) * m & full
        h = np.where(whole, x ^ (x >> np.uint64(16)), np.where(tail, x ^ (x >> np.uint64(TAIL_SHIFT)), h))
    return h.astype(np.int64)


@lru_cache(None)
def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(CASTAGNOLI), t >> 1)
    return t


def crc32c_batch(values: pa.Array) -> np.ndarray:
    lens, rows = _padded(values)
    table = _crc_table()
    c = np.full(len(lens), _M32, np.uint32)
    for k in range(int(lens.max(initial=0))):
        c = np.where(lens > k, table[(c ^ rows[:, k]) & 0xFF] ^ c >> 8, c)
    return (c ^ np.uint32(_M32)).astype(np.int64)


@lru_cache(None)
def _crc_list() -> list[int]:
    return _crc_table().tolist()


#: Bytes of a lane; buffers from the second number of bytes on are cut into lanes.
LANE, LANES_FROM = 64, 6144


@lru_cache(None)
def _behind_lane() -> list[list[int]]:
    """For each byte of a checksum, what it becomes behind a lane of zeros."""
    table, out = _crc_list(), []
    for k in range(4):
        row = []
        for x in range(256):
            c = x << 8 * k
            for _ in range(LANE):
                c = table[c & 0xFF] ^ c >> 8
            row.append(c)
        out.append(row)
    return out


def crc32c(data: bytes) -> int:
    """Of one buffer.  A long one is cut into lanes, which go side by side; without
    its first inversion a checksum is linear, so those of lanes are put together by
    what each becomes behind the lanes that follow."""
    if len(data) < LANES_FROM:
        c, table = _M32, _crc_list()
        for x in data:
            c = table[(c ^ x) & 0xFF] ^ c >> 8
        return c ^ _M32
    lanes = -(-len(data) // LANE)
    raw = np.zeros(lanes * LANE, np.uint8)
    begin = len(raw) - len(data)  # zeros in front change nothing
    raw[begin:] = np.frombuffer(data, np.uint8)
    raw[begin : begin + 4] ^= 0xFF
    columns, table = raw.reshape(lanes, LANE).T, _crc_table()
    c = np.zeros(lanes, np.uint32)
    for column in columns:
        c = table[(c ^ column) & 0xFF] ^ c >> 8
    t0, t1, t2, t3 = _behind_lane()
    total = 0
    for x in c.tolist():
        total = t0[total & 0xFF] ^ t1[total >> 8 & 0xFF] ^ t2[total >> 16 & 0xFF] ^ t3[total >> 24] ^ x
    return total ^ _M32


def masked(crc: np.ndarray | int):
    """Rotated and shifted, so that a checksum of bytes that hold checksums is no weaker."""
    return ((crc >> 15 | crc << 17) & _M32) + MASK_DELTA & _M32


def hash32_column(value: Column, seed: int = BLOOM_SEED) -> Column:
    @F.arrow_udf("long")
    def run(v: pa.Array) -> pa.Array:
        return pa.array(hash32_batch(v, seed))

    return run(value)


def masked_crc_column(value: Column) -> Column:
    @F.arrow_udf("long")
    def run(v: pa.Array) -> pa.Array:
        return pa.array(masked(crc32c_batch(v)))

    return run(value)


#: Fixed values of the two-word hash that deals cache entries to buckets.
PAIR_MULTIPLIER, PAIR_SHIFT = 0x5BD1E995, 24


def pair_hash(ns: Column, key: Column, seed: int = 0) -> Column:
    """32-bit hash of two 64-bit numbers.  Built-in functions only: the multiplier
    is below 2**31, so products of 32-bit numbers fit in a long."""

    def low(x: Column) -> Column:
        return x.bitwiseAND(F.lit(_M32).cast("long"))

    def times(x: Column) -> Column:
        return low(x * F.lit(PAIR_MULTIPLIER).cast("long"))

    h = F.lit(seed).cast("long")
    for word in (low(F.shiftrightunsigned(ns, 32)), low(ns), low(F.shiftrightunsigned(key, 32)), low(key)):
        k = times(word)
        h = times(h).bitwiseXOR(times(k.bitwiseXOR(F.shiftright(k, PAIR_SHIFT))))
    h = times(h.bitwiseXOR(F.shiftright(h, 13)))
    return h.bitwiseXOR(F.shiftright(h, 15))


def pair_hash_of(ns: int, key: int, seed: int = 0) -> int:
    h = seed
    for word in (ns >> 32 & _M32, ns & _M32, key >> 32 & _M32, key & _M32):
        k = word * PAIR_MULTIPLIER & _M32
        h = (h * PAIR_MULTIPLIER & _M32) ^ ((k ^ k >> PAIR_SHIFT) * PAIR_MULTIPLIER & _M32)
    h = (h ^ h >> 13) * PAIR_MULTIPLIER & _M32
    return h ^ h >> 15

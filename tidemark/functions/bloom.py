"""Bloom filters of sorted tables, byte for byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import BLOOM_SEED, hash32, hash32_column

_M32 = 0xFFFFFFFF


def probes_for(bits: int) -> int:
    """Probes per key: bits times ln 2, from 1 to 30."""
    return min(max(bits * 69 // 100, 1), 30)


def _positions(h: int, k: int, n_bits: int) -> list[int]:
    delta = (h >> 17 | h << 15) & _M32
    return [((h + j * delta) & _M32) % n_bits for j in range(k)]


def build(keys: list[bytes], bits: int = 10) -> bytes:
    """The filter of some keys; its last byte holds the number of probes."""
    k, n = probes_for(bits), -(-max(bits * len(keys), 64) // 8)
    out = bytearray(n + 1)
    out[n] = k
    for key in keys:
        for p in _positions(hash32(key, BLOOM_SEED), k, 8 * n):
            out[p >> 3] |= 1 << (p & 7)
    return bytes(out)


def may_contain(filter_: bytes, key: bytes) -> bool:
    """False only if the key was not added.  Unknown encodings match always."""
    if len(filter_) < 2:
        return False
    k = filter_[-1]
    return k > 30 or all(filter_[p >> 3] >> (p & 7) & 1 for p in _positions(hash32(key, BLOOM_SEED), k, 8 * (len(filter_) - 1)))


def bit_positions(h: Column, n_bits: Column, bits: int) -> Column:
    """Array of the bits that a key with hash ``h`` sets."""
    delta = F.shiftright(h, 17).bitwiseOR(F.shiftleft(h, 15)).bitwiseAND(F.lit(_M32).cast("long"))
    return F.transform(F.sequence(F.lit(0), F.lit(probes_for(bits) - 1)), lambda j: (h + j * delta) % F.lit(1 << 32).cast("long") % n_bits)


def table_filters(log: DataFrame, bits: int = 10, group: str = "file_num", key: str = "ukey") -> DataFrame:
    """``group, n_keys, n_bits, bit``: one row per set bit of each table's filter
    over its distinct user keys.  Bits are combined before the shuffle."""
    keys = log.select(group, F.col(key).alias("k")).distinct()
    size = keys.groupBy(group).agg(F.count("*").alias("n_keys")).withColumn("n_bits", (F.ceil(F.greatest(F.col("n_keys") * bits, F.lit(64)) / 8) * 8).cast("long"))
    hashed = keys.withColumn("h", hash32_column(F.col("k"))).join(size, group)
    return hashed.select(group, "n_keys", "n_bits", F.explode(bit_positions(F.col("h"), F.col("n_bits"), bits)).alias("bit")).distinct()


def probe(filters: DataFrame, probes: DataFrame, bits: int = 10, group: str = "file_num") -> DataFrame:
    """``probes`` (``group``, ``ukey``) whose every bit is set in their table's filter."""
    size = filters.select(group, "n_bits").distinct()
    asked = probes.join(size, group).withColumn("h", hash32_column(F.col("ukey")))
    bit = asked.select(group, "ukey", F.explode(F.array_distinct(bit_positions(F.col("h"), F.col("n_bits"), bits))).alias("bit"))
    hit = bit.join(filters.select(group, "bit", F.lit(1).alias("set")), [group, "bit"], "left")
    return hit.groupBy(group, "ukey").agg(F.min(F.coalesce("set", F.lit(0))).alias("may")).where("may = 1").select(group, "ukey")

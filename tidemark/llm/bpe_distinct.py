"""Byte-level BPE of a corpus by a global shuffle of its distinct words.

Texts are split into pre-tokens.  A block of documents is held as the list of
its distinct words and, for every position, the number of the word there.  Only
the words are shuffled by their hash; each distinct word of the corpus is then
encoded once, in one task, and its ids go back to the blocks that hold it, where
the documents are put together again by position.  As a block names each of its
words once, a frequent word is no hot key.

Decoding joins ids to the token-byte table, which has one row per id and is of
fixed size.  Its rows stand in the order of their ids, so the join looks rows up
by their number, for all ids of a document at once.

Positions travel with the words through the first exchange, though only the
second needs them: to keep them out, the split texts would have to be written or
split twice, which costs more.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import operator
from .vbyte_ids import decode_ranks, encode_ranks
from .wordsplit import LONGEST, chunks, code_points, pieces, span_checks

RANKS_FILE = "byte_bpe_50k.tiktoken"
#: Characters of text of a block.
BLOCK_CHARS = 32_000_000
#: Groups that a block's words are dealt to: the least multiple of the number of
#: shuffle partitions that is at least this, so that each task gets as many.
LEAST_BUCKETS, MOST_BUCKETS = 64, 1 << 14
#: Distinct words that a task remembers the ids of before it begins anew.
KNOWN_WORDS = 1_000_000
#: Words of a block that are numbered by frequency; the others are numbered in
#: the order in which they are sent, so that their numbers needn't be.
FREQUENT = 16_384
#: A shuffled row: either a block's positions (bucket -1) or some of its words.
ROW = "spread int, block long, bucket int, payload binary"


@lru_cache(None)
def rank_file(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(None)
def _encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=rank_file(path), special_tokens={})


@lru_cache(None)
def token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token-byte table: (first byte, length, all bytes); row numbers are ids."""
    ranks = rank_file(path)
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    tokens = [b""] * len(length)
    for token, k in ranks.items():
        tokens[k], length[k] = token, len(token)
    return np.cumsum(length) - length, length, np.frombuffer(b"".join(tokens), np.uint8)


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], "<i8").tobytes()
    return zstandard.compress(head + b"".join(parts), 1)


def _unpack(payload) -> list[bytes]:
    data = zstandard.decompress(payload)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    lens = np.frombuffer(data, "<i8", n, 8).tolist()
    at = 8 * (n + 1)
    out = []
    for size in lens:
        out.append(data[at : at + size])
        at += size
    return out


class _Block:
    """Distinct words and positions of some documents."""

    def __init__(self):
        self.known: dict[int | str, int] = {}
        self.words: list[str] = []
        self.hashes: list[int] = []
        self.checks = array("Q")
        self.stream: list[np.ndarray] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self.chars = 0

    def add(self, doc_ids: list[int | None], texts: list[str]) -> None:
        base = len(self.counts)
        self.doc_ids += doc_ids
        self.counts += [0] * len(doc_ids)
        for owners, parts in chunks(texts):
            joined, starts, ends, hashes = pieces(parts)
            codes, keys = pd.factorize(hashes)
            at = np.zeros(len(keys), np.int64)
            at[codes[::-1]] = np.arange(len(codes))[::-1]
            number = np.fromiter((self.known.get(k, -1) for k in keys.tolist()), np.int64, len(keys))
            check = span_checks(code_points(joined), starts[at], ends[at])
            for k in np.flatnonzero(number >= 0).tolist():
                if self.checks[number[k]] != check[k]:  # another word with the same hash
                    word = joined[starts[at[k]] : ends[at[k]]]
                    number[k] = self.known[word] if word in self.known else self._new(word, word, int(keys[k]), int(check[k]))
            for k in np.flatnonzero(number < 0).tolist():
                number[k] = self._new(int(keys[k]), joined[starts[at[k]] : ends[at[k]]], int(keys[k]), int(check[k]))
            out = number[codes]
            for k in np.flatnonzero(ends - starts > LONGEST).tolist():
                word = joined[starts[k] : ends[k]]
                out[k] = self.known[word] if word in self.known else self._new(word, word, int(hashes[k]), 0)
            self.stream.append(out.astype(np.uint32))
            heads = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
            stops = np.searchsorted(starts, heads)
            begin = 0
            for owner, stop in zip(owners, stops.tolist(), strict=True):
                self.counts[base + owner] += stop - begin
                begin = stop
            self.chars += len(joined)

    def _new(self, key: int | str, word: str, h: int, check: int) -> int:
        self.known[key] = len(self.words)
        self.words.append(word)
        self.hashes.append(h)
        self.checks.append(check)
        return len(self.words) - 1

    def rows(self, block: int, buckets: int, place: Callable[[int], int]) -> Iterator[tuple[int, int, int, bytes]]:
        # A block is used up by this; what isn't needed any more goes at once.
        self.known.clear()
        stream = np.concatenate(self.stream) if self.stream else np.zeros(0, np.uint32)
        self.stream.clear()
        n = len(self.words)
        raw = [w.encode("utf-8", "surrogatepass") for w in self.words]
        self.words.clear()
        bucket = ((np.array(self.hashes, np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
        often = np.argsort(-np.bincount(stream, minlength=n), kind="stable")
        top, others = often[:FREQUENT], often[FREQUENT:]
        # Within a bucket neighbours share beginnings, which compress well.
        others = others[np.argsort(bucket[others], kind="stable")]
        in_rest = np.bincount(bucket[others], minlength=buckets)
        first = len(top) + np.cumsum(in_rest) - in_rest
        ends = np.cumsum(in_rest).tolist()
        rest = [k for a, b in zip([0, *ends], ends, strict=False) for k in sorted(others[a:b].tolist(), key=raw.__getitem__)]
        number = np.zeros(n, np.uint32)
        number[top] = np.arange(len(top), dtype=np.uint32)
        number[rest] = np.arange(len(top), n, dtype=np.uint32)
        control, data = encode_ranks(number[stream] if len(stream) else stream)
        ids = np.array([0 if d is None else d for d in self.doc_ids], "<i8")
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        yield place(block), block, -1, _pack(ids, null, np.array(self.counts, "<i4"), np.array([n, len(stream)], "<i8"), first.astype("<i8"), control, data)
        del stream, number, control, data
        of_top = bucket[top]
        for b in range(buckets):
            own_top = np.flatnonzero(of_top == b)
            at = int(first[b]) - len(top)
            words = [raw[k] for k in top[own_top].tolist()] + [raw[k] for k in rest[at : at + int(in_rest[b])]]
            if words:
                yield b, block, b, _pack(own_top.astype("<i4"), np.array([len(w) for w in words], "<i4"), b"".join(words))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["spread", "block", "bucket", "payload"])


def _rows_of_ids(doc_ids: list[int | None], ids: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], names=["doc_id", "ids"])


@operator
def encode(docs: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, finish: Callable = _rows_of_ids, schema: str = "doc_id long, ids binary") -> DataFrame:
    """``(doc_id, ids)``: the ids of each whole text as little-endian 32-bit
    integers in a binary column, one row per row of ``docs``.

    ``finish`` makes rows of ``schema`` from some documents' ids where they are
    put together, in the same process.

    Null and empty texts have no ids; null and repeated ids stay as they are;
    other columns are ignored; an empty table gives no rows.
    """
    path = ranks_path or public_tokenizers.path(RANKS_FILE)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = min(partitions, MOST_BUCKETS)
    buckets = -(-LEAST_BUCKETS // partitions) * partitions

    def place(block: int) -> int:
        """Partition of a block: the blocks of a task lie side by side with those of others."""
        return ((block >> 32) + (block & 0xFFFFFFFF) * 7919) % partitions

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block = _Block()
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                block.add(part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()])
                if block.chars >= block_chars:
                    yield from (_batch([r]) for r in block.rows(number, buckets, place))
                    number, block = number + 1, _Block()
        if block.doc_ids:
            yield from (_batch([r]) for r in block.rows(number, buckets, place))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoding(path)
        known: dict[bytes, bytes] = {}
        wide = max(rank_file(path).values()) >= 1 << 16
        kind = "<u4" if wide else "<u2"
        for b in batches:
            for k in range(b.num_rows):
                spread, block, bucket = (b.column(i)[k].as_py() for i in range(3))
                payload = b.column(3)[k].as_buffer()
                if bucket < 0:
                    yield _batch([(spread, block, bucket, payload.to_pybytes())])
                    continue
                own, lens, raw = _unpack(payload)
                ids: list[bytes] = []
                at = 0
                for size in np.frombuffer(lens, "<i4").tolist():
                    word = raw[at : at + size]
                    at += size
                    found = known.get(word)
                    if found is None:
                        if len(known) >= KNOWN_WORDS:
                            known.clear()
                        found = known[word] = np.array(coder.encode_ordinary(word.decode("utf-8", "surrogatepass")), kind).tobytes()
                    ids.append(found)
                flat = np.frombuffer(b"".join(ids), kind)
                yield _batch([(spread, block, bucket, _pack(own, np.array([len(x) for x in ids], "<i4") // (4 if wide else 2), kind.encode(), flat))])

    def join(held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        """Documents of a block from its positions and all of its words."""
        parts = _unpack(held[0][1])
        doc_ids, null, counts = np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], np.uint8), np.frombuffer(parts[2], "<i4")
        count, n = np.frombuffer(parts[3], "<i8").tolist()
        first = np.frombuffer(parts[4], "<i8")
        words = decode_ranks(np.frombuffer(parts[5], np.uint8), np.frombuffer(parts[6], np.uint8), n)
        del parts
        length, offset, pool, used = np.full(count, -1, np.int64), np.zeros(count, np.int64), [], 0
        for bucket, payload in held[1:]:
            top, size, kind, ids = _unpack(payload)
            top, size = np.frombuffer(top, "<i4"), np.frombuffer(size, "<i4").astype(np.int64)
            at = np.concatenate([top, first[bucket] + np.arange(len(size) - len(top))])
            length[at], offset[at] = size, used + np.cumsum(size) - size
            used += int(size.sum())
            pool.append(np.frombuffer(ids, kind.decode()))
        if (length < 0).any():
            raise ValueError("words without ids")
        flat = np.concatenate(pool) if pool else np.zeros(0, "<u2")
        held.clear()
        begin = 0
        keys = [None if m else d for d, m in zip(doc_ids.tolist(), null.tolist(), strict=True)]
        for a in range(0, len(keys), 500):
            out = []
            for c in counts[a : a + 500].tolist():
                w = words[begin : begin + c]
                begin += c
                size = length[w]
                upto = np.cumsum(size)
                total = int(upto[-1]) if c else 0
                out.append(flat[np.repeat(offset[w] - (upto - size), size) + np.arange(total)])
            yield finish(keys[a : a + 500], out)

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        open_at = None
        for b in batches:
            for k in range(b.num_rows):
                block = b.column(1)[k].as_py()
                if held and block != open_at:
                    yield from join(held)
                    held = []
                open_at = block
                held.append((b.column(2)[k].as_py(), b.column(3)[k].as_buffer().to_pybytes()))
        if held:
            yield from join(held)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(split, ROW)
    # Buckets and blocks are dealt by number, so every task gets its share of them.
    coded = rows.repartitionById(partitions, F.col("spread") % partitions).mapInArrow(look_up, ROW)
    where = (F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit(0xFFFFFFFF)) * 7919) % partitions
    return coded.repartitionById(partitions, where.cast("int")).sortWithinPartitions("block", "bucket").mapInArrow(reassemble, schema)


def decode_ids(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    """Join of ids to the token-byte table, in order of position."""
    first, length, data = table
    size = length[ids]
    upto = np.cumsum(size)
    total = int(upto[-1]) if len(upto) else 0
    return data[np.repeat(first[ids] - (upto - size), size) + np.arange(total)].tobytes()


def decode(coded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """``(doc_id, ids, decoded)``: the bytes of the ids of ``(doc_id, ids)``."""
    path = ranks_path or public_tokenizers.path(RANKS_FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(path)
        for b in batches:
            out = [decode_ids(np.frombuffer(x.as_buffer(), "<u4"), table) for x in b.column(1)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@operator
def digest(docs: DataFrame, ranks_path: str | None = None, **kw) -> DataFrame:
    """:data:`DIGEST` of every document: encoded, decoded again, both hashed."""
    path = ranks_path or public_tokenizers.path(RANKS_FILE)

    def finish(doc_ids: list[int | None], ids: list[np.ndarray]) -> pa.RecordBatch:
        table, decimal = token_table(path), _decimals()
        hashes = [hashlib.sha256(b" ".join([decimal[k] if k < len(decimal) else b"%d" % k for k in x.tolist()])).hexdigest() for x in ids]
        decoded = [hashlib.sha256(decode_ids(x, table)).hexdigest() for x in ids]
        return pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(hashes), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(docs, path, finish=finish, schema=DIGEST, **kw)


@lru_cache(None)
def _decimals() -> list[bytes]:
    return [b"%d" % k for k in range(1 << 16)]

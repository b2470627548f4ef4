"""Token ids in files: frequency ranks in byte-aligned variable-length coding.

Ids are replaced by their rank in the corpus (most frequent: 0), and ranks are
written in one to four bytes each.  The lengths stand apart from the bytes, two
bits a rank, in control bytes; so a reader finds the length of four ranks by one
table lookup, and all positions of a file by array operations.

A file holds consecutive documents in ascending ``doc_id`` order::

    b"TMV1" | documents u32 | ids u64 | data bytes u64      (little-endian)
    doc_id i64 each | ids u32 each | control bytes | data bytes | b"\\n"

The rank table of a corpus is a Parquet table beside the files.  Ids may have up
to 32 bits; how many the vocabulary needs decides how they are kept before.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .prefix import prefix_sums
from .scratch import materialize, new_path, operator
from .wordsplit import hf_coder

MAGIC = b"TMV1"
END_ID = 2
VOCAB_FILE = "byte_bpe_50k.json"
#: Ids a file holds at most, unless a single document has more.
FILE_IDS = 4_000_000
_HEAD = struct.Struct("<4sIQQ")
#: Lengths of four ranks for each control byte, lowest bits first.
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1


def crc32_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encode_ranks(ranks: np.ndarray, step: int = 1 << 18) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks; ``step``, a multiple
    of four, bounds the memory this takes."""
    parts = [_encode_part(ranks[a : a + step]) for a in range(0, len(ranks), step)]
    return b"".join(c for c, _ in parts), b"".join(d for _, d in parts)


def _encode_part(ranks: np.ndarray) -> tuple[bytes, bytes]:
    ranks = ranks.astype(np.uint32)
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), raw[np.arange(4) < size[:, None]].tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """Ranks again: lengths by table lookup, positions by a running sum."""
    size = LENGTHS.astype(np.uint8)[control].reshape(-1)[:n]
    stop = np.cumsum(size, dtype=np.int64)
    start = stop - size
    out = data[start].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        out[more] |= data[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack_file(doc_ids: list[int], ranks: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ranks) if ranks else np.zeros(0, np.uint32)
    control, data = encode_ranks(flat)
    head = _HEAD.pack(MAGIC, len(doc_ids), len(flat), len(data))
    return head + np.array(doc_ids, "<i8").tobytes() + np.array([len(r) for r in ranks], "<u4").tobytes() + control + data


def unpack_file(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, ids of each, all ranks)"""
    magic, docs, n, size = _HEAD.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = _HEAD.size
    doc_ids = np.frombuffer(content, "<i8", docs, at)
    counts = np.frombuffer(content, "<u4", docs, at := at + 8 * docs)
    control = np.frombuffer(content, np.uint8, -(-n // 4), at := at + 4 * docs)
    data = np.frombuffer(content, np.uint8, size, at + len(control))
    return doc_ids, counts, decode_ranks(control, data, n)


def largest_id(vocab: str, end_id: int) -> int:
    """The largest id that documents can have; a vocabulary is small, so it is read here."""
    from tokenizers import Tokenizer

    out = max(end_id, max(Tokenizer.from_file(vocab).get_vocab(with_added_tokens=True).values(), default=0))
    if not 0 <= end_id or out >= 1 << 32:
        raise ValueError(f"ids need more than 32 bits: {end_id}, {out}")
    return out


def id_type(largest: int) -> str:
    """What holds ids up to ``largest`` in as few bytes as two or four."""
    return "<u2" if largest < 1 << 16 else "<u4"


def tokenize(docs: DataFrame, vocab: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, row, ids)``: the ids of each whole text, as integers of
    :func:`id_type` in a binary column, closed by ``end_id``; ``row`` numbers the
    rows.  Null text: empty."""
    path = vocab or public_tokenizers.path(VOCAB_FILE)
    kind = id_type(largest_id(path, end_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = hf_coder(path)

        def batch(out: list[bytes], first: int) -> pa.RecordBatch:
            part = slice(first, first + len(out))
            return pa.record_batch([keys[part], rows[part], pa.array(out, pa.binary())], names=["doc_id", "row", "ids"])

        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            keys, rows = b.column(0), b.column(1)
            out, first, held = [], 0, 0
            for k, ids in coder.ids(texts):
                out.append(np.append(ids, np.uint32(end_id)).astype(kind).tobytes())
                held += len(out[-1])
                if held > 4 << 20:
                    yield batch(out, first)
                    out, first, held = [], k + 1, 0
            if out:
                yield batch(out, first)

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return keyed.mapInArrow(run, "doc_id long, row long, ids binary")


def rank_table(tokens: DataFrame, largest: int) -> DataFrame:
    """``(id, n, rank)`` over the whole corpus: rank 0 is the most frequent id,
    ties to the smaller id.  As many rows as the vocabulary at most, whatever the
    corpus."""
    kind = id_type(largest)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(largest + 1, np.int64)
        for b in batches:
            for x in b.column(0):
                at, n = np.unique(np.frombuffer(x.as_buffer(), kind), return_counts=True)
                total[at] += n
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen])], names=["id", "n"])

    counts = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sorted(counts.collect(), key=lambda r: (-r.n, r.id))
    return tokens.sparkSession.createDataFrame([(r.id, r.n, k) for k, r in enumerate(rows)], "id long, n long, rank long")


def _ids_by_rank(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/ranks").select("rank", "id").collect()
    out = np.zeros(len(rows), np.uint32)
    for r in rows:
        out[r.rank] = r.id
    return out


@operator
def write_token_files(docs: DataFrame, path: str | None = None, vocab: str | None = None, **kw) -> str:
    """Write the ids of all documents below ``path`` and return it.

    ``path/files`` holds the files in ascending ``doc_id`` order of their names,
    ``path/ranks`` the rank table.  Rows with a null ``doc_id`` come first (as does
    -2**63, which stands for it); rows that repeat an id stand side by side in the
    order of ``docs``, however many they are; an empty table gives no file.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-files", keep=True)
    largest = largest_id(vocab or public_tokenizers.path(VOCAB_FILE), kw.get("end_id", END_ID))
    kind = id_type(largest)
    tokens = materialize(tokenize(docs, vocab, **kw), "tokens")
    ranks = rank_table(tokens, largest)
    ranks.coalesce(1).write.parquet(f"{path}/ranks")
    to_rank = np.zeros(largest + 1, np.uint32)
    for r in ranks.collect():
        to_rank[r.id] = r.rank

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ranks = to_rank[np.frombuffer(x.as_buffer(), kind)]
                if ids and size + len(ranks) > FILE_IDS:
                    yield pa.record_batch([pa.array([pack_file(ids, held)], pa.binary())], names=["content"])
                    ids, held, size = [], [], 0
                ids.append(NULL_ID if d is None else d)
                held.append(ranks)
                size += len(ranks)
        if ids:
            yield pa.record_batch([pa.array([pack_file(ids, held)], pa.binary())], names=["content"])

    # The text writer puts bytes down as they are; one row is one file.
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The row number splits ids that many rows repeat over several ranges.
    order = (F.asc_nulls_first("doc_id"), F.asc("row"))
    sorted_tokens = tokens.repartitionByRange(n, *order).sortWithinPartitions(*order)
    files = sorted_tokens.select("doc_id", "ids").mapInArrow(write, "content binary")
    files.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(f"{path}/files")
    return path


#: Stands for a null doc_id in the files.
NULL_ID = -(1 << 63)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, ids)`` read back, ids as little-endian 32-bit integers in a binary column."""
    to_id = _ids_by_rank(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                doc_ids, counts, ranks = unpack_file(x.as_buffer())
                ids, stops = to_id[ranks], np.cumsum(counts, dtype=np.int64)
                for a in range(0, len(doc_ids), 2000):
                    part = slice(a, a + 2000)
                    own = [ids[s - c : s].astype("<u4").tobytes() for s, c in zip(stops[part].tolist(), counts[part].tolist(), strict=True)]
                    keys = [None if d == NULL_ID else d for d in doc_ids[part].tolist()]
                    yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(own, pa.binary())], names=["doc_id", "ids"])

    return _file_rows(spark, path).mapInArrow(read, "doc_id long, ids binary")


def _file_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/files").where("length > 0").select("content", "path")


@operator
def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files at ``path``.

    Each file is decoded in one task; ``start`` then needs only the ids of the
    files before, whose counts (one row a file) are summed in two levels.
    """
    to_id = _ids_by_rank(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, name in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                doc_ids, counts, ranks = unpack_file(x.as_buffer())
                ids = to_id[ranks].astype("<u4")
                stops = np.cumsum(counts, dtype=np.int64)
                starts = stops - counts
                crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), stops.tolist(), strict=True)]
                keys = [None if d == NULL_ID else d for d in doc_ids.tolist()]
                names = [name] * len(keys)
                yield pa.record_batch(
                    [pa.array(names), pa.array(keys, pa.int64()), pa.array(starts), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["file", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    rows = materialize(_file_rows(spark, path).mapInArrow(read, "file string, doc_id long, at long, n_tokens long, ids_crc32 long"), "token-index")
    order = F.struct(F.when(F.col("doc_id").isNull(), F.lit(NULL_ID)).otherwise(F.col("doc_id")).alias("k"), F.col("file").alias("f"))
    sums = materialize(rows.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min(order).alias("first")), "file-sums")
    begin = prefix_sums(sums, "first", "n", "begin").select("file", "begin")
    return rows.join(begin, "file").select("doc_id", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")

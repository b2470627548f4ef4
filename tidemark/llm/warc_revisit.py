"""Web archives without repeated payloads.

Every page becomes one WARC/1.1 record.  Among pages with equal payloads of at
least ``min_bytes`` bytes the one with the largest id is written as a
``response``; the others become ``revisit`` records that refer to it and hold
fresh headers but no payload.

Payloads are never shuffled.  They are written once where they lie, in buckets
named by the task that wrote them; their headers (id, url, digest, length) are
shuffled by digest, and what comes out of that, the revisits, goes back to the
buckets, whose rows stay where they are.  The archives are written by Spark's own
text writer, so they can lie in any file system and a lost task leaves no half
file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize, new_path, operator
from .skew import join_groups

CRLF = "\r\n"
RECORD_END = CRLF + CRLF
#: Names and profile of the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:tidemark:page:"
#: Bytes an archive file holds at most, unless a single record has more.
FILE_BYTES = 16 << 20


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _uri(url: Column) -> Column:
    """Header lines hold no line ends, so these are percent-encoded."""
    clean = F.coalesce(url, F.lit(""))
    for sign, code in (("\r", "%0D"), ("\n", "%0A")):
        clean = F.replace(clean, F.lit(sign), F.lit(code))
    return clean


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


@contextmanager
def _conf(spark: SparkSession, **values: str) -> Iterator[None]:
    old = {k.replace("_", "."): spark.conf.get(k.replace("_", "."), None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k.replace("_", "."), v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stage(pages: DataFrame, table: str, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", staged_buckets: int | None = None) -> DataFrame:
    """``part, id, page_id, url, payload, payload_bytes, digest`` as a table in
    buckets of ``part``, the number of the task that wrote a row, so that no row
    moves and each task writes one bucket."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.monotonically_increasing_id().alias("id"), F.col(id_col).cast("long").alias("page_id"), _uri(F.col(url_col)).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    rows = rows.withColumn("part", F.shiftright("id", 33))
    spark = pages.sparkSession
    buckets = staged_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # With writers side by side rows needn't be sorted by bucket before.
    with _conf(spark, spark_sql_maxConcurrentOutputFileWriters="2"):
        rows.write.option("compression", "zstd").option("path", path).bucketBy(buckets, "part").saveAsTable(table)
    return spark.table(table)


def revisits(headers: DataFrame, min_bytes: int) -> DataFrame:
    """``part, id, original, original_url`` of the rows to write as revisits, from
    headers alone.

    Digests with over 1/400 of the repeated pages, of which there can't be many,
    are resolved where their headers lie, the others by a shuffle.
    """
    large = headers.where(F.col("payload_bytes") >= min_bytes)
    groups = large.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("o"), F.count("*").alias("copies")).where("copies > 1")
    repeated = materialize(groups.select("digest", F.col("o.page_id").alias("original"), F.col("o.url").alias("original_url"), "copies"), "originals")
    total = repeated.agg(F.sum("copies")).first()[0] or 0
    found = join_groups(large.select("part", "id", "page_id", "digest"), repeated, "digest", "copies", total)
    return found.where(F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))).select("part", "id", "original", "original_url")


def resolve(staged: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``staged`` and ``original, original_url``, null for pages to write as responses.

    The join needs ``spark.sql.requireAllClusterKeysForCoPartition`` off, which
    lets the buckets of ``part`` serve for ``(part, id)``.
    """
    found = revisits(staged.select("part", "id", "page_id", "url", "payload_bytes", "digest"), min_bytes)
    return staged.join(found.hint("shuffle_hash"), ["part", "id"], "left")


def records(resolved: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One WARC record per row, as bytes, without the end of the record."""
    revisit = F.col("original").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
        _line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(CRLF),
    )
    body = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    length = F.octet_length(http) + F.octet_length(body)
    refers = F.when(
        revisit,
        F.concat(_line("WARC-Refers-To", _record_id(F.col("original"))), _line("WARC-Refers-To-Target-URI", F.col("original_url")), F.lit(f"WARC-Profile: {PROFILE}{CRLF}")),
    ).otherwise("")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(CRLF),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))), F.lit(f"WARC-Date: {date}{CRLF}"),
        _line("WARC-Target-URI", F.col("url")), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), refers,
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"), _line("Content-Length", length.cast("string")), F.lit(CRLF),
    )
    return resolved.select(F.concat(F.concat(head, http).cast("binary"), body).alias("record"))


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of a task put together in archives of about :data:`FILE_BYTES`,
    one row each; a larger record is an archive of its own."""
    held: list[bytes] = []
    size = 0
    for b in batches:
        for x in b.column(0):
            record = x.as_buffer().to_pybytes()
            if held and size + len(record) > FILE_BYTES:
                yield pa.record_batch([pa.array([RECORD_END.encode().join(held)], pa.binary())], names=["content"])
                held, size = [], 0
            held.append(record)
            size += len(record) + len(RECORD_END)
    if held:
        yield pa.record_batch([pa.array([RECORD_END.encode().join(held)], pa.binary())], names=["content"])


@operator
def write_archives(pages: DataFrame, path: str | None = None, min_bytes: int = 1000, **cols) -> str:
    """Write all pages as archives below ``path`` and return it.

    Null payload: empty.  Null url: an empty URI.  A null id has an empty name.
    Repeated rows each give a record; those with the largest id of their payload
    are all responses.  Other columns are ignored; an empty table gives no record.
    Files are cut by their bytes, so very long payloads stand alone.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc", keep=True)
    table = f"tidemark_pages_{uuid.uuid4().hex}"
    staged = stage(pages, table, new_path(spark, "pages"), **cols)
    try:
        with _conf(spark, spark_sql_requireAllClusterKeysForCoPartition="false", spark_sql_sources_bucketing_enabled="true"):
            files = records(resolve(staged, min_bytes)).mapInArrow(_archives, "content binary")
            files.select(F.col("content").cast("string").alias("value")).write.option("lineSep", RECORD_END).option("maxRecordsPerFile", 1).text(path)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    return path


def parse_archive(content: memoryview) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(WARC headers, HTTP head, payload bytes that follow) of each record."""
    data = bytes(content)
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split(CRLF)
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        begin, end = stop + 4, stop + 4 + int(head["Content-Length"])
        split = data.index(b"\r\n\r\n", begin) + 4
        yield head, data[begin:split], split
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has no end")
        at = end + 4


_INDEX = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives at ``path``; every stored payload is
    hashed again and must have the digest and length that its headers say."""
    import hashlib

    def number(text: str) -> int | None:
        digits = text.removeprefix(f"<{ID_PREFIX}").removesuffix(">")
        return int(digits) if digits else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                whole = memoryview(content.as_buffer())
                for head, http, at in parse_archive(whole):
                    said = dict(line.split(": ", 1) for line in http.decode().split(CRLF)[1:] if line)
                    n, digest = int(said["Content-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and hashlib.sha1(whole[at : at + n]).hexdigest() != digest:
                        raise ValueError(f"{head['WARC-Record-ID']}: payload and digest differ")
                    refers = head.get("WARC-Refers-To")
                    rows.append((number(head["WARC-Record-ID"]), n, digest, head["WARC-Type"], number(refers) if refers else None, head["WARC-Target-URI"]))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"])

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(read, _INDEX)

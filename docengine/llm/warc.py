"""Operator 7, WARC: revisit resolution on write.

The headers (digest, id) of the records are shuffled by payload digest and each digest's first record found with partial
aggregation; records whose payload is already there become revisits that refer to it. While the digests that repeat are
few, they are broadcast and payloads don't move; beyond that records meet them in a join whose large partitions adaptive
execution splits. Archives are written by
Spark's own text writer (a record is text, the two CRLF that end it are the line separator), so a lost executor's files
are written again by the commit protocol. They are read back by Content-Length, not by searching for separators.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_folder, saved

LEAST = 100  # bytes from which on an equal payload becomes a revisit
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed by the WARC 1.1 standard
_RECORDS = 1000  # in a file
_BROADCAST_ROWS = 100_000  # digests of 32 bytes with a page_id
_BYTES = 1 << 23  # of payload read at a time
_STEP = 1 << 18  # bytes inflated at a time
_CRLF = "\r\n"


def resolved(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to of each row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("digest", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    firsts = (
        rows.where(F.col("payload_bytes") >= least).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    )
    firsts = saved(firsts, "firsts")
    firsts = F.broadcast(firsts) if firsts.count() <= _BROADCAST_ROWS else firsts
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(firsts, "digest", "left").select(
        "page_id", "url", "html", "payload_bytes", F.lower(F.hex("digest")).alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"),
    )


def record(date: str = "2024-01-01T00:00:00Z"):
    """A WARC 1.1 record as text, without the CRLF CRLF that ends it; columns as resolved() gives them."""
    line = lambda name, *value: F.concat(F.lit(f"{name}: "), *value, F.lit(_CRLF))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", urn("page_id")), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]", "%0A")), line("WARC-Payload-Digest", F.lit("sha256:"), F.col("payload_digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn("refers_to")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length("block").cast("string")), F.lit(_CRLF),
    )
    return block, F.concat(head, "block")


def write_archives(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Writes deduplicated archives (gzip files of WARC records) to a folder that Spark can write."""
    block, whole = record()
    rows = resolved(pages, least).withColumn("block", block).select(whole.alias("value"))
    rows.write.option("lineSep", _CRLF * 2).option("maxRecordsPerFile", _RECORDS).option("compression", "gzip").text(path)


def _inflated(raw: bytes):
    """The bytes of a plain or gzip file (of one member or many), a part at a time."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    d, at = zlib.decompressobj(31), 0
    while at < len(raw):
        part = d.decompress(raw[at : at + _STEP], _STEP)
        at += _STEP
        while part:
            yield part
            part = d.decompress(d.unconsumed_tail, _STEP) if d.unconsumed_tail and not d.eof else b""
        if d.eof:  # the next member begins where this one ended
            at = min(at, len(raw)) - len(d.unused_data)
            d = zlib.decompressobj(31)
    yield d.flush()


def parse(raw: bytes):
    """(headers, block) of each record of one archive file; no more than a record and a part are held inflated."""
    parts, have = _inflated(raw), bytearray()

    def fill(n: int) -> bool:
        while len(have) < n:
            part = next(parts, None)
            if part is None:
                return False
            have.extend(part)
        return True

    while fill(1):
        end = have.find(b"\r\n\r\n")
        while end < 0:
            if not fill(len(have) + 1):
                raise ValueError("an archive ends within a header")
            end = have.find(b"\r\n\r\n")
        lines = have[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(headers["content-length"])
        if not fill(end + 4 + n):
            raise ValueError("an archive ends within a record")
        yield headers, bytes(have[end + 4 : end + 4 + n])
        fill(end + 8 + n)
        del have[: end + 8 + n]


_COLUMNS = (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("html", pa.string()))


def _records(raw: bytes):
    for headers, block in parse(raw):
        named = re.search(r"urn:page:(-?\d+)", headers["warc-record-id"])
        page = int(named[1]) if named else None
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = headers["warc-payload-digest"].removeprefix("sha256:")
        if headers["warc-type"] == "revisit":
            size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
            refers = int(re.search(r"urn:page:(-?\d+)", headers["warc-refers-to"])[1])
        else:
            size, refers = len(payload), None
            if hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"page {page}: the payload doesn't match its digest")
        yield page, size, digest, headers["warc-type"], refers, headers["warc-target-uri"], None if refers is not None else payload.decode()


def _read(batches):
    def batch_of(rows: list[tuple]):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _COLUMNS)], [n for n, _ in _COLUMNS])

    for batch in batches:
        for raw in batch.column("content"):
            rows, size = [], 0
            for row in _records(raw.as_py()):
                rows.append(row)
                size += row[1]
                if size > _BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives in a folder; a response whose payload doesn't match its digest is an error.

    html is null for revisits; with_payloads() fills it from the response they refer to.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string")


def with_payloads(records: DataFrame) -> DataFrame:
    """Joins revisit records to the responses they refer to, so that each row has its html."""
    originals = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("html").alias("original"))
    back = records.where("record_type = 'revisit'").drop("html").join(originals.dropDuplicates(["refers_to"]), "refers_to", "left")
    return records.where("record_type = 'response'").unionByName(back.withColumnRenamed("original", "html"))


def deduplicated(pages: DataFrame, path: str | None = None, least: int = LEAST) -> DataFrame:
    """Writes the archives of pages and reads them back.

    Of records with equal payloads of at least `least` bytes, that with the smallest page_id is a response and others are
    revisits that refer to it; smaller payloads are all responses. Null html is an empty payload, a null url an empty
    one. Rows that repeat the smallest page_id of a payload are responses too. A null page_id
    stays null and is never referred to. Line ends in a url are escaped as %0A.
    """
    spark = pages.sparkSession
    path = path or new_folder(spark, "warc")
    write_archives(pages, path, least)
    return read_archives(spark, path)


def op7(spark, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= {LEAST} GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(p.h) AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h
"""

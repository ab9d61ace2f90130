"""WARC archives: writing pages, reading archives, and resolving repeated payloads to revisits.

Spark's text writer writes the archives: a record is one value, and the two line breaks that end
a record are the line separator. Archives are read as binary files, bounded by ``RECORDS`` each,
and unpacked as a stream in the task. Deduplication shuffles headers only: by payload digest, to
find each digest's original response, to which the other records become revisits without payload
and with fresh headers. Digests, minima and headers are built-in expressions.

Defined results: a NULL html is an empty payload; a NULL page_id comes after all others; records
with equal page_id are ordered by record id, so exactly one is the response; repeated rows are
records of their own; a NULL url has no header line, and line breaks in one are percent-encoded;
empty tables give archives without records and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.llm.common import col
from tabulens.session import cut_lineage, fresh_path

#: Records in one archive file at most.
RECORDS = 20_000
#: Shorter payloads are never made revisits.
LEAST_BYTES = 0
#: Payload bytes that a task hands on at once, about.
BATCH_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the WARC format.
BREAK = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD_COLUMNS = (
    "record_id string, record_type string, page_key string, uri string, date string, digest string, "
    "payload_bytes long, refers_to_record string, payload string"
)


def payload_digest(payload: Column) -> Column:
    """Base32 SHA-1: twenty bits, five hexadecimal digits, are four digits of the alphabet."""
    hexadecimal = F.sha1(payload)
    parts = [
        F.lpad(F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _line(name: str, value: Column) -> Column:
    """A header line, nothing for NULL."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(BREAK)), F.lit(""))


def _record(record: DataFrame) -> Column:
    """The text of a record with the columns of RECORD_COLUMNS and ``original_*`` for revisits."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}"),
        _line("Content-Length", F.col("payload_bytes")),
        F.lit(BREAK),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.coalesce("payload", F.lit(""))))
    return F.concat(
        F.lit(f"WARC/1.1{BREAK}"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.col("record_id"), F.lit(">"))),
        _line("WARC-Date", F.col("date")),
        _line("WARC-Target-URI", F.replace(F.replace("uri", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:uuid:"), F.col("original_record"), F.lit(">")))),
        _line("WARC-Refers-To-Target-URI", F.when(revisit, F.replace(F.replace("original_uri", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")))),
        _line("WARC-Refers-To-Date", F.when(revisit, F.col("original_date"))),
        _line("X-Page-ID", F.col("page_key")),
        F.lit(f"Content-Type: application/http; msgtype=response{BREAK}"),
        _line("Content-Length", F.octet_length(block)),
        F.lit(BREAK),
        block,
    )


def _write(records: DataFrame, path: str) -> str:
    lines = records.select(_record(records).alias("value"))
    lines.write.option("lineSep", BREAK * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)
    return path


def write_pages(pages: DataFrame, path: str) -> str:
    """Archives under ``path`` with one response record per row of (page_id, url, html)."""
    payload = F.coalesce(col("html"), F.lit(""))
    name = F.md5(F.concat_ws(" ", F.col("page_id").cast("string"), F.monotonically_increasing_id().cast("string")))
    record_id = F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    records = pages.select(
        record_id.alias("record_id"), F.lit("response").alias("record_type"), F.col("page_id").cast("string").alias("page_key"),
        col("url").alias("uri"), F.lit(DATE).alias("date"), payload_digest(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), payload.alias("payload"),
        *[F.lit(None).cast("string").alias(f"original_{x}") for x in ("record", "uri", "date")],
    )
    return _write(records, path)


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an unpacked archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields["content-length"]))


def _bare(identifier: str | None) -> str | None:
    return identifier[len("<urn:uuid:") : -1] if identifier else None


def _row(fields: dict[str, str], block: bytes, payload: bool) -> list:
    head, _, body = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    length = len(body)
    digest = fields["warc-payload-digest"].partition(":")[2]
    if kind == "revisit":
        lines = (x.partition(b":") for x in head.split(b"\r\n"))
        length = next((int(v) for k, _, v in lines if k.lower() == b"content-length"), None)
    elif not payload:
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()  # what is stored, not what was said
    return [
        _bare(fields["warc-record-id"]), kind, fields.get("x-page-id"), fields.get("warc-target-uri"), fields.get("warc-date"), digest,
        length, _bare(fields.get("warc-refers-to")), body.decode() if payload and kind != "revisit" else None,
    ]


def _reader(payload: bool):
    names = [x.split()[0] for x in RECORD_COLUMNS.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.string() for x in RECORD_COLUMNS.split(", ")]

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                packed = pa.BufferReader(content.as_buffer())
                with gzip.open(packed) as stream:
                    for fields, block in parse_records(stream):
                        rows.append(_row(fields, block, payload))
                        held += len(block) if payload else 500
                        if held > BATCH_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return read


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives under ``path``; without ``payload`` only headers and digests leave the task."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_reader(payload), RECORD_COLUMNS)


def originals(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(digest, original_*) of each digest: its response with the smallest page id. Minima are taken before the shuffle."""
    page = F.col("page_key").cast("long")
    order = F.struct(page.isNull().alias("last"), page.alias("page"), F.col("record_id").alias("record"), F.col("uri").alias("uri"), F.col("date").alias("date"), "payload_bytes")
    responses = headers.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= least_bytes))
    first = responses.groupBy("digest").agg(F.min(order).alias("o"))
    return first.select(
        "digest", F.col("o.record").alias("original_record"), F.col("o.page").alias("original_page"), F.col("o.uri").alias("original_uri"),
        F.col("o.date").alias("original_date"), F.col("o.payload_bytes").alias("original_bytes"),
    )


def deduplicate(spark: SparkSession, source: str, target: str, least_bytes: int = LEAST_BYTES) -> str:
    """Archives under ``target`` with the records of ``source``, repeated payloads as revisits of the original.

    Only headers meet by digest; a digest of a third of all records is split by adaptive
    execution. The payloads join the list of revisits by record id, which is even.
    """
    headers = cut_lineage(read_archives(spark, source, payload=False).drop("payload"))
    first = originals(headers, least_bytes)
    revisits = headers.join(first, "digest").where(F.col("record_id") != F.col("original_record"))
    revisits = revisits.where(F.col("payload_bytes") >= least_bytes).select(
        F.col("record_id").alias("_revisit"), "original_record", "original_uri", "original_date"
    )
    records = read_archives(spark, source).join(revisits, F.col("record_id") == F.col("_revisit"), "left")
    kind = F.when(F.col("_revisit").isNotNull(), "revisit").otherwise(F.col("record_type"))
    return _write(records.withColumn("record_type", kind), target)


def resolved(spark: SparkSession, path: str) -> DataFrame:
    """Each record of deduplicated archives, revisits with the page and the bytes of the response that their headers refer to.

    A revisit whose response is not there, or has another digest, has NULL in both. A response to which a third of all
    records refer is split by adaptive execution.
    """
    headers = cut_lineage(read_archives(spark, path, payload=False).drop("payload"))
    page = F.col("page_key").cast("long")
    revisits = headers.where("record_type = 'revisit'")
    others = headers.where("record_type IS DISTINCT FROM 'revisit'")
    responses = headers.where("record_type = 'response'").select(
        F.col("record_id").alias("_record"), F.col("digest").alias("_digest"), page.alias("_page"), F.col("payload_bytes").alias("_bytes")
    )
    found = revisits.join(responses, (F.col("refers_to_record") == F.col("_record")) & (F.col("digest") == F.col("_digest")), "left")
    names = [page.alias("page_id"), F.col("digest").alias("payload_digest"), F.col("record_type")]
    found = found.select(*names, F.col("_bytes").alias("payload_bytes"), F.col("_page").alias("refers_to"))
    own = others.select(*names, "payload_bytes", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def archived(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Pages written to archives, deduplicated, and read back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    raw = write_pages(pages, fresh_path(spark, "warc"))
    return resolved(spark, deduplicate(spark, raw, fresh_path(spark, "warc-deduplicated"), least_bytes))

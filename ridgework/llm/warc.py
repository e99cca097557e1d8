"""Web archives: pages written as WARC records, read back, and assembled into captures.

A page is three records: the request, the response (or a revisit of an equal payload archived under
another page) and a metadata record; request and metadata name the response they go with in
``WARC-Concurrent-To``. Spark's text writer writes them, with the record separator as line end, so an
archive can lie in any store Spark reaches; archives hold a bounded number of records and are gzip files.

Reading goes by each record's ``Content-Length``. Transactions are assembled by joining the three kinds of
records on the identifiers, one nested row per capture.

Payload texts are shuffled once (to meet the list of revisits) and not at all on the way back.

Defined cases: a NULL html is an empty payload; a NULL url is an empty target; line ends in a url are
dropped from headers; of equal payloads that largest ``page_id`` is the response, and all rows that
have it are; rows without ``page_id`` revisit a response that has one, or else are responses; a capture
without request or metadata has NULL there; an empty table writes an archive without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ridgework.session import scratch_dir, stage

LINE = "\r\n"
RECORD_END = "\r\n\r\n"
RECORDS_PER_ARCHIVE = 6_000
DATE = "2020-01-01T00:00:00Z"
HTTP_RESPONSE = f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}{LINE}"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Fixed digits of base 32: those that conv() writes, and those of RFC 4648 in the same order.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(value: Column) -> Column:
    """SHA-1 as upper-case base 32: ten hex digits are eight of base 32."""
    hexed = F.sha1(value)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def _record(kind: str | Column, identifier: Column, target: Column, headers: list[Column], block: Column) -> Column:
    """One record without its end: header lines, an empty line and the block."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), identifier, F.lit(">")),
        F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), target), *headers,
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(LINE, *lines), F.lit(RECORD_END), block)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """Write all pages; payloads of ``least_bytes`` or more that equal another's become revisits."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    clean = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\\r\\n]", "")
    keyed = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), clean.alias("url"), payload.alias("payload"), sha1_base32(payload).alias("digest")
    )
    # Equal payloads are counted by digest in every task first; only groups of two and more go on.
    same = keyed.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(
        F.count("*").alias("n"), F.max("page_id").alias("first_id"), F.max_by("url", F.struct("page_id", "url")).alias("first_url")
    ).where("n > 1 and first_id is not null")
    rows = keyed.join(same.drop("n"), "digest", "left")
    revisit = F.coalesce(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    named = rows.select("*", revisit.alias("revisit"), F.uuid().alias("main"), F.uuid().alias("asked"), F.uuid().alias("about"))
    target, digest = F.col("url"), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    to_main = F.concat(F.lit("WARC-Concurrent-To: <urn:uuid:"), F.col("main"), F.lit(">"))
    again = F.col("revisit")
    main = _record(
        F.when(again, "revisit").otherwise("response"), F.col("main"), target,
        [F.lit("Content-Type: application/http;msgtype=response"), digest,
         F.when(again, f"WARC-Profile: {REVISIT_PROFILE}"), F.when(again, F.concat(F.lit("WARC-Refers-To-Target-URI: "), F.col("first_url")))],
        F.concat(F.lit(HTTP_RESPONSE), F.when(again, F.lit("")).otherwise(F.col("payload"))),
    )
    path = F.concat(F.lit("/"), F.regexp_extract(target, "^[a-zA-Z]+://[^/?#]*/?([^#]*)", 1))
    host = F.regexp_extract(target, "^[a-zA-Z]+://([^/?#]*)", 1)
    request = _record(
        "request", F.col("asked"), target, [F.lit("Content-Type: application/http;msgtype=request"), to_main],
        F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{LINE}Host: "), host, F.lit(LINE + LINE)),
    )
    about = _record(
        "metadata", F.col("about"), target, [F.lit("Content-Type: application/warc-fields"), to_main],
        F.concat_ws(": ", F.lit("page_id"), F.col("page_id").cast("string")),
    )
    records = named.select(F.explode(F.array(request, main, about)).alias("record"))
    records.write.option("lineSep", RECORD_END).option("maxRecordsPerFile", RECORDS_PER_ARCHIVE).option("compression", "gzip").text(folder)


RECORD = "type string, record_id string, concurrent_to string, target string, digest string, length bigint, payload binary, fields string"


def read_records(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All records of a folder of archives; ``digest`` and ``length`` of responses are those of the payload read.

    A revisit has the digest its header names and no length. Without ``payloads`` they are digested and
    dropped in the task that reads them.
    """
    archives = spark.read.format("binaryFile").load(folder).select("content")

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in split_records(gzip.decompress(content.as_buffer())):
                    rows.append(_parsed(headers, block, payloads))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema=kind)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    kind = pa.schema([
        ("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("target", pa.string()),
        ("digest", pa.string()), ("length", pa.int64()), ("payload", pa.binary()), ("fields", pa.string()),
    ])
    return archives.mapInArrow(parse, RECORD)


def split_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive."""
    at, end = 0, RECORD_END.encode()
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record starts at byte {at}")
        body = data.index(end, at) + len(end)
        lines = data[at:body - len(end)].decode().split(LINE)[1:]
        headers = {name.lower(): value for name, value in (line.split(": ", 1) for line in lines if ": " in line)}
        size = int(headers["content-length"])
        if not data.startswith(end, body + size):
            raise ValueError(f"the record at byte {at} is not {size} bytes long")
        yield headers, data[body:body + size]
        at = body + size + len(end)


def _parsed(headers: dict[str, str], block: bytes, payloads: bool) -> dict:
    kind = headers["warc-type"]
    row = {
        "type": kind, "record_id": headers["warc-record-id"], "concurrent_to": headers.get("warc-concurrent-to"),
        "target": headers.get("warc-target-uri"), "digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
    }
    if kind == "response":
        payload = block[block.index(RECORD_END.encode()) + len(RECORD_END):]
        row |= {"digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(), "length": len(payload)}
        if payloads:
            row["payload"] = payload
    elif kind != "revisit":
        row["fields"] = block.decode()
    return row


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture``, ``request``, ``metadata`` and ``page_id`` from the metadata."""
    capture = F.struct("type", "record_id", "target", "digest", "length", "payload").alias("capture")
    main = records.where("type in ('response', 'revisit')").select("record_id", capture)
    part = F.struct("record_id", "target", "fields")
    request = records.where("type = 'request'").select(F.col("concurrent_to").alias("record_id"), part.alias("request"))
    about = records.where("type = 'metadata'").select(F.col("concurrent_to").alias("record_id"), part.alias("metadata"))
    page = F.regexp_extract("metadata.fields", "^page_id: (-?[0-9]+)", 1)
    return main.join(request, "record_id", "left").join(about, "record_id", "left").select(
        F.when(page != "", page.cast("bigint")).alias("page_id"), "capture", "request", "metadata"
    )


def resolve(found: DataFrame) -> DataFrame:
    """``found`` captures with ``refers_to`` and ``length`` of revisits taken from the response of the same digest."""
    first = found.where("capture.type = 'response'").groupBy(F.col("capture.digest").alias("digest")).agg(
        F.max("page_id").alias("first_id"), F.max("capture.length").alias("first_length")
    )
    joined = found.join(first, F.col("capture.digest") == F.col("digest"), "left")
    again = F.col("capture.type") == "revisit"
    return joined.select(
        *found.columns, F.when(again, F.col("first_id")).alias("refers_to"),
        F.when(again, F.col("first_length")).otherwise(F.col("capture.length")).alias("payload_bytes"),
    )


def round_trip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write all pages to archives in shared scratch space, read them back and assemble the captures."""
    folder = scratch_dir(pages.sparkSession, "warc")
    write_archives(pages, folder)
    # Assembly reads the records once per kind; stored, they are parsed once.
    return resolve(captures(stage(read_records(pages.sparkSession, folder, payloads), "records")))

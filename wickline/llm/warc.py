"""WARC archives: writing with segments, revisits and chunked framing; reading by reassembly.

Writing is DataFrame code: payload digests, duplicates by a pre-aggregated minimum per digest,
chunked HTTP framing, records and their segments are expressions, and Spark's text writer puts
them into archives (a record's closing blank lines are the line separator, so that bytes stay as they are).

Reading parses each archive by the records' own lengths, never by searching payloads; groups the
records of a page by origin identifier; orders segments by number; verifies that none is
missing and that the bytes add up to the stated total; decodes the chunked transfer framing; and
verifies the payload digest. A page that fails is reported with its ``status``, not dropped.

Archives hold a bounded number of records, and a group holds the segments of one record: every row gets a record
identifier of its own (its place in its input split), and the page id travels as a header.

Defined results: null html is the empty payload; a null url leaves out the target header; a null page id leaves out its
header and is read back as null; rows that share a page id are written and read back each by itself. Of rows with equal payloads the one
with the smallest page id is the response (rows without an id last, of rows with that id the first one written), all others revisit it;
pages of any length are cut into segments; an empty table makes no archive and reads as an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wickline.llm.common import cut

CRLF = "\r\n"
CHUNK_BYTES = 1024
SEGMENT_BYTES = 2048
MIN_REVISIT_BYTES = 0
RECORDS_PER_FILE = 4096
BROADCAST_ROWS = 50_000
FILES = 16  # of the list of repeated payloads
DATE = "2024-01-01T00:00:00Z"
PREFIX = "urn:wickline:record:"
PAGE, REFERS = "X-Page-ID", "X-Refers-To-Page-ID"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: five hex digits make four base32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _pieces(data: Column, n: Column, size: int) -> Column:
    """Binary ``data`` of ``n`` bytes in pieces of ``size``; none for no bytes."""
    count = F.ceil(n / F.lit(size)).cast("int")
    cut_out = lambda i: F.substring(data, i * size + 1, F.lit(size))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), cut_out)).otherwise(F.array().cast("array<binary>"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``id``, ``row`` (unique), ``url``, ``payload``, ``payload_bytes``, ``digest``, and for revisits the ``first`` (id and row) they refer to."""
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("digest"))
    large = rows.filter(F.col("payload_bytes") >= min_revisit_bytes)
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    again = cut(large.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"), FILES)
    hint = F.broadcast if again.count() <= BROADCAST_ROWS else (lambda df: df)
    return rows.join(hint(again), "digest", "left").withColumn("first", F.when(F.col("first.row") != F.col("row"), F.col("first")))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_revisit_bytes: int = MIN_REVISIT_BYTES, chunk_bytes: int = CHUNK_BYTES, segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write the pages as WARC/1.1 archives into the folder ``path``."""
    rows = records(pages, id_col, url_col, html_col, min_revisit_bytes)
    framed = lambda c: F.concat(F.hex(F.octet_length(c)), F.lit(CRLF), c.cast("string"), F.lit(CRLF))
    body = F.concat(F.array_join(F.transform(_pieces(F.col("payload"), F.col("payload_bytes"), chunk_bytes), framed), ""), F.lit("0" + CRLF + CRLF))
    status = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF
    block = F.when(F.col("first").isNull(), F.concat(F.lit(status + "Transfer-Encoding: chunked" + CRLF + CRLF), body)).otherwise(
        F.concat(F.lit(status + "Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    )
    named = lambda row: F.concat(F.lit("<" + PREFIX), F.lower(F.hex(row)), F.lit(">"))
    blocks = rows.select("id", "url", "digest", "first", named(F.col("row")).alias("record"), block.cast("binary").alias("block"))
    blocks = blocks.withColumn("total", F.octet_length("block"))
    cuts = blocks.select("id", "url", "digest", "first", "record", "total", F.posexplode_outer(_pieces(F.col("block"), F.col("total"), segment_bytes)).alias("no", "part"))
    head = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    no, segmented = F.col("no") + 1, F.col("total") > segment_bytes
    last = F.col("no") == F.ceil(F.col("total") / F.lit(segment_bytes)) - 1
    text = lambda x: x.cast("string")
    lines = [
        F.lit("WARC/1.1" + CRLF),
        head("WARC-Type", F.when(F.col("no") > 0, F.lit("continuation")).when(F.col("first").isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
        head("WARC-Record-ID", F.when(F.col("no") > 0, F.concat(F.expr("substring(record, 1, length(record) - 1)"), F.lit(":"), text(no), F.lit(">"))).otherwise(F.col("record"))),
        head("WARC-Date", F.lit(DATE)),
        head("Content-Type", F.lit("application/http; msgtype=response")),
        head("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("url").isNotNull(), head("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]", "%0A"))).otherwise(F.lit("")),
        F.when(F.col("id").isNotNull(), head(PAGE, text(F.col("id")))).otherwise(F.lit("")),
        F.when(
            F.col("first").isNotNull(),
            F.concat(
                head("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                head("WARC-Refers-To", named(F.col("first.row"))),
                F.when(F.col("first.id").isNotNull(), head(REFERS, text(F.col("first.id")))).otherwise(F.lit("")),
            ),
        ).otherwise(F.lit("")),
        F.when(segmented, head("WARC-Segment-Number", text(no))).otherwise(F.lit("")),
        F.when(F.col("no") > 0, head("WARC-Segment-Origin-ID", F.col("record"))).otherwise(F.lit("")),
        F.when(segmented & last, head("WARC-Segment-Total-Length", text(F.col("total")))).otherwise(F.lit("")),
        head("Content-Length", text(F.octet_length("part"))),
        F.lit(CRLF),
        text(F.col("part")),
    ]
    out = cuts.select(F.concat(*lines).alias("value"))
    out.write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


def _plain(data: bytes) -> bytes:
    return gzip.decompress(data) if data.startswith(b"\x1f\x8b") else data


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive."""
    at, n = 0, len(data)
    while at < n:
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        head = {}
        for line in data[at:end].decode("utf-8", "replace").split(CRLF)[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        start = end + 4
        if start + size > n:
            raise ValueError(f"the record at byte {at} is cut off")
        yield head, data[start : start + size]
        at = start + size + 4


def dechunk(body: bytes) -> bytes:
    """The payload inside chunked transfer framing (extensions and trailers are skipped)."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no chunk size")
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        part = body[end + 2 : end + 2 + size]
        if len(part) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(part)
        at = end + 4 + size


_RECORD = pa.schema([("key", pa.string()), ("no", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("page", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("block", pa.binary())])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per WARC record of the archives below ``path``."""
    kinds = "key string, no int, total long, kind string, page string, refers_to string, digest string, block binary"
    try:
        files = spark.read.format("binaryFile").load(path)
    except AnalysisException:
        return spark.createDataFrame([], kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows: list[dict] = []
                for head, block in parse_records(_plain(content.as_py())):
                    rows.append({
                        "key": head.get("warc-segment-origin-id") or head["warc-record-id"],
                        "no": int(head.get("warc-segment-number", 1)),
                        "total": int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else len(block) if "warc-segment-number" not in head else None,
                        "kind": head["warc-type"],
                        "page": head.get(PAGE.lower()),
                        "refers_to": head.get(REFERS.lower()),
                        "digest": head.get("warc-payload-digest", "").removeprefix("sha1:"),
                        "block": block,
                    })
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, _RECORD)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, _RECORD)

    return files.filter("length > 0").select("content").mapInArrow(run, kinds)


_PAGE = pa.schema([("page", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("status", pa.string())])


def _decode(kind: str | None, digest: str, parts: list[dict], total: int | None) -> dict:
    """Reassembled payload of one record with its status; ``parts`` are in the order of their numbers."""
    out = {"record_type": kind, "payload_bytes": None, "payload_digest": digest, "payload": None, "status": "ok"}
    if [p["no"] for p in parts] != list(range(1, len(parts) + 1)):
        return out | {"status": "segment missing"}
    block = b"".join(p["block"] for p in parts)
    if total != len(block):
        return out | {"status": "length differs"}
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {n.strip().lower(): v.strip() for n, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if kind == "revisit":
        return out | {"payload_bytes": int(fields.get(b"content-length", b"0"))}
    try:
        payload = dechunk(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
    except ValueError:
        return out | {"status": "bad chunks"}
    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return out | {"payload_bytes": len(payload), "payload": payload, "payload_digest": found, "status": "ok" if found == digest else "digest differs"}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per page: ``page`` (id as text), ``record_type``, ``refers_to``, ``payload_bytes``,
    ``payload_digest``, ``payload`` and ``status``."""
    grouped = read_records(spark, path).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("no", "block"))).alias("parts"),
        F.max("total").alias("total"),
        F.max(F.when(F.col("kind") != "continuation", F.col("kind"))).alias("kind"),
        F.max("page").alias("page"),
        F.max("refers_to").alias("refers_to"),
        F.max("digest").alias("digest"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                rows = b.slice(at, 64).to_pylist()
                made = [{"page": r["page"], "refers_to": r["refers_to"]} | _decode(r["kind"], r["digest"], r["parts"], r["total"]) for r in rows]
                yield pa.RecordBatch.from_pylist(made, _PAGE)

    return grouped.mapInArrow(run, "page string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary, status string")

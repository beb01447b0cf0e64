"""WARC files: writing captures, reading records, assembling transactions.

A capture is a response (or a revisit of an equal payload), a request and a metadata record, which
name the response through WARC-Concurrent-To.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, table
from tessera.llm.store import saved
from tessera.session import new_folder

#: Smaller payloads are always written whole.
MIN_PAYLOAD = 100
#: Captures of a WARC file, which a reader holds at once.
FILE_CAPTURES = 1_000
#: Header lines of a stored record that the reader returns as columns of their own.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_LINE = "\r\n"
#: Records end with two line ends.
_END = "\r\n\r\n"


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """One record; header lines with a null value are left out."""
    lines = [F.concat(F.lit(f"{name}: "), F.lit(v) if isinstance(v, str) else v, F.lit(_LINE)) for name, v in headers]
    return F.concat(
        F.lit("WARC/1.1" + _LINE),
        *[F.coalesce(line, F.lit("")) for line in lines],
        F.lit("Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(_END),
        block,
    )


def with_originals(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Pages (page_id, url, html) with ``payload``, ``digest``, ``page`` and, for repeats, ``original``.

    ``page`` names the capture: the page_id, with a checksum of url and payload where rows of one
    page_id differ in these. The original of a repeated payload is the capture of its smallest
    page_id. Digests of repeated payloads and repeated ids meet pages in joins that read both sides
    straight from a shuffle, so Spark splits a hot key.
    """
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    content = F.concat(F.coalesce(F.concat(F.lit("u"), F.col("url")), F.lit("")), F.lit("|"), F.col("digest"))
    pages = pages.withColumn("content", F.substring(F.sha2(content, 256), 1, 32))
    several = saved(
        pages.filter("page_id is not null")
        .groupBy("page_id")
        .agg(F.min("content").alias("least"), F.max("content").alias("greatest"))
        .filter("least < greatest")
        .select("page_id", F.lit(True).alias("several")),
        "several",
    )
    repeated = saved(
        pages.filter(F.octet_length("payload") >= min_payload)
        .groupBy("digest")
        .agg(
            F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "content"))).alias("first"),
            F.count("*").alias("n"),
        )
        .filter("n > 1 and first is not null")
        .select("digest", F.col("first.page_id").alias("page_id"), F.col("first.content").alias("content"))
        .join(several, "page_id", "left")
        .select("digest", F.col("page_id").alias("first"), _page().alias("first_page")),
        "repeated",
    )
    original = F.when(F.col("page_id") != F.col("first"), F.col("first_page"))
    return (
        pages.join(several, "page_id", "left")
        .join(repeated, "digest", "left")
        .select("page_id", "url", "payload", "digest", _page().alias("page"), original.alias("original"))
    )


def _page() -> Column:
    number = F.col("page_id").cast("string")
    return F.when(F.col("several"), F.concat(number, F.lit("-"), F.col("content"))).otherwise(number)


def write_warc(pages: DataFrame, path: str, date: str = "2026-01-01T00:00:00Z", min_payload: int = MIN_PAYLOAD) -> None:
    """Stores pages (page_id, url, html) as gzipped WARC files below ``path``.

    Each row gives a response record with the page as an HTTP message, a request and a metadata
    record. Of rows with equal payloads of at least ``min_payload`` bytes only those with the
    smallest page_id get a response; the others get a revisit, which refers to it and has no
    payload.

    - Null html is an empty payload. A null url leaves out the target line; blanks and control
      characters of a url become %20, so it can't break a header. A null page_id is stored without
      an id and never revisits. Rows with equal ids are captures of their own unless url and payload are equal
      too: those are written alike, and read back as one capture with as many metadata records. No
      rows, no files.
    - Other columns are ignored.

    The files are Spark's text output with the record end as the line separator: every executor
    writes whole files, and a repeated task replaces its own.
    """
    rows = with_originals(pages.select("page_id", "url", "html"), min_payload)
    # ids by page, so that a revisit can name its response; a serial number for rows without an id
    page = F.coalesce(F.col("page"), F.concat(F.lit("none-"), F.monotonically_increasing_id().cast("string")))
    rows = rows.withColumn("page", page)
    urn = "urn:capture:"
    response = F.concat(F.lit(f"<{urn}"), F.col("page"), F.lit(":response>"))
    target = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    dated = ("WARC-Date", date)
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_LINE}Content-Type: text/html; charset=utf-8{_LINE}Content-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit(_END),
    )
    whole = _record(
        [
            ("WARC-Type", "response"),
            ("WARC-Record-ID", response),
            ("WARC-Target-URI", target),
            dated,
            ("WARC-Payload-Digest", digest),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        F.concat(http, F.col("payload")),
    )
    again = _record(
        [
            ("WARC-Type", "revisit"),
            ("WARC-Record-ID", response),
            ("WARC-Target-URI", target),
            dated,
            ("WARC-Payload-Digest", digest),
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", F.concat(F.lit(f"<{urn}"), F.col("original"), F.lit(":response>"))),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        http,
    )
    request = _record(
        [
            ("WARC-Type", "request"),
            ("WARC-Record-ID", F.concat(F.lit(f"<{urn}"), F.col("page"), F.lit(":request>"))),
            ("WARC-Target-URI", target),
            dated,
            ("WARC-Concurrent-To", response),
            ("Content-Type", "application/http; msgtype=request"),
        ],
        F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(f" HTTP/1.1{_END}")),
    )
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(_LINE))
    metadata = _record(
        [
            ("WARC-Type", "metadata"),
            ("WARC-Record-ID", F.concat(F.lit(f"<{urn}"), F.col("page"), F.lit(":metadata>"))),
            ("WARC-Target-URI", target),
            dated,
            ("WARC-Concurrent-To", response),
            ("Content-Type", "application/warc-fields"),
        ],
        fields,
    )
    first = F.when(F.col("original").isNull(), whole).otherwise(again)
    text = F.concat_ws(_END, first, request, metadata)
    (
        rows.select(text.alias("value"))
        .write.option("lineSep", _END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", FILE_CAPTURES)
        .text(path)
    )


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record; blocks are cut out by their length."""
    at = 0
    while True:
        at = data.find(b"WARC/", at)
        if at < 0:
            return
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = end + 4
        at = start + int(headers.get("content-length", "0"))
        yield headers, data[start:at]


RECORD = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, "
    "date string, content_type string, payload_digest string, payload_bytes bigint, fields string, payload binary"
)
_HEADERS = (
    "warc-record-id",
    "warc-type",
    "warc-concurrent-to",
    "warc-refers-to",
    "warc-target-uri",
    "warc-date",
    "content-type",
)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the WARC files below ``path``, gzipped or not, one row each.

    ``payload`` is the HTTP body of a response, null for other types; ``payload_digest`` (SHA-256 in
    hex) and ``payload_bytes`` are computed from it, so they prove what was read. For a revisit the
    digest is the one it declares. ``fields`` is the block of a metadata record as text.

    A file is read by one task, which holds it whole. An empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        for b in batches:
            for content in b.column("content"):
                data = content.as_py()
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                rows = []
                for headers, block in parse_records(data):
                    kind = headers.get("warc-type")
                    payload = digest = size = fields = None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                    elif kind == "revisit":
                        digest = headers.get("warc-payload-digest", "").rpartition(":")[2] or None
                    elif kind == "metadata":
                        fields = block.decode("utf-8", "replace")
                    rows.append([headers.get(h) for h in _HEADERS] + [digest, size, fields, payload])
                if rows:
                    columns = list(zip(*rows, strict=True))
                    types = [pa.string()] * 8 + [pa.int64(), pa.string(), pa.binary()]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return map_batches(files, run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture from records as ``read_warc`` returns them.

    Returns ``capture_id, response, request, metadata, n_requests, n_metadata``: structs of the
    records' columns. A record belongs to the capture whose response it is concurrent to; a record
    concurrent to none is a capture of its own id. ``response`` is the response or revisit record.

    - Several requests or metadata records of one capture: the one with the smallest record id is
      nested and all are counted. Nothing gathers them, so one response may have any number.
    - Orphans, whose response isn't there, come out with a null response. Records without an id and
      without a concurrent one are left out, as are types that no transaction has.
    - Several responses with one id: the smallest by type and digest. No records, no rows.
    """
    kinds = {"response": ("response", "revisit"), "request": ("request",), "metadata": ("metadata",)}
    row = F.struct("record_id", *[c for c in records.columns if c != "record_id"])
    of_kind = {name: F.when(F.col("record_type").isin(*types), row) for name, types in kinds.items()}
    counted = {k: F.count(F.when(F.col("record_type") == k, True)) for k in ("request", "metadata")}
    return (
        records.filter(F.col("record_type").isin("response", "revisit", "request", "metadata"))
        .withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
        .filter("capture_id is not null")
        .groupBy("capture_id")
        .agg(
            *[F.min(c).alias(name) for name, c in of_kind.items()],
            counted["request"].alias("n_requests"),
            counted["metadata"].alias("n_metadata"),
        )
    )


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Captures with ``original``, the capture that a revisit refers to: its response and metadata.

    Null for responses, and for revisits of a response that isn't there.
    """
    originals = captures.filter(F.col("response.record_type") == "response").select(
        F.col("capture_id").alias("_refers_to"), F.struct("response", "metadata").alias("original")
    )
    refers = F.col("response.refers_to")
    return captures.join(originals, refers == F.col("_refers_to"), "left").drop("_refers_to")


def page_id_of(metadata: str) -> Column:
    """The page id that a metadata record's fields give."""
    found = F.regexp_extract(F.col(f"{metadata}.fields"), r"(?m)^page-id: (-?\d+)", 1)
    return F.when(found != "", found.cast("bigint"))


def op4_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    captures = saved(assemble(read_warc(spark, folder).drop("payload")), "captures")
    # rows alike in id, url and payload are one capture, with a metadata record of each
    times = F.array_repeat(F.lit(1), F.greatest("n_metadata", F.lit(1)).cast("int"))
    return resolve_revisits(captures).withColumn("_row", F.explode(times)).select(
        page_id_of("metadata").alias("page_id"),
        F.coalesce("response.payload_bytes", "original.response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        page_id_of("original.metadata").alias("refers_to"),
    )

"""WARC archives of pages, and their assembly to one nested row per capture.

Every page row is written as a request, a response (or revisit) and a metadata record. Request and
metadata name the response by WARC-Concurrent-To. Of pages with equal payloads of at least
``least`` bytes, the one with the smallest page_id is the response; the others are revisits that name
it by WARC-Refers-To and carry no payload. Archives are gzip files in the shared folder.

Reading parses each archive by its Content-Length headers, so a payload may hold anything, and then
joins the three kinds of record through the concurrent-to identifiers. Identifiers are made of the
row's own values, so none is hot and a repeated task writes the same record; rows equal in page_id,
url and html are one capture, read once.

Defined results: null html is the empty payload, a null url the empty target; pages of one page_id with
different content are captures of their own, with the response's page_id; a row with null page_id is
written, sorted after all others and revisits or answers like any row; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import io
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm.common import looked_up
from rolecall.session import checkpoint_root

LINE = "\r\n"
# Fixed values of the format.
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: ten hexadecimal digits are eight base32 digits."""
    digest = F.sha1(payload)
    parts = [
        F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)
    ]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages with payload, digest, identifier and the capture that a revisit refers to."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
        payload.alias("payload"),
    ).withColumns({
        "payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload")),
    }).withColumn("capture", F.md5(F.to_json(F.struct("page_id", "url", "payload_digest", "payload_bytes"))))
    same = F.concat_ws("-", "payload_digest", "payload_bytes")
    rows = rows.withColumn("_same", F.when(F.col("payload_bytes") >= least, same))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "capture")
    firsts = rows.filter("_same IS NOT NULL").groupBy("_same").agg(
        F.count("*").alias("_size"), F.min(order).alias("first")
    )
    # Payloads that occur once need no partner; the rest are few rows beside the pages.
    firsts = firsts.filter("_size > 1").select("_same", "_size", "first")
    total = pages.count()
    found = looked_up(rows, firsts, "_same", "_size", total)
    other = F.col("first").isNotNull() & (F.col("first.capture") != F.col("capture"))
    return found.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", "capture",
        F.when(other, F.col("first.capture")).alias("refers_capture"),
        F.when(other, F.col("first.page_id")).alias("refers_page"),
    )


def _uri(kind: str, capture) -> Column:
    return F.concat(F.lit(f"<urn:{kind}:"), capture, F.lit(">"))


def _record(headers: list[Column], block: Column) -> Column:
    """Headers, an empty line, the block, and the first of the two line ends that close a record."""
    lines = F.concat_ws(
        LINE, F.lit("WARC/1.1"), *headers,
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(lines, F.lit(LINE + LINE), block, F.lit(LINE))


def write_archives(pages: DataFrame, folder: str, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> str:
    """Write all pages' records below ``folder``; returns it. One archive per partition."""
    rows = planned(pages, least)
    is_revisit = F.col("refers_capture").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    # A line end inside a header value would end the header.
    target = line("WARC-Target-URI", F.translate("url", "\r\n", ""))
    when = F.lit(f"WARC-Date: {date}")
    response = _uri("response", F.col("capture"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(LINE + LINE),
    )
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    answered = _record([
        F.concat(F.lit("WARC-Type: "), F.when(is_revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", response), when, target,
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(is_revisit, F.concat(
            F.lit(f"WARC-Profile: {PROFILE}{LINE}WARC-Refers-To: "),
            _uri("response", F.col("refers_capture")))),
        F.lit("Content-Type: application/http; msgtype=response"),
    ], F.concat(http, F.when(is_revisit, "").otherwise(F.col("payload").cast("string"))))
    asked = _record([
        F.lit("WARC-Type: request"), line("WARC-Record-ID", _uri("request", F.col("capture"))),
        line("WARC-Concurrent-To", response), when, target,
        F.lit("Content-Type: application/http; msgtype=request"),
    ], F.lit(f"GET / HTTP/1.1{LINE}{LINE}"))
    described = _record([
        F.lit("WARC-Type: metadata"), line("WARC-Record-ID", _uri("metadata", F.col("capture"))),
        line("WARC-Concurrent-To", response), when, target,
        F.lit("Content-Type: application/warc-fields"),
    ], F.concat(
        F.lit("page-id: "), page,
        F.when(is_revisit, F.concat(
            F.lit(f"{LINE}refers-to-page: "), F.coalesce(F.col("refers_page").cast("string"), F.lit(""))
        )).otherwise(""), F.lit(LINE),
    ))
    records = rows.select(F.concat(asked, F.lit(LINE), answered, F.lit(LINE), described).alias("value"))
    records.write.option("lineSep", LINE).option("compression", "gzip").text(folder)
    return folder


def parse(stream):
    """(headers, block) of each record of an archive, by Content-Length."""
    while True:
        first = stream.readline()
        if not first:
            return
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("archive ends inside a record")
        yield headers, block


_RECORD = (
    "type string, record_id string, concurrent_to string, refers_to string, target_uri string, "
    "date string, payload_digest string, payload_bytes long, block binary"
)


def read_archives(spark: SparkSession, folder: str, blocks: bool = True) -> DataFrame:
    """The flat records of all archives below ``folder``.

    payload_bytes is stated by the HTTP header; a response's digest and length are recomputed from
    what was read and must agree. ``blocks=False`` leaves out responses' blocks once checked.
    """

    def run(batches):
        import base64
        import hashlib

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for h, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    kind, stated, digest = h["warc-type"], None, None
                    if kind in ("response", "revisit"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        stated = int(head.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response":
                            own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            if own != digest or len(payload) != stated:
                                raise ValueError(f"{h['warc-record-id']}: payload and digest differ")
                    if kind == "response" and not blocks:
                        block = None
                    rows.append((kind, h["warc-record-id"], h.get("warc-concurrent-to"),
                                 h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"),
                                 digest, stated, block))
                    size += len(block or b"") + 200
                    if size > 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.filter("length > 0").select("content")
    return files.mapInArrow(run, _RECORD)


def _batch(rows) -> pa.RecordBatch:
    names = [f.split()[0] for f in _RECORD.split(", ")]
    kinds = [pa.string()] * 7 + [pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
    )


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit with the request and metadata that name it.

    Records that a repeated page row wrote again have equal identifiers and count once. Requests and
    metadata without their response name nothing and are left out; a missing one is null.
    """
    answer = records.filter("type IN ('response', 'revisit')").dropDuplicates(["record_id"])
    request = (
        records.filter("type = 'request' AND concurrent_to IS NOT NULL")
        .groupBy("concurrent_to").agg(F.min(F.struct("record_id", "date", "block")).alias("request"))
    )
    metadata = (
        records.filter("type = 'metadata' AND concurrent_to IS NOT NULL")
        .groupBy("concurrent_to").agg(F.min(F.struct("record_id", "date", "block")).alias("metadata"))
    )
    return (
        answer.select(
            F.col("record_id").alias("capture_id"), "target_uri",
            F.struct("type", "record_id", "refers_to", "date", "payload_digest", "payload_bytes", "block")
            .alias("response"),
        )
        .join(request.withColumnRenamed("concurrent_to", "capture_id"), "capture_id", "left")
        .join(metadata.withColumnRenamed("concurrent_to", "capture_id"), "capture_id", "left")
    )


def page_rows(nested: DataFrame) -> DataFrame:
    """page_id, payload length and digest, record type and the page a revisit refers to."""
    fields = F.col("metadata.block").cast("string")
    page = lambda name: F.nullif(F.regexp_extract(fields, rf"(?m)^{name}: (\d*)", 1), F.lit(""))
    return nested.select(
        page("page-id").cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        page("refers-to-page").cast("long").alias("refers_to"),
        "target_uri",
    )


def round_trip(pages: DataFrame, least: int = 0, blocks: bool = False) -> DataFrame:
    """Write ``pages`` to the shared folder and assemble the captures from what is read back."""
    spark = pages.sparkSession
    folder = f"{checkpoint_root(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, least)
    return captures(read_archives(spark, folder, blocks))

"""WARC archives: one transaction a page is written as request, response (or revisit) and metadata
records, and read back by joining the three through their concurrent-to identifiers.

Archives are real WARC 1.1 files. A record is valid UTF-8 text and every record ends with two line
ends, so Spark's own text writer lays them down (record separator CRLF CRLF, gzip), on any file
system Spark can write, with Spark's commit protocol. Reading takes whole files of a bounded number
of captures and follows Content-Length, so payloads may hold anything, record separators too.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, salted_join, scratch, staged, table

CRLF = "\r\n"
MIN_REVISIT_BYTES = 100
#: Bytes of payloads in a file at most, but for a single longer one: a file is read whole by one task.
FILE_BYTES = 1 << 30
#: Payloads are written by classes of size, each up to so many bytes and with as many to a file as may fit.
CLASS_BYTES = (1 << 16, 1 << 22, 1 << 28)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _record_id(kind: str, page="__page", url="__url"):
    """Identifier of the capture's record of that kind, from the page, its url and its __digest."""
    parts = (F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in (page, url))
    h = F.md5(F.concat_ws("|", F.lit(kind), *parts, F.col("__digest")))
    dashed = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def _record(headers: list, block):
    """A record without its last two line ends; headers that are null are left out."""
    head = F.concat_ws(CRLF, F.lit("WARC/1.1"), *headers, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(head, F.lit(CRLF * 2), block)


def revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(__page, __digest, __first, __first_url): pages whose payload of at least 100 bytes is that of a smaller id.

    Only ids, urls and digests are shuffled; the smallest id of a digest is a partial aggregate, and
    the pages of a payload that a third of all share meet it in many tasks.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    keyed = staged(
        pages.select(F.col(id_col).alias("__page"), F.col(url_col).cast("string").alias("__url"), payload.alias("__payload"))
        .filter(F.octet_length("__payload") >= MIN_REVISIT_BYTES)
        .filter(F.col("__page").isNotNull())
        .select("__page", "__url", F.sha2("__payload", 256).alias("__digest")),
        "warc-digests",
    )
    firsts = keyed.groupBy("__digest").agg(F.min(F.struct("__page", "__url")).alias("__f"), F.count("*").alias("__n")).filter("__n > 1")
    firsts = staged(firsts.select("__digest", F.col("__f.__page").alias("__first"), F.col("__f.__url").alias("__first_url"), "__n"), "warc-firsts")
    return salted_join(keyed.drop("__url"), firsts, ["__digest"], "__n", "__page").filter("__page > __first").select("__page", "__digest", "__first", "__first_url").distinct()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_bytes: int = FILE_BYTES) -> None:
    """Writes three records a row of pages to files below path.

    A null payload is empty; a null url leaves its header out; white space and control characters
    in a url are percent-encoded; a null id is never a revisit, nor refers any to it. Repeated rows
    are written as often as they occur; rows that differ in their url alone are captures of their
    own. An empty table gives no file. Columns of other names are ignored.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    own = pages.select(F.col(id_col).alias("__page"), F.col(url_col).cast("string").alias("__url"), payload.alias("__payload")).withColumn("__digest", F.sha2(F.col("__payload").cast("binary"), 256))
    again = revisits(pages, id_col, url_col, payload_col)
    n = F.octet_length("__payload").cast("string")
    uri = F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("__url", r"[\x00-\x20\x7f]", "%20"))
    main, request, meta = _record_id("main"), _record_id("request"), _record_id("metadata")
    is_revisit = F.col("__first").isNotNull()

    def header(name: str, value):
        return F.concat(F.lit(f"{name}: "), value)

    def lead(kind, rid):
        return [header("WARC-Type", kind), header("WARC-Record-ID", rid), F.lit(f"WARC-Date: {DATE}"), uri]

    def to_main():
        return header("WARC-Concurrent-To", main)

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), n, F.lit(CRLF * 2))
    target = F.coalesce(F.regexp_replace("__url", r"[\x00-\x20\x7f]", "%20"), F.lit("/"))
    records = F.array(
        _record([*lead(F.lit("request"), request), to_main(), F.lit("Content-Type: application/http;msgtype=request")], F.concat(F.lit("GET "), target, F.lit(f" HTTP/1.1{CRLF * 2}"))),
        _record(
            [
                *lead(F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")), main),
                header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("__digest"))),
                F.when(is_revisit, F.lit(f"WARC-Profile: {PROFILE}")),
                F.when(is_revisit, header("WARC-Refers-To", _record_id("main", "__first", "__first_url"))),
                F.lit("Content-Type: application/http;msgtype=response"),
            ],
            F.when(is_revisit, http).otherwise(F.concat(http, F.col("__payload"))),
        ),
        _record([*lead(F.lit("metadata"), meta), to_main(), F.lit("Content-Type: application/warc-fields")], F.concat(F.lit("page-id: "), F.coalesce(F.col("__page").cast("string"), F.lit("")), F.lit(f"{CRLF}payload-length: "), n, F.lit(CRLF))),
    )
    size = F.octet_length(payload)
    of = sum(((size > b).cast("int") for b in CLASS_BYTES[1:]), (size > CLASS_BYTES[0]).cast("int"))
    classes = [r["k"] for r in pages.groupBy(of.alias("k")).count().collect()]  # at most one more than CLASS_BYTES
    for k in sorted(classes) or [0]:
        most = CLASS_BYTES[k] if k < len(CLASS_BYTES) else file_bytes
        below, above = (F.octet_length("__payload") <= most) if k < len(CLASS_BYTES) else F.lit(True), F.octet_length("__payload") > (CLASS_BYTES[k - 1] if k else -1)
        full = own.filter(below & above).join(again, ["__page", "__digest"], "left")
        full.select(F.explode(records).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", 3 * max(1, file_bytes // most)).text(f"{path}/class-{k}")


RECORDS = pa.schema(
    [("kind", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("payload_sha256", pa.string()), ("payload_bytes", pa.int64()), ("fields", pa.string()), ("payload", pa.binary())]
)
RECORDS_DDL = "kind string, record_id string, concurrent_to string, refers_to string, uri string, digest string, payload_sha256 string, payload_bytes bigint, fields string, payload binary"


def parse(stream: io.BufferedIOBase, with_payload: bool = False) -> Iterator[dict]:
    """The records of one archive, in order; memory is that of one record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.partition(b":")
            head[name.strip().lower().decode()] = value.strip().decode()
        block = stream.read(int(head.get("content-length", 0)))
        kind = head.get("warc-type")
        row = dict.fromkeys(RECORDS.names)
        row |= {"kind": kind, "record_id": head.get("warc-record-id"), "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"), "uri": head.get("warc-target-uri")}
        row["digest"] = (head.get("warc-payload-digest") or "").removeprefix("sha256:") or None
        if kind in ("response", "revisit"):
            _, _, payload = block.partition(b"\r\n\r\n")
            row |= {"payload_sha256": hashlib.sha256(payload).hexdigest(), "payload_bytes": len(payload), "payload": payload if with_payload and kind == "response" else None}
        elif kind == "metadata":
            row["fields"] = block.decode()
        yield row


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row a record of the archives under path."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out, size = [], 0
                for row in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())), with_payload):
                    out.append(row)
                    size += len(row["payload"] or b"") + 400
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(out, schema=RECORDS)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=RECORDS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    return map_batches(files, rows, RECORDS_DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: request, main (response or revisit) and metadata, joined through
    concurrent-to; a capture that was written k times gives k rows. A record that points to no
    main record makes no capture.
    """
    body = F.struct(*(F.col(c) for c in RECORDS.names))
    capture = F.when(F.col("kind").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))

    def only(*kinds: str):
        return F.max(F.when(F.col("kind").isin(*kinds), body))

    grouped = records.withColumn("capture_id", capture).groupBy("capture_id").agg(only("request").alias("request"), only("response", "revisit").alias("main"), only("metadata").alias("metadata"), F.count_if(F.col("kind").isin("response", "revisit")).cast("int").alias("copies"))
    return grouped.filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("__copy", "copies")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages as archives, reads those back and reports each capture."""
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    # Each capture is read from the archives once; the small assembled rows serve both sides of the join.
    got = staged(
        assemble(read_records(spark, path)).select(
            "capture_id",
            F.nullif(F.regexp_extract("metadata.fields", r"page-id: (-?\d*)", 1), F.lit("")).cast("long").alias("page_id"),
            F.when(F.col("main.kind") == "revisit", F.regexp_extract("metadata.fields", r"payload-length: (\d+)", 1).cast("long")).otherwise(F.col("main.payload_bytes")).alias("payload_bytes"),
            F.when(F.col("main.kind") == "revisit", F.col("main.digest")).otherwise(F.col("main.payload_sha256")).alias("payload_digest"),
            F.col("main.kind").alias("record_type"),
            F.col("main.refers_to").alias("__to"),
        ),
        "warc-captures",
    )
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    again = got.filter("record_type = 'revisit'")
    first = got.filter("record_type = 'response'").select(F.col("capture_id").alias("__to"), F.col("page_id").alias("refers_to")).dropDuplicates(["__to"])
    first = staged(first.join(again.groupBy("__to").agg(F.count("*").alias("__n")), "__to"), "warc-referred")
    found = salted_join(again, first, ["__to"], "__n", "capture_id", "left")
    return got.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(found.select(*columns))


OP7_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT payload_digest AS d, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON d = payload_digest
"""

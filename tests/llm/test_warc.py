import gzip
import hashlib
import io

from veritrace.llm import common, warc

BIG = "x" * 150


def test_round_trip(spark):
    rows = [(5, "http://a/ b", BIG), (2, "http://a/", BIG), (9, None, BIG), (3, "u", None), (4, "u", "short"), (6, "u", "short"), (7, "u", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n" * 20 + "é"), (7, "u", "other " * 40), (2, "http://a/", BIG), (None, "u", BIG), (11, "u", "é" * 50), (12, "u", "é" * 50), (13, "u", "y" * 99), (14, "u", "y" * 99), (2, "http://b/", BIG), (15, "u", "z" * 70_000), (16, "v", "z" * 70_000), (17, "w", "q" * 5_000_000)]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, digest int, kind string")
    path = common.scratch(spark, "w")
    warc.write_archives(pages, path, file_bytes=2 * warc.CLASS_BYTES[0])
    got = warc.assemble(warc.read_records(spark, path, with_payload=True)).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, t in rows:
        if i is not None and len((t or "").encode()) >= 100:
            first[t] = min(first.get(t, i), i)
    seen = []
    for r in got:
        page = r.metadata.fields.split("\r\n")[0].removeprefix("page-id: ")
        seen.append((page, r.main.kind, r.main.digest))
        assert r.request.concurrent_to == r.main.record_id == r.metadata.concurrent_to
        if r.main.kind == "response":
            assert hashlib.sha256(bytes(r.main.payload)).hexdigest() == r.main.digest == r.main.payload_sha256
    want = [("" if i is None else str(i), "revisit" if i is not None and t in first and i > first[t] else "response", hashlib.sha256((t or "").encode()).hexdigest()) for i, _, t in rows]
    assert sorted(seen) == sorted(want)
    assert sorted(r.main.uri for r in got if r.metadata.fields.startswith("page-id: 2\r")) == ["http://a/", "http://a/", "http://b/"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content").collect()
    assert all(sum(len(r["payload"] or b"") for r in warc.parse(gzip.GzipFile(fileobj=io.BytesIO(bytes(f.content))), with_payload=True)) <= 2 * warc.CLASS_BYTES[0] for f in files if len(f.content) < 4000)


def test_files_are_archives(spark):
    path = common.scratch(spark, "w")
    warc.write_archives(spark.createDataFrame([(1, "http://a/", "body")], "page_id long, url string, html string"), path)
    raw = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).collect())
    records = list(warc.parse(gzip.GzipFile(fileobj=io.BytesIO(raw)), with_payload=True))
    assert [r["kind"] for r in records] == ["request", "response", "metadata"] and records[1]["payload"] == b"body"


def test_empty(spark):
    path = common.scratch(spark, "w")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.assemble(warc.read_records(spark, path)).count() == 0

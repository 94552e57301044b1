import gzip
import os
import zlib

import pytest
from pyspark.sql import functions as F

from veritrace.operators import site, text, verdict
from veritrace.sources import files, http
from veritrace.streaming import audit


def test_directory(spark, tmp_path):
    for name, body in {"a.txt": "x\u200b", "sub/b.txt": "y", ".hidden": "z", "sub/.git/c": "w", "big.txt": "q" * 50}.items():
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_text(body)
    assets, skipped = files.read_directory(spark, str(tmp_path), most=40)
    assert sorted(r.target for r in assets.collect()) == ["a.txt", "sub/b.txt"]
    assert [r.target for r in skipped.collect()] == ["big.txt"]
    assets, _ = files.read_directory(spark, str(tmp_path), include_hidden=True)
    assert assets.count() == 5
    one = files.read_texts(spark, str(tmp_path / "big.txt"), most=10).first()
    assert (one.text, one.truncated, one.kind) == ("q" * 10, True, "text")


def test_output_guards(tmp_path):
    source = tmp_path / "a.txt"
    source.write_text("x")
    assert files.output_path(str(source)) == str(tmp_path / "a.cleaned.txt")
    with pytest.raises(ValueError):
        files.output_path(str(source), str(source), force=True)
    os.symlink(source, tmp_path / "link")
    with pytest.raises(ValueError):
        files.output_path(str(tmp_path / "b"), str(tmp_path / "link"))
    files.write_whole(str(tmp_path / "a.cleaned.txt"), b"y")
    with pytest.raises(FileExistsError):
        files.output_path(str(source))
    assert (tmp_path / "a.cleaned.txt").read_bytes() == b"y" and len(os.listdir(tmp_path)) == 3


def test_fetching_is_gated_and_soft(spark):
    def transport(url, timeout, cap):
        if "slow" in url:
            raise TimeoutError("slow")
        if "bad" in url:
            raise OSError("down")
        return {"gz": (gzip.compress(b"hello"), "gzip"), "raw": (zlib.compress(b"hello")[2:-4], "deflate"), "long": (b"x" * (cap + 1), "")}[url.rpartition("/")[2]]

    urls = spark.createDataFrame([("s", f"https://x/{n}") for n in ("gz", "raw", "long", "slow", "bad")] + [("s", "ftp://x/y")], "site string, url string")
    with pytest.raises(PermissionError):
        http.fetch(urls)
    got = {r.url.rpartition("/")[2]: (r.outcome, bytes(r.body) if r.body else None) for r in http.fetch(urls, authorized=True, transport=transport, cap=5, delay=0).collect()}
    assert got == {"gz": ("ok", b"hello"), "raw": ("ok", b"hello"), "long": ("ok", b"xxxxx"), "slow": ("timeout", None), "bad": ("error", None), "y": ("error", None)}


def test_bases(spark):
    df = spark.createDataFrame([("Example.com/x",), ("http://a.b:8/c",), ("ftp://x",)], "u string")
    assert [r[0] for r in df.select(site.normalize_base(F.col("u"))).collect()] == ["https://Example.com", "http://a.b:8", None]


def test_detectors_fail_soft(spark):
    def send(value):
        if value == "boom":
            raise RuntimeError("no")
        return True, value == "yes", 0.5, None, None

    df = spark.createDataFrame([(1, "yes"), (2, "boom")], "target long, text string")
    got = {r.target: (r.available, r.is_watermarked, r.error) for r in verdict.run_detectors(df, {"markllm-kgw": send}).collect()}
    assert got == {1: (True, True, None), 2: (False, None, "no")}


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("x\u200by\nz\u202e")
    texts = audit.stream_texts(audit.stream_files(spark, str(source)))
    audit.audit_stream(texts, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert {r.severity for r in found.collect()} == {"medium", "high"}
    q = audit.severity_by_window(audit.stream_texts(audit.stream_files(spark, str(source)))).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.severity, r.n) for r in spark.table("w").collect()} == {("medium", 1), ("high", 1)}
    assert text.occurrences(spark.createDataFrame([("t", "")], "target string, text string")).count() == 0

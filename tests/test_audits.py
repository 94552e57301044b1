"""Whole audits in one call, and the runners of outside tools, all with injected transports."""

import json

import pytest

from veritrace.operators import audits, c2pa, report, site, verdict
from veritrace.plans import samples
from veritrace.sources import http

SITEMAP = "<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>" + "".join(f"<url><loc>http://h.example{p}</loc></url>" for p in ("/index.html", "/page2.html", "/page3.html", "/private/secret.html")) + "<url><loc>http://other.example/x</loc></url></urlset>"
WEB = {
    "/robots.txt": b"User-agent: *\nDisallow: /private/\n",
    "/sitemap.xml": SITEMAP.encode(),
    "/index.html": "<html><h1>a​b</h1><p data-ai-generated='yes'>q</p><img src='ai.png'><img src='/img/../plain.png'><img src='http://cdn.example/z.png'></html>".encode(),
    "/page2.html": b"<html>plain</html>",
    "/page3.html": b'<html><meta name="generator" content="WordPress 6.5"></html>',
    "/private/secret.html": "<html>​</html>".encode(),
    "/ai.png": samples.png((b"tEXt", b"parameters\0Steps: 20")),
    "/plain.png": samples.png(),
}


def fetcher(asked, web=WEB):
    """A transport over a dictionary that keeps what was asked for in a file."""

    def transport(url, timeout, cap):
        with open(asked, "a") as f:
            f.write(url + "\n")
        body = web.get("/" + url.split("/", 3)[3])
        if body is None:
            raise OSError("404")
        if body == b"slow":
            raise TimeoutError("slow")
        return body, ""

    return lambda urls: http.fetch(urls, authorized=True, transport=transport, delay=0)


def test_site(spark, tmp_path):
    with pytest.raises(PermissionError):
        audits.audit_site(spark, "http://h.example")
    asked = tmp_path / "asked"
    got = audits.audit_site(spark, "http://h.example/", authorized=True, fetch=fetcher(str(asked)), include_assets=True)
    c = got.coverage.first()
    assert (c.discovered, c.audited, c.capped, c.timeouts, c.skipped) == (4, 3, 0, 0, 1)
    assert "secret" not in asked.read_text()
    found = {(r.location.rpartition("/")[2], r.category, r.severity, r.note.split(".")[0].split(", ")[0]) for r in got.whole.findings.collect()}
    assert ("index.html", "invisible-unicode", "medium", "at source: line 1") in found
    assert ("index.html", "invisible-unicode", "medium", "at visible text: line 1") in found
    assert ("index.html", "ai-metadata", "medium", "at attribute data-ai-generated") in found
    assert {x[:3] for x in found if x[0] == "page3.html"} == {("page3.html", "generator-meta", "informational")}
    assert {x[:3] for x in found if x[0] == "ai.png"} == {("ai.png", "generator-meta", "medium")}
    assert not any(x[0] in ("page2.html", "secret.html", "plain.png") for x in found)
    notes = [r.note for r in got.whole.notes.orderBy("ord").collect()]
    assert notes[0].startswith("1 sitemap entries of other hosts") and any(n.startswith("Statistical") for n in notes)
    assert {r.target for r in got.assets.targets.collect()} == {"http://h.example/ai.png", "http://h.example/plain.png"}
    full = got.whole.reports().first().report
    assert full.target == "http://h.example/" and full.summary.total == len(got.whole.findings.collect())


def test_the_cap_stops_fetching(spark, tmp_path):
    asked = tmp_path / "asked"
    web = {**WEB, "/index.html": b"slow"}
    got = audits.audit_site(spark, "http://h.example", authorized=True, fetch=fetcher(str(asked), web), max_pages=1)
    c = got.coverage.first()
    assert (c.discovered, c.audited, c.capped, c.timeouts, c.skipped) == (4, 1, 1, 1, 1)
    assert [u.rpartition("/")[2] for u in asked.read_text().split() if u.endswith("html")] == ["index.html", "page2.html"]
    assert {r.status for r in got.statuses.collect()} == {"audited", "capped", "timeout", "skipped"}


def test_a_site_without_a_sitemap_and_one_named_by_robots(spark, tmp_path):
    web = {"/": "<html>x​y<img src='a.png'></html>".encode()}
    got = audits.audit_site(spark, "http://h.example", authorized=True, fetch=fetcher(str(tmp_path / "a"), {**web, "": web["/"]}))
    # The base has no path: its page is asked for as it stands.
    assert got.coverage.first().discovered == 1
    assert any("No sitemap" in r.note for r in got.whole.notes.collect())
    index = b"<sitemapindex><sitemap><loc>http://h.example/deep.xml</loc></sitemap><sitemap><loc>http://o.example/m.xml</loc></sitemap></sitemapindex>"
    web = {"/robots.txt": b"Sitemap: http://h.example/own.xml\n", "/own.xml": index, "/deep.xml": SITEMAP.encode(), "/page2.html": b"x"}
    got = audits.audit_site(spark, "http://h.example", authorized=True, fetch=fetcher(str(tmp_path / "b"), web))
    assert got.coverage.first().discovered == 4 and got.coverage.first().audited == 1


def test_links(spark):
    df = spark.createDataFrame([(1, "https://h.example", "<img src='a.png'><a href='x/../b.pdf'>"), (2, "https://h.example/d/e.html?q#f", "<img src='../c.gif'><img src='./g.jpg'><img src='//h.example/i.svg'><img src='mailto:x.png'><img src='k l.png'>")], "target int, url string, html string")
    got = {(r.target, r.asset) for r in site.asset_urls(df).collect()}
    assert {(1, "https://h.example/a.png"), (1, "https://h.example/b.pdf"), (2, "https://h.example/c.gif"), (2, "https://h.example/d/g.jpg"), (2, "https://h.example/i.svg")} <= got


def test_directory_and_file(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("x‮y")
    (tmp_path / "in" / "sub" / "b.png").write_bytes(samples.png((b"caBX", b"data")))
    (tmp_path / "in" / "big.bin").write_bytes(b"\0" * 5000)
    got = audits.audit_directory(spark, str(tmp_path / "in"), most=4000)
    assert [r.target for r in got.skipped.collect()] == ["big.bin"]
    assert [(r.target, r.findings, r.has_high) for r in got.ranking().collect()] == [("a.txt", 1, True), ("sub/b.png", 1, False), ("big.bin", 0, False)]
    assert {(r.target, r.location) for r in got.whole.findings.collect()} == {(str(tmp_path / "in"), "a.txt"), (str(tmp_path / "in"), "sub/b.png")}
    r = got.reports().first()
    assert [(f.target, f.report is None) for f in r.files] == [("a.txt", False), ("big.bin", True), ("sub/b.png", False)]
    assert r.by_confidence.confirmed == 2 and r.skipped == ["big.bin"]
    one = audits.audit_file(spark, str(tmp_path / "in" / "big.bin"), most=100)
    assert {n.note for n in one.notes.collect()} == {"Only the first 100 bytes were read.", "Unknown binary format: no metadata was read."}


def test_content_credential_tool(spark):
    assets = spark.createDataFrame([("none", bytearray(samples.png((b"caBX", b"a")))), ("read", bytearray(samples.png((b"caBX", b"b")))), ("late", bytearray(samples.png((b"caBX", b"c")))), ("plain", bytearray(samples.png()))], "target string, content binary")

    def run(content):
        if b"caBXa" in content:
            return 1, "", "No claim found"
        if b"caBXc" in content:
            raise TimeoutError("30 s")
        assert b"caBXb" in content, "files without manifests are never given to the tool"
        return 0, json.dumps({"active_manifest": "m", "manifests": {"m": {"claim_generator": "Acme", "assertions": [], "signature_info": {"issuer": "I"}}}}), ""

    got = audits.audit_files(assets, c2pa_run=run)
    assert {(r.target, "Acme" in r.note) for r in got.findings.collect()} == {("read", True), ("late", False)}
    assert {r.target for r in got.notes.collect()} == {"none", "late"}
    # Without the tool on a machine there is no row of it, and a note.
    assert c2pa.probe(assets, lambda content: (_ for _ in ()).throw(FileNotFoundError("x"))).count() == 0
    assert {r.target for r in audits.audit_files(assets).notes.collect()} == {"none", "read", "late"}


def test_texts_that_look_binary(spark):
    df = spark.createDataFrame([("a", "x​", False, "binary"), ("b", "y", True, "text")], "target string, text string, truncated boolean, kind string")
    got = audits.audit_texts(df)
    assert [r.target for r in got.findings.collect()] == ["a"]
    notes = [(r.target, r.note.split()[0], r.ord) for r in got.notes.orderBy("target", "ord").collect()]
    assert notes == [("a", "The", 0), ("a", "Statistical", 1), ("b", "Only", 0), ("b", "Statistical", 1)]


def test_vendor_over_http(spark):
    df = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "target long, text string")
    with pytest.raises(PermissionError):
        verdict.http_replies(df, "m-1", lambda: "k")
    with pytest.raises(ValueError):
        verdict.http_replies(df, "../m", lambda: "k", authorized=True)

    def post(url, body, headers, timeout):
        assert "k" not in url.split("?")[1:] and headers == {"x-goog-api-key": "k"}
        value = json.loads(body)["contents"][0]["parts"][0]["text"]
        if value == "three":
            raise OSError("down")
        return json.dumps({"watermarkDetected": value == "one", "score": 0.25})

    got = verdict.http_verdicts(verdict.http_replies(df, "m-1", lambda: "k", authorized=True, post=post))
    assert {r.target: (r.available, r.is_watermarked, r.score, r.error) for r in got.collect()} == {1: (True, True, 0.25, None), 2: (True, False, 0.25, None), 3: (False, None, None, "down")}
    got = verdict.http_verdicts(verdict.http_replies(df, "m-1", lambda: None, authorized=True, post=post))
    assert {r.error for r in got.collect()} == {"no key is configured"}


def test_local_adapter(spark):
    df = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "target long, text string")

    def run(command, text, timeout):
        if text == "three":
            raise TimeoutError("timeout")
        return (0, 'log\n{"is_watermarked": true, "score": 4.3, "threshold": 3.0}', "") if text == "one" else (1, "", "boom")

    got = {r.target: (r.available, r.is_watermarked, r.score, r.threshold, r.error) for r in verdict.adapter_verdicts(df, "markllm-kgw", ["x"], run=run).collect()}
    assert got[1] == (True, True, 4.3, 3.0, None) and got[3] == (False, None, None, None, "timeout") and not got[2][0]
    status = verdict.check_input(spark.createDataFrame([(1, 10, "text"), (2, 2_000_000, "text"), (3, 5, "binary")], "target int, length long, kind string"), "length", "kind")
    assert [r.status for r in status.orderBy("target").collect()] == ["ok", "over the cap", "binary input"]


def test_self_check(spark):
    made = report.self_check(spark, "label")
    r = made.first().report
    assert (r.target, r.summary.total, len(r.notes)) == ("label", 0, 1)
    assert report.human_reports(made).first().text.endswith("0 findings (0 high, 0 medium, 0 low, 0 informational)")

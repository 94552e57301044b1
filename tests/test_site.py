from html import unescape

import duckdb
import pytest
from compare import oracle_rows, rows_of
from pyspark.sql import functions as F

from veritrace.operators import markup, site
from veritrace.plans import registry


def test_entities_of_visible_text(spark):
    pages = ["a&#8203;b", "a&#x200B;b", "a&#x202E;b", "a&ZeroWidthSpace;b", "a&#xE0041;b", "p&#1072;ypal", "a &amp;#8203; b", "x &copy b &eacute; &lt;", "&amp; &shy; & c", "&#x80;&#xD800;", None]
    df = spark.createDataFrame(list(enumerate(pages)), "target int, html string")
    got = {r.target: r.v for r in df.select("target", markup.visible_text(F.col("html")).alias("v")).collect()}
    assert got == {k: p if p is None else unescape(p) for k, p in enumerate(pages)}
    found = site.page_findings(df).filter("layer = 'visible'")
    seen = {r.target for r in found.collect()}
    assert {0, 1, 2, 3, 4, 5} <= seen and 6 not in seen


@pytest.fixture(scope="module")
def twice(tmp_path_factory):
    """Tables whose pages hold some URLs twice and three times, also in both halves of a host."""
    from compare import TABLES

    folder, given = tmp_path_factory.mktemp("twice"), "/root/testdata/sf0.001"
    for t in TABLES:
        if t != "pages":
            (folder / f"{t}.parquet").symlink_to(f"{given}/{t}.parquet")
    pages = f"read_parquet('{given}/pages.parquet')"
    more = f"SELECT page_id + 1001 AS page_id, url, html FROM {pages} WHERE page_id % 5 = 0 UNION ALL SELECT page_id + 2002, url, html FROM {pages} WHERE page_id % 10 = 0"
    barred = "SELECT 5001 + range AS page_id, 'https://barred.example/a/' || range % 3 AS url, '' AS html FROM range(8)"
    halves = "SELECT * FROM (VALUES (6000, 'https://twin.example/p', ''), (6002, 'https://twin.example/q', ''), (6003, 'https://twin.example/q', ''), (6005, 'https://twin.example/r', ''))"
    duckdb.sql(f"COPY (SELECT page_id, url, html FROM {pages} UNION ALL {more} UNION ALL {barred} UNION ALL {halves}) TO '{folder}/pages.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["crawl_status", "crawl_coverage", "sitemap_expand"])
def test_pages_that_share_a_url(spark, twice, name):
    assert rows_of(registry.QUERIES[name](spark, twice)) == oracle_rows(registry.ORACLE_SQL[name], twice)


def test_fetched_twice(spark):
    urls = spark.createDataFrame([("s", "http://s/x", 1), ("s", "http://s/x", 2), ("s", "http://s/y", 3)], "site string, url string, ord long")
    rules = spark.createDataFrame([("s", "/y"), ("s", "/")], "site string, rule string").filter("rule = '/y'")
    fetched = spark.createDataFrame([("http://s/x", "timeout"), ("http://s/x", "ok"), ("http://s/x", "error")], "url string, outcome string")
    got = site.crawl(urls, rules, fetched)
    assert sorted((r.ord, r.status) for r in got.collect()) == [(1, "audited"), (2, "audited"), (3, "skipped")]

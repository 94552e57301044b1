"""Views of the test tables with signals put in, written alike in Spark and DuckDB.

The tables hold no invisible characters or generator tags of their own; every sixteenth document
(eighth page) gets one kind of signal by its id, so queries over whole tables have something to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Parts of a seeded text: ints are code points, strings stand for themselves, slices for parts of the text.
WHOLE = slice(None)
DOCUMENT_SEEDS: dict[int, list] = {
    0: [slice(0, 5), 0x200B, slice(5, None)],
    1: [WHOLE, "a", 0x200D, "b"],
    2: [WHOLE, 0x1F468, 0x200D, 0x1F469],
    3: [WHOLE, 0x0645, 0x200C, 0x062A],
    4: [0xFEFF, WHOLE],
    5: [WHOLE, 0x0A, 0xFEFF],
    6: [slice(0, 2), 0xAD, slice(2, 6), 0xAD, slice(6, None)],
    7: [WHOLE, 0x2060, 0x180E],
    8: [0x202E, WHOLE, 0x202C],
    9: [WHOLE, 0xE0041],
    10: [WHOLE, 0xE000, 0xF0000],
    11: [WHOLE, 0xA0, 0x2009, 0x3000],
    12: [WHOLE, " p", 0x0430, "ypal x", 0x03B1, "y"],
    13: ["---\ngenerator: x\ntitle: y\nnote: made with ChatGPT\n---\n", WHOLE],
    14: [WHOLE, *([0x0A, 0x200B] * 25)],
    15: [WHOLE, 0x2764, 0xFE0F],
}
PAGE_SEEDS: dict[int, list] = {
    0: ['<meta name="generator" content="WordPress 6.5">', WHOLE],
    1: ['<META NAME="Generator" CONTENT="made by ChatGPT">', WHOLE],
    2: ["<meta content='Acme 1' name='generator'>", WHOLE],
    3: [WHOLE, '<p data-ai-generated="true" data-ai="x">q</p>'],
    4: [WHOLE, '<script type="application/ld+json">{"creator": "Midjourney v6"}</script>'],
    5: [WHOLE, '<script type="application/ld+json">{"name": "plain"}</script>', '<img src="/img/a.PNG">'],
    6: [WHOLE, '<img src="https://other.example/b.jpg"><a href="/doc/c.pdf">c</a><img src="http://x.example/d.gif">'],
    7: ['<meta name="generator" content="  ">', WHOLE, 0x200B, "&amp;", "<p>x", 0x200B, "</p>"],
}


def _spark_parts(text, parts: list):
    out = []
    for p in parts:
        if isinstance(p, slice):
            a = (p.start or 0) + 1
            out.append(F.substring(text, a, (1 << 30) if p.stop is None else p.stop - a + 1))
        else:
            out.append(F.lit(chr(p) if isinstance(p, int) else p))
    return F.concat(*out)


def _duck_parts(text: str, parts: list) -> str:
    out = []
    for p in parts:
        if isinstance(p, slice):
            a = (p.start or 0) + 1
            out.append(f"substr({text}, {a})" if p.stop is None else f"substr({text}, {a}, {p.stop - a + 1})")
        else:
            out.append(f"chr({p})" if isinstance(p, int) else "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
    return " || ".join(out)


def _seeded(df: DataFrame, key: str, text: str, seeds: dict[int, list]) -> DataFrame:
    value = F.coalesce(F.col(text), F.lit(""))
    case = None
    for k, parts in seeds.items():
        hit = F.pmod(F.col(key), F.lit(len(seeds))) == k
        made = _spark_parts(value, parts)
        case = F.when(hit, made) if case is None else case.when(hit, made)
    return df.withColumn(text, case.otherwise(value))


def _seeded_sql(name: str, key: str, text: str, seeds: dict[int, list], keep: str) -> str:
    value = f"coalesce({text}, '')"
    cases = " ".join(f"WHEN {k} THEN {_duck_parts(value, parts)}" for k, parts in seeds.items())
    return f"SELECT {keep}, CASE {key} % {len(seeds)} {cases} END AS {text} FROM {name}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, text)"""
    return _seeded(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", DOCUMENT_SEEDS).select(F.col("doc_id").alias("target"), "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, url, html)"""
    return _seeded(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id", "html", PAGE_SEEDS).select(F.col("page_id").alias("target"), "url", "html")


DOCUMENTS_SQL = "docs AS (SELECT doc_id AS target, text FROM (" + _seeded_sql("documents", "doc_id", "text", DOCUMENT_SEEDS, "doc_id") + "))"
PAGES_SQL = "pgs AS (SELECT page_id AS target, url, html FROM (" + _seeded_sql("pages", "page_id", "html", PAGE_SEEDS, "page_id, url") + "))"

"""Queries of routing, metadata and markup over seeded pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.expr import explode_findings, markers, metadata_value, with_markers, xmp_findings
from ..operators import c2pa, markup, routing
from . import seeds
from .text_queries import _note, _quote

_MARKERS = "[" + ", ".join(_quote(m) for m in rules.AI_MARKERS) + "]"
_CMS = "[" + ", ".join(_quote(m) for m in rules.CMS_NAMES) + "]"


def _hits(value: str, words: str = _MARKERS) -> str:
    return f"list_filter({words}, lambda m: contains(lower({value}), m))"


def _listed(value: str) -> str:
    return f"'AI markers: ' || array_to_string({_hits(value)}, ', ')"


def ai_marker_hits(spark, sf_dir):
    texts = seeds.documents(spark, sf_dir).select(F.lit("documents").alias("source"), "target", "text").unionByName(seeds.pages(spark, sf_dir).select(F.lit("pages").alias("source"), "target", F.col("html").alias("text")))
    return with_markers(texts, "found", F.col("text")).select("source", "target", F.posexplode("found").alias("nth", "marker"))


VALUES_SQL = "vals AS (SELECT doc_id AS target, CASE doc_id % 4 WHEN 0 THEN 'made with ChatGPT ' || coalesce(text, '') WHEN 1 THEN '   ' WHEN 2 THEN coalesce(text, '') ELSE 'Stable Diffusion llms.txt' END AS v FROM documents)"


def _values(spark, sf_dir):
    k, t = F.pmod("doc_id", F.lit(4)), F.coalesce("text", F.lit(""))
    v = F.when(k == 0, F.concat(F.lit("made with ChatGPT "), t)).when(k == 1, "   ").when(k == 2, t).otherwise("Stable Diffusion llms.txt")
    return seeds.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("target"), v.alias("v"))


def metadata_values(spark, sf_dir):
    f = metadata_value(F.lit("Software"), F.col("v"), F.lit("field"))
    return _values(spark, sf_dir).select("target", f.alias("f")).filter("f is not null").select("target", "f.severity", "f.category", "f.evidence", "f.note")


def xmp_scan(spark, sf_dir):
    v = F.concat(F.lit('<x:xmpmeta xmp:CreatorTool="'), F.col("v"), F.lit('" c2'), F.when(F.pmod("target", F.lit(3)) == 0, "pa:x").otherwise("q"), F.lit("/>"))
    return explode_findings(_values(spark, sf_dir).withColumn("p", v), xmp_findings(F.col("p"), F.lit("packet")), "target").select("target", "severity", "category", "evidence", "context")


_TOOL = "trim(regexp_extract(p, 'xmp:CreatorTool[\"''>\\s]*=?[\"''>]?\\s*([^<\"'']+)', 1), ' ' || chr(9) || chr(10) || chr(13))"
XMP_SQL = f"""
WITH {VALUES_SQL}, pk AS (SELECT target, '<x:xmpmeta xmp:CreatorTool="' || v || '" c2' || CASE WHEN target % 3 = 0 THEN 'pa:x' ELSE 'q' END || '/>' AS p FROM vals),
tl AS (SELECT *, {_TOOL} AS tool FROM pk)
SELECT target, 'medium' AS severity, 'c2pa-manifest' AS category, 'XMP packet names the C2PA namespace' AS evidence, '' AS context FROM pk WHERE contains(p, 'c2pa:')
UNION ALL SELECT target, CASE WHEN len({_hits('tool')}) > 0 THEN 'medium' ELSE 'informational' END, CASE WHEN len({_hits('tool')}) > 0 THEN 'ai-metadata' ELSE 'generator-meta' END, 'xmp:CreatorTool=' || CASE WHEN length(tool) > 160 THEN substr(tool, 1, 157) || '...' ELSE tool END, '' FROM tl WHERE tool <> ''
UNION ALL SELECT target, 'medium', 'ai-metadata', 'XMP packet has AI markers', substr(p, 1, 160) FROM pk WHERE len({_hits('p')}) > 0"""


def _bytes(spark, sf_dir):
    k = F.pmod("page_id", F.lit(9))
    html = F.coalesce("html", F.lit("")).cast("binary")
    lead = {0: b"%PDF-1.7\n", 1: b"GIF89a", 2: b"\x89PNG\r\n\x1a\n", 3: b"---\ntitle: x\n---\n", 4: b'<?xml version="1.0"?><svg/>', 5: b"plain words ", 6: b"zero\x00", 7: b"\x01\x02\x03\x04"}
    made = F.lit(b"")
    for n, raw in lead.items():
        made = F.when(k == n, F.lit(raw)).otherwise(made)
    cut = F.when(k == 5, F.lit(b"no markup here")).when(k == 7, F.lit(b"abcd")).otherwise(html)
    return seeds.table(spark, sf_dir, "pages").select(F.col("page_id").alias("target"), F.concat(made, cut).alias("content"))


def container_routing(spark, sf_dir):
    return _bytes(spark, sf_dir).select("target", routing.container(F.col("content")).alias("container"))


def sniff_text_binary(spark, sf_dir):
    return _bytes(spark, sf_dir).select("target", routing.sniff(F.col("content")).alias("kind"))


def _page(findings, *columns):
    def query(spark, sf_dir):
        return explode_findings(seeds.pages(spark, sf_dir), findings(F.col("html")), "target").select("target", *columns)

    return query


def frontmatter_findings(spark, sf_dir):
    return markup.parse_markdown(seeds.documents(spark, sf_dir)).select("target", "location", "evidence", "note")


_LATIN = "regexp_replace(v, '[^\\x{1}-\\x{FF}]', '?', 'g')"
#: A literal string's text escaped, and what the decoder's steps, one mark after the other, make of it.
_ESCAPED = "replace(replace(replace(v, chr(92), chr(92) || chr(92)), '(', chr(92) || '('), ')', chr(92) || ')')"
_READ = "replace(replace(replace(replace(replace(replace(e, chr(92) || 'n', chr(10)), chr(92) || 'r', chr(13)), chr(92) || 't', chr(9)), chr(92) || '(', '('), chr(92) || ')', ')'), chr(92) || chr(92), chr(92))"


def pdf_escaped(value):
    """A text as the inside of a PDF's literal string."""
    for mark in ("\\", "(", ")"):
        value = F.replace(value, F.lit(mark), F.lit("\\" + mark))
    return value


def _pdfs(spark, sf_dir):
    """(target, latin): a PDF of each value, all of it; characters beyond Latin-1 are question marks."""
    t = F.col("target").cast("string")
    v = pdf_escaped(F.regexp_replace("v", "[^\\x00-\\xff]", "?"))
    p = F.concat(F.lit("%PDF-1.4 /Producer (Acme \\(x\\) "), v, F.lit(") /Title ("), t, F.lit(") obj /Filter /FlateDecode stream\nopenai packed endstream "), F.when(F.pmod("target", F.lit(2)) == 0, "Midjourney").otherwise("none"), F.lit(" %%EOF"), F.when(F.pmod("target", F.lit(3)) == 0, " %%EOF").otherwise(""))
    return _values(spark, sf_dir).select("target", p.alias("latin"))


def pdf_info_fields(spark, sf_dir):
    return _pdfs(spark, sf_dir).select("target", F.explode(markup.pdf_fields(F.col("latin"))).alias("x")).select("target", F.col("x.k").alias("field"), F.col("x.v").alias("value"))


def pdf_marker_scan(spark, sf_dir):
    return _pdfs(spark, sf_dir).select("target", F.array_join(markers(markup.pdf_uncompressed(F.col("latin"))), ", ").alias("markers"))


def pdf_string(text):
    """A text as a PDF's literal string, its UTF-8 bytes as characters."""
    return pdf_escaped(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"))


def whole_pdfs(docs):
    """(target, latin): a PDF of each of (target, text), which names the whole text."""
    t = F.col("target")
    p = F.concat(F.lit("%PDF-1.4 /Producer (Acme \\(x\\) "), pdf_string(F.coalesce("text", F.lit(""))), F.lit(") /Title ("), t.cast("string"), F.lit(") obj /Filter /FlateDecode stream\nopenai packed endstream "), F.when(F.pmod(t, F.lit(2)) == 0, "Midjourney").otherwise("none"), F.lit(" %%EOF"), F.when(F.pmod(t, F.lit(3)) == 0, " %%EOF").otherwise(""))
    return docs.select("target", p.alias("latin"))


def pdf_findings(spark, sf_dir):
    docs = seeds.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("target"), "text")
    return explode_findings(whole_pdfs(docs), markup.pdf_findings(F.col("latin")), "target").select("target", "ord", "severity", "category", "location", "evidence", "note")


def _manifests(spark, sf_dir):
    pages = seeds.table(spark, sf_dir, "pages").select(F.col("page_id").alias("target"))
    return pages.select("target", F.lit("c2pa-manifest").alias("category"), F.lit("chunk").alias("note")).unionByName(pages.select("target", F.lit("ai-metadata").alias("category"), F.lit("field").alias("note")))


def _probes(spark, sf_dir):
    k = F.pmod("page_id", F.lit(6))
    good = '{"active_manifest": "a", "manifests": {"a": {"claim_generator": "Acme/1", "assertions": [{"label": "c2pa.actions"}, {"label": "x"}], "signature_info": {"issuer": "", "common_name": "CN"}}}}'
    probe = F.when(k == 0, good).when(k == 1, "No claim found").when(k == 2, "not json").otherwise("")
    rows = seeds.table(spark, sf_dir, "pages").filter(k < 5)
    return rows.select(F.col("page_id").alias("target"), F.when(k != 4, F.when(k == 3, 1).otherwise(0)).alias("rc"), probe.alias("stdout"), F.lit("").alias("stderr"), F.when(k == 4, "timeout").alias("failed"))


def c2pa_enrichment(spark, sf_dir):
    found, notes = c2pa.enrich(_manifests(spark, sf_dir), _probes(spark, sf_dir))
    return found.select("target", "category", "note").unionByName(notes.select("target", F.lit("note").alias("category"), "note"))


QUERIES = {
    "ai_marker_hits": ai_marker_hits,
    "metadata_values": metadata_values,
    "xmp_scan": xmp_scan,
    "container_routing": container_routing,
    "sniff_text_binary": sniff_text_binary,
    "html_generator": _page(lambda h: F.array_compact(F.transform(markup.generators(h), markup._generator_finding)), "severity", "category", "evidence", "note"),
    "html_data_ai": _page(lambda h: F.filter(markup.html_findings(h), lambda f: F.startswith(f["location"], F.lit("attribute"))), "location", "evidence"),
    "html_jsonld": _page(markup.jsonld_findings, "severity", "context", "note"),
    "frontmatter_findings": frontmatter_findings,
    "pdf_info_fields": pdf_info_fields,
    "pdf_marker_scan": pdf_marker_scan,
    "pdf_findings": pdf_findings,
    "c2pa_enrichment": c2pa_enrichment,
}

_GEN = "gens AS (SELECT target, coalesce(nullif(regexp_extract(tag, '(?i)content\\s*=\\s*\"([^\"]*)\"', 1), ''), regexp_extract(tag, '(?i)content\\s*=\\s*''([^'']*)''', 1)) AS c FROM (SELECT target, unnest(regexp_extract_all(html, '(?i)<meta\\b[^>]*>')) AS tag FROM pgs) WHERE regexp_matches(tag, '(?i)name\\s*=\\s*[\"'']generator[\"'']'))"
_PDF_ROWS = f"pdfs AS (SELECT target, v, {_READ} AS r FROM (SELECT target, v, {_ESCAPED} AS e FROM (SELECT target, {_LATIN} AS v FROM vals)))"
_PDF_FIELDS = "SELECT target, 0 AS k, '/Producer' AS field, trim('Acme (x) ' || r, ' ' || chr(9) || chr(10) || chr(13)) AS value FROM pdfs UNION ALL SELECT target, 1, '/Title', CAST(target AS VARCHAR) FROM pdfs"
_PDF_MARKS = "list_filter(" + _MARKERS + ", lambda m: contains(lower(v || CASE WHEN target % 2 = 0 THEN ' midjourney' ELSE '' END), m))"
ORACLE_SQL = {
    "ai_marker_hits": f"""WITH {seeds.DOCUMENTS_SQL}, {seeds.PAGES_SQL}, alls AS (SELECT 'documents' AS source, target, text FROM docs UNION ALL SELECT 'pages', target, html FROM pgs),
h AS (SELECT source, target, {_hits('text')} AS hs FROM alls)
SELECT source, target, CAST(unnest(generate_series(0, len(hs) - 1)) AS INTEGER) AS nth, unnest(hs) AS marker FROM h WHERE len(hs) > 0""",
    "metadata_values": f"""WITH {VALUES_SQL} SELECT target, CASE WHEN len({_hits('v')}) > 0 THEN 'medium' ELSE 'informational' END AS severity,
CASE WHEN len({_hits('v')}) > 0 THEN 'ai-metadata' ELSE 'generator-meta' END AS category,
'Software=' || CASE WHEN length(v) > 160 THEN substr(v, 1, 157) || '...' ELSE v END AS evidence,
CASE WHEN len({_hits('v')}) > 0 THEN {_listed('v')} ELSE {_note('plain')} END AS note FROM vals WHERE trim(v) <> ''""",
    "xmp_scan": XMP_SQL,
    "container_routing": """SELECT page_id AS target, CASE page_id % 9 WHEN 0 THEN 'pdf' WHEN 1 THEN 'gif' WHEN 2 THEN 'png' WHEN 3 THEN 'markdown' WHEN 4 THEN 'svg' WHEN 5 THEN 'text' WHEN 6 THEN 'unknown-binary' WHEN 7 THEN 'unknown-binary'
ELSE CASE WHEN regexp_matches(coalesce(html, ''), '(?i)^\\s*(<!doctype html|<html)') OR contains(lower(substr(coalesce(html, ''), 1, 1024)), '<meta') THEN 'html' ELSE 'text' END END AS container FROM pages""",
    "sniff_text_binary": "SELECT page_id AS target, CASE WHEN page_id % 9 IN (0, 1, 2, 6, 7) THEN 'binary' ELSE 'text' END AS kind FROM pages",
    "html_generator": f"""WITH {seeds.PAGES_SQL}, {_GEN} SELECT target, CASE WHEN len({_hits('c')}) > 0 THEN 'medium' ELSE 'informational' END AS severity,
CASE WHEN len({_hits('c')}) > 0 THEN 'ai-metadata' ELSE 'generator-meta' END AS category, 'generator=' || c AS evidence,
CASE WHEN len({_hits('c')}) > 0 THEN {_listed('c')} WHEN len({_hits('c', _CMS)}) > 0 THEN {_note('cms')} ELSE {_note('plain')} END AS note FROM gens WHERE trim(c) <> ''""",
    "html_data_ai": "WITH " + seeds.PAGES_SQL + " SELECT target, 'attribute ' || a AS location, a || '=' || v AS evidence FROM (SELECT target, unnest(regexp_extract_all(html, '(?i)\\s(data-ai[\\w-]*)\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)) AS a, unnest(regexp_extract_all(html, '(?i)\\s(data-ai[\\w-]*)\\s*=\\s*[\"'']([^\"'']*)[\"'']', 2)) AS v FROM pgs)",
    "html_jsonld": f"WITH {seeds.PAGES_SQL}, b AS (SELECT target, unnest(regexp_extract_all(html, '(?is)<script[^>]*type=[\"'']application/ld\\+json[\"''][^>]*>(.*?)</script>', 1)) AS b FROM pgs) SELECT target, 'medium' AS severity, substr(trim(b), 1, 160) AS context, {_listed('b')} AS note FROM b WHERE len({_hits('b')}) > 0",
    "frontmatter_findings": f"""WITH {seeds.DOCUMENTS_SQL} SELECT target, 'frontmatter line 2' AS location, 'generator: x' AS evidence, {_note('key')} AS note FROM docs WHERE target % 16 = 13
UNION ALL SELECT target, 'frontmatter line 4', 'note: made with ChatGPT', 'AI markers: chatgpt' FROM docs WHERE target % 16 = 13""",
    "pdf_info_fields": f"WITH {VALUES_SQL}, {_PDF_ROWS} SELECT target, field, value FROM ({_PDF_FIELDS})",
    "pdf_marker_scan": f"WITH {VALUES_SQL}, {_PDF_ROWS} SELECT target, array_to_string({_PDF_MARKS}, ', ') AS markers FROM pdfs",
    "c2pa_enrichment": f"""SELECT page_id AS target, 'ai-metadata' AS category, 'field' AS note FROM pages
UNION ALL SELECT page_id, 'c2pa-manifest', CASE WHEN page_id % 6 = 0 THEN 'chunk. C2PA tool: claim_generator=Acme/1; assertions: c2pa.actions, x; signed by: CN' ELSE 'chunk' END FROM pages WHERE page_id % 6 NOT IN (1, 3)
UNION ALL SELECT page_id, 'note', CASE page_id % 6 WHEN 1 THEN {_note('c2pa none')} WHEN 2 THEN {_note('c2pa unreadable')} WHEN 3 THEN {_note('c2pa none')} WHEN 4 THEN {_note('c2pa tool failed')} ELSE {_note('c2pa tool absent')} END FROM pages WHERE page_id % 6 <> 0""",
}

"""Queries of removal, reports and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import removal, report, text, verdict
from . import seeds
from .text_queries import FINDINGS_SQL, HITS_SQL, _in, _quote

# --- removal ---


def clean_text(spark, sf_dir):
    docs = seeds.documents(spark, sf_dir)
    return removal.clean_texts(docs, confirm=True).select("target", F.md5("cleaned").alias("md5"), "changed")


#: Each character of a seeded text is kept, dropped or made a space by the hits it gives.
_CLEAN = f"""{HITS_SQL}, cl AS (SELECT c.target, string_agg(CASE WHEN h.i IS NULL OR h.sev = 'informational' THEN c.c WHEN {_in('h.cp', rules.SPACES)} THEN ' ' ELSE '' END, '' ORDER BY c.i) AS cleaned
FROM chars c LEFT JOIN hits h ON h.target = c.target AND h.i = c.i GROUP BY c.target),
cleaned AS (SELECT d.target, d.text, coalesce(cl.cleaned, '') AS cleaned FROM docs d LEFT JOIN cl USING (target))"""


def removed_counts(spark, sf_dir):
    return removal.removed_counts(seeds.documents(spark, sf_dir))


def clean_verify(spark, sf_dir):
    docs = seeds.documents(spark, sf_dir)
    return removal.verified(removal.clean_texts(docs, confirm=True))


def removal_summary(spark, sf_dir):
    docs = seeds.documents(spark, sf_dir)
    after = removal.clean_texts(docs, confirm=True).select("target", F.col("cleaned").alias("text"))
    removed, remaining = removal.removal_summary(text.scan_text(docs), text.scan_text(after))
    return removed.withColumn("what", F.lit("removed")).unionByName(remaining.withColumn("what", F.lit("remaining")))


def strip_html(spark, sf_dir):
    return seeds.pages(spark, sf_dir).select("target", F.md5(removal.strip_html(F.col("html"))).alias("md5"))


def strip_svg(spark, sf_dir):
    svg = F.concat(F.lit("<svg inkscape:generator='x' a=\"b\"><Metadata>"), F.col("html"), F.lit("</metadata ><g generator = \"y\"/></svg>"))
    return seeds.pages(spark, sf_dir).select("target", removal.strip_svg(svg).alias("svg"))


def strip_markdown(spark, sf_dir):
    return seeds.documents(spark, sf_dir).select("target", F.md5(removal.strip_markdown(F.col("text"))).alias("md5"))


def removal_status(spark, sf_dir):
    pages = seeds.table(spark, sf_dir, "pages")
    kinds = F.array(*(F.lit(c) for c in rules.CONTAINERS))
    own = pages.select(F.col("page_id").alias("target"), F.element_at(kinds, (F.pmod("page_id", F.lit(len(rules.CONTAINERS))) + 1).cast("int")).alias("container"), (F.col("page_id") * 10_000_000).alias("length"))
    return removal.removal_status(own).select("target", "container", "status", "mode")


# --- reports ---


def report_summary(spark, sf_dir):
    return report.severity_counts(text.scan_text(seeds.documents(spark, sf_dir)), "target")


def confidence_counts(spark, sf_dir):
    return report.confidence_counts(text.scan_text(seeds.documents(spark, sf_dir)), "target")


def severity_rollup(spark, sf_dir):
    return report.severity_rollup(text.scan_text(seeds.documents(spark, sf_dir)))


def grouped_findings(spark, sf_dir):
    return report.grouped(text.scan_text(seeds.documents(spark, sf_dir))).select("target", "nth", "severity", "evidence")


def invalid_findings(spark, sf_dir):
    return report.invalid(text.scan_text(seeds.documents(spark, sf_dir))).groupBy().agg(F.count("*").alias("invalid"))


def distinct_notes(spark, sf_dir):
    docs = seeds.table(spark, sf_dir, "documents")
    notes = docs.select(F.col("source").alias("target"), F.concat(F.lit("lang "), F.col("lang")).alias("note"), F.col("doc_id").alias("ord"))
    return report.distinct_notes(notes)


def _reports(spark, sf_dir):
    docs = seeds.documents(spark, sf_dir)
    notes = text.text_notes(docs).withColumn("ord", F.lit(0).cast("long"))
    return report.reports(docs.select("target"), text.scan_text(docs), notes)


def json_reports(spark, sf_dir):
    """Each report's JSON, read back: its summary and first finding."""
    j = report.json_reports(_reports(spark, sf_dir))
    return j.select("target", F.get_json_object("json", "$.summary.total").cast("long").alias("total"), F.get_json_object("json", "$.summary.high").cast("long").alias("high"), F.coalesce(F.get_json_object("json", "$.findings[0].evidence"), F.lit("")).alias("first"), F.get_json_object("json", "$.notes[0]").alias("note"))


def human_reports(spark, sf_dir):
    h = report.human_reports(_reports(spark, sf_dir))
    return h.select("target", F.element_at(F.split("text", "\n"), -1).alias("last"))


# --- verdicts: conversations as detectors' replies ---

REPLIES = (
    "The text is not AI-generated.", "It shows no unusual formatting. It is watermarked.", "I cannot tell whether it is watermarked.",
    "Unlikely AI text", "This is likely AI", "Nothing to say", "Watermarked!", "It isn't, as far as I see; AI generated though",
)


def _replies(spark, sf_dir):
    rows = seeds.table(spark, sf_dir, "conversations")
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(REPLIES)))
    said = F.element_at(F.array(*(F.lit(r) for r in REPLIES)), (k + 1).cast("int"))
    return rows.select("conv_id", "turn", k.alias("k"), F.concat(F.coalesce("text", F.lit("")), F.lit(". "), said).alias("reply"))


def verdict_text(spark, sf_dir):
    return _replies(spark, sf_dir).select("conv_id", "turn", verdict.reply_meaning(F.col("reply")).alias("meaning"))


JSONS = (
    '{"watermarkDetected": true, "score": 0.5}', '{"watermarkDetected": false}', '{"candidates": [{"content": {"parts": [{"text": "It is watermarked."}]}, "watermarkScore": 0.75}]}',
    '{"candidates": [{"content": {"parts": [{"text": " "}]}, "attributionMetadata": {"syntheticText": {"confidence": 0.51}}}]}', '{"promptFeedback": {"blockReason": "SAFETY"}}',
    '{"candidates": []}', "[1]", "nonsense", '{"candidates": [{"content": {"parts": [{"text": "It cannot be judged if AI-generated"}]}}]}', '{"candidates": [{"x": 1}], "score": "0.3"}',
    '{"candidates": [{"content": {"parts": [{"text": "It is not watermarked"}]}}], "synthetic_text_score": 2}',
)
#: available, is_watermarked, score and error for each of JSONS, as a detector's user would read them.
_MEANT = (
    "(true, true, 0.5, NULL)", "(true, false, NULL, NULL)", "(true, true, 0.75, NULL)", "(true, NULL, 0.51, NULL)", "(false, NULL, NULL, 'blocked: SAFETY')", "(false, NULL, NULL, 'no candidates')",
    "(false, NULL, NULL, 'not a JSON object')", "(false, NULL, NULL, 'not a JSON object')", "(false, NULL, NULL, 'uncertain verdict')", "(false, NULL, NULL, 'unrecognized reply')", "(true, false, 2.0, NULL)",
)


def _pick(spark, sf_dir, values):
    rows = seeds.table(spark, sf_dir, "conversations")
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(values)))
    return rows.select("conv_id", "turn", F.element_at(F.array(*(F.lit(r) for r in values)), (k + 1).cast("int")).alias("json"))


def verdict_scores(spark, sf_dir):
    return _pick(spark, sf_dir, JSONS).select("conv_id", "turn", verdict.parse_reply(F.col("json")).alias("v")).select("conv_id", "turn", "v.*")


ADAPTER = ('log\n{"is_watermarked": true, "score": 4.3, "threshold": 3.0}\n', "boom", '[1, 2]', '{"is_watermarked": true, "score": 4.3}', '{"error": "bad config"}')
_ADAPTED = ("(true, true, 4.3, 3.0, NULL)", "(false, NULL, NULL, NULL, 'output is not JSON')", "(false, NULL, NULL, NULL, 'output is not an object')", "(false, NULL, NULL, NULL, 'a value is missing or malformed')", "(false, NULL, NULL, NULL, 'bad config')")


def adapter_outputs(spark, sf_dir):
    v = verdict.parse_adapter(F.lit(0), F.col("json"), F.lit(""))
    return _pick(spark, sf_dir, ADAPTER).select("conv_id", "turn", v.alias("v")).select("conv_id", "turn", "v.*")


def verdict_lines(spark, sf_dir):
    v = verdict.parse_reply(F.col("json"))
    rows = _pick(spark, sf_dir, JSONS).select("conv_id", "turn", v.alias("v")).select("conv_id", "turn", F.struct(F.lit("gemini-synthid-text").alias("detector"), "v.available", "v.is_watermarked", "v.score", F.lit(None).cast("double").alias("threshold"), "v.error").alias("v"))
    return rows.select("conv_id", "turn", report.verdict_line(F.col("v")).alias("line"))


def _picked(meant: tuple, columns: str) -> str:
    rows = ", ".join(f"({k}, {m[1:-1]})" for k, m in enumerate(meant))
    return f"SELECT conv_id, turn, {columns} FROM conversations JOIN (VALUES {rows}) t(k, {columns}) ON (conv_id + turn) % {len(meant)} = k"


_NAMES = (clean_text, removed_counts, clean_verify, removal_summary, strip_html, strip_svg, strip_markdown, removal_status, report_summary, confidence_counts, severity_rollup, grouped_findings, invalid_findings, distinct_notes, json_reports, human_reports, verdict_text, verdict_scores, adapter_outputs, verdict_lines)
QUERIES = {f.__name__: f for f in _NAMES}
_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in rules.SEVERITIES)
_RANK = "CASE severity " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(rules.SEVERITIES)) + " END"
_ORDER = "CASE WHEN evidence LIKE 'mixed-script%' THEN 1 ELSE 0 END, i"
_HUMAN = " || ', ' || ".join(f"count(*) FILTER (severity = '{s}') || ' {s}'" for s in rules.SEVERITIES)
ORACLE_SQL = {
    "clean_text": f"WITH {_CLEAN} SELECT target, md5(cleaned) AS md5, cleaned <> text AS changed FROM cleaned",
    "removed_counts": f"WITH {HITS_SQL} SELECT target, CAST(cp AS BIGINT) AS cp, count(*) AS n FROM hits WHERE sev <> 'informational' GROUP BY target, cp",
    "clean_verify": f"WITH {seeds.DOCUMENTS_SQL} SELECT target, true AS verified FROM docs",
    "removal_summary": f"WITH {FINDINGS_SQL} SELECT DISTINCT target, category, evidence, CASE WHEN severity = 'informational' OR evidence LIKE 'mixed-script%' THEN 'remaining' ELSE 'removed' END AS what FROM findings",
    "strip_html": f"WITH {seeds.PAGES_SQL} SELECT target, md5(regexp_replace(regexp_replace(html, '(?i)<meta\\b[^>]*name\\s*=\\s*[\"'']generator[\"''][^>]*>', '', 'g'), '(?i)\\s+data-ai[\\w-]*\\s*=\\s*(\"[^\"]*\"|''[^'']*'')', '', 'g')) AS md5 FROM pgs",
    "strip_svg": "SELECT page_id AS target, '<svg a=\"b\"><g/></svg>' AS svg FROM pages",
    "strip_markdown": f"WITH {seeds.DOCUMENTS_SQL} SELECT target, md5(CASE WHEN target % 16 = 13 THEN replace(text, 'generator: x' || chr(10), '') ELSE text END) AS md5 FROM docs",
    "removal_status": f"""SELECT target, container, CASE WHEN length > {rules.MAX_BYTES} THEN 'over the cap' WHEN container IN ('epub', 'unknown-binary') THEN 'cannot clean ' || container ELSE 'ok' END AS status,
CASE WHEN container IN ('tiff', 'pdf') THEN 'best-effort' ELSE 'verifiable' END AS mode FROM (SELECT page_id AS target, [{', '.join(map(_quote, rules.CONTAINERS))}][page_id % {len(rules.CONTAINERS)} + 1] AS container, page_id * 10000000 AS length FROM pages)""",
    "report_summary": f"WITH {FINDINGS_SQL} SELECT target, {_COUNTS}, count(*) AS total FROM findings GROUP BY target",
    "confidence_counts": f"WITH {FINDINGS_SQL} SELECT target, " + ", ".join(f"count(*) FILTER (confidence = '{c}') AS {c}" for c in rules.CONFIDENCES) + " FROM findings GROUP BY target",
    "severity_rollup": f"WITH {FINDINGS_SQL} SELECT target, severity, count(*) AS n FROM findings GROUP BY ROLLUP (target, severity)",
    "grouped_findings": f"WITH {FINDINGS_SQL} SELECT target, CAST(row_number() OVER (PARTITION BY target ORDER BY {_RANK}, {_ORDER}) AS INTEGER) AS nth, severity, evidence FROM findings",
    "invalid_findings": "SELECT CAST(0 AS BIGINT) AS invalid",
    "distinct_notes": "SELECT source AS target, 'lang ' || lang AS note, min(doc_id) AS ord FROM documents GROUP BY 1, 2",
    "json_reports": f"WITH {FINDINGS_SQL} SELECT d.target, count(f.target) AS total, count(*) FILTER (severity = 'high') AS high, coalesce(arg_min(evidence, CASE WHEN evidence LIKE 'mixed-script%' THEN 1000000000 ELSE 0 END + i), '') AS first, {_quote(rules.NOTES['statistical'])} AS note FROM docs d LEFT JOIN findings f ON d.target = f.target GROUP BY d.target",
    "human_reports": f"WITH {FINDINGS_SQL} SELECT d.target, count(f.target) || ' findings (' || {_HUMAN} || ')' AS last FROM docs d LEFT JOIN findings f ON d.target = f.target GROUP BY d.target",
    "verdict_text": "SELECT conv_id, turn, ['no', 'yes', 'unsure', 'unknown', 'yes', 'unknown', 'yes', 'yes'][(conv_id + turn) % 8 + 1] AS meaning FROM conversations",
    "verdict_scores": _picked(_MEANT, "available, is_watermarked, score, error").replace("0.5,", "0.5::DOUBLE,").replace("0.75", "0.75::DOUBLE").replace("0.51", "0.51::DOUBLE"),
    "adapter_outputs": _picked(_ADAPTED, "available, is_watermarked, score, threshold, error").replace("4.3, 3.0", "4.3::DOUBLE, 3.0::DOUBLE"),
    "verdict_lines": _picked(
        (
            "('watermark detected (score 0.5)')", "('not detected')", "('watermark detected (score 0.75)')", "('no verdict (score 0.51)')", "('unavailable (blocked: SAFETY)')", "('unavailable (no candidates)')",
            "('unavailable (not a JSON object)')", "('unavailable (not a JSON object)')", "('unavailable (uncertain verdict)')", "('unavailable (unrecognized reply)')", "('not detected (score 2.0)')",
        ), "line"
    ).replace("SELECT conv_id, turn, line", "SELECT conv_id, turn, 'gemini-synthid-text: ' || line AS line"),
}

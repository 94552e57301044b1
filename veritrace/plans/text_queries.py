"""Text queries over the seeded documents, each with SQL that takes every text apart character by character."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import text as ops
from . import seeds


def _in(cp: str, ranges) -> str:
    return "(" + " OR ".join(f"{cp} BETWEEN {a} AND {b}" for a, b in ranges) + ")"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _note(key: str) -> str:
    return _quote(rules.NOTES[key])


_SIGNAL = (*rules.ZERO_WIDTH_SPACE, *rules.JOINERS, *rules.BOM, *rules.SOFT_HYPHEN, *rules.FORMAT_CONTROLS, *rules.BIDI_CONTROLS, *rules.TAGS, *rules.PRIVATE_USE, *rules.SPACES)
_HIDDEN = ((0, 31), *rules.FORMAT_CATEGORY, *rules.PRIVATE_USE, *rules.TAGS)
_NAME = "CASE " + " ".join(f"WHEN cp = {k} THEN {_quote(v)}" for k, v in rules.NAMES.items()) + f" WHEN {_in('cp', rules.TAGS)} THEN '{rules.TAG_NAME}' ELSE '{rules.PRIVATE_NAME}' END"

#: hits(target, i, cp, line, col, sev, conf, cat, note): i counts from 1 over the whole text.
HITS_SQL = f"""
{seeds.DOCUMENTS_SQL},
chars AS (SELECT target, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM docs WHERE text <> ''),
cps AS (SELECT s.target, text, i, unicode(c) AS cp,
  CASE WHEN i > 1 THEN unicode(substr(text, i - 1, 1)) ELSE 0 END AS p, CASE WHEN i < length(text) THEN unicode(substr(text, i + 1, 1)) ELSE 0 END AS q
  FROM (SELECT * FROM chars WHERE {_in('unicode(c)', _SIGNAL)}) s JOIN docs USING (target)),
ruled AS (SELECT *, CASE
  WHEN {_in('cp', rules.JOINERS)} THEN CASE WHEN {_in('p', rules.EMOJI_CONTEXT)} OR {_in('q', rules.EMOJI_CONTEXT)} THEN ['informational', 'informational', 'invisible-unicode', {_note('emoji')}]
    WHEN {_in('p', rules.SHAPED_SCRIPTS)} OR {_in('q', rules.SHAPED_SCRIPTS)} THEN ['informational', 'informational', 'invisible-unicode', {_note('script')}]
    ELSE ['medium', 'confirmed', 'invisible-unicode', ''] END
  WHEN cp = 65279 AND i > 1 THEN ['medium', 'confirmed', 'invisible-unicode', {_note('bom')}]
  WHEN cp = 65279 THEN NULL
  WHEN cp = 173 THEN ['low', 'confirmed', 'invisible-unicode', {_note('soft hyphen')}]
  WHEN {_in('cp', rules.BIDI_CONTROLS)} THEN ['high', 'confirmed', 'bidi-override', {_note('bidi')}]
  WHEN {_in('cp', rules.TAGS)} THEN ['high', 'confirmed', 'invisible-unicode', {_note('tag')}]
  WHEN {_in('cp', rules.PRIVATE_USE)} THEN ['high', 'confirmed', 'invisible-unicode', {_note('private')}]
  WHEN {_in('cp', rules.SPACES)} THEN ['low', 'probable', 'homoglyph', {_note('space')}]
  ELSE ['medium', 'confirmed', 'invisible-unicode', ''] END AS r FROM cps),
hits AS (SELECT target, i, cp, text, r[1] AS sev, r[2] AS conf, r[3] AS cat, r[4] AS note,
  len(string_split(substr(text, 1, i - 1), chr(10))) AS line, i - length(array_to_string(list_slice(string_split(substr(text, 1, i - 1), chr(10)), 1, -2), chr(10))) - CASE WHEN contains(substr(text, 1, i - 1), chr(10)) THEN 1 ELSE 0 END AS col
  FROM ruled WHERE r IS NOT NULL)"""

#: The snippet around character i of text, col and line known.
_SNIPPET = f"""list_aggregate(list_transform(string_split(substr(string_split(text, chr(10))[line], greatest(col - 40, 1), least(col - 1, 40) + 41), ''),
  lambda c: CASE WHEN {_in('unicode(c)', _HIDDEN)} THEN '<' || printf('U+%04X', unicode(c)) || '>' ELSE c END), 'string_agg', '')"""

GROUPED_SQL = f"""
grp AS (SELECT target, cp, sev, conf, cat, note, count(*) AS n, min(i) AS fi, list('line ' || line || ', col ' || col ORDER BY i) AS locs, any_value(text) AS text, arg_min(line, i) AS line, arg_min(col, i) AS col FROM hits GROUP BY target, cp, sev, conf, cat, note),
charf AS (SELECT target, fi AS i, sev AS severity, conf AS confidence, cat AS category, locs[1] AS location,
  printf('U+%04X', cp) || ' ' || {_NAME} || CASE WHEN n > 1 THEN ' ×' || n ELSE '' END AS evidence, {_SNIPPET} AS context,
  CASE WHEN note <> '' THEN note || '. ' ELSE '' END || n || ' occurrence(s): ' || array_to_string(locs[1:20], '; ') || CASE WHEN n > 20 THEN '; +' || (n - 20) || ' more' ELSE '' END AS note FROM grp)"""

_L = _in("unicode(c)", rules.LATIN)
_G = _in("unicode(c)", rules.GREEK)
_C = _in("unicode(c)", rules.CYRILLIC)
WORDS_SQL = f"""
lets AS (SELECT target, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM docs WHERE text <> ''),
kinds AS (SELECT *, CASE WHEN {_L} THEN 'Latin' WHEN {_G} THEN 'Greek' WHEN {_C} THEN 'Cyrillic' END AS k FROM lets),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY target ORDER BY i) AS run FROM kinds WHERE k IS NOT NULL),
wrds AS (SELECT * FROM (SELECT target, string_agg(c, '' ORDER BY i) AS word, min(CASE WHEN k <> 'Latin' THEN i END) AS i,
  string_agg(CASE WHEN k <> 'Latin' THEN k || ' ' || c || ' ' || printf('U+%04X', unicode(c)) END, '; ' ORDER BY i) AS details
  FROM runs GROUP BY target, run HAVING bool_or(k = 'Latin') AND bool_or(k <> 'Latin')) JOIN docs USING (target)),
wpos AS (SELECT *, len(string_split(substr(text, 1, i - 1), chr(10))) AS line, i - length(array_to_string(list_slice(string_split(substr(text, 1, i - 1), chr(10)), 1, -2), chr(10))) - CASE WHEN contains(substr(text, 1, i - 1), chr(10)) THEN 1 ELSE 0 END AS col FROM wrds),
wordf AS (SELECT target, i, 'medium' AS severity, 'probable' AS confidence, 'homoglyph' AS category, 'line ' || line || ', col ' || col AS location,
  'mixed-script word ''' || word || ''' (' || details || ')' AS evidence, {_SNIPPET} AS context, {_note('confusable')} AS note FROM wpos)"""

FINDINGS_SQL = f"{HITS_SQL}, {GROUPED_SQL}, {WORDS_SQL}, findings AS (SELECT * FROM charf UNION ALL SELECT * FROM wordf)"


def text_findings(spark, sf_dir):
    return ops.scan_text(seeds.documents(spark, sf_dir)).drop("ord")


def text_findings_ordered(spark, sf_dir):
    """Findings numbered within their text: characters by first place, then mixed words."""
    from pyspark.sql import Window

    found = ops.scan_text(seeds.documents(spark, sf_dir))
    return found.select("target", F.row_number().over(Window.partitionBy("target").orderBy("ord")).alias("nth"), "evidence")


def text_occurrences(spark, sf_dir):
    return ops.occurrences(seeds.documents(spark, sf_dir)).select("target", F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"), F.col("cp").cast("long").alias("cp"), "severity", "confidence", "category", "note")


def text_severity_summary(spark, sf_dir):
    return ops.scan_text(seeds.documents(spark, sf_dir)).groupBy("severity", "category").agg(F.count("*").alias("findings"), F.count_distinct("target").alias("targets"))


def _by(name: str, *ranges):
    def query(spark, sf_dir):
        hits = ops.occurrences(seeds.documents(spark, sf_dir))
        from ..functions.expr import inside

        own = hits.filter(inside(F.col("cp"), [x for r in ranges for x in r]))
        return own.groupBy("target", F.col("cp").cast("long").alias("cp"), "severity", "note").agg(F.count("*").alias("n"), F.min(F.col("line").cast("long")).alias("first_line"))

    sql = f"WITH {HITS_SQL} SELECT target, CAST(cp AS BIGINT) AS cp, sev AS severity, note, count(*) AS n, CAST(min(line) AS BIGINT) AS first_line FROM hits WHERE {_in('cp', [x for r in ranges for x in r])} GROUP BY target, cp, sev, note"
    return name, query, sql


def confusable_words(spark, sf_dir):
    return ops.confusable_words(seeds.documents(spark, sf_dir)).select("target", F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"), "word", "details")


def context_snippets(spark, sf_dir):
    return ops.scan_text(seeds.documents(spark, sf_dir)).select("target", "location", "context")


def benchmark_text_findings(spark, sf_dir):
    df = seeds.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("target"), F.concat(F.col("text"), F.lit("\u00a0x\u200b")).alias("text"))
    return ops.scan_text(df).select("target", "severity", "location", "evidence")


QUERIES = {
    "text_findings": text_findings,
    "text_findings_ordered": text_findings_ordered,
    "text_occurrences": text_occurrences,
    "text_severity_summary": text_severity_summary,
    "confusable_words": confusable_words,
    "context_snippets": context_snippets,
    "benchmark_text_findings": benchmark_text_findings,
}
ORACLE_SQL = {
    "text_findings": f"WITH {FINDINGS_SQL} SELECT target, severity, confidence, category, location, evidence, context, note FROM findings",
    "text_findings_ordered": f"WITH {FINDINGS_SQL} SELECT target, CAST(row_number() OVER (PARTITION BY target ORDER BY CASE WHEN evidence LIKE 'mixed-script%' THEN 1 ELSE 0 END, i) AS INTEGER) AS nth, evidence FROM findings",
    "text_occurrences": f"WITH {HITS_SQL} SELECT target, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, CAST(cp AS BIGINT) AS cp, sev AS severity, conf AS confidence, cat AS category, note FROM hits",
    "text_severity_summary": f"WITH {FINDINGS_SQL} SELECT severity, category, count(*) AS findings, count(DISTINCT target) AS targets FROM findings GROUP BY severity, category",
    "confusable_words": f"WITH {seeds.DOCUMENTS_SQL}, {WORDS_SQL} SELECT target, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, word, details FROM wpos",
    "context_snippets": f"WITH {FINDINGS_SQL} SELECT target, location, context FROM findings",
    "benchmark_text_findings": """
SELECT item_id AS target, 'low' AS severity, 'line ' || len(string_split(text, chr(10))) || ', col ' || (length(string_split(text, chr(10))[-1]) + 1) AS location, 'U+00A0 NO-BREAK SPACE' AS evidence FROM benchmark
UNION ALL SELECT item_id, 'medium', 'line ' || len(string_split(text, chr(10))) || ', col ' || (length(string_split(text, chr(10))[-1]) + 3), 'U+200B ZERO WIDTH SPACE' FROM benchmark""",
}
for _name, _query, _sql in (
    _by("zero_width_spaces", rules.ZERO_WIDTH_SPACE),
    _by("joiner_context", rules.JOINERS),
    _by("bom_position", rules.BOM),
    _by("soft_hyphen", rules.SOFT_HYPHEN),
    _by("format_controls", rules.FORMAT_CONTROLS),
    _by("bidi_controls", rules.BIDI_CONTROLS),
    _by("tag_and_pua", rules.TAGS, rules.PRIVATE_USE),
    _by("space_homoglyphs", rules.SPACES),
):
    QUERIES[_name], ORACLE_SQL[_name] = _query, _sql

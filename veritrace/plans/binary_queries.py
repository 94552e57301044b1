"""Queries of binary containers: every document becomes a file of some container that holds its whole text."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.shipping import ship_files
from ..functions.staging import staged
from ..operators import containers, strip
from . import samples, seeds
from .markup_queries import _ESCAPED, _READ, _hits
from .text_queries import _note

KINDS = tuple(samples.ONE_FIELD)


def assets(spark, sf_dir):
    """(target, content): white space and control characters of a text are single blanks, as XML holds no others."""
    ship_files(spark)
    v = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x00-\\x20\\x7f-\\xa0]+", " "), "^\\p{Zs}+|\\p{Zs}+$", "")
    v = F.concat(F.when(v == "", "x").otherwise(v), F.when(F.pmod("doc_id", F.lit(3)) == 0, " by ChatGPT").otherwise(""))

    @F.pandas_udf("binary")
    def made(k: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([samples.ONE_FIELD[KINDS[int(i)]](x) for i, x in zip(k, value, strict=True)])

    rows = seeds.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("target"), F.pmod("doc_id", F.lit(len(KINDS))).alias("k"), v.alias("v"))
    return rows.select("target", made("k", "v").alias("content"))


def asset_containers(spark, sf_dir):
    return containers.with_container(assets(spark, sf_dir)).select("target", "container")


def asset_findings(spark, sf_dir):
    found, _ = containers.audit_assets(assets(spark, sf_dir))
    return found.select("target", "severity", "category", "location", "evidence")


def asset_notes(spark, sf_dir):
    _, notes = containers.audit_assets(assets(spark, sf_dir))
    return notes.select("target", "note")


def container_records(spark, sf_dir):
    own = containers.with_container(assets(spark, sf_dir))
    return containers.records(own).select("target", "container", F.col("nth").cast("long").alias("nth"), "place", "kind", "name", F.md5("value").alias("md5"))


def stripped_assets(spark, sf_dir):
    """What is left of stripped assets, and what a new audit finds, by container: in a TIFF file a zeroed pointer leads to the file's first bytes."""
    own = containers.with_container(assets(spark, sf_dir)).filter(F.col("container").isin(*strip.STRIPPERS))
    done = staged(strip.strip_assets(own, confirm=True), "stripped")  # read twice below
    left, _ = containers.audit_assets(done.select("target", "content"))
    kept = left.groupBy("target").agg(F.count("*").alias("left"))
    md5 = F.when(F.col("container").isin(*_PLAIN), F.md5("content")).otherwise("")
    return done.select("target", "container", "status", F.size("dropped").cast("long").alias("dropped"), md5.alias("md5")).join(kept, "target", "left").select("target", "container", "status", "dropped", "md5", F.coalesce("left", F.lit(0)).cast("long").alias("left"))


#: Files that strip to what is built without the field.
_PLAIN = {"png": samples.png(), "jpeg": samples.jpeg(), "webp": samples.webp(), "gif": samples.gif()}
QUERIES = {f.__name__: f for f in (asset_containers, asset_findings, asset_notes, container_records, stripped_assets)}


def _case(values: dict[str, str], otherwise: str = "''") -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {otherwise} END"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Texts as the containers hold them: PNG and PDF in Latin-1, a JPEG file in several segments, a TIFF value in an audit up to its cap.
_V = "trim(regexp_replace(coalesce(text, ''), '[\\x{1}-\\x{20}\\x{7F}-\\x{A0}]+', ' ', 'g'))"
_LATIN = "regexp_replace(v, '[^\\x{1}-\\x{FF}]', '?', 'g')"
_CHARS = samples.COMMENT_CHARS
#: What an audit looks at of a TIFF value; records hold all of it.
_LIMIT = f" WHERE kind NOT IN ('tiff', 'webp') OR strlen(whole) < {containers.IFD_VALUE}"
_ROWS = f"""a AS (SELECT doc_id AS target, [{', '.join(f"'{k}'" for k in KINDS)}][doc_id % {len(KINDS)} + 1] AS kind, CASE WHEN v = '' THEN 'x' ELSE v END || CASE WHEN doc_id % 3 = 0 THEN ' by ChatGPT' ELSE '' END AS whole FROM (SELECT doc_id, {_V} AS v FROM documents)),
s AS (SELECT target, kind, whole, unnest(generate_series(0, CASE WHEN kind = 'jpeg' THEN (length(whole) - 1) // {_CHARS} ELSE 0 END)) AS i FROM a),
c AS (SELECT target, kind, i, CASE WHEN kind = 'jpeg' THEN substr(whole, 1 + {_CHARS} * i, {_CHARS}) ELSE whole END AS v FROM s{_LIMIT}),
l AS (SELECT target, kind, i, CASE WHEN kind IN ('png', 'pdf') THEN {_LATIN} ELSE v END AS v FROM c),
r AS (SELECT target, kind, i, trim(CASE WHEN kind = 'pdf' THEN {_READ} ELSE v END) AS v, v AS raw FROM (SELECT *, {_ESCAPED} AS e FROM l))"""
_WHOLE_ROWS = _ROWS.replace(_LIMIT, "")
_PLACE = _case({n: _quoted(samples.EVIDENCE[n][0]) for n in samples.EVIDENCE})
_FIELD = _case({n: _quoted(samples.EVIDENCE[n][1]) for n in samples.EVIDENCE})
_CUT = f"CASE WHEN kind <> 'odt' AND length(v) > {rules.VALUE_CUT} THEN substr(v, 1, {rules.VALUE_CUT - 3}) || '...' ELSE v END"
_MARKED = f"len({_hits('v')}) > 0"
_KIND_OF = _case({"png": "'png'", "docx": "'field'", "odt": "'whole'"}, "'field'")
ORACLE_SQL = {
    "asset_containers": f"WITH {_ROWS} SELECT target, kind AS container FROM a",
    "asset_findings": f"""WITH {_ROWS}, f AS (SELECT target, kind, v, {_FIELD} || '=' || {_CUT} AS evidence FROM r WHERE kind <> 'unknown-binary' AND v <> '')
SELECT target, CASE WHEN {_MARKED} THEN 'medium' ELSE 'informational' END AS severity, CASE WHEN {_MARKED} THEN 'ai-metadata' ELSE 'generator-meta' END AS category, {_PLACE} AS location, evidence FROM f
UNION ALL SELECT target, 'informational', 'generator-meta', 'docProps/app.xml', 'Application=Writer' FROM a WHERE kind = 'docx'
UNION ALL SELECT target, 'medium', 'ai-metadata', 'PDF outside compressed streams', 'AI marker bytes' FROM f WHERE kind = 'pdf' AND {_MARKED} AND len(list_filter({_hits('v')}, lambda m: NOT contains(lower(evidence), m))) > 0""",
    "asset_notes": f"WITH {_ROWS} SELECT target, CASE kind WHEN 'svg' THEN {_note('statistical')} ELSE {_note('unknown')} END AS note FROM a WHERE kind IN ('svg', 'unknown-binary')",
    "container_records": f"""WITH {_WHOLE_ROWS} SELECT target, kind AS container, CAST(CASE WHEN kind = 'epub' THEN 1 ELSE i END AS BIGINT) AS nth, {_PLACE} AS place, {_KIND_OF} AS kind, {_FIELD} AS name, md5(v) AS md5 FROM r WHERE kind NOT IN ('unknown-binary', 'pdf') AND v <> ''
UNION ALL SELECT target, 'svg', 1, 'SVG <title>', 'svg text', 'title', md5('t') FROM a WHERE kind = 'svg'
UNION ALL SELECT target, 'docx', 1, 'docProps/app.xml', 'whole', 'Application', md5('Writer') FROM a WHERE kind = 'docx'
UNION ALL SELECT target, 'epub', 0, 'a.xhtml', 'page', 'a.xhtml', md5('<html/>') FROM a WHERE kind = 'epub'""",
    "stripped_assets": f"""WITH {_ROWS} SELECT target, kind AS container, 'ok' AS status, CAST(CASE kind WHEN 'docx' THEN 3 WHEN 'jpeg' THEN (length(whole) - 1) // {_CHARS} + 1 ELSE 1 END AS BIGINT) AS dropped, {_case({k: f"'{hashlib.md5(b).hexdigest()}'" for k, b in _PLAIN.items()})} AS md5,
CAST(CASE WHEN kind = 'tiff' AND strlen(whole) > 7 AND strlen(whole) < {containers.IFD_VALUE} THEN 1 WHEN kind = 'pdf' AND regexp_matches(whole, '[()\\\\]') THEN 1 ELSE 0 END AS BIGINT) AS "left" FROM a WHERE kind NOT IN ('svg', 'epub', 'unknown-binary')""",
}

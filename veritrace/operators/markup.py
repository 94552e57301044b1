"""Layers B and C for text: HTML, Markdown frontmatter, PDF fields, XMP packets and plain metadata values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.expr import explode_findings, finding, let, marker_note, markers, metadata_value, none, strip, xmp_findings

# The patterns by which tags, attributes and blocks are told.
ATTRIBUTE = r"""([\p{L}\p{N}_:-]+)\s*=\s*["']([^"']*)["']"""
JSONLD = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
DATA_AI = r"""(?i)\s(data-ai[\p{L}\p{N}_-]*)\s*=\s*["']([^"']*)["']"""
META = r"(?i)<meta\b[^>]*>"


def attributes(tag: Column) -> Column:
    """A tag's quoted attributes, (k, v) in order, names in lower case."""
    return F.transform(F.arrays_zip(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1)).alias("k"), F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(2)).alias("v")), lambda x: F.struct(F.lower(x["k"]).alias("k"), x["v"].alias("v")))


def attribute(attrs: Column, name: str) -> Column:
    """The last value of that name, or the empty string."""
    return F.coalesce(F.try_element_at(F.filter(attrs, lambda x: x["k"] == name), F.lit(-1))["v"], F.lit(""))


def generators(html: Column) -> Column:
    """The contents of all generator meta tags, in order."""
    tags = F.transform(F.regexp_extract_all(html, F.lit(META), F.lit(0)), attributes)
    return F.transform(F.filter(tags, lambda a: F.lower(attribute(a, "name")) == "generator"), lambda a: attribute(a, "content"))


def _generator_finding(content: Column) -> Column:
    place = F.lit('<meta name="generator">')
    evidence = F.concat(F.lit("generator="), content)
    found = markers(content)
    cms = F.exists(F.array(*(F.lit(c) for c in rules.CMS_NAMES)), lambda c: F.contains(F.lower(content), c))
    return (
        F.when(F.size(found) > 0, finding("medium", "confirmed", "ai-metadata", place, evidence, None, marker_note(found)))
        .when(cms, finding("informational", "confirmed", "generator-meta", place, evidence, None, rules.NOTES["cms"]))
        .when(strip(content) != "", finding("informational", "confirmed", "generator-meta", place, evidence, None, rules.NOTES["plain"]))
        .otherwise(none())
    )


def jsonld_findings(html: Column, location: Column | None = None) -> Column:
    location = F.lit("JSON-LD script block") if location is None else location
    blocks = F.regexp_extract_all(html, F.lit(JSONLD), F.lit(1))

    def one(block: Column) -> Column:
        found = markers(block)
        return F.when(F.size(found) > 0, finding("medium", "confirmed", "ai-metadata", location, "JSON-LD block has AI markers", F.substring(strip(block), 1, rules.VALUE_CUT), marker_note(found))).otherwise(none())

    return F.array_compact(F.transform(blocks, one))


def html_findings(html: Column) -> Column:
    """Findings of a page's markup: generator tags, then data-ai attributes, then JSON-LD blocks."""
    tags = F.array_compact(F.transform(generators(html), _generator_finding))
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(DATA_AI), F.lit(1)).alias("k"), F.regexp_extract_all(html, F.lit(DATA_AI), F.lit(2)).alias("v"))
    data = F.transform(pairs, lambda x: finding("medium", "confirmed", "ai-metadata", F.concat(F.lit("attribute "), x["k"]), F.concat(x["k"], F.lit("="), x["v"]), None, rules.NOTES["data-ai"]))
    return F.concat(tags, data, jsonld_findings(html))


def _may_tell(html: Column) -> Column:
    """A page without any of the three words has no finding."""
    low = F.lower(html)
    return F.contains(low, F.lit("generator")) | F.contains(low, F.lit("data-ai")) | F.contains(low, F.lit("ld+json"))


def guarded_html(html: Column) -> Column:
    """html_findings(), worked out only for pages that may have any."""
    return F.when(_may_tell(html), html_findings(html)).otherwise(F.array().cast(fields_type()))


def parse_html(df: DataFrame, target: str = "target", html: str = "html") -> DataFrame:
    return explode_findings(df.filter(_may_tell(F.col(html))).withColumn("target", F.col(target)), html_findings(F.col(html)), "target")


#: Line ends of Markdown: CRLF, or one of LF CR VT FF FS GS RS NEL LS PS.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
# A frontmatter line's key and value, and keys about generators.
KEY_OF = r"^([A-Za-z0-9_.-]+)\s*:"
VALUE_OF = r"^[A-Za-z0-9_.-]+\s*:\s*(.*)$"
KEY = r"(?i)^(generator|model|ai[-_].*|claude.*|gpt.*|llm.*)$"


def frontmatter(text: Column) -> Column:
    """The lines between the first line --- and the next, or null."""
    lines = F.split(text, LINE_ENDS)
    close = F.array_position(F.transform(F.slice(lines, 2, 1 << 30), lambda x: strip(x) == "---"), True)
    return F.when((strip(F.element_at(lines, 1)) == "---") & (close > 0), F.slice(lines, F.lit(2), close.cast("int") - 1))


def markdown_findings(text: Column) -> Column:
    def one(line: Column, i: Column) -> Column:
        key = F.regexp_extract(line, KEY_OF, 1)
        value = F.regexp_replace(strip(F.regexp_extract(line, VALUE_OF, 1)), r"""^["']+|["']+$""", "")
        found = markers(value)
        note = F.when(key.rlike(KEY), F.lit(rules.NOTES["key"])).otherwise(marker_note(found))
        return F.when((key != "") & (key.rlike(KEY) | (F.size(found) > 0)), finding("medium", "confirmed", "ai-metadata", F.concat(F.lit("frontmatter line "), (i + 2).cast("string")), F.concat(key, F.lit(": "), value), None, note)).otherwise(none())

    return F.array_compact(F.transform(F.coalesce(frontmatter(text), F.array().cast("array<string>")), one))


def _opened(text: Column) -> Column:
    return text.rlike(r"(?U)^[\s\x1c-\x1f]*---")


def guarded_markdown(text: Column) -> Column:
    """markdown_findings(), worked out only for texts that begin like one."""
    return F.when(_opened(text), markdown_findings(text)).otherwise(F.array().cast(fields_type()))


def parse_markdown(df: DataFrame, target: str = "target", text: str = "text") -> DataFrame:
    return explode_findings(df.filter(_opened(F.col(text))).withColumn("target", F.col(target)), markdown_findings(F.col(text)), "target")


# Literal fields of a PDF's document information; possessive, as long values overflow the stack else.
PDF_FIELD = r"/(Producer|Creator|Title|Author|CreationDate)\s*\(((?:[^()\\]++|\\.)*+)\)"


def pdf_fields(latin: Column) -> Column:
    """(k, v) of a PDF's literal document fields, unescaped; latin: its bytes as characters."""
    pairs = F.arrays_zip(F.regexp_extract_all(latin, F.lit(PDF_FIELD), F.lit(1)).alias("k"), F.regexp_extract_all(latin, F.lit(PDF_FIELD), F.lit(2)).alias("v"))

    def plain(v: Column) -> Column:
        for mark, char in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\(", "("), ("\\)", ")"), ("\\\\", "\\")):
            v = F.replace(v, F.lit(mark), F.lit(char))
        return strip(v)

    return F.transform(pairs, lambda x: F.struct(F.concat(F.lit("/"), x["k"]).alias("k"), plain(x["v"]).alias("v")))


def pdf_packet(latin: Column) -> Column:
    """The first XMP packet: to its end mark, or 64 KiB; empty if there is none."""
    at = F.instr(latin, "<?xpacket")
    rest = F.substring(latin, at, F.char_length(latin))
    end = F.instr(rest, "<?xpacket end")
    return F.when(at == 0, "").when(end > 0, F.substring(rest, F.lit(1), end - 1)).otherwise(F.substring(rest, 1, 65536))


def pdf_uncompressed(latin: Column) -> Column:
    """The file without its compressed streams: from stream to endstream, where FlateDecode is told in the 1,024 bytes before."""
    parts = F.split(latin, r"(?=stream\r?\n)(?<!end)(?<![0-9A-Za-z_])")

    def without(parts: Column) -> Column:
        def kept(part: Column, i: Column) -> Column:
            end = F.instr(part, "endstream")
            before = F.substring(F.element_at(parts, F.greatest(i, F.lit(1))), -1024, 1024)
            packed = (i > 0) & (end > 0) & F.contains(before, F.lit("/FlateDecode"))
            return F.when(packed, F.concat(F.repeat(F.lit(" "), F.lit(1)), F.substring(part, end + 9, F.char_length(part)))).otherwise(part)

        return F.transform(parts, kept)

    return F.array_join(let(parts, without), "")


def pdf_findings(latin: Column) -> Column:
    """Findings of a PDF's fields, XMP packet and markers outside compressed streams; each is worked out once."""
    empty = F.array().cast(fields_type())

    def field(x: Column) -> Column:
        return let(markers(x["v"]), lambda m: metadata_value(x["k"], x["v"], F.concat(F.lit("PDF /Info "), x["k"]), found=m))

    fields = F.array_compact(F.transform(pdf_fields(latin), lambda x: F.when(x["v"] != "", field(x)).otherwise(none())))
    packets = let(pdf_packet(latin), lambda p: F.when(p != "", xmp_findings(p, F.lit("PDF XMP metadata stream"))).otherwise(empty))

    def every(s: Column) -> Column:
        found = s["found"]
        told = F.exists(s["first"], lambda f: F.forall(found, lambda m: F.contains(F.lower(f["evidence"]), m)))
        extra = F.when((F.size(found) > 0) & ~told, F.array(finding("medium", "confirmed", "ai-metadata", "PDF outside compressed streams", "AI marker bytes", None, marker_note(found)))).otherwise(empty)
        edited = (F.size(found) > 0) & (F.regexp_count(latin, F.lit("%%EOF")) > 1)
        return F.struct(F.concat(s["first"], extra).alias("all"), edited.alias("edited"))

    def noted(s: Column) -> Column:
        return F.transform(s["all"], lambda f, i: F.when(s["edited"] & (i == F.size(s["all"]) - 1), f.withField("note", F.concat(f["note"], F.lit(". " + rules.NOTES["incremental"])))).otherwise(f))

    return let(let(F.struct(F.concat(fields, packets).alias("first"), markers(pdf_uncompressed(latin)).alias("found")), every), noted)


def fields_type() -> str:
    from ..functions.expr import FINDING_DDL

    return f"array<{FINDING_DDL}>"


# What is taken out of a page, in this order.
VISIBLE_STEPS = (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->", r"<[^>]+>")
#: The entities that plain pages use; pages with any other are unescaped by Python's table.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&shy;", "\u00ad"), ("&zwnj;", "\u200c"), ("&zwj;", "\u200d"), ("&amp;", "&"))
OTHER_ENTITY = "&(?!(?:" + "|".join(mark[1:-1] for mark, _ in ENTITIES) + ");)[#A-Za-z]"


def visible_text(html: Column, entities: bool = True) -> Column:
    """A page's text: scripts, styles, comments and tags are blanks; all of HTML's entities are resolved, once."""
    out = html
    for step in VISIBLE_STEPS:
        out = F.regexp_replace(out, step, " ")
    if not entities:
        return out
    plain = out
    for mark, char in ENTITIES:
        plain = F.replace(plain, F.lit(mark), F.lit(char))
    return F.coalesce(unescape_all(F.when(out.rlike(OTHER_ENTITY), out)), plain)


def unescape_all(column: Column) -> Column:
    """All of HTML's entities, by Python's table, in Arrow batches; null stays null."""
    @F.pandas_udf("string")
    def resolved(s: pd.Series) -> pd.Series:
        from html import unescape

        return s.map(unescape, na_action="ignore")

    return resolved(column)

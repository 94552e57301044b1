"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules

FINDING = ("severity", "confidence", "category", "location", "evidence", "context", "note")


def inside(cp: Column, ranges) -> Column:
    """Whether a code point lies in one of the ranges."""
    out = F.lit(False)
    for a, b in ranges:
        out = out | ((cp == a) if a == b else cp.between(a, b))
    return out


def cp_name(cp: Column) -> Column:
    """U+ and at least four hex digits."""
    return F.format_string("U+%04X", cp)


def finding(severity: str, confidence: str, category: str, location, evidence, context=None, note=None) -> Column:
    """A finding as a struct; empty strings stand for no context and no note."""
    assert severity in rules.SEVERITIES and confidence in rules.CONFIDENCES and category in rules.CATEGORIES

    def text(x):
        return F.lit("") if x is None else F.lit(x) if isinstance(x, str) else x

    return F.struct(F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), F.lit(category).alias("category"), text(location).alias("location"), text(evidence).alias("evidence"), text(context).alias("context"), text(note).alias("note"))


FINDING_DDL = "struct<severity:string,confidence:string,category:string,location:string,evidence:string,context:string,note:string>"


def none() -> Column:
    return F.lit(None).cast(FINDING_DDL)


def let(value: Column, body) -> Column:
    """body(value), with value worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns that later expressions read and do not work out again."""
    for name, column in columns.items():
        df = df.select("*", F.explode(F.array(column)).alias(name))
    return df


def markers(value: Column, words=rules.AI_MARKERS) -> Column:
    """The marker words that occur in a value whatever its case, in their fixed order."""
    # The value is lowered once, as the only element of an array.
    return F.element_at(F.transform(F.array(F.lower(value)), lambda low: F.filter(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(low, w))), 1)


def with_markers(df: DataFrame, name: str, value: Column, words=rules.AI_MARKERS) -> DataFrame:
    """df with its values' markers(), for long values: they are lowered once, as a column, and not once a word."""
    own = once(df, __low=F.lower(value))
    return once(own, **{name: F.array_compact(F.array(*(F.when(F.contains("__low", F.lit(w)), F.lit(w)) for w in words)))}).drop("__low")


def marker_note(found: Column, lead: str = "AI markers: ") -> Column:
    return F.concat(F.lit(lead), F.array_join(found, ", "))


def cut(value: Column, most: int = rules.VALUE_CUT) -> Column:
    """The value, or its beginning and three dots."""
    return F.when(F.char_length(value) > most, F.concat(F.substring(value, 1, most - 3), F.lit("..."))).otherwise(value)


def strip(value: Column) -> Column:
    """Without white space, of whatever script, at either end."""
    return F.regexp_replace(value, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


#: A value that strip() leaves something of.
NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"


def metadata_value(name: Column, value: Column, location: Column, otherwise: bool = True, found: Column | None = None) -> Column:
    """The finding that a metadata field gives: AI markers, or informational if it is not blank, or null.

    found: the value's markers, if they are at hand.
    """
    found = markers(value) if found is None else found
    evidence = F.concat(name, F.lit("="), cut(value))
    plain = F.when(F.lit(otherwise) & value.rlike(NOT_BLANK), finding("informational", "confirmed", "generator-meta", location, evidence, None, rules.NOTES["plain"]))
    return F.when(F.size(found) > 0, finding("medium", "confirmed", "ai-metadata", location, evidence, None, marker_note(found))).otherwise(plain)


# Where an XMP packet names its tool.
CREATOR_TOOL = r"""xmp:CreatorTool["'>\s]*=?["'>]?\s*([^<"']+)"""


def xmp_findings(packet: Column, location: Column, found: Column | None = None) -> Column:
    """The findings of an XMP packet: C2PA namespace, creator tool, markers; each may fire."""
    tool = F.regexp_extract(packet, CREATOR_TOOL, 1)
    found = markers(packet) if found is None else found
    return F.array_compact(
        F.array(
            F.when(F.contains(packet, F.lit("c2pa:")) | F.contains(packet, F.lit("ns.adobe.com/c2pa")), finding("medium", "confirmed", "c2pa-manifest", location, "XMP packet names the C2PA namespace", None, rules.NOTES["c2pa xmp"])).otherwise(none()),
            F.when(tool != "", metadata_value(F.lit("xmp:CreatorTool"), strip(tool), location)).otherwise(none()),
            F.when(F.size(found) > 0, finding("medium", "confirmed", "ai-metadata", location, "XMP packet has AI markers", F.substring(packet, 1, rules.VALUE_CUT), marker_note(found))).otherwise(none()),
        )
    )


def explode_findings(df: DataFrame, findings: Column, *keep: str) -> DataFrame:
    """A row a finding of an array of them: keep..., ord, then the columns of a finding."""
    out = df.select(*keep, F.posexplode(findings).alias("ord", "f"))
    return out.select(*keep, F.col("ord").cast("long").alias("ord"), *(F.col(f"f.{c}").alias(c) for c in FINDING))

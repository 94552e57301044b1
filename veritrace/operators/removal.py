"""Removal: cleaned texts and files, what was taken out, and whether a new audit agrees.

Nothing here runs as part of an audit: every entry asks for confirm=True and only returns new columns.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from . import markup, text

REFUSED = ("epub", "unknown-binary")
REMINDER = "Removal changes files: keep the originals, and check that the law and your agreements allow it."


def require_confirmation(confirm: bool) -> None:
    if not confirm:
        raise PermissionError("removal needs confirm=True")
    logging.getLogger(__name__).warning(REMINDER)


def clean_text(value: Column) -> Column:
    """The text without hidden characters; look-alike spaces become spaces.

    A byte order mark at the very start stays, as do joiners beside emoji or scripts that need them,
    judged on the original text; soft hyphens count as format controls and go.
    """
    beside = rules.char_class(rules.EMOJI_CONTEXT, rules.SHAPED_SCRIPTS)
    joiner = rules.char_class(rules.JOINERS)
    out = value
    # One pass over the original text: lookarounds see it unchanged.
    # A look ahead at each place is cheap: most characters are none that any rule drops.
    drop = f"(?={rules.SOME})(?:(?<!{beside}){joiner}(?!{beside})|{rules.char_class(rules.ZERO_WIDTH_SPACE, rules.SOFT_HYPHEN, rules.FORMAT_CONTROLS, rules.BIDI_CONTROLS, rules.TAGS, rules.PRIVATE_USE)}|(?<!^)\\x{{FEFF}})"
    out = F.regexp_replace(out, drop, "")
    # ASCII texts hold nothing to take out.
    return F.when(F.octet_length(value) == F.char_length(value), value).otherwise(F.regexp_replace(out, f"(?={rules.SOME}){rules.char_class(rules.SPACES)}", " "))


def removed_counts(df: DataFrame, target: str = "target", value: str = "text") -> DataFrame:
    """(target, cp, n): how often cleaning takes out or replaces each character."""
    hits = text.occurrences(df, target, value).filter("severity <> 'informational'")
    return hits.groupBy("target", F.col("cp").cast("long").alias("cp")).agg(F.count("*").alias("n"))


def clean_texts(df: DataFrame, target: str = "target", value: str = "text", confirm: bool = False) -> DataFrame:
    """(target, cleaned, changed)"""
    require_confirmation(confirm)
    own = text.once(df.select(F.col(target).alias("target"), F.col(value).alias("__text")), cleaned=clean_text(F.col("__text")))
    return own.select("target", "cleaned", (F.col("cleaned") != F.col("__text")).alias("changed"))


def verified(df: DataFrame, target: str = "target", cleaned: str = "cleaned") -> DataFrame:
    """(target, verified): no finding is left but informational ones and mixed-script words."""
    left = text.occurrences(df, target, cleaned).filter("severity <> 'informational'").select("target").distinct().withColumn("left", F.lit(True))
    return df.select(F.col(target).alias("target")).join(left, "target", "left").select("target", F.col("left").isNull().alias("verified"))


def strip_html(html: Column) -> Column:
    """Without generator tags and data-ai attributes; all else byte for byte."""
    out = F.regexp_replace(html, r"""(?i)<meta\b[^>]*name\s*=\s*["']generator["'][^>]*>""", "")
    return F.regexp_replace(out, r"""(?i)\s+data-ai[\p{L}\p{N}_-]*\s*=\s*("[^"]*"|'[^']*')""", "")


def strip_svg(svg: Column) -> Column:
    """Without metadata elements and generator attributes."""
    out = F.regexp_replace(svg, r"(?is)<metadata\b.*?</metadata\s*>", "")
    return F.regexp_replace(out, r"""(?i)\s+[A-Za-z0-9_:.-]*generator\s*=\s*("[^"]*"|'[^']*')""", "")


# Keys of generators.
#: A key goes if it is one of these, or begins with one and a dash or underscore.
FRONTMATTER = r"(?i)^(?:generator|model|ai|claude|gpt|llm)(?:[-_][A-Za-z0-9_.-]*)?$"


def strip_markdown(value: Column) -> Column:
    """Without the frontmatter lines of keys about generators; the body stays byte for byte."""
    ends = F.concat(F.regexp_extract_all(value, F.lit(f"({markup.LINE_ENDS})"), F.lit(1)), F.array(F.lit("")))
    lines = F.zip_with(F.split(value, markup.LINE_ENDS), ends, lambda a, b: F.struct(a.alias("s"), F.coalesce(b, F.lit("")).alias("e")))
    close = F.size(markup.frontmatter(value)) + 2  # the closing fence's number

    def stays(x: Column, i: Column) -> Column:
        key = F.regexp_extract(x["s"], markup.KEY_OF, 1)
        return (i == 0) | (i + 1 >= close) | ~key.rlike(FRONTMATTER)

    kept = F.array_join(F.transform(F.filter(lines, stays), lambda x: F.concat(x["s"], x["e"])), "")
    return F.when(markup.frontmatter(value).isNull(), value).otherwise(kept)


def removal_summary(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(removed, remaining): distinct (target, category, evidence) that only the first audit has, and that the second has."""
    key = ["target", "category", "evidence"]
    return before.select(*key).distinct().join(after.select(*key).distinct(), key, "left_anti"), after.select(*key).distinct()


def removal_status(df: DataFrame, container: str = "container", length: str = "length", most: int = rules.MAX_BYTES) -> DataFrame:
    """Adds status: why an asset is refused, or 'ok', and mode: how far its removal can be verified."""
    c = F.col(container)
    status = F.when(F.col(length) > most, "over the cap").when(c.isin(*REFUSED), F.concat(F.lit("cannot clean "), c)).otherwise("ok")
    return df.withColumn("status", status).withColumn("mode", F.when(c.isin("tiff", "pdf"), "best-effort").otherwise("verifiable"))

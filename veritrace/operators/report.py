"""Reports: counts, rankings, notes and renderings over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.expr import FINDING


def severity_counts(findings: DataFrame, *keys: str) -> DataFrame:
    """One row a key with a count for each severity, zeros kept, and the total."""
    grouped = findings.groupBy(*keys)
    return grouped.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in rules.SEVERITIES), F.count("*").alias("total"))


def confidence_counts(findings: DataFrame, *keys: str) -> DataFrame:
    return findings.groupBy(*keys).agg(*(F.count_if(F.col("confidence") == c).alias(c) for c in rules.CONFIDENCES))


def severity_rollup(findings: DataFrame) -> DataFrame:
    """Counts by target and severity, by target, and in all."""
    return findings.rollup("target", "severity").agg(F.count("*").alias("n"))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in rules.SEVERITIES)), severity).cast("int")


def grouped(findings: DataFrame) -> DataFrame:
    """Adds nth: a finding's place in its target's report, from high to informational, in order of ord within."""
    return findings.withColumn("nth", F.row_number().over(Window.partitionBy("target").orderBy(severity_rank(F.col("severity")), "ord")))


def ranked(targets: DataFrame, findings: DataFrame) -> DataFrame:
    """(target, findings, has_high): targets with high findings first, then by number of findings, then by name.

    Targets without findings, also skipped ones, count as zero.
    """
    counts = severity_counts(findings, "target").select("target", F.col("total").alias("findings"), (F.col("high") > 0).alias("has_high"))
    joined = targets.join(counts, "target", "left").select("target", F.coalesce("findings", F.lit(0)).cast("long").alias("findings"), F.coalesce("has_high", F.lit(False)).alias("has_high"))
    return joined.orderBy(F.col("has_high").desc(), F.col("findings").desc(), "target")


def distinct_notes(notes: DataFrame) -> DataFrame:
    """Each note of a target once, where it stood first (column ord)."""
    return notes.groupBy("target", "note").agg(F.min("ord").alias("ord"))


def invalid(findings: DataFrame) -> DataFrame:
    """Findings outside the vocabulary; there must be none."""
    return findings.filter(~F.col("severity").isin(*rules.SEVERITIES) | ~F.col("confidence").isin(*rules.CONFIDENCES) | ~F.col("category").isin(*rules.CATEGORIES))


def relocated(findings: DataFrame, target: Column) -> DataFrame:
    """Child findings in their parent's report: the location is the child's name, the old one goes to the note."""
    note = F.concat(F.lit("at "), F.col("location"), F.when(F.col("note") != "", F.concat(F.lit(". "), F.col("note"))).otherwise(""))
    return findings.withColumn("note", note).withColumn("location", F.col("target").cast("string")).withColumn("target", target)


CAVEATS = (
    "A vendor's detector holds its own key: its verdict cannot be checked by others.",
    "A scheme's detector checks one configuration: a negative does not rule others out.",
    "No verdict proves nothing either way.",
)


def verdict_line(v: Column) -> Column:
    """How a verdict (detector, available, is_watermarked, score, threshold, error) reads in a report."""

    def number(x: Column) -> Column:
        return x.cast("string")

    score, bound = v["score"], v["threshold"]
    detail = F.when(score.isNotNull() & bound.isNotNull() & v["is_watermarked"].isNotNull(), F.concat(F.lit(" (score "), number(score), F.lit(", threshold "), number(bound), F.lit(")"))).when(score.isNotNull(), F.concat(F.lit(" (score "), number(score), F.lit(")"))).otherwise("")
    state = F.when(v["is_watermarked"].isNull(), "no verdict").when(v["is_watermarked"], "watermark detected").otherwise("not detected")
    return F.when(~v["available"], F.concat(v["detector"], F.lit(": unavailable ("), F.coalesce(v["error"], F.lit("")), F.lit(")"))).otherwise(F.concat(v["detector"], F.lit(": "), state, detail))


def reports(targets: DataFrame, findings: DataFrame, notes: DataFrame | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """(target, report): a nested report for every target, those without findings too.

    A target's findings are one report, so they are gathered in one row; targets are independent.
    """
    body = F.struct("ord", *FINDING)
    found = findings.groupBy("target").agg(F.sort_array(F.collect_list(body)).alias("findings"), *(F.count_if(F.col("severity") == s).alias(s) for s in rules.SEVERITIES))
    out = targets.select("target").join(found, "target", "left")
    said = distinct_notes(notes).groupBy("target").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "note"))), lambda x: x["note"]).alias("notes")) if notes is not None else None
    out = out.join(said, "target", "left") if said is not None else out.withColumn("notes", F.lit(None).cast("array<string>"))
    if verdicts is not None:
        out = out.join(verdicts.groupBy("target").agg(F.collect_list(F.struct("detector", "available", "is_watermarked", "score", "threshold", "scope_note", "error")).alias("verdicts")), "target", "left")
    else:
        out = out.withColumn("verdicts", F.lit(None).cast("array<struct<detector:string,available:boolean,is_watermarked:boolean,score:double,threshold:double,scope_note:string,error:string>>"))
    from .. import __version__

    plain = F.transform(F.coalesce("findings", F.array().cast(f"array<struct<ord:bigint,{','.join(f'{c}:string' for c in FINDING)}>>")), lambda f: F.struct(*(f[c].alias(c) for c in FINDING)))
    summary = F.struct(*(F.coalesce(F.col(s), F.lit(0)).cast("long").alias(s) for s in rules.SEVERITIES), F.size(plain).cast("long").alias("total"))
    caveats = F.when(F.size(F.coalesce("verdicts", F.array())) > 0, F.array(*(F.lit(c) for c in CAVEATS)))
    return out.select("target", F.struct(F.lit("veritrace").alias("tool"), F.lit(__version__).alias("version"), F.col("target").cast("string").alias("target"), F.coalesce("notes", F.array().cast("array<string>")).alias("notes"), summary.alias("summary"), plain.alias("findings"), F.col("verdicts"), caveats.alias("caveats")).alias("report"))


def self_check(spark, target: str = "none") -> DataFrame:
    """(target, report): an empty report under a note that no audit was run, to try the sinks with."""
    targets = spark.createDataFrame([(target,)], "target string")
    findings = spark.createDataFrame([], "target string, ord bigint, " + ", ".join(f"{c} string" for c in FINDING))
    return reports(targets, findings, targets.select("target", F.lit(0).cast("long").alias("ord"), F.lit(rules.NOTES["self-check"]).alias("note")))


def json_reports(reported: DataFrame) -> DataFrame:
    """(target, json); verdicts and caveats are there only if there are verdicts."""
    return reported.select("target", F.to_json("report").alias("json"))


def human_reports(reported: DataFrame) -> DataFrame:
    """(target, text): the report to read, from high to informational, then notes, verdicts and the count."""
    r = F.col("report")

    def section(severity: str) -> Column:
        own = F.filter(r["findings"], lambda f: f["severity"] == severity)

        def lines(f: Column) -> Column:
            return F.concat(F.lit("- "), f["location"], F.lit("\n  evidence: "), f["evidence"], F.when(f["context"] != "", F.concat(F.lit("\n  context: "), f["context"])).otherwise(""), F.when(f["note"] != "", F.concat(F.lit("\n  note: "), f["note"])).otherwise(""), F.lit("\n  category: "), f["category"], F.lit("; confidence: "), f["confidence"])

        return F.when(F.size(own) > 0, F.concat(F.lit(f"[{severity}]\n"), F.array_join(F.transform(own, lines), "\n"), F.lit("\n")))

    notes = F.when(F.size(r["notes"]) > 0, F.concat(F.lit("Notes:\n"), F.array_join(F.transform(r["notes"], lambda n: F.concat(F.lit("- "), n)), "\n"), F.lit("\n")))
    verdicts = F.when(F.size(F.coalesce(r["verdicts"], F.array())) > 0, F.concat(F.lit("Verdicts (cannot be checked independently)\n"), F.array_join(F.transform(r["verdicts"], lambda v: F.concat(F.lit("- "), verdict_line(v), F.when(v["scope_note"] != "", F.concat(F.lit("\n  note: "), v["scope_note"])).otherwise(""))), "\n"), F.lit("\n"), F.array_join(F.transform(r["caveats"], lambda c: F.concat(F.lit("  caveat: "), c)), "\n"), F.lit("\n")))
    total = F.concat(r["summary"]["total"].cast("string"), F.lit(" findings ("), F.concat_ws(", ", *(F.concat(r["summary"][s].cast("string"), F.lit(f" {s}")) for s in rules.SEVERITIES)), F.lit(")"))
    return reported.select("target", F.concat_ws("\n", F.concat(F.lit("Audit findings\nTarget: "), r["target"], F.lit("\n")), *(section(s) for s in rules.SEVERITIES), notes, verdicts, total).alias("text"))

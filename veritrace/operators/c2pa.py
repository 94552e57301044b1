"""Content credentials: findings checked against what a C2PA tool said, row by row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.shipping import ship

PROBE = "rc int, stdout string, stderr string, failed string"
TOOL, TIMEOUT = "c2patool", 30


def run_tool(content: bytes) -> tuple[int, str, str]:
    """(exit code, stdout, stderr) of the tool on a file with these bytes; FileNotFoundError if this machine has none."""
    import shutil
    import subprocess
    import tempfile

    if not (tool := shutil.which(TOOL)):
        raise FileNotFoundError(TOOL)
    with tempfile.NamedTemporaryFile() as f:  # the tool reads files alone; it is gone with the call
        f.write(content)
        f.flush()
        done = subprocess.run([tool, f.name], capture_output=True, text=True, timeout=TIMEOUT, check=False)
    return done.returncode, done.stdout, done.stderr


def probe(assets: DataFrame, run: Callable[[bytes], tuple[int, str, str]] = run_tool) -> DataFrame:
    """(target, rc, stdout, stderr, failed): what run says of each asset (target, content), on the executors.

    An asset whose machine has no tool has no row; any other failure is told in failed.
    """
    ship(assets.sparkSession)

    def rows(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for target, content in zip(batch["target"], batch["content"], strict=True):
                try:
                    out.append((target, *run(bytes(content)), None))
                except FileNotFoundError:
                    continue
                except Exception as e:  # noqa: BLE001  a tool may fail in any way
                    out.append((target, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["target", "rc", "stdout", "stderr", "failed"]).astype({"rc": "Int32"})

    own = assets.select("target", "content")
    return own.mapInPandas(rows, f"target {own.schema['target'].dataType.simpleString()}, {PROBE}")


def _outcomes(findings: DataFrame, probes: DataFrame) -> DataFrame:
    """(target, outcome, detail) for targets with manifest findings; probes: (target, rc, stdout, stderr, failed)."""
    own = findings.filter(F.col("category") == "c2pa-manifest").select("target").distinct().join(probes, "target", "left")
    said = F.concat_ws("\n", F.coalesce("stdout", F.lit("")), F.coalesce("stderr", F.lit("")))
    v = F.try_parse_json("stdout")
    outcome = (
        F.when(F.col("rc").isNull() & F.col("failed").isNull(), "absent")
        .when(F.col("failed").isNotNull(), "failed")
        .when((F.col("rc") != 0) | F.contains(said, F.lit("No claim found")) | F.contains(said, F.lit("No JUMBF data found")), "none")
        .when(v.isNull(), "unreadable")
        .otherwise("read")
    )
    manifest = F.from_json("stdout", "active_manifest string, manifests map<string, struct<claim_generator:string, assertions:array<struct<label:string>>, signature_info:struct<issuer:string, common_name:string>>>")
    active = F.try_element_at(manifest["manifests"], manifest["active_manifest"])
    labels = F.transform(active["assertions"], lambda a: F.coalesce(a["label"], F.lit("?")))
    signer = F.coalesce(F.nullif(active["signature_info"]["issuer"], F.lit("")), F.nullif(active["signature_info"]["common_name"], F.lit("")))
    detail = F.concat_ws("; ", F.concat(F.lit("claim_generator="), F.nullif(active["claim_generator"], F.lit(""))), F.when(F.size(labels) > 0, F.concat(F.lit("assertions: "), F.array_join(labels, ", "))), F.concat(F.lit("signed by: "), signer))
    return own.select("target", outcome.alias("outcome"), F.when(outcome == "read", detail).otherwise("").alias("detail"))


def enrich(findings: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, notes). A tool that finds no claim takes the manifest findings back; what it read is added to their notes."""
    known = _outcomes(findings, probes)
    joined = findings.join(known, "target", "left")
    manifest = F.col("category") == "c2pa-manifest"
    kept = joined.filter(~(manifest & (F.coalesce("outcome", F.lit("")) == "none")))
    note = F.when(manifest & (F.coalesce("detail", F.lit("")) != ""), F.concat("note", F.lit(". C2PA tool: "), "detail")).otherwise(F.col("note"))
    says = {"absent": "c2pa tool absent", "failed": "c2pa tool failed", "none": "c2pa none", "unreadable": "c2pa unreadable"}
    text = None
    for k, n in says.items():
        text = F.when(F.col("outcome") == k, rules.NOTES[n]) if text is None else text.when(F.col("outcome") == k, rules.NOTES[n])
    return kept.withColumn("note", note).select(*findings.columns), known.filter(F.col("outcome") != "read").select("target", text.alias("note"))

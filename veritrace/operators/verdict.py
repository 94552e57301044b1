"""External detectors' answers, as rows apart from findings; nothing is sent unless a transport is given."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.expr import strip
from ..functions.shipping import ship

# How replies are worded and where scores stand.
SAID = r"\b(?:watermarked|ai-generated|ai generated|likely ai)\b"
DENIED = r"\b(?:unlikely|not|no|never|isn't|doesn't|wasn't)\b"
UNSURE = r"\b(?:cannot|can't|unable|unclear|undetermined|unsure)\b"
SCORES = ("watermarkScore", "watermark_score", "syntheticTextScore", "synthetic_text_score", "score")
ATTRIBUTION_SCORES = ("syntheticTextScore", "synthetic_text_score", "score", "syntheticText.score", "syntheticText.confidence")
MODEL_NAME = r"[A-Za-z0-9][A-Za-z0-9._-]*"
INPUT_CAP = 1_048_576
VERDICT = "detector string, available boolean, is_watermarked boolean, score double, threshold double, scope_note string, error string"


def reply_meaning(reply: Column) -> Column:
    """'yes', 'no', 'unsure' or 'unknown' of a free-text reply.

    The earliest marker counts, with what precedes it in its clause: a doubt makes it unsure, a denial no.
    """
    low = F.lower(strip(reply))
    at = F.regexp_instr(low, F.lit(SAID))
    clause = F.regexp_extract(F.substring(low, F.lit(1), at - 1), r"[^.!?;\n]*$", 0)
    return F.when(reply.isNull() | (at == 0), "unknown").when(clause.rlike(UNSURE), "unsure").when(clause.rlike(DENIED), "no").otherwise("yes")


def _number(v: Column, path: str) -> Column:
    """The number at a path, null if what is there is none."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|BOOLEAN)"), F.when(kind == "BOOLEAN", F.try_variant_get(v, path, "boolean").cast("double")).otherwise(F.try_variant_get(v, path, "double")))


def score_of(v: Column) -> Column:
    """The first numeric score: the candidate's own, the reply's, the candidate's attribution's."""
    paths = [f"$.candidates[0].{k}" for k in SCORES] + [f"$.{k}" for k in SCORES] + [f"$.candidates[0].attributionMetadata.{k}" for k in ATTRIBUTION_SCORES]
    return F.coalesce(*(_number(v, p) for p in paths))


def parse_reply(json: Column) -> Column:
    """A verdict's (available, is_watermarked, score, error) from a detector's JSON reply; never a guess."""
    v = F.try_parse_json(json)

    def text(path: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
        return F.when(kind == "STRING", F.try_variant_get(v, path, "string"))

    flag = F.when(F.schema_of_variant(F.try_variant_get(v, "$.watermarkDetected", "variant")) == "BOOLEAN", F.try_variant_get(v, "$.watermarkDetected", "boolean"))
    has = F.schema_of_variant(F.try_variant_get(v, "$.candidates[0]", "variant")).rlike("^OBJECT<.+>$")
    said = text("$.candidates[0].content.parts[0].text")
    said = F.when(strip(said) != "", said)
    meaning, score = reply_meaning(said), score_of(v)
    top = F.coalesce(*(_number(v, f"$.{k}") for k in SCORES))
    blocked = text("$.promptFeedback.blockReason")

    def out(ok: bool, yes=None, number=None, error=None) -> Column:
        return F.struct(F.lit(ok).alias("available"), (F.lit(None).cast("boolean") if yes is None else yes).alias("is_watermarked"), (F.lit(None).cast("double") if number is None else number).alias("score"), (F.lit(None).cast("string") if error is None else error).alias("error"))

    return (
        F.when(v.isNull() | ~F.schema_of_variant(v).rlike("^OBJECT"), out(False, error=F.lit("not a JSON object")))
        .when(flag.isNotNull(), out(True, flag, top))
        .when(~F.coalesce(has, F.lit(False)), out(False, error=F.when(blocked.isNotNull(), F.concat(F.lit("blocked: "), blocked)).otherwise("no candidates")))
        .when(said.isNull() & score.isNull(), out(False, error=F.lit("unrecognized reply")))
        .when(said.isNull(), out(True, None, score))
        .when(meaning == "unknown", out(False, error=F.lit("unrecognized verdict")))
        .when(meaning == "unsure", out(False, error=F.lit("uncertain verdict")))
        .otherwise(out(True, meaning == "yes", score))
    )


def parse_adapter(rc: Column, stdout: Column, stderr: Column) -> Column:
    """A verdict from what a local adapter printed: the last line is a JSON object with the three values."""
    v = F.try_parse_json(F.element_at(F.split(strip(stdout), "\n"), -1))
    is_object = F.schema_of_variant(v).rlike("^OBJECT")
    error = F.try_variant_get(v, "$.error", "string")
    score, bound = F.try_variant_get(v, "$.score", "double"), F.try_variant_get(v, "$.threshold", "double")
    flag = F.try_variant_get(v, "$.is_watermarked", "boolean")
    why = F.when(v.isNull(), "output is not JSON").when(~is_object, "output is not an object").when((rc != 0) | error.isNotNull(), F.coalesce(error, F.substring(stderr, 1, 300), F.lit("failed"))).when(flag.isNull() | score.isNull() | bound.isNull(), "a value is missing or malformed")
    ok = why.isNull()
    return F.struct(ok.alias("available"), F.when(ok, flag).alias("is_watermarked"), F.when(ok, score).alias("score"), F.when(ok, bound).alias("threshold"), why.alias("error"))


def check_input(df: DataFrame, length: str, kind: str, allow_large: bool = False, most: int = INPUT_CAP) -> DataFrame:
    """Adds status: a text over the cap or a binary input is not sent."""
    large = F.lit(False) if allow_large else F.col(length) > most
    return df.withColumn("status", F.when(large, "over the cap").when(F.col(kind) == "binary", "binary input").otherwise("ok"))


def ask(df: DataFrame, detector: str, send: Callable[[str], tuple[bool, bool | None, float | None, float | None, str | None]], scope_note: str = "", target: str = "target", text: str = "text") -> DataFrame:
    """(target, verdict columns): each text's verdict through send, on the executors; any failure is an unavailable verdict."""
    if detector not in rules.DETECTORS:
        raise ValueError(f"unknown detector: {detector}")
    ship(df.sparkSession)

    def rows(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for key, value in zip(batch["target"], batch["text"], strict=True):
                try:
                    got = send(value)
                except Exception as e:  # noqa: BLE001  a detector may fail in any way; that is its verdict
                    got = (False, None, None, None, str(e) or type(e).__name__)
                out.append((key, detector, got[0], got[1], got[2], got[3], scope_note, got[4]))
            yield pd.DataFrame(out, columns=["target", "detector", "available", "is_watermarked", "score", "threshold", "scope_note", "error"])

    own = df.select(F.col(target).alias("target"), F.col(text).alias("text"))
    return own.mapInPandas(rows, f"target {own.schema['target'].dataType.simpleString()}, {VERDICT}")


# The public API that answers for a vendor's detector.
GENERATE_URL = "https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent"
TASK = "DETECT_TEXT_WATERMARK"


def post_json(url: str, body: bytes, headers: dict[str, str], timeout: float) -> str:
    """The reply to a POST of JSON."""
    import urllib.request

    ask_ = urllib.request.Request(url, data=body, headers={"Content-Type": "application/json", **headers}, method="POST")
    with urllib.request.urlopen(ask_, timeout=timeout) as reply:
        return reply.read().decode("utf-8", "replace")


def http_replies(df: DataFrame, model: str, key_of: Callable[[], str | None], authorized: bool = False, post: Callable[[str, bytes, dict[str, str], float], str] = post_json, timeout: float = 30.0, target: str = "target", text: str = "text") -> DataFrame:
    """(target, reply, error): the detector's JSON reply to each text, or why there is none. Texts leave the cluster, so authorized must be True.

    key_of gives the key on the executor (from its environment, say): it is no part of the plan and
    goes into a header, never the URL.
    """
    import json
    import re

    if not authorized:
        raise PermissionError("sending texts to a vendor needs authorized=True")
    if not re.fullmatch(MODEL_NAME, model):
        raise ValueError(f"malformed model name: {model!r}")
    ship(df.sparkSession)

    def rows(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for key, value in zip(batch["target"], batch["text"], strict=True):
                try:
                    secret = key_of()
                    if not secret:
                        raise ValueError("no key is configured")
                    body = {"contents": [{"role": "user", "parts": [{"text": value}]}], "generationConfig": {"taskType": TASK}}
                    out.append((key, post(GENERATE_URL.format(model=model), json.dumps(body).encode(), {"x-goog-api-key": secret}, timeout), None))
                except Exception as e:  # noqa: BLE001  whatever fails, there is no reply
                    out.append((key, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["target", "reply", "error"])

    own = df.select(F.col(target).alias("target"), F.col(text).alias("text"))
    return own.mapInPandas(rows, f"target {own.schema['target'].dataType.simpleString()}, reply string, error string")


def http_verdicts(replies: DataFrame, detector: str = "gemini-synthid-text", scope_note: str = "") -> DataFrame:
    """(target, verdict columns) of http_replies(): a failure is an unavailable verdict, never a guess."""
    v = F.when(F.col("error").isNotNull(), F.struct(F.lit(False).alias("available"), F.lit(None).cast("boolean").alias("is_watermarked"), F.lit(None).cast("double").alias("score"), F.col("error").alias("error"))).otherwise(parse_reply(F.col("reply")))
    return replies.select("target", v.alias("v")).select("target", F.lit(detector).alias("detector"), "v.available", "v.is_watermarked", "v.score", F.lit(None).cast("double").alias("threshold"), F.lit(scope_note).alias("scope_note"), "v.error")


def run_command(command: list[str], text: str, timeout: float) -> tuple[int, str, str]:
    """(exit code, stdout, stderr) of a local adapter on a file that holds the text, its last argument."""
    import subprocess
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".txt", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        done = subprocess.run([*command, f.name], capture_output=True, text=True, timeout=timeout, check=False)
    return done.returncode, done.stdout, done.stderr


def adapter_verdicts(df: DataFrame, detector: str, command: list[str], run: Callable[[list[str], str, float], tuple[int, str, str]] = run_command, timeout: float = 30.0, scope_note: str = "", target: str = "target", text: str = "text") -> DataFrame:
    """(target, verdict columns): what a local adapter, started once a text on the executors, prints; every failure is an unavailable verdict."""
    if detector not in rules.DETECTORS:
        raise ValueError(f"unknown detector: {detector}")
    ship(df.sparkSession)

    def rows(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for key, value in zip(batch["target"], batch["text"], strict=True):
                try:
                    out.append((key, *run(command, value, timeout), None))
                except Exception as e:  # noqa: BLE001  an adapter may fail in any way; that is its verdict
                    out.append((key, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["target", "rc", "stdout", "stderr", "failed"]).astype({"rc": "Int32"})

    own = df.select(F.col(target).alias("target"), F.col(text).alias("text"))
    said = own.mapInPandas(rows, f"target {own.schema['target'].dataType.simpleString()}, rc int, stdout string, stderr string, failed string")
    v = F.when(F.col("failed").isNotNull(), F.struct(F.lit(False).alias("available"), F.lit(None).cast("boolean").alias("is_watermarked"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("threshold"), F.col("failed").alias("error"))).otherwise(parse_adapter(F.col("rc"), F.col("stdout"), F.col("stderr")))
    return said.select("target", v.alias("v")).select("target", F.lit(detector).alias("detector"), "v.available", "v.is_watermarked", "v.score", "v.threshold", F.lit(scope_note).alias("scope_note"), "v.error")


def run_detectors(df: DataFrame, senders: dict[str, Callable], target: str = "target", text: str = "text") -> DataFrame:
    """Verdicts of several detectors, in the vocabulary's order."""
    out = None
    for detector in rules.DETECTORS:
        if detector in senders:
            part = ask(df, detector, senders[detector], target=target, text=text)
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no detector was given")
    return out

"""Audits of streams: every operator that needs one row alone works on them as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import rules
from ..operators import routing, text


def stream_files(spark: SparkSession, path: str, most: int = rules.MAX_BYTES) -> DataFrame:
    """(target, seen, content) of files as they arrive in a folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(path)
    return files.select(F.col("path").alias("target"), F.col("modificationTime").alias("seen"), F.substring("content", 1, most).alias("content"))


def stream_texts(files: DataFrame) -> DataFrame:
    own = files.filter(routing.sniff(F.col("content")) == "text")
    return own.select("target", "seen", routing.decoded(F.col("content")).alias("text"))


def stream_occurrences(texts: DataFrame) -> DataFrame:
    """Occurrences of a stream of texts (target, text), without state."""
    return text.occurrences(texts)


def severity_by_window(texts: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(begin, severity, n) of texts (target, seen, text): counts in windows of time, closed as the watermark passes."""
    marked = texts.withWatermark("seen", late).withColumn("target", F.struct("target", "seen"))
    hits = text.occurrences(marked).select(F.col("target.seen").alias("seen"), "severity")
    return hits.groupBy(F.window("seen", window).alias("w"), "severity").agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), "severity", "n")


def audit_stream(texts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes all findings of each batch of texts to path, exactly once."""

    def batch(rows: DataFrame, number: int) -> None:
        text.scan_text(rows).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

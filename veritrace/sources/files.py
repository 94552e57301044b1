"""Files as assets, and reports and cleaned files as sinks."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import report, routing


def read_files(spark: SparkSession, path: str, most: int = rules.MAX_BYTES) -> DataFrame:
    """(target, content, truncated): one file or several, each cut at most bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("target"), F.substring("content", 1, most).alias("content"), (F.col("length") > most).alias("truncated"))


def read_texts(spark: SparkSession, path: str, most: int = rules.MAX_BYTES) -> DataFrame:
    """(target, text, truncated, kind): files as UTF-8 texts; kind tells whether they look like text."""
    own = read_files(spark, path, most)
    return own.select("target", routing.decoded(F.col("content")).alias("text"), "truncated", routing.sniff(F.col("content")).alias("kind"))


def read_directory(spark: SparkSession, path: str, most: int = rules.MAX_BYTES, include_hidden: bool = False) -> tuple[DataFrame, DataFrame]:
    """(assets, skipped): all files below a directory. Files over the cap are skipped, not cut, as are dot files and
    folders unless include_hidden; sizes are known from the listing, so skipped files are never read.

    Spark's listing leaves names out that begin with a dot or an underscore: these, a few as a rule, are
    listed and read by the driver.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = base.getFileSystem(spark._jsc.hadoopConfiguration())
    root = store.makeQualified(base).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    own = files.withColumn("target", F.replace(F.regexp_replace("path", r"^file:/+", "file:/"), F.lit(root), F.lit("")))
    assets, skipped = own.filter(F.col("length") <= most).select("target", "content"), own.filter(F.col("length") > most).select("target", "length")
    passed, large = [], []
    listed = store.listFiles(base, True)
    while listed.hasNext():
        status = listed.next()
        target = status.getPath().toString().removeprefix(root)
        parts = target.split("/")
        if not any(p[0] in "._" for p in parts) or (not include_hidden and any(p[0] == "." for p in parts)):
            continue
        if status.getLen() > most:
            large.append((target, status.getLen()))
            continue
        stream = store.open(status.getPath())
        try:
            passed.append((target, bytearray(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
        finally:
            stream.close()
    if passed:
        assets = assets.unionByName(spark.createDataFrame(passed, "target string, content binary"))
    if large:
        skipped = skipped.unionByName(spark.createDataFrame(large, "target string, length bigint"))
    return assets, skipped


def write_reports(reported: DataFrame, path: str, form: str = "json") -> None:
    """Reports as JSON lines, or to read; Spark's commit protocol makes the folder appear whole or not at all."""
    made = report.json_reports(reported).select("json") if form == "json" else report.human_reports(reported).select("text")
    made.write.mode("errorifexists").text(path)


def output_path(source: str, output: str | None = None, force: bool = False) -> str:
    """Where a cleaned file goes: next to its source unless told; never over the source, a link, or, without force, a file."""
    stem, ext = os.path.splitext(source)
    target = output or f"{stem}.cleaned{ext}"
    if os.path.realpath(target) == os.path.realpath(source):
        raise ValueError("a file is never cleaned in place")
    if os.path.islink(target):
        raise ValueError("the output is a symbolic link")
    if os.path.exists(target) and not force:
        raise FileExistsError(target)
    return target


def write_whole(path: str, data: bytes) -> None:
    """The file appears with all its bytes or not at all."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise

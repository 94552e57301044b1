"""Shared helpers: staged tables in the cluster's shared folder, names that cannot clash."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..functions.staging import scratch, shared_dir, staged  # noqa: F401  for the operators

#: A word, as the contracts define it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a batch that a worker holds at once.
BATCH_ROWS = 1000
#: A key with more than one in so many of a join's rows is hot: there are fewer than that, whatever the input.
HOT = 2000


def discard(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def salted_join(rows: DataFrame, per_key: DataFrame, key: list[str], count: str, spread: str, how: str = "inner") -> DataFrame:
    """rows joined to per_key, which has one row a key and in column count how many of rows it has, at most.

    No task gets all rows of a hot key: the list of hot keys, fewer than HOT, goes to all tasks, and
    what they hold is dealt over several salts by column spread. For inner and left joins; columns
    of the name __salt are not allowed. per_key is best staged, as it is read twice.
    """
    found = per_key.agg(F.sum(count).alias("total"), F.max(count).alias("most")).first()
    share = max(64, (found["total"] or 0) // HOT)
    if (found["most"] or 0) <= share:
        return rows.join(per_key, key, how)
    salts = F.ceil(F.col(count) / share).cast("int")
    hot = per_key.filter(F.col(count) > share).select(*key, salts.alias("__salt"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("__salt")).cast("int"), F.lit(0)))
    every = per_key.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(F.col(count) > share, salts - 1).otherwise(0))))
    return dealt.join(every, [*key, "__salt"], how).drop("__salt")


def numbers(xs: list) -> Column:
    """A constant array, however long, as one literal of the plan."""
    return F.from_json(F.lit(json.dumps(xs)), "array<bigint>")


def range_number(column: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts lie below a number, found by way of every so-manieth cut; 0 for a null."""
    coarse = max(1, round(len(cuts) ** 0.5))
    whole = F.size(F.filter(numbers(cuts[::coarse]), lambda c: c < column))
    fine = F.size(F.filter(F.slice(numbers(cuts), F.greatest((whole - 1) * coarse, F.lit(0)) + 1, coarse), lambda c: c < column))
    return F.when(column.isNull() | F.lit(not cuts), 0).when(whole == 0, 0).otherwise((whole - 1) * coarse + fine).cast("int")


def by_ranges(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows dealt by ascending ranges of a number, nulls first, and sorted within; only the key is read to find the ranges."""
    n = partitions(rows.sparkSession)
    cuts = rows.agg(F.percentile_approx(key, [k / n for k in range(1, n)] or [0.5], 20 * n)).first()[0] or []
    return rows.repartitionById(n, range_number(F.col(key), sorted(set(cuts[: n - 1])))).sortWithinPartitions(key, *order)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions the cluster is tuned to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, rows, ddl: str) -> DataFrame:
    """mapInArrow with this package at hand in the workers.

    Rows here are whole texts: a batch holds BATCH_ROWS of them at most, or as few as the session asks for.
    """
    spark = df.sparkSession
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(rows, ddl)


def ascii_lower(column):
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations alone.

Each source gets a budget of words. Whole passes over the source take what they can; the rest of
the budget goes to the documents whose hash is below a threshold. The threshold is found without
sorting: words are summed by source and by the hash's next BITS bits, the bucket in which the budget
runs out becomes the boundary, and only its documents are summed again by the next bits, until the
boundary holds a single hash. Its documents then share what is left. So the same rows give the same
mix in any order and partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, discard, staged, table

#: Bits of the hash that one histogram resolves, and bits in all.
BITS, HASH_BITS = 12, 48
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0


def hash_of(column):
    """The first 48 bits of the MD5 of an id's text; null counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds target to rows (source, source_size), a row a source.

    Sources in order of code points, null last, weigh weights, repeating, and share share times all
    words; no target passes most times its source's size, and what is cut off is shared again by
    weight. The end of that is a level: each target is weight * level or its bound. The level is
    read off running sums over the sources in order of bound / weight. Sources are few beside
    documents: this is one task over one row a source.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(by_name) - 1) % len(weights)).cast("int") + 1)
    rows = sources.withColumn("w", w).withColumn("bound", F.col("source_size") * F.lit(most))
    every = Window.partitionBy(F.lit(0))
    by_ratio = every.orderBy(F.col("bound") / F.col("w"), "w", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("pool", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("bound_before", F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        # If all sources before this one are at their bounds, the rest share at this level.
        .withColumn("level", F.greatest(F.lit(0.0), (F.col("pool") - F.col("bound_before")) / F.col("w_left")))
        .withColumn("open", F.col("level") * F.col("w") < F.col("bound"))
    )
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("target", F.least("bound", F.coalesce(F.col("w") * level, "bound"))).select("source", "source_size", "target")


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), a row for each row of docs.

    size: words of the text, none if null. taken: words that the mix takes of the row, repeats
    counted: whole passes, one more below the threshold, and of the rows at it a share of what is
    left, so a source's words come to its target rounded down, but for the rounding of each such row.
    Rows of one id have one hash. A null source is a source, the last; a source without words has
    target and taken zero. Columns of other names are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words_in(F.col(text_col)).alias("size"))
    rows = staged(rows.withColumn("hash", hash_of(F.col("doc_id"))), "sizes")  # the texts are read once
    return _taken(rows, thresholds(rows, weights, share, most))


def words_in(text):
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def thresholds(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """For each source of rows (source, size, hash) its source_size, target, passes, prefix and rest:
    whole passes, the hash below which rows are taken once more, and the words left for rows at it.
    """
    budgets = staged(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    # The state of the search, a row a source: the hash bits settled so far, and the words still to take there.
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = budgets.withColumn("passes", passes).withColumn("rest", F.greatest(F.lit(0), F.floor(F.col("target")) - F.col("passes") * F.col("source_size")).cast("long")).withColumn("prefix", F.lit(0).cast("long"))
    shift = HASH_BITS
    while shift:
        shift = shift - BITS
        inside = rows.withColumnRenamed("source", "s").join(state, _same("s", "source"))
        if shift + BITS < HASH_BITS:
            inside = inside.filter(F.shiftright("hash", shift + BITS) == F.col("prefix"))
        bucket = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        # A source's buckets, at most 2**BITS of them, in one row: the boundary is the first at which the running sum passes the rest.
        listed = bucket.filter("n > 0").groupBy("source").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("buckets"))
        step = F.aggregate(
            "buckets",
            F.struct(F.lit(None).cast("long").alias("at"), F.col("rest").alias("rest")),
            lambda acc, x: F.when(acc["at"].isNotNull(), acc).when(x["n"] > acc["rest"], F.struct(x["bucket"].alias("at"), acc["rest"].alias("rest"))).otherwise(F.struct(F.lit(None).cast("long").alias("at"), (acc["rest"] - x["n"]).alias("rest"))),
        )
        kept = state.columns
        moved = state.join(listed.withColumnRenamed("source", "s"), _same("s", "source"), "left").withColumn("step", step)
        # A source without words has no boundary: no bucket and no hash is at or below -1.
        moved = moved.withColumn("prefix", F.coalesce("step.at", F.lit(-1).cast("long"))).withColumn("rest", F.when(F.col("step.at").isNotNull(), F.col("step.rest")).otherwise(F.coalesce("step.rest", "rest")))
        before, state = state, staged(moved.select(kept), "thresholds")
        discard(before)
    return state


def _taken(rows: DataFrame, state: DataFrame, sizes: DataFrame | None = None, extra: list[str] | None = None) -> DataFrame:
    """Applies the thresholds; state.prefix is now a whole hash. sizes: the same rows in a narrower table."""
    small = (rows if sizes is None else sizes).withColumnRenamed("source", "s").join(state, _same("s", "source"))
    at = small.filter(F.col("hash") == F.col("prefix")).groupBy("source").agg(F.sum("size").alias("tied"))
    # A row a source, written: Spark then knows how small it is, and the texts need not be shuffled to meet it.
    state = staged(state.join(at.withColumnRenamed("source", "ts"), _same("ts", "source"), "left").drop("ts"), "thresholds")
    joined = rows.withColumnRenamed("source", "s").join(state, _same("s", "source"))
    part = F.when(F.col("hash") < F.col("prefix"), F.col("size")).when((F.col("hash") == F.col("prefix")) & (F.col("tied") > 0), F.floor(F.col("size").cast("decimal(20,0)") * F.col("rest") / F.col("tied"))).otherwise(0).cast("long")
    return joined.select(*(extra or ["doc_id"]), "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + part).alias("taken"))


def draw(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", chars_col: str = "n_chars", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: every row of docs as often as the mix takes it, with the columns of docs.

    A row at its source's threshold is cut after the words that the mix takes of it; chars_col, if
    docs has it, then tells the length of what is left. Cases are those of mix().
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias("d"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    keyed = keyed.select("d", "text", "source", words_in(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("hash"))
    rows = staged(keyed.select("source", "size", "hash"), "sizes")
    state = thresholds(rows, weights, share, most)
    taken = _taken(keyed, state, rows, extra=["d", "text"])
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("long")
    part = F.col("taken") - whole * F.col("size")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    out = taken.select("d", "text", F.explode(copies).alias("cut"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("cut").cast("int")), "")
    out = out.select("d", "cut", F.when(F.col("cut") > 0, cut).otherwise(F.col("text")).alias("text"))

    def column(name: str):
        own = F.col("d").getField(name)
        if name == text_col:
            own = F.when(F.col("cut") > 0, F.col("text")).otherwise(own)
        elif name == chars_col:
            own = F.when(F.col("cut") > 0, F.char_length("text").cast(docs.schema[name].dataType)).otherwise(own)
        return own.alias(name)

    return out.select(*(column(c) for c in docs.columns))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents: sources weigh 3, 1, 2, repeating, share 150 % of all words and stop at twice their own."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, 2.0::DOUBLE * source_size AS bound, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, w, source NULLS LAST) AS k FROM s
), v AS (
  SELECT a.source, a.source_size, a.w, a.bound, a.k,
         greatest(0.0::DOUBLE, ((SELECT 1.5::DOUBLE * sum(source_size) FROM s)
           - coalesce((SELECT sum(b.bound) FROM o b WHERE b.k < a.k), 0.0::DOUBLE))
         / (SELECT sum(b.w) FROM o b WHERE b.k >= a.k)) AS level
  FROM o a
), t AS (
  SELECT source, source_size,
         least(bound, coalesce(w * (SELECT level FROM v x WHERE x.level * x.w < x.bound ORDER BY x.k LIMIT 1), bound)) AS target
  FROM v
), p AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t
), r AS (
  SELECT *, greatest(0, CAST(floor(target) AS BIGINT) - passes * source_size) AS rest FROM p
), c AS (
  SELECT d.*, r.source_size, r.target, r.passes, r.rest,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS BIGINT) AS upto,
         CAST(sum(size) OVER (PARTITION BY d.source, h) AS BIGINT) AS tied
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
       CAST(passes * size + CASE WHEN upto <= rest THEN size
            WHEN upto - tied <= rest THEN (size::HUGEINT * (rest - (upto - tied))) // tied ELSE 0 END AS BIGINT) AS taken
FROM c
"""

"""Homomorphic multiset fingerprints of documents, in DataFrame operations alone.

A document is the multiset of its paragraphs (lines). Each paragraph is hashed to a wide vector and
the fingerprint is the sum of the vectors, lane by lane modulo a power of two, so the order of
paragraphs does not matter and paragraphs can be added or taken out by adding or subtracting theirs.

The vector of a paragraph has two parts. EQUAL lanes of 32 bits come from hashes of the whole
paragraph; they carry equality. LIKE lanes of 32 bits hold, for every word of the paragraph, plus or
minus one by the bits of a hash of the word and its two successors there; their products estimate
how many such runs of words two documents share, which is the likeness of two fingerprints. A text
is below 2**31 bytes and so has fewer than 2**30 words: its LIKE lanes never wrap.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, table

EQUAL, LIKE = 16, 128
LINE_END = "\n"
#: Seeds of the hashes, so that the parts are independent.
_EQUAL_SEED, _LIKE_SEED = 1, 1001
_LOW32 = 0xFFFFFFFF


def _lane(column):
    """The sum modulo 2**32, as a signed integer of 32 bits."""
    half = F.lit(1 << 31)
    return (F.pmod(column + half, F.lit(1 << 32)) - half).cast("int")


def vectors(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key..., fp): the fingerprint of each key's text, an array of EQUAL + LIKE integers.

    A null text is empty; the empty text is one empty paragraph without words. Words end at ASCII
    white space. Texts are taken apart where they lie; if the rows are already dealt by some of the
    key's columns, nothing is shuffled, else partial sums are.
    """
    k = [F.col(c) for c in key]
    lines = texts.select(*k, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), LINE_END)).alias("line"))
    words = F.split(F.col("line"), r"[\x20\x09-\x0D]+")
    runs = lines.select(*k, "line", words.alias("w")).select(*k, "line", F.posexplode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, 1 << 30).alias("b"), F.slice("w", 3, 1 << 30).alias("c"))).alias("at", "run"))
    run = [F.col("run")[c] for c in ("a", "b", "c")]
    real = F.col("run")["a"] != ""
    first = F.col("at") == 0
    hashed = runs.select(*k, "line", first.alias("first"), real.alias("real"), *(F.xxhash64(*run, F.lit(_LIKE_SEED + i)).alias(f"h{i}") for i in range(LIKE // 64)))
    sums = [F.sum(F.when(F.col("real"), 1).otherwise(0).cast("long")).alias("n")]
    # Two lanes a sum: bit k of a hash in the low half, bit k + 32 in the high half.
    for i in range(LIKE // 64):
        for b in range(32):
            sums.append(F.sum(F.when(F.col("real"), F.shiftright(F.col(f"h{i}"), b).bitwiseAND(F.lit(0x100000001))).otherwise(F.lit(0).cast("long"))).alias(f"s{i}_{b}"))
    for e in range(EQUAL // 2):
        h = F.xxhash64("line", F.lit(_EQUAL_SEED + e))
        sums.append(F.sum(F.when(F.col("first"), h.bitwiseAND(F.lit(_LOW32))).otherwise(F.lit(0).cast("long"))).alias(f"e{e}_0"))
        sums.append(F.sum(F.when(F.col("first"), F.shiftrightunsigned(h, 32)).otherwise(F.lit(0).cast("long"))).alias(f"e{e}_1"))
    total = hashed.groupBy(*key).agg(*sums)
    lanes = [_lane(F.col(f"e{e}_{half}")) for e in range(EQUAL // 2) for half in (0, 1)]
    for i in range(LIKE // 64):
        for b in range(32):
            for ones in (F.col(f"s{i}_{b}").bitwiseAND(F.lit(_LOW32)), F.shiftrightunsigned(F.col(f"s{i}_{b}"), 32)):
                lanes.append(_lane(2 * ones - F.col("n")))
    return total.select(*key, F.array(*lanes).alias("fp"))


def combine(a, b, sign: int = 1):
    """The fingerprint of the union of two documents' paragraphs, or with sign -1 of their difference."""

    return F.zip_with(a, b, lambda x, y: _lane(x.cast("long") + sign * y.cast("long")))


def text_of(fp):
    """Fixed-width lowercase hex of a fingerprint."""
    return F.lower(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(_LOW32))), 8, "0")), ""))


def likeness(a, b):
    """0 to 1: the cosine of the LIKE lanes, not below 0.

    1 for equal fingerprints, and for those whose runs of words occur in the same proportions (a
    text and itself twice); 0 if one of two unlike fingerprints has no words.
    """

    def dot(x, y):
        return F.aggregate(F.zip_with(F.slice(x, EQUAL + 1, LIKE), F.slice(y, EQUAL + 1, LIKE), lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)

    cosine = dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    return F.when(a == b, 1.0).when((dot(a, a) == 0) | (dot(b, b) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def _numbers(xs: list) -> F.Column:
    """A constant array, however long, as one literal of the plan."""
    return F.from_json(F.lit(json.dumps(xs)), "array<bigint>")


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, nth, guest, doc_id, text, next_text): rows in descending order of ids with the text of the next.

    The first row follows the last; rows of one id are in order of their texts, null ids come last,
    a single row is its own next. Rows are dealt once, into ranges of ids between percentiles, a few
    ranges a shuffle partition; nth is the place in the range. Each range ends with a guest, a copy
    of the row after its last, whose next_text means nothing.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    wanted = 4 * partitions(spark)
    cuts = rows.agg(F.percentile_approx("doc_id", [k / wanted for k in range(1, wanted)], 20 * wanted)).first()[0] or []
    # Range 0 has the largest ids; an id's range is the number of cuts at or above it, counted by way of every coarse-th cut.
    cuts = sorted(set(cuts), reverse=True)
    coarse = max(1, round(len(cuts) ** 0.5))
    whole = F.size(F.filter(_numbers(cuts[::coarse]), lambda c: c >= F.col("doc_id")))
    fine = F.size(F.filter(F.slice(_numbers(cuts), F.greatest((whole - 1) * coarse, F.lit(0)) + 1, coarse), lambda c: c >= F.col("doc_id")))
    own = F.when(F.col("doc_id").isNull(), len(cuts)).when(F.lit(not cuts), 0).when(whole == 0, 0).otherwise((whole - 1) * coarse + fine).cast("int")
    rows = rows.withColumn("own", own)
    heads = {r["own"]: r["head"] for r in rows.groupBy("own").agg(F.max("doc_id").alias("head")).collect()}  # a row a range
    filled = sorted(heads)
    before = {p: filled[i - 1] for i, p in enumerate(filled)}
    every = range(len(cuts) + 1)
    head, host = (F.element_at(_numbers([x.get(p) for p in every]), F.col("own") + 1) for x in (heads, before))
    hosts = F.when(F.col("doc_id").eqNullSafe(head), F.array(F.lit(None).cast("int"), host.cast("int"))).otherwise(F.array(F.lit(None).cast("int")))
    dealt = rows.select("own", "doc_id", "text", F.explode(hosts).alias("host"))
    dealt = dealt.select(F.coalesce("host", "own").alias("part"), F.col("host").isNotNull().alias("guest"), "doc_id", "text")
    order = Window.partitionBy("part").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    found = dealt.select("part", F.row_number().over(order).alias("nth"), "guest", "doc_id", "text", F.lead("text").over(order).alias("next_text"), F.lag("guest").over(order).alias("late"))
    return found.filter(~F.col("guest") | ~F.coalesce("late", F.lit(True))).drop("late")  # of guests of one id, the first alone


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp), a row for each row of docs.

    The edited text has its last floor(n_chars / 2) code points replaced by as many of the next
    document's first ones, or all of them. A null text is empty, and the next of a single row is
    itself. Rows of one id follow each other in order of their texts and repeated rows are rows of
    their own, all of them in one range, as rows of null ids are, which come last; ids are meant to
    be mostly distinct. Texts are whole, however long. An empty table gives no rows; columns of
    other names are ignored.
    """
    near = neighbours(docs, id_col, text_col)
    n = F.char_length("text")
    half = F.expr("char_length(text) div 2").cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    near = near.select("part", "nth", "guest", "doc_id", n.cast("long").alias("n_chars"), "text", F.when(~F.col("guest"), edited).alias("edited"))
    own = F.struct(F.lit("").alias("sha"), F.col("text").alias("text"))
    changed = F.struct(F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), F.col("edited").alias("text"))
    both = near.select("part", "nth", "guest", "doc_id", "n_chars", F.explode(F.when(F.col("guest"), F.array(own)).otherwise(F.array(own, changed))).alias("v"))
    key = ["part", "nth", "guest", "doc_id", "n_chars", "sha"]
    made = vectors(both.select("part", "nth", "guest", "doc_id", "n_chars", "v.sha", "v.text"), key)
    # A row's own vector comes first, then that of its edited text, then the next row's own: all in one range.
    order = Window.partitionBy("part").orderBy("nth", "sha")
    found = made.select("guest", "doc_id", "n_chars", "sha", "fp", F.lead("sha").over(order).alias("edited_sha256"), F.lead("fp").over(order).alias("edited_fp"), F.lead("fp", 2).over(order).alias("next_fp"))
    return found.filter((F.col("sha") == "") & ~F.col("guest")).drop("sha", "guest")


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, their edited texts and how like these and the next documents they are."""
    made = edits(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_chars", "edited_sha256", text_of("fp").alias("fingerprint"), text_of("edited_fp").alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))

"""Toxicity grades by cumulative-link ordinal regression on sparse features of words.

Features are the words of a text and their first 3 to 6 letters, each valued by its share of the
words: log(1 + 200 * count / (words + 20)). Grades are 0 (clean), 1 and 2 (toxic, below or from the
median share of marked words among toxic rows: the labels say no more than toxic or not). What is
marked in one half of the sample is told by a model fitted on the other half. One weight vector serves all thresholds:
P(grade > k) = sigmoid(w . x - threshold_k); the expected severity is the sum of these.

The model is fitted on a bounded sample of labelled rows, SAMPLE of either label, those whose ids
hash lowest. Scoring reads whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, staged, table
from .tokens import slices

#: Labelled rows of either label that the model may be fitted on, and features it may weigh.
SAMPLE, FEATURES = 5000, 2048
PREFIXES = (3, 4, 5, 6)
GRADES = 3
#: From this probability of a grade above 0 on, a document is rejected.
REJECT = 0.5
#: The L1 penalty of the weight with the most evidence.
PENALTY = 2e-4
#: What the clean rows weigh in the fit: more than half, as a clean document lost is worse.
CLEAN = 0.7
#: Values that the fit multiplies at a time.
CHUNK = 1 << 16
_WORD = re.compile(r"[^\W\d_]+")


def counts(text: str) -> Counter:
    """The words of a text, in lower case, without digits and signs around them."""
    out: Counter = Counter()
    for part in slices(text):
        out.update(_WORD.findall(part.lower()))
    return out


def value(count, words):
    """A feature's value; short texts are taken as a little longer, so one word is not all."""
    return np.log1p(200 * count / (words + 20))


def features(words: Counter) -> Counter:
    """Counts of whole words (ending in a blank) and prefixes."""
    out: Counter = Counter()
    for w, n in words.items():
        out[w + " "] += n
        for k in PREFIXES:
            if len(w) >= k:
                out[w[:k]] += n
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()

    def __post_init__(self):
        self.starts = {f[: PREFIXES[0]] for f in self.weights}

    def vector(self, words: Counter) -> Counter:
        out: Counter = Counter()
        for w, n in words.items():
            if w[: PREFIXES[0]] in self.starts or w + " " in self.weights:
                for f in (w + " ", *(w[:k] for k in PREFIXES if len(w) >= k)):
                    if f in self.weights:
                        out[f] += n
        return out

    def above(self, text: str) -> list[float]:
        """P(grade > k) for every threshold k."""
        if not self.thresholds:
            return [0.0] * (GRADES - 1)
        words = counts(text)
        size = sum(words.values())
        score = sum(self.weights[f] * value(n, size) for f, n in self.vector(words).items())
        return [float(1 / (1 + np.exp(np.clip(t - score, -500, 500)))) for t in self.thresholds]


def _sums(to: np.ndarray, of: np.ndarray, x: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """The sums of x * weights[of] by to; the driver holds no more than CHUNK products, added in their order."""
    out = np.zeros(size)
    for a in range(0, len(x), CHUNK):
        own = slice(a, a + CHUNK)
        np.add.at(out, to[own].astype(np.intp), weights[of[own]] * x[own])
    return out


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, x: np.ndarray, grade: np.ndarray, penalty: np.ndarray, steps: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds by proximal gradient steps on the cumulative-link likelihood.

    Each threshold is one yes/no question (grade above k?) with the shared weights; in sum the noes
    weigh CLEAN of it, however many they are. penalty: the L1 penalty of each weight; weights are not negative:
    a word can only be evidence of toxicity.
    """
    n, p = len(grade), len(penalty)
    k = len(np.unique(grade)) - 1
    asked = [(grade > g).astype(float) for g in range(k)]
    share = [np.where(a > 0, (1 - CLEAN) / max(a.sum(), 1), CLEAN / max((1 - a).sum(), 1)) for a in asked]
    w, t = np.zeros(p), np.zeros(k)
    v, u, mass = w.copy(), t.copy(), 1.0
    # The steepest the slope can rise, by power iteration on the weighted rows; a logistic bends at most a quarter.
    pull, z = sum(share), np.ones(p)
    for _ in range(50):
        z = _sums(cols, rows, x, pull * _sums(rows, cols, x, z, n), p)
        top = np.linalg.norm(z)
        z /= max(top, 1e-12)
    rate = 4.0 / (1.05 * top + 2 * float(pull.sum()))
    for _ in range(steps):
        score = _sums(rows, cols, x, v, n)
        slope, turn = np.zeros(n), np.zeros(k)
        for g in range(k):
            d = share[g] * (1 / (1 + np.exp(np.clip(u[g] - score, -500, 500))) - asked[g])
            slope += d
            turn[g] = -d.sum()
        new_w = np.maximum(0.0, v - rate * (_sums(cols, rows, x, slope, p) + penalty))
        new_t = np.maximum.accumulate(u - rate * turn)
        new_mass = (1 + np.sqrt(1 + 4 * mass * mass)) / 2
        v, u = new_w + (mass - 1) / new_mass * (new_w - w), new_t + (mass - 1) / new_mass * (new_t - t)
        w, t, mass = new_w, new_t, new_mass
    return w, t


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(toxic, text) of the labelled sample, equal texts once."""
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna().groupBy("id").agg(F.max("toxic").alias("toxic"))
    drawn = [own.filter(F.col("toxic") > 0), own.filter(F.col("toxic") == 0)]
    drawn = [x.orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for x in drawn]
    chosen = drawn[0].union(drawn[1])  # at most 2 * SAMPLE rows of two numbers
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "id").withColumn("h", F.xxhash64("text"))
    return staged(found.dropDuplicates(["h", "toxic"]).select(F.xxhash64("id", "h").alias("row"), F.col("toxic").cast("long").alias("toxic"), "text"), "labelled")


def _evidence(sample: DataFrame, n: list[int]) -> list[tuple[str, float]]:
    """The features that most speak for toxic rows, with their log-likelihood ratios, at most FEATURES."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter(), Counter()]
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text"), strict=True):
                seen[min(toxic, 1)].update(features(counts(text.as_py())).keys())
        for c in range(2):
            yield pa.RecordBatch.from_pydict({"feature": list(seen[c].keys()), "clean": [k * (1 - c) for k in seen[c].values()], "toxic": [k * c for k in seen[c].values()]}, schema=pa.schema([("feature", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())]))

    df = map_batches(sample, rows, "feature string, clean bigint, toxic bigint").groupBy("feature").agg(F.sum("clean").cast("double").alias("a"), F.sum("toxic").cast("double").alias("b"))
    na, nb = float(n[0]), float(n[1])

    def term(k, of):
        return F.when(k > 0, k * F.log(k / of)).otherwise(0.0)

    both = F.col("a") + F.col("b")
    ratio = 2 * (term(F.col("a"), both * na / (na + nb)) + term(F.col("b"), both * nb / (na + nb)) + term(na - F.col("a"), (na + nb - both) * na / (na + nb)) + term(nb - F.col("b"), (na + nb - both) * nb / (na + nb)))
    best = df.filter((F.col("b") >= 2) & (F.col("b") / nb > F.col("a") / na)).withColumn("g", ratio).orderBy(F.col("g").desc(), "feature").limit(FEATURES)
    return [(r["feature"], r["g"]) for r in best.select("feature", "g").collect()]


def _severe(rows: np.ndarray, cols: np.ndarray, x: np.ndarray, share: np.ndarray, toxic: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """The rows whose share of marked words is the toxic rows' median or more; share: each value's share of its row's words.

    Every other row, in the order of their hashes, is marked by a yes/no model of the rest; none is
    severe if either half lacks clean or toxic rows.
    """
    n = len(toxic)
    half, marked = np.arange(n) % 2 == 1, np.zeros(n)
    for other in (half, ~half):
        if not toxic[other].any() or toxic[other].all():
            return np.zeros(n, bool)
        own = other[rows]
        w, _ = fit_ordinal((np.cumsum(other) - 1).astype(np.int32)[rows[own]], cols[own], x[own], toxic[other].astype(int), penalty)
        marked += np.where(other, 0.0, _sums(rows, cols, share, (w > 0).astype(float), n))
    return marked >= np.median(marked[toxic])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model of the labelled rows; without labels of both kinds it finds nothing toxic.

    Null ids and labels are left out, an id with several labels is toxic if any says so, and labels
    of absent ids count for nothing; equal texts count once. The driver gets the sample's counts of
    at most FEATURES features a row: 2 * SAMPLE rows of a few kilobytes, some 40 MB, at any size.
    """
    sample = _sample(docs, labels, id_col, text_col, label_col)
    size = {min(r["toxic"], 1): r["count"] for r in sample.groupBy("toxic").count().collect()}
    n = [size.get(0, 0), size.get(1, 0)]
    if not all(n):
        return Model()
    evidence = _evidence(sample, n)
    if not evidence:
        return Model()
    place = {f: i for i, (f, _) in enumerate(evidence)}
    chosen = Model(dict.fromkeys(place, 1.0))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, label, text in zip(*(batch.column(c).to_pylist() for c in ("row", "toxic", "text")), strict=True):
                own = counts(text)
                got = chosen.vector(own)
                out.append({"row": row, "toxic": label, "words": sum(own.values()), "at": [place[f] for f in got], "n": [float(k) for k in got.values()]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("row", pa.int64()), ("toxic", pa.int64()), ("words", pa.int64()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.float64()))]))

    # The bounded sample, as columns.
    got = map_batches(sample, rows, "row bigint, toxic bigint, words bigint, at array<int>, n array<double>").toArrow().sort_by("row")
    at = np.repeat(np.arange(got.num_rows, dtype=np.int32), pc.list_value_length(got.column("at")).to_numpy())
    cols = pc.list_flatten(got.column("at")).to_numpy()
    values = pc.list_flatten(got.column("n")).to_numpy()
    toxic = got.column("toxic").to_numpy() > 0
    words = got.column("words").to_numpy().astype(np.float64)
    del got
    x = value(values, words[at])
    share = values / np.maximum(1, words)[at]
    del values
    pa.default_memory_pool().release_unused()  # the driver goes on with other stages
    g = np.asarray([x for _, x in evidence])
    penalty = PENALTY * g.max() / g  # the less evidence, the dearer
    grade = toxic.astype(int) + (toxic & _severe(at, cols, x, share, toxic, penalty))
    w, t = fit_ordinal(at, cols, x, grade, penalty)
    return Model({f: float(w[i]) for f, i in place.items() if w[i] > 0}, tuple(t.tolist()) + (np.inf,) * (GRADES - 1 - len(t)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs and p_toxic, expected_severity, grade (the likeliest number of thresholds passed) and rejected.

    A null or empty text is clean, whatever its label; texts are scored whole, however long; rows
    that repeat, and texts that tie, get the same marks; an empty table gives no rows. A column of
    docs that has one of these names is replaced.
    """
    added = ["p_toxic", "expected_severity", "grade", "rejected"]
    kept = [c for c in docs.columns if c not in added]
    schema = pa.schema([("p_toxic", pa.float64()), ("expected_severity", pa.float64()), ("grade", pa.int32()), ("rejected", pa.bool_())])
    text_at = kept.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [model.above(x.as_py() or "") for x in batch.column(text_at)]
            made = [pa.array([x[0] for x in p], pa.float64()), pa.array([sum(x) for x in p], pa.float64()), pa.array([sum(y >= 0.5 for y in x) for x in p], pa.int32()), pa.array([x[0] >= REJECT for x in p], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema=pa.schema([*batch.schema, *schema]))

    out = T.StructType([*docs.select(*kept).schema.fields, T.StructField("p_toxic", T.DoubleType()), T.StructField("expected_severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("rejected", T.BooleanType())])
    return map_batches(docs.select(*kept), rows, out)


def op10_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of all documents by the model of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", "p_toxic", "expected_severity", "grade", "rejected")

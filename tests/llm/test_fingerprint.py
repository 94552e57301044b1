import collections
import hashlib
import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veritrace.llm import fingerprint as q


def lanes(text):
    """The LIKE lanes, from the words alone."""
    runs = collections.Counter()
    for line in text.split("\n"):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", line)]
        runs.update(tuple(w[i : i + 3]) for i in range(len(w)) if w[i])
    out = np.zeros(q.LIKE, object)
    for run, n in runs.items():
        h = 42  # a row's columns are hashed one after the other, each with the last hash as its seed
        for x in run:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        for i in range(q.LIKE // 64):
            bits = xxhash.xxh64_intdigest(np.int32(q._LIKE_SEED + i).tobytes(), h)
            out[64 * i : 64 * i + 64] += [n if bits >> b & 1 else -n for half in range(32) for b in (half, half + 32)]
    return out


def near(x, y):
    a, b = lanes(x), lanes(y)
    if x == y or sorted(x.split("\n")) == sorted(y.split("\n")):
        return 1.0
    if not a.dot(a) or not b.dot(b):
        return 0.0
    return max(0.0, min(1.0, a.dot(b) / math.sqrt(a.dot(a) * b.dot(b))))


def check(df):
    docs = [(r[0], r[1] or "") for r in df.select("doc_id", "text").collect()]
    docs.sort(key=lambda x: x[1])
    docs.sort(key=lambda x: (x[0] is None, -(x[0] or 0)))
    want, texts = [], {}
    for k, (d, x) in enumerate(docs):
        y = docs[(k + 1) % len(docs)][1]
        e = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        row = (str(d), len(x), hashlib.sha256(e.encode()).hexdigest())
        want.append(row)
        texts[row] = (x, e, y)
    got = q.edits(df).select("doc_id", "n_chars", "edited_sha256", *(q.text_of(c).alias(c) for c in ("fp", "edited_fp", "next_fp")), q.likeness(F.col("fp"), F.col("edited_fp")).alias("a"), q.likeness(F.col("fp"), F.col("next_fp")).alias("b")).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    seen = {}
    for r in got:
        for text, fp in zip(texts[str(r.doc_id), r.n_chars, r.edited_sha256], (r.fp, r.edited_fp, r.next_fp), strict=True):
            key = tuple(sorted(text.split("\n")))  # paragraphs in any order
            assert seen.setdefault(key, fp) == fp
        x, e, y = texts[str(r.doc_id), r.n_chars, r.edited_sha256]
        assert (r.a, r.b) == (pytest.approx(near(x, e), abs=1e-9), pytest.approx(near(x, y), abs=1e-9))
    assert len(set(seen.values())) == len(seen)
    return got


def test_odd_rows(spark):
    rows = [(1, "a b\nc"), (1, "a b\nc"), (1, "zz"), (5, None), (None, "x y z"), (None, "b"), (9, ""), (7, "c\na b"), (3, "🙂🙂 é\n\nq"), (8, "w " * 70_000), (10, "w " * 20_000), (11, "w " * 40_000), (12, "a b c d e " * 20_000 + "\nw")]
    check(spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id long, text string, part string, nth int"))
    check(spark.createDataFrame([(4, "a b c d e f g")], "doc_id long, text string"))
    assert q.edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents(spark):
    got = check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    long = [r for r in got if r.n_chars > 400 and r.b < 1]
    assert sum(r.a > r.b for r in long) >= 0.97 * len(long)


def test_adding_and_taking_out(spark):
    rows = [("all", "p one\nq two\nr three"), ("some", "r three\np one"), ("one", "q two")]
    fps = {r.k: r.fp for r in q.vectors(spark.createDataFrame(rows, "k string, text string"), ["k"]).collect()}
    df = spark.createDataFrame([(fps["all"], fps["some"], fps["one"])], "a array<int>, b array<int>, c array<int>")
    assert df.filter((q.combine(F.col("b"), F.col("c")) == F.col("a")) & (q.combine(F.col("a"), F.col("c"), -1) == F.col("b"))).count() == 1

import collections
import math
import re

import numpy as np
import pytest

from veritrace.llm import severity as q

DATA = "/root/testdata/sf0.001"

CLEAN = "the quick brown fox jumps over a lazy dog while many small birds sing in tall green trees near water".split()


def corpus(n, seed):
    r = np.random.default_rng(seed)
    for k in range(n):
        words = r.choice(CLEAN, 60).tolist()
        toxic = k % 4 == 0
        for _ in range(r.integers(2, 6) if toxic else 0):
            words[r.integers(0, 60)] = str(r.choice(["vile", "nasty###", "Vile,", "hatefulness", "hatefully"]))
        yield k + 1000 * seed, " ".join(words), int(toxic)


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t, _ in rows], "doc_id long, text string, grade string, p_toxic int")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def test_held_out(spark):
    docs, labels = frames(spark, list(corpus(200, 1)))
    model = q.fit(docs, labels)
    rows = list(corpus(120, 2))
    got = {r.doc_id: r for r in q.score(frames(spark, rows)[0], model).collect()}
    assert sum(got[i].rejected != bool(y) for i, _, y in rows) <= 2
    assert all(0 <= got[i].expected_severity <= 2 and got[i].p_toxic >= got[i].expected_severity - got[i].p_toxic for i, _, _ in rows)
    dense, sparse = (" ".join([*CLEAN, *["vile"] * k]) for k in (6, 1))
    assert model.above(dense)[1] >= model.above(sparse)[1]
    assert model.above("") == model.above("") and not model.above("")[0] >= q.REJECT


def test_thresholds_rise_and_weights_are_evidence():
    grade = np.asarray([0] * 50 + [1] * 20 + [2] * 20)
    rows = np.arange(90)
    x = grade + 0.1 * np.random.default_rng(0).random(90)
    w, t = q.fit_ordinal(rows, np.zeros(90, int), x, grade, np.asarray([1e-4]))
    assert w[0] > 0 and t[0] < t[1]
    assert (((w[0] * x)[:, None] > t).sum(axis=1) == grade).mean() > 0.9


def test_nothing_to_learn_from(spark):
    docs, labels = frames(spark, list(corpus(20, 1)))
    for given in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r.rejected for r in q.score(docs, q.fit(docs, given)).collect()} == {False}
    odd = spark.createDataFrame([(None, None), (1, None), (1, ""), (2, "vile " * 200_000)], "doc_id long, text string")
    assert q.score(odd, q.fit(docs, labels)).count() == 4
    assert q.score(odd.limit(0), q.fit(docs, labels)).count() == 0
    assert q.fit(docs, labels.union(spark.createDataFrame([(None, 1), (0, None)], "doc_id long, toxic int"))).weights


def probabilities(model, text):
    """P(grade > k) from the words alone, feature by feature."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    seen = collections.Counter(f for w in words for f in [w + " ", *(w[:k] for k in (3, 4, 5, 6) if len(w) >= k)])
    score = sum(model.weights.get(f, 0.0) * math.log1p(200 * n / (len(words) + 20)) for f, n in seen.items())
    return [1 / (1 + math.exp(min(500.0, max(-500.0, t - score)))) for t in model.thresholds]


def test_the_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    model = q.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert model.weights and len(model.thresholds) == q.GRADES - 1
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = q.op10_severity(spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        p = probabilities(model, texts[r.doc_id])
        assert r.p_toxic == pytest.approx(p[0], abs=1e-9) and r.expected_severity == pytest.approx(sum(p), abs=1e-9)
        assert r.rejected == (p[0] >= q.REJECT) and r.grade == sum(x >= 0.5 for x in p)


def test_the_fit_is_the_least_there_is():
    r = np.random.default_rng(8)
    n, p = 120, 6
    rows, cols = np.repeat(np.arange(n), 3), r.integers(0, p, 3 * n)
    x, grade = r.random(3 * n), r.integers(0, 3, n)
    x[cols == 0] += grade[rows[cols == 0]]
    penalty = np.full(p, 1e-3)

    def loss(w, t):
        score, out = np.bincount(rows, w[cols] * x, minlength=n), float(penalty @ w)
        for k in range(2):
            yes = grade > k
            prob = 1 / (1 + np.exp(t[k] - score))
            out -= (1 - q.CLEAN) * np.log(prob[yes]).mean() + q.CLEAN * np.log(1 - prob[~yes]).mean()
        return out

    w, t = q.fit_ordinal(rows, cols, x, grade, penalty, steps=6000)
    best = loss(w, t)
    for _ in range(400):
        step = r.normal(size=p + 2) * 10.0 ** r.uniform(-4, -1)
        other_w, other_t = np.maximum(0, w + step[:p]), np.sort(t + step[p:])
        assert loss(other_w, other_t) >= best - 1e-7


def test_repeats_ties_and_names(spark):
    docs, labels = frames(spark, list(corpus(80, 1)))
    model = q.fit(docs, labels.union(labels))
    rows = spark.createDataFrame([(1, "vile vile", "a"), (1, "vile vile", "a"), (1, "vile vile", "b"), (2, "x " * 300_000 + "vile", "c")], "doc_id long, text string, rejected string")
    got = q.score(rows, model).collect()
    assert len(got) == 4 and len({r.p_toxic for r in got if r.doc_id == 1}) == 1
    assert got[0].rejected is True and all(r.rejected in (True, False) for r in got)  # a column of that name is replaced


def test_the_fit_makes_no_products_of_the_whole_sample():
    import tracemalloc

    r = np.random.default_rng(3)
    n, each, p = 4000, 150, 400
    rows, cols = np.repeat(np.arange(n, dtype=np.int32), each), r.integers(0, p, n * each).astype(np.int32)
    x = r.random(n * each)
    tracemalloc.start()
    w, _ = q.fit_ordinal(rows, cols, x, r.integers(0, 3, n), np.full(p, 1e-4), steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(w) == p and peak < x.nbytes / 2
    values = r.random(p)
    assert np.array_equal(q._sums(rows, cols, x, values, n), np.bincount(rows, values[cols] * x, minlength=n))

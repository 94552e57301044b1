import numpy as np
import pytest

from veritrace.llm import topk

SCHEMA = "vec_id long, embedding array<double>, rank string, score string, norm int"


def brute(rows, k, every):
    v = [(i, [int(np.floor(1024 * float(x))) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, a in v:
        if i % every == 0:
            best = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False)))), j) for j, b in v if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def cases():
    r = np.random.default_rng(0)
    yield "lengths", [(i, (r.normal(size=12) * r.lognormal(0, 1)).tolist()) for i in range(400)]
    yield "clusters", [(i, (np.eye(6)[i % 6] * 3 + r.normal(size=6) * 0.1).tolist()) for i in range(300)]
    yield "odd rows", [(i, [1.0, float(i % 3)]) for i in range(60)] + [(200, None), (None, [1.0, 2.0]), (14, [1.0]), (21, []), (28, [float("nan"), 1.0]), (35, [None, 1.0]), (7, [0.0, 0.0]), (7, [-1.0, -2.0])]
    yield "huge", [(i, [float(x) for x in r.normal(size=3) * 10.0 ** (i % 20)]) for i in range(50)]
    yield "negative", [(i, [-1.0 if i else 1.0, -i * 1e-3]) for i in range(30)]
    yield "few", [(0, [1.0]), (7, [2.0])]


@pytest.mark.parametrize("name,rows", list(cases()), ids=[n for n, _ in cases()])
def test_against_brute_force(spark, name, rows):
    df = spark.createDataFrame([(i, e, "x", "y", 1) for i, e in rows], SCHEMA)
    assert sorted(map(tuple, topk.top_k(df, 10, 7).collect())) == brute(rows, 10, 7)


def test_blocks_and_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 20)
    monkeypatch.setattr(topk, "BUCKET_VECTORS", 50)
    rows = dict(cases())["lengths"]
    df = spark.createDataFrame([(i, e, "x", "y", 1) for i, e in rows], SCHEMA)
    assert sorted(map(tuple, topk.top_k(df, 10, 7).collect())) == brute(rows, 10, 7)


def test_empty(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0

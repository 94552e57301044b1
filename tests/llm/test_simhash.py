import collections
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veritrace.llm import simhash as q
from veritrace.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(fps, bits):
    ids = sorted(fps)
    f = np.asarray([fps[i] for i in ids], np.uint64)
    return groups(ids, ((i, ids[k + 1 + j]) for k, i in enumerate(ids) for j in np.flatnonzero(np.bitwise_count(f[k + 1 :] ^ f[k]) <= bits).tolist()))


def test_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += [(9001, None), (9000, ""), (9002, " \n"), (9003, "Two words"), (9004, "two WORDS"), (9005, "É x y z"), (9006, "é x y z"), (9007, "the same words over and over " * 20_000)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, fp long, root string")
    fps = {d: fingerprint(t) for d, t in docs}
    want = near(fps, 2)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in q.near_duplicates(df).collect()}
    assert got == {d: (fps[d], want[d]) for d in fps}
    assert q.near_duplicates(df.limit(0)).count() == 0


def test_a_large_bucket(spark):
    r = np.random.default_rng(5)
    base = int(r.integers(0, 1 << 63))
    values = {base}
    for _ in range(900):
        x = base
        for b in r.choice(24, r.integers(1, 8), replace=False):
            x ^= 1 << int(b)
        values.add(x)
    values |= {int(x) for x in r.integers(0, 1 << 63, 200)}
    fps = dict(enumerate(sorted(values)))
    df = spark.createDataFrame([(q._signed(x),) for x in fps.values()], "fp long")
    number = {q._signed(x): i for i, x in fps.items()}
    for bits in (1, 2):
        got = groups(fps, ((number[e.node], number[e.root]) for e in components(q.links(df, bits)).collect()))
        assert got == near(fps, bits)


def alike(docs, size=5, similarity=0.8):
    sets = {d: frozenset(np.concatenate([*q.shingle_hashes(t.encode(), size), np.zeros(0, np.uint64)]).tolist()) for d, t in docs}
    where = collections.defaultdict(list)
    linked = [(d, e) for d in sets for e in sets if not sets[d] and not sets[e]]
    for d in sorted(sets):
        shared = collections.Counter(e for x in sets[d] for e in where[x])
        linked += [(d, e) for e, k in shared.items() if k >= similarity * (len(sets[d]) + len(sets[e]) - k) - 1e-9]
        for x in sets[d]:
            where[x].append(d)
    return groups(sets, linked)


def test_near_copies(spark, monkeypatch):
    for name, rows in (("BLOCK", 40), ("SHARD", 90), ("SKETCH_BLOCK", 60), ("SKETCH_SHARD", 110), ("STAR", 16)):
        monkeypatch.setattr(q, name, rows)
    r = np.random.default_rng(3)
    base = [f"w{i}" for i in r.integers(0, 5000, 160)]
    docs = [(5, ""), (6, "  "), (7, "a b"), (8, "A B"), (9, "a b c")]
    for k in range(200):
        w = list(base)
        for _ in range(r.integers(0, 7)):
            w[r.integers(0, 160)] = f"e{r.integers(0, 10**6)}"
        docs.append((1000 + k, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = alike(docs)
    assert {x.doc_id: x.component_id for x in q.classes(df).collect()} == want
    assert sorted(x.doc_id for x in q.one_of_each(df).collect()) == sorted(set(want.values()))


def test_near_copies_that_repeat_a_line(spark):
    r = np.random.default_rng(11)
    docs = []
    for k in range(40):
        w = [f"w{k}x{i}" for i in r.integers(0, 5000, 300)]
        line = " ".join(f"l{k}x{i}" for i in range(11))
        docs += [(2 * k, " ".join(w) + f" {line}"), (2 * k + 1, " ".join([*w[:-1], "other"]) + f" {line}" * 100)]
    want = alike(docs)
    assert set(want.values()) == {2 * k for k in range(40)}
    assert {x.doc_id: x.component_id for x in q.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want


@pytest.mark.parametrize("similarity", [0.5, 0.7, 0.8, 0.9])
def test_recall_at_any_similarity(spark, similarity):
    r = np.random.default_rng(17)
    docs = []
    for k in range(60):  # pairs on either side of the similarity
        w = [f"w{i}" for i in r.integers(0, 10**6, 200)]
        docs.append((2 * k, " ".join(w)))
        for _ in range(int(r.integers(0, round(42 * (1 - similarity) / similarity) + 2))):
            w[r.integers(0, 200)] = f"e{r.integers(0, 10**6)}"
        docs.append((2 * k + 1, " ".join(w)))
    want = alike(docs, similarity=similarity)
    got = {x.doc_id: x.component_id for x in q.classes(spark.createDataFrame(docs, "doc_id long, text string"), similarity=similarity).collect()}
    linked = {d for d in want if want[d] != d}
    assert len(linked) > 20 and all(got[d] == d for d in want if d not in linked)
    assert sum(got[d] == want[d] for d in linked) >= 0.99 * len(linked)


def test_groups_that_are_almost_alike(spark, monkeypatch):
    # Many documents of one pattern, somewhat less alike than 0.8, with chains of links between them.
    monkeypatch.setattr(q, "PAIRED", 4)
    for name, rows in (("BLOCK", 10), ("SHARD", 20), ("SKETCH_BLOCK", 15), ("SKETCH_SHARD", 25)):
        monkeypatch.setattr(q, name, rows)
    r = np.random.default_rng(23)
    base = [f"w{i}" for i in r.integers(0, 5000, 150)]
    docs = []
    for k in range(120):
        w = list(base)
        for _ in range(int(r.integers(2, 9))):
            w[r.integers(0, 150)] = f"e{r.integers(0, 10**6)}"
        docs.append((3 * k, " ".join(w)))
    want = alike(docs)
    assert 5 < len(set(want.values())) < 115
    assert {x.doc_id: x.component_id for x in q.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want


def test_names_and_nulls(spark):
    rows = [(1, "a b c d e f", 0, "x"), (2, "a b c d e f", 1, None), (None, None, 2, "y"), (None, "a b c d e f", 3, "z"), (4, None, 4, "w"), (5, " ", 5, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int, twice string").withColumn("__gone", F.lit(1)).withColumn("component_id", F.lit(2)).withColumn("least", F.lit(3))
    got = q.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(r.gone for r in got.collect()) == [0, 2, 3, 4]
    got = {(r.doc_id, r.fp): r.component_id for r in q.near_duplicates(df.withColumn("fp", F.lit("q"))).collect()}
    assert {k[0]: v for k, v in got.items() if k[1] == 0} == {None: 4, 4: 4, 5: 4} and {v for k, v in got.items() if k[1]} == {1}


def test_rows_that_repeat(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "x"), (3, None), (4, ""), (2, "A b C d e f")], "doc_id long, text string").withColumn("least", F.lit(0))
    assert sorted(map(str, (r.doc_id for r in q.one_of_each(df).collect()))) == ["1", "3", "None"]
    assert q.one_of_each(df.limit(0)).count() == 0


@pytest.mark.parametrize(("bits", "m"), [(2, None), (37, 8)])
def test_chain_test_by_its_runs_and_how_long_it_is(spark, bits, m):
    own = [x % 2**64 for x in q.segments(bits, m)]
    m, r = len(own), np.random.default_rng(8)
    pairs = [(int(a), int(a) ^ sum(1 << int(k) for k in r.choice(64, min(64, int(n)), replace=False))) for a, n in zip(r.integers(0, 1 << 62, 600), r.integers(0, 2 * bits + 4, 600), strict=True)]

    def chained(diff):
        c = [(diff & s).bit_count() for s in own]
        return any(all(sum(c[(i + j) % m] for j in range(k + 1)) <= (k + 1) * bits // m for k in range(m)) for i in range(m))

    want = [chained(a ^ b) for a, b in pairs]
    test = q.chain_test(F.col("a"), F.col("b"), bits, m)
    df = spark.createDataFrame([(k, *((x + 2**63) % 2**64 - 2**63 for x in p)) for k, p in enumerate(pairs)], "k int, a long, b long")
    assert [x.t for x in df.select("k", test.alias("t")).orderBy("k").collect()] == want and 0 < sum(want) < len(want)
    # The driver plans it again whenever a stage of its query ends.
    assert str(test).count("bit_count") <= m * m

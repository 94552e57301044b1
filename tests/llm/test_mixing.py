import pytest
from pyspark.sql import functions as F

from veritrace.llm import mixing


def levels(sizes):
    """Shares by weight, what is over a bound shared again until none is."""
    left = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    pool, out = 1.5 * sum(sizes.values()), {}
    while left:
        level = pool / sum(left.values())
        full = [s for s, w in left.items() if w * level >= 2 * sizes[s]]
        if not full:
            return out | {s: w * level for s, w in left.items()}
        for s in full:
            out[s] = 2.0 * sizes[s]
            pool -= out[s]
            del left[s]
    return out


def test_targets_and_takes(spark):
    rows = [(k, "w " * (k % 90 + 1), ["a", "b", "Z", "é", None][k % 5], k) for k in range(400)] + [(1000, "x " * 4000, "big", 0), (1001, "y", "big", 0), (1002, None, "none", 0), (1003, "", "none", 0), (5, "w " * 7, "a", 5), (5, "w " * 9, "a", 5), (None, "n o", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = levels(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) < 4 for s in want)
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    drawn = mixing.draw(df.withColumn("n_chars", F.char_length("text").cast("long"))).collect()
    words = {}
    for r in drawn:
        words[r.source] = words.get(r.source, 0) + len((r.text or "").split())
        assert r.n_chars == len(r.text)
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0 and mixing.draw(df).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(none).collect()] == [0, 0] and mixing.draw(none).count() == 0


def test_no_python_on_the_executors(spark):
    plan = mixing.mix(spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, source string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

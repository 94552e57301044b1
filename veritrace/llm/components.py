"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, salted_join, staged


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger end a to its smaller end b."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


#: Edges that one task holds at least, and edges from which on hubs are looked after.
TASK_EDGES, HUB_EDGES = 5_000, 20_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a bigint, b bigint); root is the component's smallest node.

    Every round is written to the shared folder, in as many files as the edges need; rounds grow with
    the logarithm of the graph's diameter, and a node's neighbours are only ever reduced to their
    minimum or joined, never collected; in large graphs the joins deal the edges of a hub over many
    tasks. Loops are dropped; null ends are not allowed.
    """

    def kept(found: DataFrame, name: str) -> DataFrame:
        return staged(found.coalesce(tasks), name)

    def joined(rows: DataFrame, per_node: DataFrame) -> DataFrame:
        return salted_join(rows, per_node, ["a"], "n", "b") if size > HUB_EDGES else rows.join(per_node, "a")

    now, mark, size, tasks = staged(_down(edges), "edges"), None, 0, 1
    while True:
        found = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (found["n"], found["x"]) == mark or not found["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        if mark is None:
            size, tasks = found["n"], max(1, found["n"] // TASK_EDGES)
        mark = (found["n"], found["x"])
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        least = kept(least, "least") if size > HUB_EDGES else least
        large = joined(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.filter("m < a").select("a", "m"))
        large = kept(_down(large), "edges")
        fewer = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        fewer = kept(fewer, "least") if size > HUB_EDGES else fewer
        small = joined(large, fewer).select("b", "m").union(fewer.select("a", "m")).toDF("a", "b")
        done = [now, large, *([least, fewer] if size > HUB_EDGES else [])]
        now = kept(_down(small), "edges")
        for old in done:
            discard(old)

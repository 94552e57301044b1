"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are sorted by length and cut into buckets of like lengths. A query that already has k
candidates with products of at least theta can only be served by a bucket through vectors whose
cosine with it is at least theta / (its length * the bucket's longest). By that local threshold a
bucket is passed over (above 1), searched by coordinates (high: vectors must lie in a range on each
of the query's largest coordinates) or by length (low: the bucket is read down to the length that can
still reach theta). What remains is verified by its integer product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, partitions, staged, table

SCALE = 1024
#: A bucket ends at so many vectors or where lengths fall below this share of its longest.
BUCKET_VECTORS, BUCKET_SHARE = 2048, 0.9
#: Queries that one pass over the index serves: what is broadcast at once, 8 bytes a component.
BLOCK_QUERIES = 32_768
#: Local thresholds from which coordinates prune better than lengths, and the coordinates looked at.
COORDINATES_FROM, COORDINATES = 0.6, 5
#: Products below this are exact in double precision.
EXACT = float(1 << 52)
LONG = (-(1 << 63), (1 << 63) - 1)

QUANTISED = pa.schema([("vec_id", pa.int64()), ("norm", pa.float64()), ("q", pa.binary())])
INDEX = pa.schema([("norm", pa.float64()), ("n", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("norms", pa.binary()), ("vectors", pa.binary())])


def quantise(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, norm, q): floor(1024 * x) of every component, as doubles in bytes.

    Rows whose id or vector is null or holds a null or non-finite component are left out.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, norms, made = [], [], []
            for vec_id, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if vec_id is None or not x.is_valid or x.values.null_count:
                    continue
                with np.errstate(over="ignore"):
                    q = np.floor(SCALE * x.values.to_numpy().astype(np.float64))
                if np.isfinite(q).all():
                    top = np.abs(q).max(initial=0.0)
                    ids.append(vec_id)
                    norms.append(float(top * np.linalg.norm(q / top)) if top else 0.0)
                    made.append(q.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, norms, made), QUANTISED.types, strict=True)], schema=QUANTISED)

    narrow = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    return map_batches(narrow, rows, "vec_id bigint, norm double, q binary")


def _matrix(parts: list[bytes]) -> np.ndarray:
    """Vectors of any lengths as rows, shorter ones filled with zeros."""
    dim = max((len(p) // 8 for p in parts), default=0)
    out = np.zeros((len(parts), dim))
    for k, p in enumerate(parts):
        out[k, : len(p) // 8] = np.frombuffer(p)
    return out


def index(quantised: DataFrame) -> DataFrame:
    """Buckets of the vectors, one a row; vectors are dealt by ranges of length, equal lengths by id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, norms, parts = [], [], []

        def flush() -> pa.RecordBatch:
            m = _matrix(parts)
            whole = m.astype("<i4") if np.abs(m).max(initial=0) < 2**31 else m
            row = {"norm": norms[0], "n": len(ids), "dim": m.shape[1], "ids": np.asarray(ids, "<i8").tobytes(), "norms": np.asarray(norms).tobytes(), "vectors": whole.tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=INDEX)

        for batch in batches:
            for vec_id, norm, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (len(ids) >= BUCKET_VECTORS or norm < BUCKET_SHARE * norms[0]):
                    yield flush()
                    ids, norms, parts = [], [], []
                ids.append(vec_id)
                norms.append(norm)
                parts.append(q)
        if ids:
            yield flush()

    dealt = quantised.repartitionByRange(partitions(quantised.sparkSession), F.col("norm").desc(), "vec_id").sortWithinPartitions(F.col("norm").desc(), "vec_id")
    return map_batches(dealt, rows, "norm double, n int, dim int, ids binary, norms binary, vectors binary")


class Bucket:
    def __init__(self, row: dict):
        self.ids, self.norms = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["norms"])
        n, dim = row["n"], row["dim"]
        kind = "<i4" if len(row["vectors"]) == 4 * n * dim else "<f8"
        self.vectors = np.frombuffer(row["vectors"], kind).reshape(n, dim).astype(np.float64)
        self.longest = row["norm"]
        self._unit = None

    @property
    def unit(self) -> np.ndarray:
        if self._unit is None:
            self._unit = self.vectors / np.where(self.norms, self.norms, 1.0)[:, None]
        return self._unit


class Search:
    """The best k of each query of a block over the buckets seen so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.vectors, self.k = ids, vectors, k
        top = np.abs(vectors).max(axis=1, initial=0.0)
        self.norms = top * np.linalg.norm(vectors / np.where(top, top, 1.0)[:, None], axis=1)
        #: Products that k candidates are known to reach, somewhere.
        self.theta = np.full(len(ids), -np.inf) if floor is None else floor.copy()
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, vec_id), in order

    def products(self, queries: np.ndarray, vectors: np.ndarray, largest: float) -> np.ndarray:
        dim = max(queries.shape[1], vectors.shape[1])
        queries, vectors = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) if x.shape[1] < dim else x for x in (queries, vectors))
        if largest < EXACT:
            return queries @ vectors.T
        whole = np.frompyfunc(int, 1, 1)
        return whole(queries).dot(whole(vectors).T)

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        own = ids != self.ids[q]
        if scores.dtype != object and len(scores) > 4 * self.k:  # only the best can matter
            own &= scores >= np.partition(np.where(own, scores, -np.inf), -self.k)[-self.k]
        found = [(-min(max(int(s), LONG[0]), LONG[1]), int(i)) for s, i in zip(scores[own], ids[own], strict=True)]
        self.best[q] = sorted(self.best[q] + found)[: self.k]
        if len(self.best[q]) == self.k:
            self.theta[q] = max(self.theta[q], -self.best[q][-1][0])

    def scan(self, bucket: Bucket) -> None:
        reach = self.norms * bucket.longest
        with np.errstate(invalid="ignore", divide="ignore"):
            local = np.where(reach > 0, self.theta / np.where(reach > 0, reach, 1.0), np.where(self.theta > 0, np.inf, -np.inf))
        by_length = np.flatnonzero(local < COORDINATES_FROM)
        for a in range(0, len(by_length), 1024):
            self._by_length(by_length[a : a + 1024], bucket)
        for q in np.flatnonzero((local >= COORDINATES_FROM) & (local <= 1 + 1e-9)).tolist():
            self._by_coordinates(q, local[q] * (1 - 1e-9), bucket)

    def _by_length(self, own: np.ndarray, bucket: Bucket) -> None:
        with np.errstate(invalid="ignore", divide="ignore"):
            least = np.where((self.theta[own] > 0) & (self.norms[own] > 0), self.theta[own] / self.norms[own], 0.0) * (1 - 1e-9)
        n = int(np.searchsorted(-bucket.norms, -least.min(), side="right"))  # lengths fall
        largest = float(self.norms[own].max(initial=0.0) * bucket.longest)
        scores = self.products(self.vectors[own], bucket.vectors[:n], largest)
        hits = scores >= self.theta[own][:, None]
        for k in np.flatnonzero(hits.any(axis=1)).tolist():
            at = np.flatnonzero(hits[k])
            self.add(int(own[k]), bucket.ids[at], scores[k][at])

    def _by_coordinates(self, q: int, local: float, bucket: Bucket) -> None:
        unit = self.vectors[q] / self.norms[q]
        dim = min(len(unit), bucket.vectors.shape[1])
        focus = np.argsort(-np.abs(unit[:dim]))[:COORDINATES]
        keep = np.ones(len(bucket.ids), bool)
        rest = np.sqrt(max(0.0, 1 - local * local))
        for f in focus.tolist():
            x = float(np.clip(unit[f], -1, 1))
            side = np.sqrt(max(0.0, 1 - x * x)) * rest
            low = -1.0 if x <= -local else x * local - side
            high = 1.0 if x >= local else x * local + side
            keep &= (bucket.unit[:, f] >= low - 1e-9) & (bucket.unit[:, f] <= high + 1e-9)
        at = np.flatnonzero(keep)
        if len(at):
            scores = self.products(self.vectors[q : q + 1], bucket.vectors[at], float(self.norms[q] * bucket.longest))[0]
            hit = scores >= self.theta[q]
            self.add(q, bucket.ids[at[hit]], scores[hit])


FOUND = pa.schema([("block", pa.int32()), ("query", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _pass(buckets: DataFrame, seeds: list[dict], block: int, ids: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """The best k of each query in every task's buckets, for a block of queries."""
    start = Search(ids, vectors, k)
    for row in seeds:
        start.scan(Bucket(row))
    sent = buckets.sparkSession.sparkContext.broadcast((ids, vectors, start.theta))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*sent.value[:2], k, sent.value[2])
        for batch in batches:
            for row in batch.to_pylist():
                search.scan(Bucket(row))
        out = [(block, q, int(search.ids[q]), vec_id, -score) for q, best in enumerate(search.best) for score, vec_id in best]
        for a in range(0, len(out), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a : a + 100_000], strict=True), FOUND.types, strict=True)], schema=FOUND)

    return staged(map_batches(buckets, rows, "block int, query int, query_id bigint, vec_id bigint, score bigint"), "found")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer products of every query, ties to the smaller id.

    Queries are the rows whose id is divisible by every, candidates all rows of other ids. Rows with
    a null id, a null vector or a null or non-finite component take no part; vectors of different
    lengths are compared as if filled with zeros; scores beyond 64 bits are cut to the nearest. Each
    repeated query row has a list of its own; a repeated candidate appears as often as it occurs.
    """
    spark = vectors.sparkSession
    quantised = staged(quantise(vectors, id_col, vector_col), "quantised")
    buckets = staged(index(quantised), "buckets")
    seeds = [r.asDict() for r in buckets.orderBy(F.col("norm").desc(), "ids").limit(2).collect()]  # two buckets: thresholds to begin with
    queries = quantised.filter(F.pmod("vec_id", F.lit(every)) == 0)
    n = queries.count()
    found, blocks = None, -(-n // BLOCK_QUERIES)
    numbered = queries
    if blocks > 1:  # equal blocks in the order of ids; a block's rows are bounded by the accuracy of the cuts
        cuts = queries.agg(F.percentile_approx("vec_id", [i / (2 * blocks) for i in range(1, 2 * blocks)], 40 * blocks)).first()[0]
        cuts = [None, *sorted(set(cuts)), None]
    else:
        cuts = [None, None]
    for block, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        own = numbered if low is None else numbered.filter(F.col("vec_id") > low)
        own = own if high is None else own.filter(F.col("vec_id") <= high)
        got = own.select("vec_id", "q").orderBy("vec_id").collect()
        if not got:
            continue
        ids, own_vectors = np.asarray([r["vec_id"] for r in got], np.int64), _matrix([bytes(r["q"]) for r in got])
        part = _pass(buckets, seeds, block, ids, own_vectors, k)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    order = Window.partitionBy("block", "query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer products of every hundredth vector with all others."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

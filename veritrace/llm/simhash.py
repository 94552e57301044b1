"""SimHash fingerprints and the documents they link, found by pigeonring filtering.

Two fingerprints of 64 bits that differ in at most t bits, cut into m = 2t + 1 segments on a ring,
have a place from which every run of l segments differs in at most l * t / m bits in sum. For runs
of one and two segments that is no bit, for three and four at most one: so two segments in a row are
equal, and the third or the fourth is. The index holds each distinct fingerprint under its 2m
triples of segments of that kind; partners in a bucket pass the whole chain test, then the Hamming
test. A bucket with more than BUCKET fingerprints is not paired: its fingerprints meet through the
fingerprints one bit away from them, which finds the same links in linear time.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_batches, salted_join, staged, table
from .components import components

SEED = 42
BUCKET = 64
#: Shingles hashed at a time.
CHUNK = 1 << 16


def shingle_hashes(text: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of size words, in chunks; a shorter text is one shingle, one without words has none."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return
    last = max(1, len(words) - size + 1)
    for a in range(0, last, CHUNK):
        own = words[a : min(last, a + CHUNK) + size - 1]
        n = max(1, len(own) - size + 1)
        runs = zip(*(own[k : k + n] for k in range(size)), strict=True) if len(own) >= size else [own]
        yield np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(SEED)), np.uint64, n)


def fingerprint(text: bytes, size: int) -> int:
    """The fingerprint of all shingles of a text, repeats included; zero for a text without words."""
    return _majority(shingle_hashes(text, size))


def _majority(parts: Iterable[np.ndarray]) -> int:
    """A bit is one if it is set in over half the hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for h in parts:
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed integer; a null text is empty."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(x.as_py() or b"", shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.asarray(made, np.uint64).view(np.int64))], schema=FINGERPRINTS)

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")), rows, "doc_id bigint, fp bigint")


def segments(max_bits: int, m: int | None = None) -> list[int]:
    """Masks of m segments, or of 2 * max_bits + 1, as signed integers."""
    m = m or 2 * max_bits + 1
    cuts = [64 * k // m for k in range(m + 1)]
    return [_signed((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def index_masks(max_bits: int) -> list[int]:
    """Masks under which two fingerprints within max_bits agree at least once, by the ring of segments."""
    own = segments(max_bits)
    m = len(own)
    if max_bits == 0:
        return [-1]
    runs = {frozenset({i, (i + 1) % m} | ({(i + k) % m} if m > 3 else set())) for i in range(m) for k in (2, 3)}
    return sorted(_signed(sum(own[i] for i in run)) for run in runs)


def chain_test(a, b, max_bits: int, m: int | None = None):
    """Whether some place on the ring of m segments keeps every run of them from there within its share of max_bits.

    From the longest run back, what is left for the segments before is the least of their own run's
    share and of what the next segment leaves: each segment stands once in a place, so the
    expression, which the driver plans again and again, grows with m**2, not m**3.
    """
    own = segments(max_bits, m)
    m = len(own)
    diff = a.bitwiseXOR(b)
    bits = [F.bit_count(diff.bitwiseAND(F.lit(s))) for s in own]
    places = []
    for i in range(m):
        left = F.lit(max_bits)
        for k in range(m - 1, 0, -1):
            left = F.least(F.lit(k * max_bits // m), left - bits[(i + k) % m])
        places.append(bits[i] <= left)
    out = places[0]
    for p in places[1:]:
        out = out | p
    return out


def hamming(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct: DataFrame, max_bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp) at most max_bits (0, 1 or 2) apart.

    All such pairs out of buckets of at most bucket fingerprints; out of larger ones pairs that
    connect whatever such pairs connect.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits must be 0, 1 or 2")
    masks = index_masks(max_bits)
    keyed = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(x)) for x in masks))).alias("t", "key"))
    buckets = staged(keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("n > 1"), "buckets")
    near = chain_test(F.col("a"), F.col("b"), max_bits) & (hamming(F.col("a"), F.col("b")) <= max_bits)
    twos = buckets.filter("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).filter(near)
    more = staged(salted_join(keyed, buckets.filter("n > 2").select("t", "key", "n"), ["t", "key"], "n", "fp"), "bucketed")
    small = more.filter(F.col("n") <= bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))  # at most bucket each
    pairs = small.select(F.explode("fps").alias("a"), "fps").select("a", F.explode(F.filter("fps", lambda b: (b > F.col("a")) & (hamming(F.col("a"), b) <= max_bits))).alias("b")).filter(near)
    # At most two apart, equal under the mask: the fingerprints share a neighbour one bit away. Such a
    # neighbour has no more than 64 of them, all within two bits of each other.
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << k)) for k in range(64)))
    mask = F.element_at(F.array(*(F.lit(x) for x in masks)), F.col("t") + 1)
    around = more.filter(F.col("n") > bucket).select("t", "key", "fp", F.explode(F.filter(flips, lambda x: x.bitwiseAND(mask) == 0)).alias("flip"))
    met = around.groupBy("t", "key", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle")).agg(F.sort_array(F.collect_list("fp")).alias("fps")).filter(F.size("fps") > 1)
    if max_bits == 2:
        large = met.select(F.element_at("fps", 1).alias("a"), F.explode(F.slice("fps", 2, 64)).alias("b"))
    else:
        large = met.select(F.explode("fps").alias("a"), "fps").select("a", F.explode(F.filter("fps", lambda b: b > F.col("a"))).alias("b")).filter(near)
    return twos.union(pairs).union(large).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id that links reach from the document.

    A null or empty text has fingerprint zero and is linked like any other; a null id is in its
    group but never names it, so a group of null ids alone has a null component. Equal fingerprints
    are collapsed before anything is paired; repeated rows stay. Columns of other names are ignored.
    """
    own = staged(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = staged(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = staged(components(links(distinct, max_bits)), "roots")
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = staged(member.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps")), "named")
    class_of = staged(salted_join(member, named, ["root"], "fps", "fp").select("fp", "n", "component_id"), "classes")
    return salted_join(own, class_of, ["fp"], "n", "doc_id").select("doc_id", "fp", "component_id")


# Near copies by similarity. Documents whose sets of shingles are 0.8 alike differ in 4 to 14 of 64 bits
# on our tables, too far apart for any index of fingerprints to be selective. So candidates share a
# band of minima instead; the chain and Hamming tests prune them, and the sets themselves decide.

BAND_ROWS = 5
#: Share of the pairs at the wanted similarity that no band may find, and deviations that the two tests allow.
LOST, FAR_DEVIATIONS, AGREED_DEVIATIONS = 1e-4, 5.7, 4
FAR_SEGMENTS = 8
#: Buckets up to this size are paired whole; members of larger ones meet in blocks.
PAIRED = 32
#: Rows of a block and a shard when sketches meet, and when sets do; sets that meet one other set in a task.
SKETCH_BLOCK, SKETCH_SHARD = 1 << 12, 1 << 13
BLOCK, SHARD = 512, 1024
STAR = 128
#: Bits for each id of a bitmap that tells tasks which ids are meant, and its most (16 MB).
ID_BITS, MOST_BITS = 32, 1 << 27

SKETCHES = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("fp", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())), ("minima", pa.list_(pa.int64()))])


class Scheme(NamedTuple):
    """What a similarity asks for: bands, bits in which fingerprints may differ, minima that must agree by two bits."""

    similarity: float
    bands: int
    far_bits: int
    agreed: int


def scheme(similarity: float) -> Scheme:
    """The scheme for sets that are at least so alike.

    Two sets of similarity s share a band of r minima with probability s**r; their fingerprints
    differ in each bit with probability arccos(2s / (1 + s)) / pi at most (sets of one size differ
    most); minima agree with probability s, those that do not agree in two bits by chance in a quarter.
    """
    if not 0.3 <= similarity <= 1:
        raise ValueError("similarity must lie between 0.3 and 1: below, bands are too many to be of use")
    bands = math.ceil(math.log(LOST) / math.log1p(-(min(similarity, 0.999) ** BAND_ROWS)))
    bit = math.acos(2 * similarity / (1 + similarity)) / math.pi
    far = math.floor(64 * bit + FAR_DEVIATIONS * math.sqrt(64 * bit * (1 - bit)))
    minima, share = bands * BAND_ROWS, similarity + (1 - similarity) / 4
    return Scheme(similarity, bands, min(64, far), math.floor(minima * share - AGREED_DEVIATIONS * math.sqrt(minima * share * (1 - share))))


def _set_of(text: bytes, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    parts = [np.unique(h) for h in shingle_hashes(text, size)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


_PAIRS_OF_BITS = 0x5555555555555555


def _two_bits(minima: np.ndarray) -> list[int]:
    """Two bits of each minimum, 32 to a signed integer."""
    bits = np.zeros(-(-len(minima) // 32) * 32, np.uint64)
    bits[: len(minima)] = (minima >> np.uint64(40)) & np.uint64(3)
    packed = (bits.reshape(-1, 32) << (2 * np.arange(32, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
    return packed.view(np.int64).tolist()


def agreeing(a, b, minima: int):
    """How many of the minima agree by their two bits; a, b: arrays of _two_bits()."""
    out = F.lit(minima)
    for k in range(-(-minima // 32)):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        out = out - F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_PAIRS_OF_BITS)))
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int) -> DataFrame:
    """(doc_id, digest of the set of shingles, fingerprint of the set, size of the set, keys of its bands of minima, two bits of each minimum)."""
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, bands * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py() or b""
                own = _set_of(raw, shingle)
                least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
                for a in range(0, len(own), 2048):
                    np.minimum(least, (own[a : a + 2048, None] * factors).min(axis=0), out=least)
                keys = [xxhash.xxh64_intdigest(least[k : k + BAND_ROWS].tobytes(), k) for k in range(0, len(least), BAND_ROWS)] if len(own) else []
                out.append((doc_id, xxhash.xxh128_digest(own.tobytes()), int(np.uint64(_majority(own[a : a + CHUNK] for a in range(0, len(own), CHUNK))).astype(np.int64)), len(own), np.asarray(keys, np.uint64).view(np.int64).tolist(), _two_bits(least)))
            columns = zip(*out, strict=True) if out else ([] for _ in SKETCHES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SKETCHES.types, strict=True)], schema=SKETCHES)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return map_batches(narrow, rows, "doc_id bigint, digest binary, fp bigint, n bigint, bands array<bigint>, minima array<bigint>")


def _packed(own: np.ndarray) -> bytes:
    """The first five bytes of each hash: two shingles of a pair that share them are one in ten million pairs."""
    return np.unique(own >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(raw) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _bitmap(ids: DataFrame):
    """(slot, sent): the place of column id in a bitmap of hashed ids, and the bitmap, 32 bits a word, for all tasks.

    It grows with the ids to MOST_BITS. Every id of ids is in it, and a few others are: most others
    where ids are so many that most bits are set.
    """
    bits = min(MOST_BITS, max(1 << 16, 1 << (ID_BITS * ids.count()).bit_length()))
    slot = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.groupBy(F.shiftright(slot, 5).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(31)).cast("int"))).alias("bits"))
    bitmap = np.zeros(bits // 32, np.uint32)
    found = words.toArrow()  # at most MOST_BITS / 32 rows
    bitmap[found.column("w").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return slot, ids.sparkSession.sparkContext.broadcast(bitmap)


def _has(bitmap: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bitmap[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1


def _sets(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, own): the packed sets of the wanted ids, and of some others.

    The texts are not moved: each task drops the documents that the bitmap of ids does not have.
    Where that is full, sets of further documents are written in vain, of all at the worst.
    """
    slot, sent = _bitmap(wanted)
    schema = pa.schema([("id", pa.int64()), ("own", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(_has(sent.value, batch.column(2).to_numpy())))
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array([_packed(_set_of(x.as_py() or b"", shingle)) for x in kept.column(1)], pa.binary())], schema=schema)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).filter("id is not null")
    return staged(map_batches(texts.select("id", "text", slot.alias("slot")), rows, "id bigint, own binary"), "sets")


def _alike(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of ids whose sets of shingles are at least so alike, by the sets themselves.

    a is in few pairs, b may be in many: these meet the set of b in blocks of about STAR.
    """
    pair_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (_unpacked(z.as_buffer()) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), schema=pair_schema).filter(pa.array(keep, pa.bool_()))

    found = _sets(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), docs, id_col, text_col, shingle)
    size = staged(pairs.groupBy("b").agg(F.count("*").alias("size")), "stars")
    blocks = F.ceil(F.col("size") / STAR).cast("int")
    asked = found.join(size.withColumnRenamed("b", "id"), "id").select(F.col("id").alias("b"), F.col("own").alias("y"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    asking = salted_join(pairs, size, ["b"], "size", "a").select("a", "b", F.pmod(F.xxhash64("a"), blocks).cast("int").alias("block"))
    paired = asking.join(found.select(F.col("id").alias("a"), F.col("own").alias("x")), "a").join(asked, ["b", "block"])
    edges = staged(map_batches(paired.select("a", "b", "x", "y"), check, "a bigint, b bigint").distinct(), "alike")
    discard(found)
    return edges


def _neighbourhoods(member: DataFrame, place: DataFrame) -> DataFrame:
    """member (id, root, ...) with hood, its rows k and askers l, and out: whether the row asks.

    place: (node, root), the neighbourhood of each id. Those ask that are in another class than most
    of their neighbourhood; neighbourhoods where nobody asks are left out.
    """
    own = staged(member.join(place.select(F.col("node").alias("id"), F.col("root").alias("hood")), "id"), "members")
    of = own.groupBy("hood", "root").agg(F.count("*").alias("c"))
    size = staged(of.groupBy("hood").agg(F.sum("c").alias("k"), F.max(F.struct("c", "root")).alias("most")).select("hood", "k", (F.col("k") - F.col("most.c")).alias("l"), F.col("most.root").alias("usual")).filter("l > 0"), "hoods")
    return salted_join(own, size, ["hood"], "k", "id").withColumn("out", F.col("root") != F.col("usual")).drop("usual")


def _dealt(member: DataFrame, block: int, shard: int) -> DataFrame:
    """Rows of _neighbourhoods() over cells (hood, s, b), so that each asker meets all rows: askers go to one block and every shard, rows to one shard and every block.

    Rows grow with rows times blocks, never with pairs.
    """
    shards, blocks = F.ceil(F.col("k") / shard).cast("int"), F.ceil(F.col("l") / block).cast("int")
    s, b = F.pmod(F.xxhash64("id", F.lit(1)), shards).cast("int"), F.pmod(F.xxhash64("id", F.lit(2)), blocks).cast("int")
    every = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(s.alias("s"), x.alias("b"), F.lit(False).alias("asks")))
    asked = F.when(F.col("out"), F.transform(F.sequence(F.lit(0), shards - 1), lambda x: F.struct(x.alias("s"), b.alias("b"), F.lit(True).alias("asks")))).otherwise(F.array().cast("array<struct<s:int,b:int,asks:boolean>>"))
    rest = [c for c in member.columns if c not in ("k", "l", "out")]
    return member.select(*rest, F.explode(F.concat(every, asked)).alias("x")).select(*rest, "x.s", "x.b", "x.asks")


def _promising(member: DataFrame, plan: Scheme) -> DataFrame:
    """(id): rows (id, root, hood, k, l, out, fp, n, minima) whose sketches are near one of another class, one of the two asking."""
    minima, words = plan.bands * BAND_ROWS, -(-plan.bands * BAND_ROWS // 32)

    def meet(rows: pa.Table) -> pa.Table:
        asks = rows.column("asks").to_numpy()
        ids, root, fp, n = (rows.column(c).to_numpy() for c in ("id", "root", "fp", "n"))
        fp = fp.view(np.uint64)
        own = rows.column("minima").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, words)
        others, near = np.flatnonzero(~asks), np.zeros(len(ids), bool)
        for i in np.flatnonzero(asks).tolist():
            at = others[(np.bitwise_count(fp[others] ^ fp[i]) <= plan.far_bits) & (root[others] != root[i])]
            at = at[np.minimum(n[at], n[i]) >= plan.similarity * np.maximum(n[at], n[i]) - 1e-9]
            x = own[at] ^ own[i]
            at = at[minima - np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(_PAIRS_OF_BITS)).sum(axis=1) >= plan.agreed]
            near[at] = True
            near[i] = len(at) > 0
        return pa.table({"id": pa.array(ids[near], pa.int64())})

    return _dealt(member, SKETCH_BLOCK, SKETCH_SHARD).groupBy("hood", "s", "b").applyInArrow(meet, "id bigint").distinct()


def _met(member: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of askers among rows (id, root, own, hood, k, l, out): one at least to any class that an asker reaches."""

    def meet(rows: pa.Table) -> pa.Table:
        asks = rows.column("asks").to_numpy()
        ids, root_of = rows.column("id").to_numpy(), rows.column("root").to_numpy()
        sets = [_unpacked(x.as_buffer()) for x in rows.column("own")]
        mine = np.flatnonzero(asks)
        sizes = np.asarray([len(sets[i]) for i in mine])
        a, b = [], []
        if len(mine):
            flat, whose = np.concatenate([sets[i] for i in mine]), np.repeat(np.arange(len(mine)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, whose = flat[order], whose[order]
            best: dict[tuple[int, int], int] = {}
            for j in np.flatnonzero(~asks).tolist():
                low, high = np.searchsorted(flat, sets[j], "left"), np.searchsorted(flat, sets[j], "right")
                n = high - low
                at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                both = np.bincount(whose[at], minlength=len(mine))
                for k in np.flatnonzero(both >= similarity * (sizes + len(sets[j]) - both) - 1e-9).tolist():
                    if root_of[mine[k]] != root_of[j]:
                        key = (int(ids[mine[k]]), int(root_of[j]))
                        best[key] = min(best.get(key, int(ids[j])), int(ids[j]))
            a, b = [k[0] for k in best], list(best.values())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _dealt(member, BLOCK, SHARD).groupBy("hood", "s", "b").applyInArrow(meet, "a bigint, b bigint").distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): near copies, a row for each row of docs.

    Sets of shingles link if their Jaccard similarity is at least similarity; texts without words
    are alike, a shorter text is one shingle. Rows of one id are one document, of the least text
    that its id names; a null id is alone.

    Equal sets count once. A set first meets the least other set that shares a band with it and
    passes the tests, which links most groups whole while each set is moved once. Then only sets of
    different classes that share a band are left to meet, so no link between classes is lost.
    """
    plan = scheme(similarity)
    own = staged(sketches(docs, id_col, text_col, shingle, plan.bands).filter("doc_id is not null"), "sketches")
    distinct = own.groupBy("digest").agg(F.min(F.struct("doc_id", "fp", "n", "bands", "minima")).alias("s"), F.count("*").alias("docs"))
    distinct = staged(distinct.select("digest", F.col("s.doc_id").alias("id"), "s.fp", "s.n", "s.bands", "s.minima", "docs"), "distinct")
    sketch = distinct.select("id", "fp", "n", "minima")
    banded = distinct.select("id", F.explode("bands").alias("key"))  # keys of different bands have different seeds
    size = staged(banded.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("least")).filter("size > 1"), "buckets")
    banded = staged(salted_join(banded, size, ["key"], "size", "id"), "bands")

    def may(a, b):
        tests = (a["n"] >= similarity * b["n"] - 1e-9) & (b["n"] >= similarity * a["n"] - 1e-9) & chain_test(a["fp"], b["fp"], plan.far_bits, FAR_SEGMENTS)
        return tests & (hamming(a["fp"], b["fp"]) <= plan.far_bits) & (agreeing(a["minima"], b["minima"], plan.bands * BAND_ROWS) >= plan.agreed)

    body = F.struct("fp", "n", "minima")
    star = staged(banded.filter("id <> least").select("id", "least").distinct(), "stars")
    hub = staged(star.groupBy("least").agg(F.count("*").alias("c")).join(sketch.withColumnRenamed("id", "least"), "least").select("least", "c", body.alias("y")), "hubs")
    star = salted_join(star.join(sketch, "id").select("id", "least", body.alias("x")), hub, ["least"], "c", "id").filter(may(F.col("x"), F.col("y")))
    star = staged(star.groupBy("id").agg(F.min("least").alias("b")).select(F.col("id").alias("a"), "b"), "candidates")
    edges = _alike(star, docs, id_col, text_col, shingle, similarity)
    roots = staged(components(edges), "roots")

    # Buckets that still hold several classes.
    known = staged(banded.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")).drop("least"), "known")
    mixed = known.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("id").alias("least"), F.first("size").alias("most")).filter("lo <> hi")
    known = staged(salted_join(known, staged(mixed.select("key", "least", "most"), "mixed"), ["key"], "most", "id"), "known")
    few = known.filter(F.col("size") <= PAIRED).join(sketch, "id").groupBy("key").agg(F.collect_list(F.struct("id", "root", "fp", "n", "minima")).alias("xs"))  # at most PAIRED each
    pairs = few.select(F.explode("xs").alias("x"), "xs").select("x", F.explode(F.filter("xs", lambda y: (y["id"] < F.col("x")["id"]) & (y["root"] != F.col("x")["root"]) & may(F.col("x"), y))).alias("y"))
    pairs = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    large = staged(known.filter(F.col("size") > PAIRED).select("id", "root", "least").distinct(), "large")
    if not large.isEmpty():
        place = staged(components(large.select(F.col("id").alias("a"), F.col("least").alias("b"))), "hoods")
        member = _neighbourhoods(large.select("id", "root").distinct().join(sketch, "id"), place)
        near = staged(_promising(member, plan), "promising")
        pairs = pairs.union(near.join(place.withColumnRenamed("node", "id"), "id").select(F.col("id").alias("a"), F.col("root").alias("b")))
    pairs = staged(pairs, "pairs")
    if not pairs.isEmpty():
        place = staged(components(pairs), "hoods")
        root = roots.select(F.col("node").alias("id"), "root")
        member = place.select(F.col("node").alias("id")).join(root, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
        member = staged(_neighbourhoods(member, place), "members")
        found = _sets(member.select("id"), docs, id_col, text_col, shingle)
        edges = edges.union(staged(_met(member.join(found, "id"), similarity), "rest"))
        discard(found)
        roots = staged(components(edges), "roots")
    named = distinct.select("digest", "id", "docs").join(roots.withColumnRenamed("node", "id"), "id", "left").select("digest", "docs", F.coalesce("root", "id").alias("component_id"))
    return salted_join(own.select("doc_id", "digest"), staged(named, "named"), ["digest"], "docs", "doc_id").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without those that have a near copy of smaller id in their class.

    All columns stay, whatever their names. Null and empty texts are near copies of each other. Of
    rows that repeat an id and text one stays; rows with a null id stay; an empty table gives none.
    """
    found = staged(classes(docs, id_col, text_col, shingle, similarity).groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count("*").alias("n")), "classes")
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))  # so that no name clashes with those made here
    doc, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    plain = plain.withColumn("id", F.col(doc).cast("long"))
    # Only rows that may go, or repeat, meet the list; all others stay where they are.
    marked = found.filter("least < doc_id or n > 1").select(F.col("doc_id").alias("id"))
    slot, sent = _bitmap(marked)

    @F.arrow_udf("boolean")
    def may_go(slots: pa.Array) -> pa.Array:
        return pa.array(_has(sent.value, slots.to_numpy()))

    meant = F.when(F.col("id").isNotNull(), may_go(F.coalesce(slot, F.lit(0)))).otherwise(False)
    told = plain.withColumn("meant", meant)
    kept = told.filter("meant").join(found.filter("least < doc_id").select(F.col("doc_id").alias("id")), "id", "left_anti")
    twice = found.filter("n > 1 and least >= doc_id").select(F.col("doc_id").alias("id"))
    if not twice.isEmpty():
        kept = kept.join(twice, "id", "left_anti").unionByName(kept.join(twice, "id", "left_semi").dropDuplicates([doc, text]))
    columns = [f"c{i}" for i in range(len(names))]
    return told.filter("not meant").select(*columns).union(kept.select(*columns)).toDF(*names)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components that links of at most two bits make."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

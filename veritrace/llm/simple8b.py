"""Token ids as files of Simple-8b words.

The format. A word is 64 bits: the low 4 bits hold a selector, the other 60 a fixed number of ids of
equal width, the first id lowest. Selector 0 is an escape: the next word holds one value of 60 bits
or more as it is; selector 1 stands for 120 zeros and has no payload. A block is a list of whole
documents: their ids and lengths, the words, and a skip table that gives about every SKIP words the
word and the number of values before it, so any part of a block can be decoded on its own and all its words at
once. Blocks are the rows of Parquet files (Spark writes them, so any file system does), a shard of
blocks is what one task wrote; shards, blocks and documents ascend by document id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_ranges, map_batches, scratch, table

#: Values in a word and bits for each, by selector; 0 and 1 are special.
COUNTS = (1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
#: Bits that each value below 2**16 takes.
_WIDTH = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)
END_ID = 0
#: A block is closed at so many ids or documents; a longer document has a block of its own.
BLOCK_IDS, BLOCK_DOCS = 1 << 18, 1 << 14
SKIP = 1 << 10


def encode(values: np.ndarray) -> np.ndarray:
    """Words for non-negative integers below 2**64; each word takes as many values as fit."""
    v = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64)
    if v.max() < len(_WIDTH):
        width = _WIDTH[v]
    else:
        width = np.zeros(n, np.uint8)
        for w in range(60):
            np.putmask(width, v >= np.uint64(1 << w), w + 1)
        np.putmask(width, v >= np.uint64(1 << 60), 64)
    # best[i]: the selector of a word that starts at value i; a run of k values has its widest at most w.
    best = np.full(n, 15, np.uint8)
    run, length = width, 1  # run[i]: the widest of values i .. i + length - 1
    for s in range(14, 0, -1):
        k, w = COUNTS[s], WIDTHS[s]
        if n < k:
            break
        while length < k:
            step = min(length, k - length)
            run = np.maximum(run[: len(run) - step], run[step:])
            length += step
        fits = run <= w
        if not fits.any() and not (run <= 8).any():
            break  # no longer run can fit a narrower width
        np.putmask(best[: len(fits)], fits, s)
    best[width == 64] = 0
    step = np.asarray(COUNTS, np.uint8)[best].tobytes()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.asarray(starts, np.int64)
    selector = best[starts]
    slots = 1 + (selector == 0)
    place = np.cumsum(slots) - slots
    words = np.zeros(int(slots.sum()), np.uint64)
    for s in np.unique(selector).tolist():
        own = starts[selector == s]
        if s == 0:
            words[place[selector == 0] + 1] = v[own]
            continue
        made = np.full(len(own), s, np.uint64)
        if s > 1:
            for k in range(COUNTS[s]):
                made |= v[own + k] << np.uint64(4 + k * WIDTHS[s])
        words[place[selector == s]] = made
    return words


def _layout(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its selector (16: the raw value after an escape) and how many values it holds."""
    selector = (words & np.uint64(15)).astype(np.int64)
    maybe = np.flatnonzero(selector == 0)
    raw = -1
    for k in maybe.tolist():  # escapes are rare; a raw value may end in any four bits
        if k != raw:
            raw = k + 1
            selector[raw] = 16
    counts = np.asarray((0, *COUNTS[1:], 1), np.int64)[selector]
    return selector, counts


def decode(words: np.ndarray) -> np.ndarray:
    """The values of words that encode() made."""
    words = np.ascontiguousarray(words, dtype=np.uint64)
    selector, counts = _layout(words)
    place = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selector).tolist():
        if s in (0, 1):
            continue
        own = selector == s
        at, w = place[own], words[own]
        if s == 16:
            out[at] = w
            continue
        mask = np.uint64((1 << WIDTHS[s]) - 1)
        for k in range(COUNTS[s]):
            out[at + k] = (w >> np.uint64(4 + k * WIDTHS[s])) & mask
    return out


def skips(words: np.ndarray) -> np.ndarray:
    """Rows (word, number of values before it) about every SKIP words, never inside an escape."""
    selector, counts = _layout(words)
    at = np.arange(0, len(words), SKIP)
    at += selector[at] == 16
    return np.stack([at, (np.cumsum(counts) - counts)[at]], axis=1)


def decode_from(words: np.ndarray, table_: np.ndarray, first: int, count: int) -> np.ndarray:
    """Values first .. first + count - 1 of a block, decoding only the words that hold them."""
    k = int(np.searchsorted(table_[:, 1], first, side="right")) - 1
    stop = int(np.searchsorted(table_[:, 1], first + count, side="left"))
    at, before = table_[k].tolist()
    return decode(words[at : int(table_[stop, 0]) if stop < len(table_) else len(words)])[first - before :][:count]


BLOCKS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("words", pa.binary()), ("skips", pa.binary())])
BLOCKS_DDL = "shard int, block int, first bigint, n_ids bigint, doc_ids array<bigint>, doc_lengths array<bigint>, words binary, skips binary"


def write_ids(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Writes the ids of every text, and end_id after each, in ascending order of the ids.

    A null text is empty and still has its end id; null ids come first; rows of one id keep
    together in order of their texts. One range shuffle moves each text once; blocks leave the
    task as they fill. Columns of other names are ignored.
    """
    from pyspark import TaskContext

    from .tokens import encoder

    end = np.asarray([end_id], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        ids, lengths, parts, n, block, first = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            words = encode(np.frombuffer(b"".join(parts), "<u4"))
            row = {"shard": shard, "block": block, "first": first, "n_ids": n, "doc_ids": ids, "doc_lengths": lengths, "words": words.astype("<u8").tobytes(), "skips": skips(words).astype("<i8").tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=BLOCKS)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                made = enc.encode(text.as_py() or "") + end
                own = len(made) // 4
                if ids and (n + own > BLOCK_IDS or len(ids) >= BLOCK_DOCS):
                    yield flush()
                    block, first = block + 1, first + n
                    ids, lengths, parts, n = [], [], [], 0
                ids.append(doc_id.as_py())
                lengths.append(own)
                parts.append(made)
                n += own
        if ids:
            yield flush()

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    map_batches(by_ranges(narrow, "id", "text"), rows, BLOCKS_DDL).write.option("compression", "zstd").parquet(path)


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int64()))])
READ_DDL = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids array<bigint>"


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row a document of the files: where its ids start among all, how many, their crc32 and, if asked for, the ids."""
    blocks = spark.read.schema(BLOCKS_DDL).parquet(path)
    totals = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}  # a row for each writing task
    before, at = {}, 0
    for shard in sorted(totals):
        before[shard] = at
        at += totals[shard]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
                values = decode(np.frombuffer(row["words"].as_py(), "<u8"))
                ids = values.astype("<u4")
                lengths = np.asarray(row["doc_lengths"].as_py(), np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                raw = memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                kept = [values[a:b].astype(np.int64) for a, b in zip(starts, ends, strict=True)] if with_ids else [None] * len(crcs)
                offset = before[row["shard"].as_py()] + row["first"].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((row["doc_ids"].as_py(), starts + offset, lengths, crcs, kept), READ.types, strict=True)], schema=READ)

    return map_batches(blocks.select("shard", "first", "doc_ids", "doc_lengths", "words"), rows, READ_DDL)


def op3_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents, writes their ids as Simple-8b files, reads these back and reports each document."""
    import public_tokenizers

    path = scratch(spark, "simple8b")
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")

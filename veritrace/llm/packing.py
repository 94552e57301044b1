"""Packing token pieces into windows by minimum bin slack.

A document longer than the window fills whole windows from its start; what is left of each document
is one piece shorter than the window. The multiset of left lengths has at most one count for each
length below the window, whatever the number of documents, and is all that the driver sees. It
plans patterns: the longest length left opens a window, a subset-sum dynamic program over bits finds
the multiset of the other lengths that comes closest to the room left, backtracking gives how many
of each, and the pattern is used as often as the counts allow. Pieces then find their window by
their rank among the pieces of their length, so no task ever holds a length's pieces together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, staged, table

WINDOW = 4096
END_ID = 2


def fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """How many of each length (counts: how many there are) come closest to room without exceeding it.

    One bit set per total; lengths are added from the longest down, copies in doubling bundles,
    and the search ends as soon as room itself is reached.
    """
    mask = (1 << (room + 1)) - 1
    reach, trail = 1, []
    for length in sorted((x for x, c in counts.items() if c > 0 and x <= room), reverse=True):
        left, bundle = min(counts[length], room // length), 1
        while left:
            take = min(bundle, left)
            grown = reach | (reach << (length * take)) & mask
            if grown != reach:
                trail.append((length, take, reach))
                reach = grown
            left, bundle = left - take, bundle * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(trail):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(times, lengths with how many of each) for windows that use every piece once."""
    left, out = {x: c for x, c in counts.items() if c > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        used = fill(window - longest, left)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[x] // k for x, k in used.items())
        out.append((times, used))
        for x, k in used.items():
            left[x] -= times * k
            if not left[x]:
                del left[x]
    return out


def _slots(patterns: list[tuple[int, dict[int, int]]], first_sequence: int = 0) -> dict[int, np.ndarray]:
    """By length, rows (first rank, copies a window, sequence of the first window, offset of the first copy)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = first_sequence
    for times, used in patterns:
        offset = 0
        for length in sorted(used, reverse=True):
            out.setdefault(length, []).append((ranks.get(length, 0), used[length], sequence, offset))
            ranks[length] = ranks.get(length, 0) + times * used[length]
            offset += length * used[length]
        sequence += times
    return {x: np.asarray(rows, np.int64) for x, rows in out.items()}


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("nth", pa.int64()), ("ids", pa.binary())])
PIECES_DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, nth bigint, ids binary"
#: Units that each of the encoder's two tables keeps: packing runs beside other stages' memory.
UNITS, NEW_UNITS = 150_000, 75_000


def cut(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of each row of docs, with the task that cut them, their number among its pieces of that length and, if asked for, their ids.

    Staged in the shared folder: task and number are then fixed, whatever runs again later.
    """
    from pyspark import TaskContext

    from .tokens import encoder

    end = np.asarray([end_id], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer, UNITS, NEW_UNITS), TaskContext.get().partitionId(), [0] * (window + 1)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = memoryview(enc.encode(text.as_py() or "") + end)
                n = len(ids) // 4
                for start in range(0, n, window):
                    own = ids[4 * start : 4 * (start + window)]
                    k = len(own) // 4
                    out.append((doc_id.as_py(), start, k, zlib.crc32(own), n, part, seen[k], bytes(own) if with_ids else None))
                    seen[k] += 1
            columns = zip(*out, strict=True) if out else ([] for _ in PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PIECES.types, strict=True)], schema=PIECES)

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return staged(map_batches(narrow, rows, PIECES_DDL), "pieces")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece: its document, where it starts there, its length, the crc32 of its ids, the
    document's tokens, its sequence, its offset in it and, with_ids, its ids, little-endian unsigned
    32-bit integers (column ids): a sequence is its pieces' ids by offset.

    A null text is empty: its only id is end_id. Each row of docs is packed, repeated rows and null
    ids too; an empty table gives no rows. Columns of other names are ignored.
    """
    pieces = cut(docs, tokenizer, id_col, text_col, window, end_id, with_ids)
    # Task by length: the ranks that earlier tasks' pieces of that length take up. A row for each task and length.
    by_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = staged(by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")), "pieces-before")
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most window rows
    patterns = plan(counts, window)
    slots = _slots(patterns)  # a bounded number of rows for each length: patterns follow the lengths, not the pieces

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def placed(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        length, rank = lengths.to_numpy(), ranks.to_numpy()
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
            x = int(length[own[0]])
            table_ = slots[x]
            hit = table_[np.searchsorted(table_[:, 0], rank[own], side="right") - 1]
            window_no, copy = np.divmod(rank[own] - hit[:, 0], hit[:, 1])
            sequence[own] = hit[:, 2] + window_no
            offset[own] = hit[:, 3] + copy * x
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    # The small table of ranks goes to all tasks if Spark finds it small: pieces with ids are better left where they are.
    ranked = before.drop("n") if with_ids else before.drop("n").hint("merge")
    found = pieces.join(ranked, ["part", "length"]).withColumn("at", placed("length", F.col("before") + F.col("nth")))
    return found.select(*PIECES.names[:5], "at.sequence_id", "at.offset", *(["ids"] if with_ids else []))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

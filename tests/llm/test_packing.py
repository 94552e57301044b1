import collections
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from veritrace.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")


def test_fill_is_the_best_there_is():
    random.seed(2)
    for _ in range(60):
        counts = {random.randint(1, 40): random.randint(1, 4) for _ in range(5)}
        room = random.randint(0, 90)
        sums = {0}
        for x, c in counts.items():
            sums = {s + x * k for s in sums for k in range(c + 1)}
        used = packing.fill(room, counts)
        assert sum(x * k for x, k in used.items()) == max(s for s in sums if s <= room)
        assert all(k <= counts[x] for x, k in used.items())


def test_plan_uses_every_piece_once():
    random.seed(1)
    for _ in range(30):
        counts = {x: random.randint(1, 30) for x in random.sample(range(1, 200), random.randint(1, 60))}
        used = collections.Counter()
        for times, pattern in packing.plan(counts, 200):
            assert sum(x * k for x, k in pattern.items()) <= 200
            used.update({x: times * k for x, k in pattern.items()})
        assert used == counts


def test_sequences(spark):
    rows = [(1, "a b c " * 3000), (2, None), (3, ""), (3, "x y"), (3, "x y"), (4, "a<|endoftext|> b <|startoftext|>"), (None, "z"), *((10 + k, "word " * (k % 700)) for k in range(300))]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, part int, offset int").repartition(3)
    plain = Tokenizer.from_file(FILE)
    ids = {t: np.asarray([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in rows}
    want = collections.Counter((d, a, min(4096, len(ids[t]) - a), zlib.crc32(ids[t][a : a + 4096].tobytes()), len(ids[t])) for d, t in rows for a in range(0, len(ids[t]), 4096))
    got = packing.pack(df, FILE).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    whole = collections.Counter()
    for r in packing.pack(df, FILE, with_ids=True).collect():
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        whole[r.sequence_id] += r.length
    assert max(whole.values()) <= 4096 and sum(whole.values()) == sum(r.length for r in got)
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 4096) + 1
    assert packing.pack(df.limit(0), FILE).count() == 0

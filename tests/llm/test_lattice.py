import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from veritrace.llm import lattice as q

FILE = public_tokenizers.path("piece_bpe_32k.model")
PIECES = ["▁", "a", "b", "ab", "▁a", "aba"]
SCORES = np.asarray([[-3.0, -1.0], [-2.0, -2.0], [-2.5, -3.0], [-1.7, -4.0], [-1.2, -1.0], [-4.0, -2.0]])
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ways(text, c):
    """The sum over all ways to cut the text."""
    if not text:
        return 1.0
    total = sum(math.exp(SCORES[i, c]) * ways(text[len(p) :], c) for i, p in enumerate(PIECES) if text.startswith(p))
    return total + (math.exp(-9.0 * len(text[0].encode())) * ways(text[1:], c) if text[0] not in PIECES else 0.0)


def test_forward_recursion():
    lattice = q.Lattice({p: i for i, p in enumerate(PIECES)}, SCORES, np.full((256, 2), -9.0), np.log([0.3, 0.4]))
    words = ["a", "ab", "abab", "bé", "aabaab", "xyz", ""]
    got = lattice.log_probabilities(words)
    assert got == pytest.approx(np.asarray([[math.log(ways("▁" + w, c) * (0.3, 0.4)[c]) for c in (0, 1)] for w in words]))


def test_expected_uses():
    lattice = q.Lattice({p: i for i, p in enumerate(PIECES)}, SCORES, np.full((256, 2), -9.0), np.log([0.3, 0.4]))
    words, has = ["a", "abab", "bé", "aabaab", "b" * 150], np.asarray([[1, 0], [1, 1], [0, 1], [1, 1], [1, 0]])

    def every(text):
        """All ways to cut a text, as lists of pieces and bytes."""
        if not text:
            yield []
            return
        for i, p in enumerate(PIECES):
            if text.startswith(p):
                yield from ([i, *rest] for rest in every(text[len(p) :]))
        if text[0] not in PIECES:
            yield from ([*(len(PIECES) + b for b in text[0].encode()), *rest] for rest in every(text[1:]))

    want = np.zeros((len(PIECES) + 256, 2))
    for w, h in zip(words[:4], has[:4], strict=True):
        for c in (0, 1):
            cuts = list(every("▁" + w))
            p = np.asarray([math.exp(sum(SCORES[i, c] if i < len(PIECES) else -9.0 for i in x)) for x in cuts])
            for x, share in zip(cuts, p / p.sum(), strict=True):
                for i in x:
                    want[i, c] += share * h[c]
    want[PIECES.index("▁"), 0] += 1  # the long word: one way
    want[PIECES.index("b"), 0] += 150
    assert lattice.uses(words, has) == pytest.approx(want)


def brute(docs, classes_of):
    """The whole model's log10 probability of each text, word by word and way by way."""
    import sentencepiece

    m, v = sentencepiece.SentencePieceProcessor(model_file=FILE), q.vocabulary(FILE)
    tokens = [[w.lower() for w in (t or "").split()] + [""] for _, t in docs]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in docs]
    trained = [(c or "", x) for c, x, h in zip(classes_of, tokens, held, strict=True) if not h]
    of = collections.Counter(c for c, _ in trained)
    classes = sorted(of, key=lambda c: (-of[c], c))
    counts = {c: collections.Counter(w for d, x in trained if d == c for w in x) for c in classes}
    both = sum(counts.values(), collections.Counter())
    once, twice = (sum(n == k for n in both.values()) for k in (1, 2))
    discount = once / (once + 2 * twice) if once else 0.5
    known = [i for i in range(len(v.names)) if v.usable[i]]
    prior = dict(zip(known, v.prior[known] / v.prior[known].sum(), strict=True))
    piece = {v.names[i]: i for i in known if not v.first_byte <= i < v.first_byte + 256}

    def arcs(text):
        """By end, (begin, pieces): single characters that are no piece are their bytes."""
        out = []
        for j in range(1, len(text) + 1):
            own = [(i, [piece[text[i:j]]]) for i in range(max(0, j - 16), j) if text[i:j] in piece]
            if text[j - 1] not in piece:
                own.append((j - 1, [v.first_byte + b for b in text[j - 1].encode()]))
            out.append(own)
        return out

    def forward(text, p):
        a = [1.0]
        for own in arcs(text):
            a.append(sum(a[i] * math.prod(p[k] for k in ks) for i, ks in own))
        return a

    def weights(used):
        """P of pieces and of the end, by class, after uses."""
        made = {}
        total = {i: sum(used[c].get(i, 0.0) for c in classes) for i in known}
        for c in classes:
            n, types = sum(used[c].values()), max(1.0, len(counts[c]))
            stop = min(0.5, max(0.05, types / max(1.0, n + types)))
            own = {i: used[c].get(i, 0.0) + q.BORROWED * total[i] for i in known}
            size = sum(own.values()) + q.PRIOR
            made[c] = {i: (own[i] + q.PRIOR * prior[i]) / size * (1 - stop) for i in known}, stop
        return made

    used = {c: collections.Counter(i for w in counts[c] if w for i in m.encode(w) if i in prior) for c in classes}
    model = weights(used)
    for _ in range(q.UPDATES):
        used = {c: collections.Counter() for c in classes}
        for c in classes:
            p = model[c][0]
            for w in counts[c]:
                if w:
                    text = "▁" + w
                    a = forward(text, p)
                    b = [0.0] * len(text) + [1.0]
                    for j in range(len(text), 0, -1):
                        for i, ks in arcs(text)[j - 1]:
                            b[i] += math.prod(p[k] for k in ks) * b[j]
                    for j, own in enumerate(arcs(text), 1):
                        for i, ks in own:
                            for k in ks:
                                used[c][k] += a[i] * math.prod(p[x] for x in ks) * b[j] / a[-1]
        model = weights(used)

    def marginal(w, c):
        n = sum(counts[c].values())
        reserve = discount * len(counts[c]) / n
        p, stop = model[c]
        sub = q.END_SHARE if w == "" else forward("▁" + w, p)[-1] * stop * (1 - q.END_SHARE)
        return max(0.0, counts[c][w] - discount) / n + reserve * q.SHARED * both[w] / sum(both.values()) + reserve * (1 - q.SHARED) * sub

    out = []
    for x in tokens:
        each = []
        for c in classes:
            seen, total = collections.Counter(), math.log10((counts[c][""] + 0.5) / (both[""] + 0.5 * len(classes)))
            for i, w in enumerate(x):
                total += math.log10((q.URN * marginal(w, c) + seen[w]) / (q.URN + i))
                seen[w] += 1
            each.append(total)
        top = max(each)
        out.append(top + math.log10(sum(10 ** (e - top) for e in each)))
    return out


def test_the_whole_model(spark, monkeypatch):
    docs = [(k, f"alpha beta Betta w{k % 5} gamma{k % 3} naïve") for k in range(24)] + [(1, None), (2, ""), (30, "same " * 9), (31, "unheard-of Ωmega alphabeta"), (37, "beta same alpha")]
    classes = ["en" if k % 3 else None for k in range(len(docs))]
    df = spark.createDataFrame([(*d, c, k) for k, (d, c) in enumerate(zip(docs, classes, strict=True))], "doc_id long, text string, lang string, row int")
    want = sorted(zip([d for d, _ in docs], brute(docs, classes), strict=True))
    for dictionary in (q.DICTIONARY, 2):
        monkeypatch.setattr(q, "DICTIONARY", dictionary)
        got = sorted((r.doc_id, r.score) for r in q.score(df, FILE).collect())
        assert [d for d, _ in got] == [d for d, _ in want]
        assert [x for _, x in got] == pytest.approx([x for _, x in want], rel=1e-5)


def test_log_gamma():
    x = np.asarray([1e-8, 0.3, 1.0, 5.5, 3000.0])
    assert q.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-9, abs=1e-9)


def check(docs, got):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None] for _, t in docs]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in docs]
    c = collections.Counter(w for x, h in zip(tokens, held, strict=True) if not h for w in x)
    n = sum(c.values())
    want = sorted(((str(d), h, len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in x), 4)) for (d, _), x, h in zip(docs, tokens, held, strict=True)), key=str)
    assert sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=str) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_counts_and_base(spark, monkeypatch):
    docs = [(k, f"Alpha beta w{k % 9} x{k}") for k in range(60)] + [(1, None), (2, ""), (None, "a b a"), (3, "same " * 5000), (3, "same"), (70, "q" * 3000)]
    df = spark.createDataFrame([(*d, "en" if k % 3 else None, 5) for k, d in enumerate(docs)], "doc_id long, text string, lang string, n int")
    got = q.score(df, FILE).collect()
    check(docs, got)
    monkeypatch.setattr(q, "DICTIONARY", 3)  # nearly all words by the join
    again = q.score(df, FILE).collect()
    check(docs, again)
    assert sum(r.score for r in again) == pytest.approx(sum(r.score for r in got), rel=1e-6)
    assert q.score(df.limit(0), FILE).count() == 0


def test_pieces_of_long_words(spark, monkeypatch):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=FILE)
    words = ["abc", "日本語" * 400, "a" * 300 + "zebra", "x", "q" * 900]
    own = [(w, int(k % 2 == 0), int(k > 0)) for k, w in enumerate(words)]
    df = spark.createDataFrame(own, "word string, c0 int, c1 int")
    want = np.zeros((2, len(m)))
    for w, *c in own:
        for i in m.encode(w):
            want[:, i] += c
    assert np.array_equal(q.piece_counts(df, FILE, len(m), 2), want)
    monkeypatch.setattr(q, "CALL_CHARS", 100)
    assert ["".join(t for at, texts in q.calls(words) for i, t in zip(at, texts, strict=True) if i == k) for k in range(5)] == words


def test_many_classes_and_none_to_train_on(spark):
    docs = [(k, "a b c") for k in range(40)]
    df = spark.createDataFrame([(*d, f"l{k % 11}") for k, d in enumerate(docs)], "doc_id long, text string, lang string")
    check(docs, q.score(df, FILE).collect())
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][:3]
    only = [(k, "a b") for k in held]
    check(only, q.score(spark.createDataFrame([(*d, "x") for d in only], "doc_id long, text string, lang string"), FILE).collect())

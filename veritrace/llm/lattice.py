"""Document likelihood with a subword lattice.

A word can be had in many ways: from any of the ways to cut it into pieces of an existing subword
vocabulary, or whole, as an arc of its own, if the corpus has it. The marginal probability sums over
all of them; over the pieces by a forward recursion in log space. Pieces weigh what the vocabulary's
scores say, updated by how often each piece is used in the training words: first as the vocabulary
itself cuts them, then by the expected uses over all ways to cut them (a forward and a backward
recursion). Whole words weigh their discounted share of the training tokens. Both are had for each
class of documents (the languages). A document is drawn from one class, and its words from an urn that begins with these marginals and
gains a word with every draw (Polya's), so words that recur are likelier: its probability is the
mixture over the classes. All counts are of the whole corpus and stay in tables: only a bounded
dictionary of the most frequent words is sent out, and all other words meet their probabilities in a
join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_batches, staged, table

#: Words of up to so many bytes in the dictionary that is sent to the workers, and longer ones: at most 64 MB or so, and 16 MB.
DICTIONARY, DICTIONARY_BYTES = 1 << 18, 128
LONG_WORDS, LONG_BYTES = 1 << 8, 1 << 16
#: Classes of documents that have counts of their own; all others are one more.
CLASSES = 8
#: Words counted in a worker before the counts are handed on.
COUNTED = 300_000
#: Words that are cut into pieces at a time, and their characters; a longer word is cut in slices of so many.
CALL, CALL_CHARS = 5000, 1 << 18
#: Share of the end among tokens in the lattice's own distribution, and uses that the vocabulary's scores count for.
END_SHARE, PRIOR = 0.01, 1000.0
#: Of a class's reserve what goes to the words of other classes, what pieces used in all classes weigh in one, and the urn's size at the start.
SHARED, BORROWED, URN = 0.1, 0.02, 3000.0
FOLDS, HELD_OUT = 7, 2
#: How often the pieces' weights are updated by their expected uses.
UPDATES = 1
END = ""
#: Words that pass through the lattice together, characters from which on a word passes alone, and in slices for the expected uses.
TOGETHER, LONG, SLICE = 20_000, 128, 1 << 16

_sent: dict[int, object] = {}


Arcs = list[list[tuple[int, np.ndarray, np.ndarray]]]


class Lattice:
    """Log probabilities (natural) of words from scored pieces, for several classes at once.

    scores: a row a piece and a column a class; byte_scores: the same for the 256 bytes. Pieces are
    found by a hash of 64 bits of their characters, for many words and places at once.
    """

    def __init__(self, pieces: dict[str, int], scores: np.ndarray, byte_scores: np.ndarray, stop: np.ndarray):
        self.scores, self.bytes, self.stop = scores, byte_scores, stop
        self.longest = max(map(len, pieces), default=1)
        self.seen, self.tables = np.zeros(1 << 20, bool), {}
        for n in range(1, self.longest + 1):
            own = [p for p in pieces if len(p) == n]
            if own:
                h = np.zeros(len(own), np.uint64)
                for column in _codes(own).T:
                    h = (h ^ column) * _MIX
                order = np.argsort(h)
                self.tables[n] = h[order], np.asarray([pieces[p] for p in own], np.int64)[order]
                self.seen[h >> np.uint64(44)] = True

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """A row a word. The forward recursion runs over words of one length together."""
        out = np.zeros((len(words), self.scores.shape[1]))
        for own in _by_length(words):
            texts = ["\u2581" + words[k] for k in own]
            out[own] = self._forward(texts, self.arcs(_codes(texts)))[-1]
        return out + self.stop

    def uses(self, words: list[str], has: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, then of each byte, by class: of the words that the class has, over all ways to cut them.

        A word longer than SLICE characters counts in slices.
        """
        counts = np.zeros((len(self.scores) + 256, self.scores.shape[1]))
        parts = [(w[a : a + SLICE], k, a) for k, w in enumerate(words) for a in range(0, max(1, len(w)), SLICE)]
        for own in _by_length([p[0] for p in parts]):
            texts = [("" if parts[k][2] else "\u2581") + parts[k][0] for k in own]
            for same in {len(t) for t in texts}:
                at = [i for i, t in enumerate(texts) if len(t) == same]
                self._expected([texts[i] for i in at], has[[parts[own[i]][1] for i in at]].astype(np.float64), counts)
        return counts

    def arcs(self, codes: np.ndarray) -> Arcs:
        """By the place where they end, (length, rows, pieces) of the pieces in rows of characters."""
        m, n = codes.shape
        out: Arcs = [[] for _ in range(n + 1)]
        if m == 1:  # a long word: all places at once
            h = np.zeros(n, np.uint64)
            found = []
            for size in range(1, min(self.longest, n) + 1):
                h = (h[: n - size + 1] ^ codes[0, size - 1 :]) * _MIX
                at, ids = self._pieces(h, size)
                found.append((at + size, np.full(len(at), size), ids))
            end, size, ids = (np.concatenate(x) for x in zip(*found, strict=True))
            row = np.zeros(1, np.int64)
            for e, k, i in zip(end.tolist(), size.tolist(), ids.tolist(), strict=True):
                out[e].append((k, row, np.asarray([i])))
            return out
        for begin in range(n):
            h = np.zeros(m, np.uint64)
            for size in range(1, min(self.longest, n - begin) + 1):
                h = (h ^ codes[:, begin + size - 1]) * _MIX
                rows, ids = self._pieces(h, size)
                if len(rows):
                    out[begin + size].append((size, rows, ids))
        return out

    def _pieces(self, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.seen[h >> np.uint64(44)])
        if size not in self.tables or not len(at):
            return at[:0], at[:0]
        known, ids = self.tables[size]
        place = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
        hit = known[place] == h[at]
        return at[hit], ids[place[hit]]

    def _steps(self, texts: list[str], arcs: Arcs) -> list[tuple[np.ndarray, np.ndarray]]:
        """By place, the rows whose character there is no piece, and the scores of its bytes."""
        out = []
        for j in range(1, len(texts[0]) + 1):
            alone = np.ones(len(texts), bool)
            for size, rows, _ in arcs[j]:
                if size == 1:
                    alone[rows] = False
            rows = np.flatnonzero(alone)
            out.append((rows, np.asarray([self.bytes[list(texts[k][j - 1].encode())].sum(axis=0) for k in rows.tolist()]).reshape(len(rows), self.scores.shape[1])))
        return out

    def _forward(self, texts: list[str], arcs: Arcs, keep: bool = False, steps=None) -> list[np.ndarray]:
        """log P of the first j characters, for the last places, or if kept for all."""
        steps = steps or self._steps(texts, arcs)
        alpha = [np.zeros((len(texts), self.scores.shape[1]))]
        for j in range(1, len(texts[0]) + 1):
            total = np.full_like(alpha[0], -np.inf)
            for size, rows, ids in arcs[j]:
                total[rows] = np.logaddexp(total[rows], alpha[-size][rows] + self.scores[ids])
            rows, step = steps[j - 1]
            if len(rows):
                total[rows] = np.logaddexp(total[rows], alpha[-1][rows] + step)
            alpha.append(total)
            if not keep and len(alpha) > self.longest:
                del alpha[0]
        return alpha

    def _expected(self, texts: list[str], has: np.ndarray, counts: np.ndarray) -> None:
        """Adds the expected uses in texts of one length, weighted by has, to counts."""
        arcs, n, pieces = self.arcs(_codes(texts)), len(texts[0]), len(self.scores)
        if not n:
            return
        steps = self._steps(texts, arcs)
        alpha = self._forward(texts, arcs, True, steps)
        whole = alpha[-1]
        beta: list[np.ndarray] = [np.full_like(whole, -np.inf) for _ in range(n)] + [np.zeros_like(whole)]
        ids_, uses_ = [], []
        for j in range(n, 0, -1):
            rest = beta[j] - whole
            for size, rows, ids in arcs[j]:
                through = self.scores[ids] + beta[j][rows]
                beta[j - size][rows] = np.logaddexp(beta[j - size][rows], through)
                ids_.append(ids)
                uses_.append(np.exp(alpha[j - size][rows] + self.scores[ids] + rest[rows]) * has[rows])
            rows, step = steps[j - 1]
            if len(rows):
                beta[j - 1][rows] = np.logaddexp(beta[j - 1][rows], step + beta[j][rows])
                use = np.exp(alpha[j - 1][rows] + step + rest[rows]) * has[rows]
                for k, r in enumerate(rows.tolist()):
                    for b in texts[r][j - 1].encode():
                        counts[pieces + b] += use[k]
        if ids_:
            ids, uses = np.concatenate(ids_), np.concatenate(uses_)
            for c in range(counts.shape[1]):
                counts[:pieces, c] += np.bincount(ids, uses[:, c], minlength=pieces)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _codes(texts: list[str]) -> np.ndarray:
    """The characters of texts of one length, a row a text."""
    n = len(texts[0])
    return np.asarray(texts, f"U{max(1, n)}").view(np.uint32).reshape(len(texts), max(1, n))[:, :n].astype(np.uint64)


def _by_length(words: list[str]) -> Iterator[list[int]]:
    """Places of the words of each length; those of long words alone."""
    found: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        if len(w) < LONG:
            found.setdefault(len(w), []).append(k)
        else:
            yield [k]
    yield from found.values()


def _gathered(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have so many rows or bytes."""
    held, n, b = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, b = n + batch.num_rows, b + batch.nbytes
        if n >= rows or b >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n, b = [], 0, 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps up."""
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - sum(np.log(x + i) for i in range(8))


class Vocabulary(NamedTuple):
    names: list[str]
    prior: np.ndarray
    usable: np.ndarray
    first_byte: int


def vocabulary(path: str) -> Vocabulary:
    """The pieces of a sentencepiece file with prior probabilities after their scores.

    Scores of merge order are ranks (0, -1, -2 ...): a piece weighs 1 / (10 + rank). Byte pieces
    weigh as the last one. Control pieces and those that cross words are left out.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [m.id_to_piece(i) for i in range(len(m))]
    scores = np.asarray([m.get_score(i) for i in range(len(m))])
    is_byte = np.asarray([m.is_byte(i) for i in range(len(m))])
    usable = np.asarray([not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) and "▁" not in x[1:] for i, x in enumerate(names)])
    weight = np.where(usable, 1.0 / (10.0 - np.where(is_byte, scores.min(initial=0.0, where=scores > -1e8), np.maximum(scores, -1e8))), 0.0)
    return Vocabulary(names, weight / weight.sum(), usable, int(np.flatnonzero(is_byte)[0]))


def words_of(text: bytes) -> list[bytes]:
    """Words at ASCII white space, A-Z in lower case."""
    return text.lower().split()


def count(docs: DataFrame, classes: list[str], k: int) -> DataFrame:
    """(word, n, c0, c1 ...): tokens of each word in all rows (held_out, cls, text), and in training rows by class.

    k: classes, one more than named if there are others.
    """
    of = {c: i for i, c in enumerate(classes)}
    schema = pa.schema([("word", pa.string()), ("cls", pa.int32()), ("n", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter() for _ in range(k + 1)]

        def flush() -> Iterator[pa.RecordBatch]:
            for c, words in enumerate(seen):
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()).cast(pa.string()), pa.array(np.full(len(words), c, np.int32)), pa.array(list(words.values()), pa.int64())], schema=schema)
                    words.clear()

        for batch in batches:
            for held_out, cls, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = words_of(text.as_py() or b"")
                words.append(b"")  # the end
                for a in range(0, len(words), COUNTED):
                    seen[k if held_out else of.get(cls, k - 1)].update(words[a : a + COUNTED])
                    if sum(map(len, seen)) > COUNTED:
                        yield from flush()
        yield from flush()

    found = map_batches(docs.select("held_out", "cls", "text"), rows, "word string, cls int, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col("cls") == i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(k)))


def calls(words: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Places of words and the words, or slices of long ones, in lists of at most CALL and about CALL_CHARS characters."""
    at, texts, size = [], [], 0
    for k, w in enumerate(words):
        for a in range(0, len(w), CALL_CHARS):
            at.append(k)
            texts.append(w[a : a + CALL_CHARS])
            size += len(texts[-1])
            if len(at) == CALL or size >= CALL_CHARS:
                yield at, texts
                at, texts, size = [], [], 0
    if at:
        yield at, texts


def piece_counts(words: DataFrame, path: str, size: int, k: int) -> np.ndarray:
    """How often each piece is used in each class's distinct words, all of their characters, by the vocabulary's own segmentation."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        total = np.zeros((k, size), np.int64)
        for batch in batches:
            own = batch.column(0).to_pylist()
            has = [batch.column(1 + c).to_numpy() > 0 for c in range(k)]
            for at, texts in calls(own):
                ids = m.encode(texts, out_type=int, num_threads=1)
                word = np.repeat(at, [len(x) for x in ids])
                flat = np.fromiter((i for x in ids for i in x), np.int64, len(word))
                for c in range(k):
                    total[c] += np.bincount(flat[has[c][word]], minlength=size)
        cls, used = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cls.astype(np.int32)), pa.array(used.astype(np.int32)), pa.array(total[cls, used])], schema=pa.schema([("cls", pa.int32()), ("piece", pa.int32()), ("n", pa.int64())]))

    out = np.zeros((k, size))
    summed = map_batches(words.select("word", *(f"c{i}" for i in range(k))), rows, "cls int, piece int, n bigint").groupBy("cls", "piece").agg(F.sum("n").alias("n"))
    for r in summed.collect():  # a row a class and piece of the vocabulary
        out[r["cls"], r["piece"]] = r["n"]
    return out


def expected_counts(words: DataFrame, lattice: Lattice, k: int) -> np.ndarray:
    """Expected uses of pieces and bytes in each class's distinct words, a row a piece."""
    schema = pa.schema([("piece", pa.int32()), ("uses", pa.list_(pa.float64()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(lattice.scores) + 256, k))
        for batch in _gathered(batches, TOGETHER, 8 << 20):
            total += lattice.uses(batch.column(0).to_pylist(), np.stack([batch.column(1 + c).to_numpy() > 0 for c in range(k)], axis=1))
        used = np.flatnonzero(total.any(axis=1))
        own = pa.FixedSizeListArray.from_arrays(pa.array(total[used].ravel()), k).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), own], schema=schema)

    out = np.zeros((len(lattice.scores) + 256, k))
    made = map_batches(words.select("word", *(f"c{i}" for i in range(k))), rows, "piece int, uses array<double>")
    for r in made.groupBy("piece").agg(*(F.sum(F.element_at("uses", c + 1)).alias(f"u{c}") for c in range(k))).collect():  # a row a piece of the vocabulary
        out[r["piece"]] = [r[f"u{c}"] for c in range(k)]
    return out


def most_frequent(words: DataFrame, room: int) -> DataFrame:
    """About room rows of (word, n) with the highest n, by a histogram of n: nothing is sorted, no task sees more than its own rows."""
    bucket = F.floor(F.log2("n") * 16)
    sizes = words.groupBy(bucket.alias("b")).count().collect()  # some hundred rows
    for r in sorted(sizes, key=lambda r: -r["b"]):
        if r["count"] > room:  # of the last bucket as many as there is room for, by their hash
            return words.filter((bucket > r["b"]) | ((bucket == r["b"]) & (F.pmod(F.xxhash64("word"), F.lit(1000)) < 980 * room // r["count"])))
        room -= r["count"]
    return words


class Corpus(NamedTuple):
    tokens: int  # training tokens
    types: int  # distinct training tokens
    discount: float
    class_tokens: np.ndarray
    class_types: np.ndarray
    class_docs: np.ndarray

    def marginal(self, counts: np.ndarray, sub: np.ndarray) -> np.ndarray:
        """log10 P(token | class), from rows of counts by class and of lattice probabilities (log10) by class."""
        n = np.maximum(1.0, self.class_tokens)
        reserve = np.where(self.class_tokens > 0, self.discount * self.class_types / n, 1.0)
        whole = np.maximum(0.0, counts - self.discount) / n + reserve * SHARED * counts.sum(axis=1, keepdims=True) / max(1, self.tokens)
        pieces = sub + np.log10(reserve * (1 - SHARED))
        with np.errstate(divide="ignore"):
            whole = np.log10(whole)
        top = np.maximum(whole, pieces)
        return top + np.log10(10.0 ** (whole - top) + 10.0 ** (pieces - top))


def score(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = "lang") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs.

    Rows whose crc32 of the id's text is 2 modulo 7 are held out of all counts. A null text is empty
    and has its end alone; a null id counts as the empty text; a null class is a class like any
    other; repeated rows count as often as they occur. The CLASSES largest classes have counts of
    their own, all others share one. Without training rows the lattice of the vocabulary's scores is
    all there is; an empty table gives no rows. Texts and words are whole, however long. Columns of
    other names are ignored.
    """
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    cls = F.coalesce(F.col(class_col).cast("string"), F.lit("")) if class_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold == HELD_OUT).alias("held_out"), cls.alias("cls"), F.col(text_col).cast("string").cast("binary").alias("text"))
    by_class = rows.filter(~F.col("held_out")).groupBy("cls").count().orderBy(F.col("count").desc(), "cls").limit(CLASSES + 1).collect()
    classes = [r["cls"] for r in by_class[:CLASSES]]
    k = len(classes) + (len(by_class) > CLASSES or not classes)
    counts = staged(count(rows, classes, k), "counts")
    c = [F.col(f"c{i}") for i in range(k)]
    trained = sum(c[1:], c[0])
    got = counts.agg(F.coalesce(F.sum(trained), F.lit(0)).alias("n"), F.count_if(trained > 0).alias("v"), F.count_if(trained == 1).alias("once"), F.count_if(trained == 2).alias("twice"), *(F.coalesce(F.sum(x), F.lit(0)).alias(f"n{i}") for i, x in enumerate(c)), *(F.count_if(x > 0).alias(f"v{i}") for i, x in enumerate(c))).first()
    ends = counts.filter(F.col("word") == END).first()
    discount = got["once"] / (got["once"] + 2 * got["twice"]) if got["once"] else 0.5
    corpus = Corpus(got["n"], got["v"], discount, *(np.asarray([float(r[f"{x}{i}"]) if r else 0.0 for i in range(k)]) for r, x in ((got, "n"), (got, "v"), (ends, "c"))))

    v = vocabulary(vocabulary_path)
    types = np.maximum(1.0, corpus.class_types)
    kept = [i for i in range(len(v.names)) if v.usable[i] and not v.first_byte <= i < v.first_byte + 256]
    every = np.asarray([*kept, *range(v.first_byte, v.first_byte + 256)])
    pieces, weight = {v.names[i]: j for j, i in enumerate(kept)}, v.prior[every] / v.prior[every].sum()

    def lattice_of(used: np.ndarray) -> Lattice:
        """The lattice after uses (pieces, then bytes, by class) of the distinct training words."""
        stop = np.clip(types / np.maximum(1.0, used.sum(axis=0) + types), 0.05, 0.5)
        used = used + BORROWED * used.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore"):
            logs = np.log((used + PRIOR * weight[:, None]) / (used.sum(axis=0) + PRIOR)) + np.log(1 - stop)
        return Lattice(pieces, logs[: len(kept)], logs[len(kept) :], np.log(stop * (1 - END_SHARE)))

    trained_words = counts.filter((trained > 0) & (F.col("word") != END))
    lattice = lattice_of((piece_counts(trained_words, vocabulary_path, len(v.names), k) * v.usable).T[every])
    for _ in range(UPDATES):
        lattice = lattice_of(expected_counts(trained_words, lattice, k))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, TOGETHER, 8 << 20):
            words = batch.column(0).to_pylist()
            sub = lattice.log_probabilities(words) / math.log(10)
            sub[[w == END for w in words]] = math.log10(END_SHARE)
            table_ = np.stack([batch.column(2 + i).to_numpy() for i in range(k)], axis=1).astype(np.float64)
            p = corpus.marginal(table_, sub)
            own = pa.FixedSizeListArray.from_arrays(pa.array(p.astype(np.float32).ravel()), k).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(table_.sum(axis=1).astype(np.int64)), own], schema=pa.schema([("word", pa.string()), ("n", pa.int64()), ("c", pa.int64()), ("p", pa.list_(pa.float32()))]))

    model = staged(map_batches(counts, weigh, "word string, n bigint, c bigint, p array<float>"), "words")
    discard(counts)
    size = F.octet_length("word")
    short, long = model.filter(size <= DICTIONARY_BYTES), model.filter((size > DICTIONARY_BYTES) & (size <= LONG_BYTES))
    frequent = most_frequent(short, DICTIONARY).union(most_frequent(long, LONG_WORDS)).select("word", "c", "p").toArrow()
    known = frequent.column("c").to_numpy()
    weights = np.stack(frequent.column("p").to_numpy()).astype(np.float64) if len(known) else np.zeros((0, k))
    per = math.log10(corpus.tokens + corpus.types + 1)  # 1 * (V + 1)
    matrix = np.concatenate([(np.log10(known + 1) - per)[:, None], (known > 0)[:, None], weights], axis=1)
    sent = docs.sparkSession.sparkContext.broadcast((frequent.column("word").cast(pa.binary()).combine_chunks(), matrix.astype(np.float64)))
    found = staged(_apply(rows, sent, k), "scored")
    # The words that are not in the dictionary: each meets its row of the table.
    rest = found.filter(F.col("word").isNotNull()).select("row", "word", "m")
    rest = rest.join(model.select("word", "c", "p"), "word")
    m = F.col("m").cast("double")

    def drawn(p):
        """log10 of an urn's weight of a word times its weight after a draw, and so on, m times."""
        first = F.lit(URN) * F.pow(F.lit(10.0), p.cast("double"))
        return F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), F.lit(0.0), lambda acc, i: acc + F.log10(first + i))

    parts = rest.groupBy("row").agg(F.sum(m * (F.log10(F.col("c") + 1.0) - F.lit(per))).alias("base"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("known"), *(F.sum(F.when(F.col("m") == 1, F.element_at("p", i + 1) + F.lit(math.log10(URN))).otherwise(drawn(F.element_at("p", i + 1)))).alias(f"s{i}") for i in range(k)))
    heads = found.filter(F.col("word").isNull()).select("row", "doc_id", "held_out", F.col("m").alias("n_tokens"), "sums")
    joined = heads.join(parts, "row", "left")

    def total(i: int, name: str):
        return F.element_at("sums", i + 1) + F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    docs_of = corpus.class_docs + 0.5
    prior = np.log10(docs_of / docs_of.sum())
    each = [total(2 + i, f"s{i}") + F.lit(float(prior[i])) for i in range(k)]
    top = F.greatest(*each) if k > 1 else each[0]
    mixed = top + F.log10(sum((F.pow(F.lit(10.0), x - top) for x in each[1:]), F.pow(F.lit(10.0), each[0] - top)))
    return joined.select("doc_id", "held_out", "n_tokens", total(1, "known").cast("long").alias("n_known"), F.lit(corpus.tokens).cast("long").alias("train_tokens"), total(0, "base").alias("base_score"), mixed.alias("score"))


def _apply(rows: DataFrame, sent, k: int) -> DataFrame:
    """For each row of rows one with its tokens and its sums over the dictionary's words, and one for each other word."""
    id_type = rows.schema["doc_id"].dataType

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = sent.id if hasattr(sent, "id") else id(sent)
        if key not in _sent:
            _sent.clear()
            words, matrix = sent.value
            _sent[key] = ({w: i for i, w in enumerate(words.to_pylist())}, matrix)
        place, matrix = _sent[key]
        get = place.get
        for batch in batches:
            head = ([], [], [], [], [])
            others: tuple[list, list, list] = ([], [], [])
            for row, doc_id, held_out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                words = words_of(text.as_py() or b"")
                words.append(b"")
                sums = np.zeros(k + 2)
                rare: Counter = Counter()
                hits = []
                for a in range(0, len(words), 1 << 16):
                    own = words[a : a + (1 << 16)]
                    at = np.asarray([get(w, -1) for w in own], np.int64)
                    rare.update(own[i] for i in np.flatnonzero(at < 0).tolist())
                    hits.append(at[at >= 0])
                at, m = np.unique(np.concatenate(hits), return_counts=True)
                found = matrix[at]
                sums[:2] = m @ found[:, :2]
                sums[2:] = (found[:, 2:] + math.log10(URN)).sum(axis=0)
                if len(more := np.flatnonzero(m > 1)):
                    first = URN * 10.0 ** found[more, 2:]
                    sums[2:] += ((log_gamma(first + m[more, None]) - log_gamma(first)) / math.log(10) - np.log10(first)).sum(axis=0)
                sums[2:] += (math.lgamma(URN) - math.lgamma(URN + len(words))) / math.log(10)
                for column, x in zip(head, (row, doc_id, held_out, len(words), sums.tolist()), strict=True):
                    column.append(x)
                others[0].extend([row] * len(rare))
                others[1].extend(rare)
                others[2].extend(rare.values())
            n, r = len(head[0]), len(others[0])
            if n:
                ids = pa.array(head[1], batch.schema.field(1).type)
                out = [pa.array(head[0] + others[0], pa.int64()), pa.concat_arrays([ids, pa.nulls(r, ids.type)]), pa.array(head[2] + [None] * r, pa.bool_()), pa.array([None] * n + others[1], pa.binary()).cast(pa.string()), pa.array(head[3] + others[2], pa.int64()), pa.array(head[4] + [None] * r, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(out, names=["row", "doc_id", "held_out", "word", "m", "sums"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    return map_batches(numbered, made, f"row bigint, doc_id {id_type.simpleString()}, held_out boolean, word string, m bigint, sums array<double>")


def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents, learning from six sevenths of them."""
    import public_tokenizers

    return score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

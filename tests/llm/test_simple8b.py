import functools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veritrace.llm import common, simple8b, tokens

ODD = [
    "", "a", " a", "a ", "a  b", "a\n\nb", "  ", "\t x y", "a\x1c!\x1cb !\x1c", "don't  we'll x", "É́ é a ́", "<|endoftext|> x", "a <|endoftext|>  <|startoftext|><|endoftext|>b c<|ENDOFTEXT|>", "<|endof<|endoftext|>text|>", "\n<|endoftext|>\n ",
    "a\r\n b  \n\n  c 1 23 ",
    "Foo.Bar,baz!x aд.b ²3 b²3.", "Straße ÀÉ. don't 'southern", "a.b..c 3.5 4,000 x4. 4x.", "ΑΣ ς", "日本 語　テ", "x#y=\u0338 a(b)c_d 1a’s a\u0301`",
]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_library_s(file):
    plain = Tokenizer.from_file(public_tokenizers.path(file))
    enc = tokens.Encoder(public_tokenizers.path(file))
    for text in [*ODD, "word " * 300_000, "x" * 5000]:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([*ODD, "<|endoftext|>", "<|startoftext|>", "<|", " ", "\n"]), st.text(max_size=4)), max_size=8).map("".join))
@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_any_text(file, text):
    plain, enc = _both(file)
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@functools.cache
def _both(file):
    return Tokenizer.from_file(public_tokenizers.path(file)), tokens.Encoder(public_tokenizers.path(file))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50_000), st.just(0), st.integers(0, 2**64 - 1), st.integers(0, 3)), max_size=700))
def test_round_trip(values):
    words = simple8b.encode(np.asarray(values, np.uint64))
    assert simple8b.decode(words).tolist() == values


def test_any_part_of_a_block():
    r = np.random.default_rng(0)
    v = np.where(r.random(9000) < 0.02, np.uint64(2**64 - 1), r.integers(0, 50_000, 9000).astype(np.uint64))
    words = simple8b.encode(v)
    for first in (0, 1, 2999, 8000, 8990):
        assert (simple8b.decode_from(words, simple8b.skips(words), first, 10) == v[first : first + 10]).all()


def test_files(spark, monkeypatch):
    monkeypatch.setattr(simple8b, "BLOCK_IDS", 50)
    rows = [(3, "some words here " * 9), (1, None), (1, "x"), (None, "null id"), (2, ""), (3, "again")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    path = common.scratch(spark, "t")
    file = public_tokenizers.path("byte_bpe_50k.json")
    simple8b.write_ids(df, path, file)
    plain = Tokenizer.from_file(file)
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()), ids))
        at += len(ids)
    assert sorted(map(tuple, simple8b.read_ids(spark, path, with_ids=True).collect()), key=lambda r: r[1]) == want
    simple8b.write_ids(df.limit(0), path + "-empty", file)
    assert simple8b.read_ids(spark, path + "-empty").count() == 0

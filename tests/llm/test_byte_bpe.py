import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from risewatch.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = byte_bpe.read_ranks(PATH)
TABLE = byte_bpe.PairTable(RANKS)
REAL = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
FIND = regex.compile(public_tokenizers.PATTERN).findall


def encode(texts):
    flat, off = byte_bpe._Pieces(TABLE).encode([FIND(t) for t in texts])
    return [flat[a:b].tolist() for a, b in zip(off, off[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_like_the_library(texts):
    assert encode(texts) == [REAL.encode_ordinary(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="thean ing", min_size=100, max_size=900))
def test_long_pieces(text):
    text = text.replace(" ", "")
    assert encode([text, text * 3]) == [REAL.encode_ordinary(text), REAL.encode_ordinary(text * 3)]


def test_runs_and_special_strings():
    rng = random.Random(1)
    texts = ["a" * 5000, "=-" * 900, " " * 3000, "<|endoftext|>", "é日本" * 400, "".join(rng.choice("ab") for _ in range(4000))]
    assert encode(texts) == [REAL.encode_ordinary(t) for t in texts]


def test_pair_table_misses_and_padding():
    left, right = np.array([-1, 5, 50255], np.int32), np.array([3, -1, 50255], np.int32)
    assert TABLE.rank(left, right).tolist() == [byte_bpe.NONE] * 3


def test_round_trip(spark):
    rows = [(1, "Hello  world\n"), (2, None), (3, ""), (4, "naïve ☃ " * 500)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    out = byte_bpe.decode(byte_bpe.encode(docs, "text", PATH, public_tokenizers.PATTERN), "ids", PATH)
    both = byte_bpe.encode_and_decode(docs, "text", PATH, public_tokenizers.PATTERN)
    assert sorted(out.collect()) == sorted(both.collect())
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in out.collect()} == {k: t or "" for k, t in rows}


def test_unknown_id(spark):
    bad = spark.createDataFrame([([1, 60000],)], "ids array<int>")
    with pytest.raises(Exception, match="vocabulary"):
        byte_bpe.decode(bad, "ids", PATH).collect()

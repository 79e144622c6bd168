"""Byte-pair codes against the tiktoken library, and exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from riskspark.llm import bpe

RAW = open(public_tokenizers.path(bpe.VOCABULARY), "rb").read()
CODEC = bpe.codec(RAW, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
    mergeable_ranks={base64.b64decode(t): int(r) for t, r in map(bytes.split, RAW.splitlines())})


def ids(text):
    return np.frombuffer(CODEC.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


@pytest.mark.parametrize("text", [
    "a" * 5000, "ab" * 5000, " " * 3000, "=-" * 2000, "thethe" * 2000, "aaab" * 2000, "ing" * 999 + "x", "\n" * 500 + "x",
    "漢字" * 500, "🙂" * 300, "<|endoftext|>", "it's we'll I'd 12345  \x1c\x00",
])
def test_long_and_special_texts(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_words_of_common_pieces():
    draw = random.Random(1)
    for _ in range(2000):
        text = "".join(draw.choice(["the", "ing", "ation", " of", "er", "s", " ", "é", "1", "!!"]) for _ in range(30))
        assert ids(text) == LIBRARY.encode_ordinary(text)


def test_documents(spark, odd, empty):
    out = bpe.digests(bpe.decode(bpe.encode(odd)))
    assert out.count() == odd.count()
    for row in out.collect():
        expected = LIBRARY.encode_ordinary(row.text or "")
        assert row.n_tokens == len(expected)
        assert row.ids_sha256 == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
    assert bpe.decode(bpe.encode(empty)).collect() == []

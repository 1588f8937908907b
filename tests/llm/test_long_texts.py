"""Texts that the tokeniser's library cannot take whole: runs of white space, and texts without any."""

import hashlib
import random

import pytest

from loomshed.llm import bpe
from loomshed.llm.registry import tokenizer

MIXED = " \n\t  \r\n"


@pytest.fixture(scope="module")
def enc(spark):
    return bpe.encoder(*tokenizer(spark))


def run(kind: str, n: int) -> str:
    return (kind * (n // len(kind) + 1))[:n]


@pytest.mark.parametrize("kind", [" ", "\n", "\t", MIXED])
@pytest.mark.parametrize("n", [999, 1000, 1001, 40_000, 300_000])
@pytest.mark.parametrize("frame", ["{}", "{}word", "word{}", "two words{}and more", "{} x{}."])
def test_runs_have_the_ids_of_the_library(enc, kind, n, frame):
    text = frame.replace("{}", run(kind, n)) + "a b" * 12_000
    assert bpe.encode(enc, text) == enc.encode_ordinary(text)
    back = frame.replace("{}", run(kind, n))
    assert bpe.encode(enc, "a b" * 12_000 + back) == enc.encode_ordinary("a b" * 12_000 + back)


@pytest.mark.parametrize("n", [1_000_000, 5_000_000])
@pytest.mark.parametrize("kind", [" ", "\n", "\t", MIXED])
def test_runs_beyond_the_library(enc, kind, n):
    """A run of n characters before a word has the ids of n - 1 as one piece, then those of the rest."""
    text = run(kind, n)
    ids = bpe.encode(enc, text + "word")
    assert enc.decode_bytes(ids).decode() == text + "word"
    one = enc._encode_single_piece(text[:-1].encode())
    assert ids == one + enc.encode_ordinary(text[-1] + "word")
    if len(kind) == 1:  # a longer run of one character goes on as shorter ones do
        period = len(enc.encode_ordinary(run(kind, 200_000))) - len(enc.encode_ordinary(run(kind, 100_000)))
        short = enc.encode_ordinary(run(kind, 100_000 + (n - 1) % 100_000))
        assert len(one) == len(short) + period * ((n - 1) // 100_000 - 1)
    assert bpe.encode(enc, text) == enc._encode_single_piece(text.encode())


def test_texts_without_white_space(enc):
    for text in ("a" * 1_000_000, "é-1" * 300_000):
        assert bpe.encode(enc, text) == enc.encode_ordinary(text)


def test_random_texts_with_runs(enc):
    r = random.Random(5)
    for _ in range(40):
        bits = [r.choice(["word", " ", "\n", "x" * 50, run(MIXED, r.randrange(900, 1100)), "don't", "　", "9", "--"]) for _ in range(900)]
        text = "".join(bits)
        assert len(text) > bpe.PIECE_CHARS and bpe.encode(enc, text) == enc.encode_ordinary(text)


def test_the_operator_takes_a_million_spaces(spark):
    ranks, pattern = tokenizer(spark)
    texts = [" " * 1_000_000, "a" + "\n" * 1_000_000 + "b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_documents(docs, ranks, pattern).collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()

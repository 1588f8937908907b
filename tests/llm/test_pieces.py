"""Piece encoding by the table of last tokens against the library, on hard texts, and against plain merging."""

import dataclasses
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from loomshed.llm import pieces
from loomshed.llm.registry import MODEL_FILE
from loomshed.session import table


@pytest.fixture(scope="module")
def model(spark):
    return pieces.read_model(spark, public_tokenizers.path(MODEL_FILE))


def test_random_texts_have_the_ids_of_the_library(model):
    sp, own = pieces.table_of(model)
    r = random.Random(8)
    bits = list("ab  ▁th\n\té中🙂=-*#/ ​\x00") + [sp.id_to_piece(i) for i in r.sample(range(259, 32_000), 600)]
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(40)))
        assert (own.encode(sp.normalize(text)) if text else []) == sp.encode(text), repr(text)


@pytest.mark.parametrize("text", [" " * 1_000_000, "x" * 300_000, "ab" * 200_000, "▁" * 33 + "word", " a" * 50_000 + " " * 17, "\n" * 100_000, "🙂" * 20_000, "<s> <0x41> </s>"])
def test_long_and_odd_texts(model, text):
    sp, own = pieces.table_of(model)
    assert own.encode(sp.normalize(text)) == sp.encode(text)


def test_last_tokens_are_those_of_every_prefix(model):
    sp, own = pieces.table_of(model)
    word = "▁internationalisation----▁▁▁▁"
    last = own.last_tokens(word)
    for n in range(1, len(word) + 1):
        assert own.pieces[last[n]] == pieces.merged(list(word[:n]), own.rank)[-1]


def test_what_is_remembered_is_bounded(model, monkeypatch):
    sp, own = pieces.table_of(model)
    monkeypatch.setattr(pieces, "WORDS", 50)
    monkeypatch.setattr(pieces, "PAIRS", 30)
    own.words.clear()
    own.pairs.clear()
    text = " ".join(f"word{i} item{i % 7}" for i in range(2000))
    assert own.encode(sp.normalize(text)) == sp.encode(text)
    assert len(own.words) <= 50 and len(own.words.older) <= 50 and len(own.pairs) <= 30


def test_a_model_without_byte_pieces_has_one_unknown_a_run(model):
    sp, own = pieces.table_of(model)
    bare = dataclasses.replace(own, byte_ids=None)
    for text in ("🙂", "a🙂🙂b", "🙂 🙂", "x \x00\n🙂🙂 y"):
        want = []
        for i in sp.encode(text):
            i = own.unknown if sp.is_byte(i) else i
            if i != own.unknown or not want or want[-1] != i:
                want.append(i)
        assert bare.encode(sp.normalize(text)) == want


def test_the_operator_round_trips(spark, model):
    sp, _ = pieces.table_of(model)
    texts = [None, "", " ", "plain words", "plain words", "é中🙂\x00\n", "x " * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n_tokens", "token_ids")})
    docs = docs.unionByName(docs.filter("doc_id = 3")).unionByName(docs.filter("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    rows = pieces.encode_documents(docs, model).collect()
    assert len(rows) == 9
    for r in rows:
        text = texts[3 if r.doc_id is None else r.doc_id] or ""
        ids = sp.encode(text)
        assert r.token_ids == ids and r.n_tokens == len(ids) and r.decoded_text == (sp.decode(ids) if ids else "")
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded_text.encode()).hexdigest()
    back = pieces.decode_documents(spark.createDataFrame([(r.doc_id, r.token_ids) for r in rows], "doc_id long, token_ids array<int>"), model)
    assert sorted(r.text for r in back.collect()) == sorted(r.decoded_text for r in rows)
    assert pieces.encode_documents(docs.limit(0), model).count() == 0


def test_the_query_equals_the_library(spark, model):
    from loomshed.llm import registry

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = {r.doc_id: r for r in registry.op13_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    for r in table(spark, "/root/testdata/sf0.001", "documents").collect():
        ids = sp.encode(r.text or "")
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()

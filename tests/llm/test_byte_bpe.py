"""Byte-level BPE against tiktoken, and back."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from fathom.llm import byte_bpe


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.codec()


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(), special_tokens={})


def test_every_byte_has_a_printable_character_of_its_own():
    found = byte_bpe.byte_characters()
    assert len(set(found)) == 256 and found.isprintable() and " " not in found


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(codec, tik, text):
    ids = codec.encode(text)
    assert ids.tolist() == tik.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_code_points_beside_others(codec, tik):
    for point in [*range(1, 0x3000, 7), *range(0x1F000, 0x1FA00, 5)]:
        text = "a{0}b1{0}2 {0} \t{0}!{0}".format(chr(point))
        assert codec.encode(text).tolist() == tik.encode_ordinary(text)


def test_long_words_and_texts(codec, tik, monkeypatch):
    r = random.Random(2)
    texts = ["a" * 100_000, " " * 50_000, "".join(r.choice("abcd") for _ in range(30_000)), " ".join(str(r.random()) for _ in range(20_000)), "<|endoftext|>"]
    monkeypatch.setattr(byte_bpe, "CHUNK", 1000)
    monkeypatch.setattr(byte_bpe, "KEPT", 500)
    for text in texts:
        ids = codec.encode(text)
        assert ids.tolist() == tik.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_a_token_that_its_merges_do_not_reach():
    """tiktoken gives a pre-token that is a token without looking at its parts."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"ab": 257, b"abc d"[:3] + b"e": 258}
    own, tik = byte_bpe.Codec(ranks), tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("abce", "abc", "xabce", "abceabce"):
        assert own.encode(text).tolist() == tik.encode_ordinary(text)
    with pytest.raises(ValueError, match="gaps"):
        byte_bpe.serialised({b"a": 0, b"b": 2})


def test_rows(spark, tik):
    texts = [None, "", " \n", "Hello, hello wörld 😀", "Hello, hello wörld 😀"]
    docs = spark.createDataFrame([(i if i else None, t, b"x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids binary, n_tokens int")
    found = byte_bpe.decoded(byte_bpe.encoded(docs)).collect()
    assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.bytes)) for r in found] == [(i if i else None, tik.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts)]
    assert byte_bpe.encoded(docs.limit(0)).count() == 0
    with pytest.raises(Exception, match="list index out of range"):
        byte_bpe.decoded(spark.createDataFrame([(1, b"\xff\xff\xff\x00")], "doc_id long, ids binary")).collect()


def test_query(spark, tik):
    path = "/root/testdata/sf0.001"
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.query(spark, path).collect()}
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        ids = np.array(tik.encode_ordinary(d.text or ""), dtype="<u4")
        assert found[d.doc_id] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())

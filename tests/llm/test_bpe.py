import hashlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import bpe, entries

RANKS, PATTERN = bpe.public_ranks()
CODEC = bpe.Codec(RANKS, PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_those_of_the_library(text):
    ids = CODEC.encode(text)
    assert ids == REFERENCE.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["", " ", "\n\n  \t x", "a" * 5000, "ab" * 20000, "<|endoftext|>", "\x1c\x1d a", "don't  we'll", "😀😀 naïve", "1234567 890"])
def test_odd_texts(text):
    assert CODEC.encode(text) == REFERENCE.encode_ordinary(text)


def test_perfect_hash_is_minimal_and_refuses_others():
    keys = [str(i).encode() for i in range(1000)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.slot_key.tolist()) == list(range(1000))
    assert table.find(keys) == list(range(1000))
    assert table.find([b"x", b"", b"1000"]) == [-1, -1, -1]
    assert bpe.PerfectHash([]).find([b"a"]) == [-1]


def test_memo_starts_over(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    codec = bpe.Codec(RANKS, PATTERN)
    for text in ("one two three four five", "six seven", "one two"):
        assert codec.encode(text) == REFERENCE.encode_ordinary(text)


def test_rows_nulls_and_clashing_names(spark):
    texts = [(1, "Hello world", "x"), (2, None, "y"), (3, "", None), (None, "Hello world", "x"), (1, "Hello world", "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, n_tokens string")
    rows = bpe.token_digests(docs, RANKS, PATTERN).collect()
    assert len(rows) == 5
    empty = hashlib.sha256(b"").hexdigest()
    for r in rows:
        ids = REFERENCE.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == (hashlib.sha256(r.text.encode()).hexdigest() if r.text else empty)


def test_encode_then_decode(spark):
    docs = spark.createDataFrame([("Grüße",), (None,)], "text string")
    back = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert [bytes(r.decoded).decode() for r in back] == ["Grüße", ""]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.query(spark, docs).collect() == []


def test_the_whole_query_against_the_library(spark):
    folder = "/root/testdata/sf0.001"
    texts = dict(tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    rows = entries.op10_byte_bpe(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = REFERENCE.encode_ordinary(texts[r.doc_id] or "")
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want, r.doc_id

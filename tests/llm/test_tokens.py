"""Encoding against two public implementations, and back."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm.tokens import FOLDER, WORDS, Encoder, count_tokens, encode, parse_vocabulary, read_vocabulary

PATH = f"{FOLDER}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")
RANKS = parse_vocabulary(read_vocabulary(PATH)) if os.path.exists(PATH) else {}


@pytest.fixture(scope="module")
def public():
    import tiktoken

    return tiktoken.Encoding("public", pat_str=WORDS, mergeable_ranks=RANKS, special_tokens={})


def test_both_formats():
    assert parse_vocabulary(read_vocabulary(f"{FOLDER}/byte_bpe_50k.json")) == RANKS


ENCODER = Encoder(RANKS) if RANKS else None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("aabb nde'st<|>", max_size=80), max_size=4))
def test_same_ids(public, texts):
    got = ENCODER.encode(texts)
    assert got == [public.encode_ordinary(t) for t in texts]
    names = {v: k for k, v in RANKS.items()}
    assert [b"".join(names[i] for i in ids).decode() for ids in got] == texts


def test_operator(spark, public, smallest):
    docs = spark.read.parquet(f"{smallest}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, ""), (-2, None), (-3, "<|endoftext|>"), (-4, "ab " * 50_000), (-5, "x" * 20_000)], docs.schema)
    both = docs.union(extra)
    got = {r.doc_id: r.ids for r in encode(both, ["doc_id"], "text", PATH).collect()}
    assert got == {r.doc_id: public.encode_ordinary(r.text or "") for r in both.collect()}
    sizes = {r.doc_id: r.tokens for r in count_tokens(both, ["doc_id"], "text", PATH).collect()}
    assert sizes == {k: len(v) for k, v in got.items()}
    assert encode(docs.limit(0), ["doc_id"], "text", PATH).count() == 0

"""Token counts and byte-level BPE against their libraries."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabscope.llm.bpe import decode_ids, encode_texts, merge, read_ranks, slices
from tabscope.llm.token_counts import token_counts

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

ODD = [
    (1, "it's 12 words,  two  spaces \n\n and\x1c odd\x85 ones"), (2, None), (3, ""), (4, "   "), (5, "a<|endoftext|>b <|endoftext|> c"),
    (6, "x" * 5000), (7, "wort " * 60_000), (8, "Straße – naïve 日本語 \U0001f600"), (1, "it's 12 words,  two  spaces \n\n and\x1c odd\x85 ones"),
    (9, "  \n a\t\tb \r\n"), (None, "no id"), (10, "!\x1c? \x1f1"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", 1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, bucket int").repartition(3)


def test_counts_equal_the_library(odd):
    plain = Tokenizer.from_file(JSON)
    want = sorted((str(i), len((t or "").encode()), len(plain.encode(t or "", add_special_tokens=False))) for i, t in ODD)
    got = token_counts(odd, JSON, step_bytes=1000).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_ids_equal_the_library_and_round_trip(odd):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    want = sorted((str(i), library.encode_ordinary(t or "")) for i, t in ODD)
    ids = encode_texts(odd, RANKS, public_tokenizers.PATTERN, step_bytes=2000, block_words=30, buckets=7)
    got = decode_ids(ids, RANKS).collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in got) == sorted((str(i), (t or "").encode()) for i, t in ODD)


def test_documents_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    got = {r.doc_id: list(r.ids) for r in encode_texts(docs, RANKS, public_tokenizers.PATTERN).collect()}
    plain = Tokenizer.from_file(JSON)
    counts = {r.doc_id: r.n_tokens for r in token_counts(docs, JSON).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == library.encode_ordinary(r.text)
        assert counts[r.doc_id] == len(plain.encode(r.text, add_special_tokens=False))


def test_queries(spark):
    from tabscope.llm.queries import op2_byte_bpe

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op2_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    assert all(r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest() for r in rows)


@pytest.mark.parametrize("piece", [b"a" * 300, b"thththererer" * 20, bytes(range(256)), "éèê".encode() * 40, b"q"])
def test_long_pieces_merge_as_the_library_does(piece):
    ranks = read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    assert merge(piece, ranks) == library._encode_single_piece(piece)


def test_slices_lose_nothing():
    text = "ab  cd  e\n" * 1000
    cut = list(slices(text, 37))
    assert "".join(cut) == text and len(cut) > 100


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts(empty, JSON).count() == 0
    assert encode_texts(empty, RANKS, public_tokenizers.PATTERN).withColumn("n", F.size("ids")).count() == 0

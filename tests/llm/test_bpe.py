"""Prefix tables for BPE against the tiktoken library."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from snaplake.llm import bpe, queries

PLACES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]
SF = "/root/testdata/sf0.001"


def library(name):
    ranks = bpe.read_ranks(public_tokenizers.path(name))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


@pytest.fixture(scope="module", params=PLACES)
def both(request):
    encoding, ranks = library(request.param)
    return encoding, bpe.Vocabulary(ranks)


def texts():
    rng = random.Random(5)
    kinds = ["abc ", "aeiourstn", "  \n\t\x1c\x0b　\xa0ab'sdllve", "éèçüß漢字кириллица🙂", "0123456789½²", "===---___***   "]
    for k in range(1500):
        yield "".join(rng.choice(kinds[k % 6]) for _ in range(rng.randint(0, 60)))
    yield from ["", " ", "\n", "a" * 3000, " " * 500 + "x", "don't won't 'tis", "end \n\n  next", "a\n b  c\td "]


def test_same_ids_as_the_library(both):
    encoding, vocabulary = both
    codec = bpe.Codec(vocabulary, public_tokenizers.PATTERN)
    for text in texts():
        packed = codec.encode(text)
        assert list(memoryview(packed).cast("I")) == encoding.encode_ordinary(text), text
        assert codec.decode(packed).decode() == text


def test_append_and_edit_equal_a_fresh_table(both):
    vocabulary = both[1]
    rng = random.Random(6)
    make = lambda n: bytes(rng.choice(b"abcdethinrs =-") for _ in range(n))
    for _ in range(200):
        table = bpe.Prefixes(vocabulary).append(make(rng.randint(0, 200)))
        table.append(make(7))
        data = table.data
        start = rng.randint(0, len(data))
        end, new = rng.randint(start, len(data)), make(rng.randint(0, 6))
        fresh = bpe.Prefixes(vocabulary).append(data[:start] + new + data[end:])
        table.edit(start, end, new)
        assert (table.data, table.last) == (fresh.data, fresh.last)
        assert b"".join(vocabulary.bytes_of[i] for i in table.ids()) == table.data


def test_bounded_memory_changes_nothing(both, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "MOST_SEAMS", 5)
    encoding, vocabulary = both
    codec = bpe.Codec(vocabulary, public_tokenizers.PATTERN)
    for text in list(texts())[:200]:
        assert list(memoryview(codec.encode(text)).cast("I")) == encoding.encode_ordinary(text)


def test_query(spark):
    encoding, _ = library(PLACES[0])
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op1_byte_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]] or ""
        ids = encoding.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "a b", "x"), (3, "a b", "x")], "doc_id long, text string, token_ids string"
    )
    done = bpe.decode(bpe.encode(docs, queries.RANKS, public_tokenizers.PATTERN), queries.RANKS).collect()
    assert sorted((str(r["doc_id"]), len(r["token_ids"]), bytes(r["decoded"])) for r in done) == [
        ("1", 0, b""), ("2", 0, b""), ("3", 8, b"a b"), ("3", 8, b"a b"), ("None", 8, b"a b")
    ]
    assert bpe.decode(bpe.encode(docs.limit(0), queries.RANKS, public_tokenizers.PATTERN), queries.RANKS).count() == 0

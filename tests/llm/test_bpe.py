"""Encoding and decoding against the tokenizers library and against the plain merge loop."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadloom.llm import bpe, queries

DATA = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a" * 5000, "é" * 700, "the" * 400, "日本語" * 300, " " * 900, "\n \n" * 50 + "x", "<|endoftext|>", "a<|endoftext|> b<|endof", "x  y   z", "can't we'll 'S", "١٢٣ ½ Ⅷ ՘ \U00010940֋ a\U0003d000", "a\x1cb\u0085c d e᠎f"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_as_library(library, vocabulary):
    encoder, rng = bpe.Encoder(vocabulary), random.Random(1)
    letters = "".join(chr(rng.randrange(1 << 15)) for _ in range(3000))
    texts = ODD + [letters, "".join(rng.choice("abcdefghing") for _ in range(4000))]
    for _ in range(2000):
        texts.append("".join(rng.choice([*"ab  \n\t'sdre.,é中1½\x1c\x85", "<|endoftext|>", "  ", "'ll", "hello", "ing", chr(rng.randrange(0x2000))]) for _ in range(rng.randrange(40))))
    for text, got in zip(texts, encoder.encode(texts)):
        assert ids(got) == library.encode(text, add_special_tokens=False).ids


def test_signs(library, vocabulary):
    """Every code point, between a letter and a digit."""
    encoder = bpe.Encoder(vocabulary)
    for low in range(0, 0x110000, 512):
        text = "".join(f"a{chr(c)}1 {chr(c)}." for c in range(low, low + 512) if not 0xD800 <= c < 0xE000)
        assert ids(encoder.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids


def test_long_words_take_the_heap(vocabulary):
    encoder, rng = bpe.Encoder(vocabulary), random.Random(3)
    for _ in range(200):
        parts = [vocabulary.of_byte[b] for b in "".join(rng.choice(["a", "aa", "th", "the", "in", "ing", "z"]) for _ in range(rng.randrange(90))).encode()]
        assert encoder.scanned(list(parts)) == encoder.heaped(list(parts))


def test_many_short_words_at_once(vocabulary):
    encoder, rng = bpe.Encoder(vocabulary), random.Random(5)
    words = ["".join(rng.choice(["a", "e", "th", "the", "in", "ing", "é", "z", " "]) for _ in range(rng.randrange(1, 30)))[:40] for _ in range(3000)]
    encoder.learn(list(set(words)))
    for w in set(words):
        assert ids(encoder.words[w]) == encoder.scanned([vocabulary.of_byte[b] for b in w.encode()])


def test_memory_is_bounded(library, vocabulary):
    encoder = bpe.Encoder(vocabulary, remembered=20)
    texts = [" ".join(f"word{i} tail{i % 7}" for i in range(n, n + 50)) + " " + "x" * 99 for n in range(500)]
    for text in texts:
        assert ids(encoder.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids
        assert len(encoder.pieces) <= 20 and len(encoder.words) <= 20 and "x" * 99 not in encoder.pieces


def test_columns(spark, library, vocabulary):
    texts = [None, "", *ODD, ODD[0], "long text <|endoftext|> " * 40_000]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id int, text string, ids string, packed int")
    rows = df.select("doc_id", bpe.encode(vocabulary, F.col("text")).alias("tokens"), bpe.round_trip(vocabulary).alias("trip")).select("doc_id", "tokens", "trip.*", bpe.decode(vocabulary, "tokens").alias("back")).collect()
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.tokens == library.encode(text, add_special_tokens=False).ids and r.back == r.decoded == text and ids(r.packed) == r.tokens
    assert df.limit(0).select(bpe.encode(vocabulary)).count() == 0


def test_decode_any_ids(spark, library, vocabulary):
    rng = random.Random(8)
    lists = [[rng.randrange(50257) for _ in range(30)] for _ in range(200)] + [[], [50256, 50256]]
    df = spark.createDataFrame([(x,) for x in lists], "ids array<int>")
    assert [r.back for r in df.select(bpe.decode(vocabulary).alias("back")).collect()] == [library.decode(x, skip_special_tokens=False) for x in lists]
    odd = spark.createDataFrame([(None,), ([50257, -1, 64],)], "ids array<int>").select(bpe.decode(vocabulary).alias("back")).collect()
    assert [r.back for r in odd] == ["", vocabulary.tokens[64].decode()]


def test_query(spark, library):
    rows = {r.doc_id: r for r in queries.op11_bpe(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for r in docs:
        want, got = library.encode(r.text or "", add_special_tokens=False).ids, rows[r.doc_id]
        assert got.n_tokens == len(want) and got.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()

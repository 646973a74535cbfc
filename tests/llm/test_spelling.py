"""Spelling variants against brute force: neighbourhoods, forms, roots, counts, odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from threadloom.llm import queries, spelling

DATA = "/root/testdata/sf0.001"


def neighbourhood(w, alphabet):
    out = {w[:k] + a + w[k:] for k in range(len(w) + 1) for a in alphabet}
    out |= {w[:k] + w[k + 1 :] for k in range(len(w))}
    out |= {w[:k] + a + w[k + 1 :] for k in range(len(w)) for a in alphabet}
    return out - {w}


def brute(counts, least=5, times=5):
    words = {w: n for w, n in counts.items() if n >= least}
    alphabet = {x for w in words for x in w}
    near = {w: [x for x in neighbourhood(w, alphabet) if x in words] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= times * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), words[w], len(near[w]), max((words[x] for x in near[w]), default=None) if w in form else None) for w in words}


def as_set(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_neighbourhood_is_complete_and_distinct():
    alphabet = np.array(sorted(map(ord, "abcé")), np.int64)
    for word in ["a", "aab", "abca", "éééa", "bbbbbb"]:
        codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).reshape(1, -1)
        hashes, _, place, code = spelling.joined(list(spelling.neighbours(codes, alphabet)))
        strings = [spelling.edited(word, p, c) for p, c in zip(place.tolist(), code.tolist())]
        assert len(strings) == len(set(strings)) and set(strings) == neighbourhood(word, "abcé")
        assert (spelling.word_hashes(np.array(strings, object)) == hashes).all()


def test_variants(spark):
    rng = random.Random(2)
    counts = Counter()
    for _ in range(400):
        counts["".join(rng.choice("abé") for _ in range(rng.randrange(1, 7)))] += rng.choice([1, 4, 5, 30, 200, 1000, 6000])
    counts |= {"": 9, "x" * 500: 7, "x" * 499 + "y": 40, "日本語": 50, "日本": 10}
    rows = [(w, n, 1) for w, n in counts.items()] + [(None, 100, 1), ("a", 3, 2), ("a", 3, 2)]
    counts["a"] += 6
    df = spark.createDataFrame(rows, "word string, n long, form int")
    want = brute(counts)
    assert as_set(spelling.variants(df)) == want and any(r[1] and r[1] != r[2] for r in want)
    assert spelling.variants(df.limit(0)).count() == 0


def test_full_filter(spark, monkeypatch):
    """A filter that lets most strings through changes nothing."""
    monkeypatch.setattr(spelling, "MOST_BLOCKS", 1)
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(3, 6))) for _ in range(150)}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(r.word, r.near) for r in spelling.near_words(df, block_bits=6).collect()}
    assert got == {(w, x) for w in words for x in neighbourhood(w, "abc") if x in words}


def test_word_counts(spark):
    texts = ["Straße STRASSE ÉCOLE école École", "a1b2cdefgh under_score", None, "", "×÷ abcdef×ghijkl", "abcdef " * 50_000, "abcdef " * 3, "İstanbul KELVINKelvin"]
    df = spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)], "doc_id int, text string, word string")
    want = Counter()
    for t in texts:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(x.lower() if "A" <= x <= "Z" else x for x in w)
            want[w] += len(w) >= 6
    assert {r.word: r.n for r in spelling.word_counts(df).collect()} == {w: n for w, n in want.items() if n}
    assert spelling.word_counts(df.limit(0)).count() == 0
    shorter = {r.word: r.n for r in spelling.word_counts(df, key="doc_id", rewrite=lambda key, w: w[1:] if key == "5" else w).collect()}
    assert shorter["abcdef"] == 3 and "bcdef" not in shorter


def test_counts_are_handed_on(spark):
    words = ["".join(random.Random(i).choice("abcdefgh") for _ in range(7)) for i in range(300)]
    df = spark.createDataFrame([(i, " ".join(words)) for i in range(30)], "doc_id int, text string")
    assert {r.word: r.n for r in spelling.word_counts(df, held=10).collect()} == {w: 30 * n for w, n in Counter(words).items()}


def test_query(spark):
    counts = Counter()
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            w = "".join(x.lower() if "A" <= x <= "Z" else x for x in w)
            h = zlib.crc32(f"{r.doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    got = queries.op13_spelling_variants(spark, DATA)
    assert as_set(got) == brute({w: n for w, n in counts.items() if len(w) >= 6})
    assert got.where(F.col("form").isNotNull()).count() > 10


def test_sql_says_the_same(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = set(con.execute(spelling.VARIANTS_SQL).fetchall())
    assert as_set(queries.op13_spelling_variants(spark, DATA)) == want

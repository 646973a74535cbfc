"""Periodic runs against brute force: all periods of all places, planted periods, odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import periodic, queries

DATA = "/root/testdata/sf0.001"


def brute(w, least=6, periods=4):
    n, out = len(w), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, periods * q) and not any(w[i : i + length - r] == w[i + r : i + length] for r in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {k for i, length, q in found for k in range(i + q, i + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize("least,periods", [(6, 4), (2, 2), (3, 3), (9, 6)])
def test_runs(least, periods):
    rng = random.Random(least)
    for _ in range(300):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            n, letters = rng.randrange(40), "abcde"[: rng.choice([1, 2, 3, 5])]
            w = [rng.choice(letters) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randrange(3, 9)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append([x.encode() for x in w])
        codes, ends = periodic.numbered(texts)
        start, end, period = periodic.runs(codes, ends, least, periods)
        first, of = np.concatenate([[0], ends[:-1] + 1]), np.searchsorted(ends, start)
        for i, w in enumerate(texts):
            own = of == i
            assert list(zip((start[own] - first[i]).tolist(), (end - start)[own].tolist(), period[own].tolist())) == brute(w, least, periods)


def test_odd_rows(spark):
    rng = random.Random(5)
    long = " ".join(rng.choice("ab") for _ in range(3000)) + " x y z" * 2000
    texts = [None, "", " \t\n", "one", "a a a a a a", "a a a\u0085b", "x \x1c y", "ä " * 9, long, long, "a b " * 8 + "\nb " * 7]
    rows = [(None if i == 4 else i, t, 1, "r", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, runs string, n int")
    for at_once in (1 << 20, 10):
        got = df.select("n", periodic.periodic_runs("text", at_once=at_once).alias("found")).select("n", "found.*").collect()
        assert len(got) == len(texts)
        for r in got:
            w = re.findall(r"[^\x20\x09-\x0D]+", texts[r.n] or "")
            short = w if len(w) < 100 else None
            found = [(x.start, x.length, x.period) for x in r.runs]
            assert r.words == len(w) and r.collapsed == collapsed(w, found)
            assert short is None or found == brute(short)
            assert short is not None or max(found, key=lambda x: x[1])[1:] == (6000, 3)
    assert df.limit(0).select(periodic.periodic_runs("text")).count() == 0


def test_query(spark):
    rows = {r.doc_id: r for r in queries.op12_periodic_runs(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    planted = 0
    for r in docs:
        w, h = re.findall(r"[^\x20\x09-\x0D]+", r.text or ""), zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(w)
        if len(w) > 600:
            continue  # too slow for brute force
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        found = brute(w)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        listed = "".join(f"{i},{length},{q}\n" for i, length, q in found)
        got = rows[r.doc_id]
        assert (got.n_runs, got.start, got.length, got.period) == (len(found), *best)
        assert got.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert got.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert got.collapsed_sha256 == hashlib.sha256(collapsed(w, found).encode()).hexdigest()
    assert planted > 5


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a a a a a a a", "r", 2)], "doc_id int, text string, runs string, words int")
    row = df.withColumn("found", periodic.periodic_runs(F.col("text"))).first()
    assert row.runs == "r" and row.words == 2 and row.found.words == 7 and row.found.collapsed == "a"


def test_sql_says_the_same(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = queries.op12_periodic_runs(spark, DATA)
    want = con.execute(periodic.RUNS_SQL)
    names = [c[0] for c in want.description]
    assert set(map(tuple, got.select(*names).collect())) == set(want.fetchall())

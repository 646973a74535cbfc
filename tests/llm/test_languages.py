"""Kneser-Ney counts against plain Python; many languages; rare grams that a small table leaves out."""

import collections
import random

from pyspark.sql import functions as F

from threadloom.llm import langid


def corpus(languages, rows=40, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(languages):
        vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 7))) for _ in range(40)]
        out += [(k * rows + i, f"l{k:02d}", " ".join(rng.choice(vocabulary) for _ in range(30))) for i in range(rows)]
    return out


def test_counts_of_all_orders(spark):
    texts = ["abc abd", "abc", "é abab"]
    counted = langid.kneser_ney(langid.gram_counts(spark.createDataFrame([("x", t) for t in texts], "lang string, text string")))
    grams = collections.Counter(w[i : i + 4] for t in texts for w in ["   " + " ".join("".join(c if c.isalpha() else " " for c in t).split()) + " "] for i in range(len(w) - 3))
    for k in (4, 3, 2, 1):
        got = sorted(r.n for r in counted[k].collect())
        assert got == sorted(grams.values())
        grams = collections.Counter(g[1:] for g in grams)


def test_forty_languages_and_small_tables(spark):
    docs = spark.createDataFrame(corpus(40), "doc_id long, lang string, text string").cache()
    for values, least in ((langid.TABLE_VALUES, 0.97), (40 * 40 * 60, 0.8)):
        model = langid.fit(docs, table_values=values)
        assert len(model.langs) == 40 and all(t.hashes.size <= 40 * 60 + 1 for t, _ in model.tables.values()) == (values < langid.TABLE_VALUES)
        held = docs.where(langid.fold("doc_id", 4) == 2).select("lang", langid.predict(model).alias("x"))
        assert held.where(F.col("x.lang") == F.col("lang")).count() >= least * held.count()


def test_marks_stay_in_their_words(spark):
    import numpy as np

    texts = ["हिन्दी भाषा", "ि्", "été 2", "\U00011103\U00011104\U00011127"]
    raw = [t.encode() for t in texts]
    codes, at, has = langid.letters(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    words = ["".join(map(chr, codes[a:b])).strip() for a, b in zip(at[:-1], at[1:])]
    assert words[0] == "हिन्दी भाषा" and words[2] == "été" and has.tolist() == [True, False, True, True]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(langid.predict(None).alias("x")).collect()
    assert [r.x.lang for r in got] == ["und"] * 4


def test_a_language_of_rows_kept_aside_is_learned(spark):
    rows = corpus(2)
    ids = spark.range(5000).withColumnRenamed("id", "doc_id").where((langid.fold("doc_id", 4) == 3) & (F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(16)) == 0) & (F.col("doc_id") > 1000))
    few = [r.doc_id for r in ids.limit(3).collect()]
    docs = spark.createDataFrame(rows + [(i, "rare", "жзик лмно жзик прст") for i in few], "doc_id long, lang string, text string")
    model = langid.fit(docs)
    assert model.langs == ["l00", "l01", "rare"]
    assert spark.createDataFrame([("жзик прст",)], "text string").select(langid.predict(model).alias("x")).first().x.lang == "rare"


def test_a_whole_model_leaves_no_gram_out(spark):
    docs = spark.createDataFrame([*corpus(4), (9_000, None, None), (9_001, None, "12 !"), (9_002, None, "жз abc")], "doc_id long, lang string, text string").cache()
    scores = {}
    for values in (langid.TABLE_VALUES, 40):  # the tables in the tasks, and joined
        model = langid.fit(docs, table_values=values, whole=True)
        assert (model.rest is None) == (values > 40)
        scores[values] = {r.doc_id: (r.p.lang, round(r.p.score, 4)) for r in langid.predicted(docs, model).collect()}
    assert len(scores[40]) == docs.count() and scores[40] == scores[langid.TABLE_VALUES]
    assert scores[40][9_000] == ("und", 0.0) == scores[40][9_001]

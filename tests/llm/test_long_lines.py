"""Licence passages of long lines: every notice counts, each once."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.llm import licences
from threadloom.session import table

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scanner(spark):
    return licences.fit(table(spark, DATA, "documents"))


@pytest.fixture(scope="module")
def words(spark):
    """Words of corpus lines that resemble no template."""
    rows = table(spark, DATA, "documents").where("lang = 'en' and not lower(text) rlike 'licen[cs]e|copyright|rights|permi'").select("text").collect()
    return " ".join(r.text for r in rows).split()


def found(spark, scanner, rows):
    out = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.explode(licences.scan(scanner)).alias("x"))
    return sorted((r.doc_id, r.x.paragraph, r.x.start, r.x.end, r.x.family) for r in out.collect())


def test_every_notice_of_a_line(spark, scanner, words):
    rng = random.Random(6)
    filler = lambda n: " ".join(words[i : i + n]) if (i := rng.randrange(len(words) - n)) >= 0 else ""
    notices = [("MIT", licences.TEMPLATES["MIT"][2]), ("Apache-2.0", licences.TEMPLATES["Apache-2.0"][2]), ("CC0", licences.TEMPLATES["CC0"][1])]
    rows, want = [], []
    for i in range(20):
        chosen = rng.sample(notices, 2)
        rows.append((i, "first line\n" + " ".join([filler(80), chosen[0][1], filler(150), chosen[1][1], filler(60)])))
        want += [(i, 1, family) for family, _ in chosen]
    got = found(spark, scanner, rows)
    assert sorted((d, p, f) for d, p, _, _, f in got if f != "unknown") == sorted(want)
    assert all(60 <= a < b for _, _, a, b, f in got if f != "unknown")


def test_two_notices_of_one_window_and_two_of_one_family(spark, scanner, words):
    mit, apache = licences.TEMPLATES["MIT"][2], licences.TEMPLATES["Apache-2.0"][0]
    far = " ".join(words[:200])
    got = found(spark, scanner, [(1, f"Released under the MIT License. {apache}"), (2, f"{mit} {far} {mit}"), (3, None), (4, "")])
    assert [(d, f) for d, _, _, _, f in got if f != "unknown"] == [(1, "MIT"), (1, "Apache-2.0"), (2, "MIT"), (2, "MIT")]

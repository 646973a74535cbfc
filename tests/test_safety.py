"""Safety findings and card candidates with the reference's categories and severities."""

from pyspark.sql import functions as F

from threadloom.functions import scalars as S
from threadloom.operators import package


def test_every_rule(spark):
    rows = [
        (1, "order 1234567890123 paid with 4111 1111-1111 1111", None, None), (2, "41111111111111110000", None, None), (3, "Password: hunter22", None, None),
        (4, "123-45-6789, diagnosed", None, None), (5, "salary and a zero-day", None, None), (6, "blocked by obsolete parts", "blocker", 0.4), (7, "waiting on them", "status", 0.5), (8, None, None, 0.1),
    ]
    got = {(r.ref, r.category, r.severity) for r in package.safety_scan(spark.createDataFrame(rows, "ref int, text string, kind string, confidence double")).collect()}
    low = "low_confidence_or_needs_confirmation"
    assert got == {
        (1, "payment_financial", "high"), (3, "credential_or_secret", "high"), (4, "personal_sensitive", "high"), (5, "hr_legal", "medium"), (5, "security_sensitive", "medium"),
        (6, "stale_or_conflicting", "medium"), (6, low, "low"), (7, "blocker_or_dependency", "medium"), (8, low, "low"),
    }
    mail = spark.createDataFrame([(1, "no longer", "Gmail.com"), (2, "x", "a.org")], "ref int, text string, sender_domain string")
    assert [(r.ref, r.category, r.severity) for r in package.safety_scan(mail).collect()] == [(1, "personal_sensitive", "medium")]


def test_every_card_candidate(spark):
    text = "1234567890123 then 4111 1111-1111 1111 and 41111111111111110000"
    row = spark.createDataFrame([(text,)], "x string").select(S.card_candidates(F.col("x")).alias("c"), F.transform(S.card_candidates(F.col("x")), S.luhn_ok).alias("ok")).first()
    assert row.c == ["1234567890123", "4111111111111111"] and row.ok == [False, True]

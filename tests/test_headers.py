"""Header grammars: cases with their results, with and without the marks that need a parser."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from threadloom.functions import headers

WORDS = {
    "plain": "plain", "": "", None: None, "=?utf-8?b?4oCU?=": "—", "INCIDENT P1: p99 =?utf-8?b?4oCU?= triaging": "INCIDENT P1: p99 — triaging",
    "=?US-ASCII?Q?View_Your_New_Benefit_Amount?=": "View Your New Benefit Amount", "=?US-ASCII?Q?Usin?= =?US-ASCII?Q?g_It?=": "Using It", "=?iso-8859-1?q?caf=E9?=": "café", "=?no-such?q?a?=": "=?no-such?q?a?=", "a =? b": "a =? b",
}
ADDRESSES = {
    None: [], "": [], "  ": [], "Ann.Lee+x@Co.com": [("Ann.Lee+x@Co.com", "ann.lee@co.com", [])], "Ann <ann@co.com>, bob@co.com": [("Ann <ann@co.com>", "ann@co.com", ["Ann"]), ("bob@co.com", "bob@co.com", [])],
    '"Lee, Ann" <ann@co.com>': [("Lee, Ann <ann@co.com>", "ann@co.com", ["Lee, Ann"])], "=?utf-8?q?J=C3=BCrg?= <j@x.de>": [("Jürg <j@x.de>", "j@x.de", ["Jürg"])], "undisclosed-recipients:;": [], "just a name": None, " c@d.org ": [("c@d.org", "c@d.org", [])],
    "team: a@x.com, b@x.com;": [("a@x.com", "a@x.com", []), ("b@x.com", "b@x.com", [])], "ann@co.com (Ann)": [("Ann <ann@co.com>", "ann@co.com", ["Ann"])],
}
DATES = {
    None: "1970-01-01 00:00:00", "": "1970-01-01 00:00:00", "nonsense": "1970-01-01 00:00:00", "Mon, 15 Jan 2024 10:30:00 +0000": "2024-01-15 10:30:00", "15 Jan 2024 10:30:00 -0530": "2024-01-15 16:00:00", "Mon, 5 Feb 2024 23:59:59 +0200": "2024-02-05 21:59:59",
    "Mon, 15 Jan 2024 10:30:00 GMT": "2024-01-15 10:30:00", "Mon, 15 Jan 2024 10:30:00 EST": "2024-01-15 15:30:00", "2024-01-15T10:30:00Z": "2024-01-15 10:30:00", "2024-01-15T10:30:00+02:00": "2024-01-15 08:30:00", "2024-01-15 10:30": "2024-01-15 10:30:00",
    "Mon, 15 Jan 2024 10:30:00 +0000 (UTC)": "2024-01-15 10:30:00", "Mon, 31 Feb 2024 10:30:00 +0000": "1970-01-01 00:00:00", "Mon, 15 Jan 2024 10:30:00 -0000": "2024-01-15 10:30:00", "15 Jan 24 10:30:00 +0000": "2024-01-15 10:30:00",
}


def table(spark, cases):
    return spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")


def test_encoded_words(spark):
    got = [r.v for r in table(spark, WORDS).select("i", headers.decode_words(F.col("c")).alias("v")).orderBy("i").collect()]
    assert got == list(WORDS.values())


def test_addresses(spark):
    rows = table(spark, ADDRESSES).select("i", headers.parse_addresses(F.col("c")).alias("v")).orderBy("i").collect()
    for (case, want), r in zip(ADDRESSES.items(), rows):
        if want is not None:
            assert [(x.raw, x.email, x.display_names) for x in r.v] == want, case


@pytest.mark.parametrize("zone", ["UTC"])
def test_dates(spark, zone):
    rows = table(spark, DATES).select("i", headers.parse_date(F.col("c")).alias("v")).orderBy("i").collect()
    for (case, want), r in zip(DATES.items(), rows):
        assert r.v.replace(tzinfo=None) == datetime.fromisoformat(want), case


def test_plain_rows_need_no_parser(spark):
    plain = table(spark, ["a@b.com", "Mon, 15 Jan 2024 10:30:00 +0000"])
    assert plain.limit(0).select(headers.decode_words(F.col("c"))).count() == 0

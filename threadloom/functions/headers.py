"""Grammars of mail headers: address lists, encoded words, dates.

Rows without the marks of a grammar stay in the JVM; the others are parsed by the standard library,
batch by batch.
"""

from __future__ import annotations

from datetime import datetime, timezone
from email.header import decode_header
from email.utils import getaddresses, parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import norm_email

#: Dates as most programs write them: day of the week, day, month, year, time, numeric zone
PLAIN_DATE = r"^(?:[A-Za-z]{3}, )?(\d{1,2}) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (\d{4}) (\d\d):(\d\d):([0-5]\d) ([+-])(\d\d)([0-5]\d)$"


def decoded(value: str | None) -> str | None:
    """A header value with its encoded words (RFC 2047) decoded; the value itself if that fails."""
    if not value or "=?" not in value:
        return value
    try:
        parts = decode_header(value)
        return "".join(raw.decode(charset or "utf-8", errors="replace") if isinstance(raw, bytes) else raw for raw, charset in parts)
    except Exception:  # noqa: BLE001  a broken header is kept as it is
        return value


def decode_words(c: Column) -> Column:
    """Encoded words (``=?charset?B or Q?...?=``) of a header decoded, neighbours without a space between; null stays null."""

    @F.pandas_udf("string")
    def header_words(values: pd.Series) -> pd.Series:
        return values.map(decoded)

    marked = c.contains("=?")
    return F.when(marked, header_words(F.when(marked, c))).otherwise(c)


def parse_addresses(c: Column) -> Column:
    """Array of (raw, email, display_names) of an address list, as in To or Cc.

    Names may be quoted, hold commas and encoded words, addresses comments; entries without an address
    are left out and addresses normalised.  Null and empty lists give no entries.
    """

    @F.pandas_udf("array<struct<name: string, address: string>>")
    def address_list(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [{"name": decoded(n) or "", "address": a} for n, a in getaddresses([v or ""]) if a])

    plain = c.rlike(r"^\s*[^\s,;:<>()\"\\@\[\]]+@[^\s,;:<>()\"\\@\[\]]+\s*$")
    alone = F.array(F.struct(F.lit("").alias("name"), F.trim(F.regexp_replace(c, r"\s", "")).alias("address")))
    none = F.array().cast("array<struct<name: string, address: string>>")
    odd = F.when(~plain & (F.trim(c) != ""), c)
    listed = F.when(plain, alone).when(odd.isNotNull(), address_list(odd)).otherwise(none)

    def entry(x: Column) -> Column:
        named = x["name"] != ""
        raw = F.trim(F.when(named, F.concat(x["name"], F.lit(" <"), x["address"], F.lit(">"))).otherwise(x["address"]))
        return F.struct(raw.alias("raw"), norm_email(x["address"]).alias("email"), F.when(named, F.array(x["name"])).otherwise(F.array().cast("array<string>")).alias("display_names"))

    return F.transform(listed, entry)


def parsed_date(value: str | None) -> datetime:
    zero = datetime(1970, 1, 1, tzinfo=timezone.utc)
    if not value:
        return zero
    try:
        found = parsedate_to_datetime(value)
    except (TypeError, ValueError):
        try:
            found = datetime.fromisoformat(value.replace("Z", "+00:00"))
        except ValueError:
            return zero
    return (found if found.tzinfo else found.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)


def parse_date(c: Column) -> Column:
    """The instant of a Date header: RFC 2822, else ISO 8601, else 1970; without a zone it is UTC.

    Null and empty headers are 1970.  Dates in the usual form are read without Python.
    """

    @F.pandas_udf("timestamp")
    def header_date(values: pd.Series) -> pd.Series:
        return pd.to_datetime(values.map(lambda v: parsed_date(v).replace(tzinfo=None)))

    text = F.trim(F.coalesce(c, F.lit("")))
    part = lambda i: F.regexp_extract(text, PLAIN_DATE, i)
    local = F.try_to_timestamp(F.concat_ws(" ", part(3), part(2), F.lpad(part(1), 2, "0"), F.concat_ws(":", part(4), part(5), part(6))), F.lit("yyyy MMM dd HH:mm:ss"))
    shift = F.try_to_number(part(8), F.lit("99")) * 3600 + F.try_to_number(part(9), F.lit("99")) * 60
    sign = F.when(part(7) == "-", -1).otherwise(1)
    plain = F.when(text.rlike(PLAIN_DATE), F.timestamp_micros(F.unix_micros(local) - (sign * shift).cast("long") * 1_000_000))
    zero = F.timestamp_seconds(F.lit(0))
    odd = F.when(plain.isNull() & (text != ""), c)
    return F.coalesce(plain, F.when(odd.isNotNull(), header_date(odd)), zero)

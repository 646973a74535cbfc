"""Readers with declared schemas: mailbox JSON, MIME files, labels."""

from __future__ import annotations

import datetime
import email
import email.policy
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "provider_id string, provider_thread_id string, headers map<string,string>, body_text string, attachments array<struct<sha256:string,filename:string,mimetype:string,size_bytes:bigint>>"
MAILBOX = f"owner_email string, internal_domains array<string>, messages array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in ('provider_id string', 'provider_thread_id string', 'headers map<string,string>', 'body_text string', 'attachments array<struct<sha256:string,filename:string,mimetype:string,size_bytes:bigint>>'))}>>"


def read_mailbox(spark: SparkSession, path: str) -> DataFrame:
    """Messages of mailbox files (one JSON object each), with the owner's address."""
    rows = spark.read.schema(MAILBOX).option("multiLine", True).json(path)
    return rows.select("owner_email", "internal_domains", F.explode("messages").alias("m")).select("owner_email", "internal_domains", "m.*")


def body_of(part: email.message.EmailMessage) -> str | None:
    """The text of a part; in an unknown character set what UTF-8 makes of it, null if it cannot be decoded."""
    try:
        return part.get_content()
    except (LookupError, ValueError):
        raw = part.get_payload(decode=True)
        return None if raw is None else raw.decode("utf-8", "replace")


def parsed_day(text: str) -> datetime.date:
    """A day written yyyy-mm-dd and no other way."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ValueError(f"{text!r} is no day of the form yyyy-mm-dd")
    return datetime.date.fromisoformat(text)


def read_mime(spark: SparkSession, path: str) -> DataFrame:
    """Headers and first plain part of MIME files; files that cannot be parsed give null bodies."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, content in zip(pdf["path"], pdf["content"]):
                message = email.message_from_bytes(bytes(content), policy=email.policy.default)
                part = message.get_body(("plain", "html"))
                out.append((name, {k: str(v) for k, v in message.items()}, body_of(part) if part else None))
            yield pd.DataFrame(out, columns=["path", "headers", "body_text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, headers map<string,string>, body_text string")


def in_window(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Rows from ``start`` to the end of the day ``end`` (yyyy-mm-dd, strictly); the bounds reach the scan."""
    days = [parsed_day(x) for x in (start, end) if x]
    if len(days) == 2 and days[0] > days[1]:
        raise ValueError("the window ends before it begins")
    if start:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    return df.where(F.col(column) < F.date_add(F.lit(end).cast("date"), 1)) if end else df

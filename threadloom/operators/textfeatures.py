"""Term weights, labels and feature-hash embeddings of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import STOP

#: Words as a tokeniser with Unicode word characters sees them; those of two or more ASCII letters alone count
WORD_SIGNS, TERM = r"[\p{L}\p{N}\p{M}_]+", "^[a-z]{2,}$"
#: Least letters and numbers of a token that an embedding counts
LEAST_TOKEN = 3
#: Characters of the texts whose terms a task weighs
PART_CHARS = 4_000_000


def _words(stop: list[str]) -> Column:
    return F.filter(F.regexp_extract_all(F.lower("text"), F.lit(WORD_SIGNS), F.lit(0)), lambda w: w.rlike(TERM) & ~w.isin(stop))


def terms(docs: DataFrame, stop: list[str] = STOP, pairs: bool = True) -> DataFrame:
    """(id, term, tf): words and, with ``pairs``, two neighbouring words of the texts (id, text), without stop words.

    Stop words are dropped before words become neighbours.  Null texts hold no terms.
    """
    rows = docs.where("text is not null").select("id", _words(stop).alias("w"))
    two = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b))
    listed = F.concat("w", F.when(F.size("w") > 1, two).otherwise(F.array().cast("array<string>"))) if pairs else F.col("w")
    return rows.select("id", F.explode(listed).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def _numbered(texts: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, sorted words, and the terms of the ids: place of the id, number of the term, tf.

    ``texts`` are (id, words, pairs); with V words, the term of word i has number i, that of words i
    and j side by side (i + 1) * V + j, so that a part gives its terms the same numbers every time.
    """
    ids = texts["id"].unique()
    of = pc.index_in(texts["id"], ids).to_numpy()
    lists = pc.split_pattern(pa.concat_arrays(texts["words"].chunks), " ")
    size, flat = pc.list_value_length(lists).to_numpy(), lists.flatten()
    words = flat.unique()
    words = words.take(pc.sort_indices(words))
    code, text = pc.index_in(flat, words).to_numpy().astype(np.int64), np.repeat(np.arange(len(lists)), size)
    own = of[text].astype(np.int64)
    if texts["pairs"][0].as_py():
        beside = np.flatnonzero(text[1:] == text[:-1])
        own, code = np.concatenate([own, own[beside]]), np.concatenate([code, (code[beside] + 1) * len(words) + code[beside + 1]])
    terms, back = np.unique(code, return_inverse=True)
    cell, tf = np.unique(own * len(terms) + back, return_counts=True)
    return ids, words, cell // len(terms), terms[cell % len(terms)], tf


def _spelled(words: pa.Array, number: np.ndarray) -> pa.Array:
    """The terms of some numbers."""
    first = words.take(pa.array(number % len(words)))
    two = number >= len(words)
    before = words.take(pa.array(np.maximum(number // len(words) - 1, 0)))
    return pc.if_else(pa.array(two), pc.binary_join_element_wise(before, first, " "), first)


def tfidf(docs: DataFrame, stop: list[str] = STOP, pairs: bool = True, part_chars: int = PART_CHARS) -> DataFrame:
    """(id, term, tf, weight): sparse vectors of length 1 of the texts (id, text), tf * (ln((1 + n) / (1 + df)) + 1).

    ``n`` counts the ids, those without terms too, which have no rows.  Repeated ids are one text.
    Texts are dealt by id into parts of about ``part_chars`` characters, as their words alone.  Each
    part adds up its terms, these sums alone are shuffled by term, and the part gets the total of each
    of its terms back under a number; no row of a text and a term is shuffled.
    """
    n, chars = docs.agg(F.count_distinct("id"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(8, -(-chars // part_chars))
    held = docs.where("text is not null").select(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(parts)).cast("int").alias("part"), "id", F.concat_ws(" ", _words(stop)).alias("words"), F.lit(pairs).alias("pairs"))
    # a fixed number of partitions: with those that AQE would join, a task had the texts of many parts
    texts = held.where("words <> ''").repartition(parts, "part")

    def summed(texts: pa.Table) -> pa.Table:
        _, words, _, number, _ = _numbered(texts)
        number, held_by = np.unique(number, return_counts=True)
        return pa.table({"part": pa.array(np.full(len(number), texts["part"][0].as_py(), np.int32)), "number": number, "term": _spelled(words, number).cast(pa.string()), "n": held_by})

    def weighted(texts: pa.Table, totals: pa.Table) -> pa.Table:
        ids, words, own, number, tf = _numbered(texts)
        known, df = totals["number"].to_numpy(), totals["df"].to_numpy()
        order = np.argsort(known)
        raw = tf * (np.log((1 + n) / (1 + df[order][np.searchsorted(known, number, sorter=order)])) + 1)
        size = np.sqrt(np.bincount(own, raw * raw, len(ids)))
        return pa.table({"id": ids.take(pa.array(own)), "term": _spelled(words, number).cast(pa.string()), "tf": tf, "weight": raw / size[own]})

    sums = texts.groupBy("part").applyInArrow(summed, "part int, number long, term string, n long")
    totals = sums.select("part", "number", F.sum("n").over(Window.partitionBy("term")).alias("df"))
    kind = docs.schema["id"].dataType.simpleString()
    found = texts.groupBy("part").cogroup(totals.repartition(parts, "part").groupBy("part")).applyInArrow(weighted, f"id {kind}, term string, tf long, weight double")
    return found.select("id", "term", "tf", F.round("weight", 6).alias("weight"))


def top_weights(vectors: DataFrame, k: int = 12) -> DataFrame:
    """(id, rank, term, weight): the k heaviest terms of each vector, ties by term."""
    order = Window.partitionBy("id").orderBy(F.desc("weight"), "term")
    return vectors.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "rank", "term", "weight")


def titled(c: Column) -> Column:
    return F.initcap(F.lower(c))


def project_labels(bags: DataFrame, projects: DataFrame, overrides: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(project, label, label_source) of ``projects`` (project, top, start) by their terms ``bags`` (project, term, tf).

    A label of ``overrides`` (project, label) stands.  Else terms rank by tf * ln((1 + C) / (1 + cdf)),
    then by name, and the first of several words or in title case is the label, else the first two
    together; without terms it is the top person and the month of the start.  Rows of ``bags`` that
    repeat a term add up, in ``parts`` partitions by project if given: a number that grows with the
    rows bounds the terms that a task holds.
    """
    clusters = projects.agg(F.greatest(F.count_distinct("project"), F.lit(1)).alias("c"))
    bags = bags.repartition(parts, "project") if parts else bags
    bags = bags.groupBy("project", "term").agg(F.sum("tf").alias("tf"))
    cdf = bags.groupBy("term").agg(F.count("*").alias("cdf"))
    scored = bags.join(cdf, "term").join(F.broadcast(clusters), how="cross").withColumn("less", -F.round(F.col("tf") * F.ln((1 + F.col("c")) / (1 + F.col("cdf"))), 9))
    telling = F.col("term").contains(" ") | ((F.col("term") == titled(F.col("term"))) & (F.col("term") != F.lower("term")))
    place = F.struct("less", "term")
    order = Window.partitionBy("project").orderBy("less", "term")
    first = scored.withColumn("r", F.row_number().over(order)).groupBy("project").agg(F.min(F.when(telling, place))["term"].alias("entity"), F.max(F.when(F.col("r") == 1, F.col("term"))).alias("one"), F.max(F.when(F.col("r") == 2, F.col("term"))).alias("two"))
    named = projects.join(first, "project", "left")
    named = named.join(overrides.select("project", F.col("label").alias("own")), "project", "left") if overrides is not None else named.withColumn("own", F.lit(None).cast("string"))
    month = F.concat_ws(" · ", F.coalesce("top", F.lit("unknown")), F.date_format("start", "MMM yyyy"))
    label = F.coalesce("own", titled(F.col("entity")), F.when(F.col("one").isNotNull(), titled(F.concat_ws(" · ", "one", "two"))), month)
    source = F.when(F.col("own").isNotNull(), "user").when(F.col("entity").isNotNull(), "entity").when(F.col("one").isNotNull(), "ctfidf").otherwise("fallback")
    return named.select("project", label.alias("label"), source.alias("label_source"))


def _byte(c: Column, digits: int) -> Column:
    """The first hexadecimal digits of the SHA-256 of a text as a number."""
    return F.conv(F.substring(F.sha2(c, 256), 1, digits), 16, 10).cast("long")


def hashed_features(docs: DataFrame, dim: int) -> DataFrame:
    """(id, bucket, value): the places that are not 0 in the feature-hash embeddings of texts (id, text).

    Each token of letters and numbers adds 1 or -1, by a hash of its own, to a bucket by its hash; the
    vectors have length 1.  A text without tokens, or whose tokens cancel out, has a 1 in the bucket
    of its own hash; a null text counts as empty.  Tokens are added up before anything is shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    # signs between white space that are neither letters nor numbers go at once, so tokens are what is left between white space
    tokens = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]+", ""), r"\s+")
    # a row without token stands for the text, with the bucket it takes if nothing else is left
    each = docs.select("id", (_byte(text, 8) % dim).cast("int").alias("own"), F.explode(F.concat(F.filter(tokens, lambda t: F.length(t) >= LEAST_TOKEN), F.array(F.lit(None).cast("string")))).alias("token"))
    sign = F.when(_byte(F.concat("token", F.lit("#sign")), 2) % 2 == 1, 1).otherwise(-1)
    each = each.select("id", F.when(F.col("token").isNull(), F.col("own")).alias("own"), (_byte(F.col("token"), 8) % dim).cast("int").alias("bucket"), F.when(F.col("token").isNotNull(), sign).otherwise(0).alias("sign"))
    sums = each.groupBy("id", "bucket", "own").agg(F.sum("sign").alias("s"), F.count("*").alias("n"))
    size = F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy("id")))
    placed = sums.withColumn("size", size).where("s <> 0 or bucket is null and size = 0")
    times = F.when(F.col("bucket").isNull(), F.col("n")).otherwise(1).cast("int")  # texts of one id that hold nothing have a row each
    return placed.select("id", F.coalesce("bucket", "own").alias("bucket"), F.when(F.col("bucket").isNull(), 1.0).otherwise(F.try_divide("s", "size")).alias("value"), F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


def hashed_vectors(docs: DataFrame, dim: int = 1024) -> DataFrame:
    """(id, v): the embeddings of ``hashed_features`` as arrays of ``dim`` components."""
    held = hashed_features(docs, dim).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("m"))  # dim entries at most
    return held.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("v"))

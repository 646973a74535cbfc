"""Search: vectors, postings with BM25, hybrid fusion, embedding backfill."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Most documents and queries of a meeting, least documents of one, and tasks that share the documents if these allow
DOCS, QUERIES, LEAST_DOCS, TASKS = 131_072, 16_384, 1_024, 24
#: Queries and documents that are compared at once in a task
STRIP, TILE = 512, 8_192
#: Documents of a task of the text search
TASK_DOCS = 4_000


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, shorter ones filled up with zeros, and their lengths; -1 if a vector is null or holds null."""
    lists = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values, held = lists.flatten(), np.maximum(size, 0)
    row, start = np.repeat(np.arange(len(size)), held), np.cumsum(held) - held
    out = np.zeros((len(size), max(1, held.max(initial=0))))
    out[row, np.arange(len(row)) - start[row]] = pc.fill_null(pc.cast(values, pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    size[row[pc.is_null(values).to_numpy(zero_copy_only=False)]] = -1
    return out, size


def _scores(x: np.ndarray, y: np.ndarray, x_size: np.ndarray, y_size: np.ndarray, places: int) -> np.ndarray:
    """Rounded cosines; infinite where they are NaN, which comes first, and -infinite where there is none, which comes last."""
    width = min(x.shape[1], y.shape[1])  # what is beyond belongs to vectors of other lengths
    with np.errstate(all="ignore"):
        lengths = np.sqrt((x * x).sum(axis=1))[:, None], np.sqrt((y * y).sum(axis=1))[None, :]
        near = np.round(x[:, :width] @ y[:, :width].T / (lengths[0] * lengths[1]), places)
    near[np.isnan(near)] = np.inf
    none_x, none_y = (x_size < 0) | (lengths[0][:, 0] == 0), (y_size < 0) | (lengths[1][0] == 0)
    near[none_x], near[:, none_y] = -np.inf, -np.inf
    if len(np.union1d(x_size[~none_x], y_size[~none_y])) > 1:
        near[x_size[:, None] != y_size[None, :]] = -np.inf
    return near


def _top(q: np.ndarray, v: np.ndarray, q_size: np.ndarray, v_size: np.ndarray, k: int, places: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of q, row of v, score) of the k rows of v best for each row of q, in strips of q; ties go to the earlier row of v."""
    for at in range(0, len(q), STRIP):
        part = slice(at, at + STRIP)
        a, b, s, few = np.zeros(0, int), np.zeros(0, int), np.zeros(0), None
        for to in range(0, len(v), TILE):
            near = _scores(q[part], v[to : to + TILE], q_size[part], v_size[to : to + TILE], places)
            if few is None:
                least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -np.inf)
                x, y = np.nonzero(near >= least[:, None])
            else:
                x, y = np.nonzero((near > few[:, None]) | short[:, None])  # what only ties with the last of k comes too late
            a, b, s = np.concatenate([a, x]), np.concatenate([b, y + to]), np.concatenate([s, near[x, y]])
            order = np.lexsort((b, -s, a))
            a, b, s = a[order], b[order], s[order]
            first = np.searchsorted(a, np.arange(len(near) + 1))
            keep = np.arange(len(a)) - first[a] < k
            a, b, s = a[keep], b[keep], s[keep]
            last = np.searchsorted(a, np.arange(len(near)), "right") - 1
            few, short = s[last], np.bincount(a, minlength=len(near)) < k
        yield a + at, b, s


def vector_search(docs: DataFrame, queries: DataFrame, k: int = 20, least: float | None = None, at_once: int = QUERIES, block: int = DOCS) -> DataFrame:
    """(query_id, id, score, rank): the k documents (id, v) nearest to each query (query_id, q) by cosine, rounded to four places.

    Ties go to smaller ids.  A document without a cosine (a vector that is null, of length 0 or of
    another length than the query's, or that holds null) has a null score and comes last, one with a NaN first.  Documents are dealt
    into blocks of ``block`` at most, queries of ``at_once`` at most; every two blocks meet in one
    task, which keeps k rows a query.  So each query meets each document once, and the work grows with the product.
    """
    asked = queries.select(F.col("query_id").alias("id"), F.col("q").alias("v"))
    n, m = docs.count(), asked.count()
    rows, cols = max(1, -(-n // min(block, max(LEAST_DOCS, -(-n // TASKS))))), max(1, -(-m // at_once))

    def dealt(side: DataFrame, own: str, other: str, parts: int, others: int, seed: int) -> DataFrame:
        mine = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(parts)).cast("int")
        return side.select("id", "v", F.lit(bool(seed)).alias("asks"), mine.alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches))
        asks = both["asks"]
        one, all_ = both.filter(asks), both.filter(pc.invert(asks)).sort_by([("id", "ascending")])
        if len(one) and len(all_):
            (q, q_size), (v, v_size) = _matrix(one["v"]), _matrix(all_["v"])
            to, ids = one["id"].combine_chunks(), all_["id"].combine_chunks()
            for a, b, s in _top(q, v, q_size, v_size, k, 4):
                score = pa.array(np.where(s == np.inf, np.nan, s), mask=s == -np.inf)
                yield pa.RecordBatch.from_arrays([to.take(pa.array(a)), ids.take(pa.array(b)), score], ["query_id", "id", "score"])

    kinds = queries.schema["query_id"].dataType.simpleString(), docs.schema["id"].dataType.simpleString()
    if kinds[0] != kinds[1]:
        raise ValueError("ids of queries and documents need one type")
    element = "array<double>"
    sides = dealt(docs.select("id", F.col("v").cast(element).alias("v")), "row", "col", rows, cols, 0).unionByName(dealt(asked.select("id", F.col("v").cast(element).alias("v")), "col", "row", cols, rows, 7))
    # a fixed number of partitions: rows are few against the comparisons
    met = sides.repartition(3 * rows * cols, "row", "col").groupBy("row", "col").applyInArrow(meet, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    if least is not None:
        met = met.where(F.col("score") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def postings(docs: DataFrame, wanted: DataFrame | None = None, mark: str | None = None) -> DataFrame:
    """(term, id, tf, len) of the ASCII words of (id, text), of the ``wanted`` terms alone if given.

    ``mark`` is a term that each text holds once besides its words.
    """
    words = docs.select("id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))
    rows = words.select("id", F.size("w").alias("len"), F.explode("w" if mark is None else F.concat("w", F.array(F.lit(mark)))).alias("term"))
    if wanted is not None:
        # by document, and few documents a task: what is grouped later grows with the queries
        rows = rows.where("term is not null").join(wanted, "term", "left_semi").repartition(max(8, -(-docs.count() // TASK_DOCS)), "id")
    return rows.groupBy("term", "id", "len").agg(F.count("*").alias("tf"))


def text_search(docs: DataFrame, queries: DataFrame, k: int = 20, every: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents of each query (query_id, text) by BM25; ``every``: with all its terms.

    Queries are a stated set.  Texts are split once; words that no query asks for are dropped before
    anything is grouped, the others are shuffled once, by document, and what follows stays in the document's task.
    """
    terms = queries.select("query_id", F.explode(S.tokens(F.col("text"))).alias("term"))
    asked = terms.groupBy("query_id").agg(F.count("*").alias("asked"))
    # the empty term stands once in every text that is not null: it counts texts and their words
    index = postings(docs, F.broadcast(terms.select(F.explode(F.array("term", F.lit(""))).alias("term")).distinct()), "")
    df = index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("texts"), F.sum(F.col("len") * F.col("tf")).alias("words"))
    whole = lambda c: F.max(F.when(F.col("term") == "", F.col(c)))
    stats = df.agg(whole("texts").alias("n"), (whole("words") / whole("texts")).alias("avg_len"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = terms.join(df, "term").join(F.broadcast(stats), how="cross").select("query_id", "term", idf.alias("idf"), "avg_len")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = index.join(F.broadcast(weights), "term").select("query_id", "id", part.alias("part"))
    found = scored.groupBy("query_id", "id").agg(F.round(F.sum("part"), 4).alias("score"), F.count("*").alias("matched"))
    if every:
        found = found.join(asked, "query_id").where("matched = asked").drop("asked")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def hybrid(vector_hits: DataFrame, text_hits: DataFrame, k: int = 10, w_vector: float = 0.6, w_text: float = 0.4) -> DataFrame:
    """Fusion of two hit lists (query_id, id, score): min-max in each pool, weighted sum, top k."""
    def scaled(hits: DataFrame, name: str) -> DataFrame:
        pool = Window.partitionBy("query_id")
        low, high = F.min("score").over(pool), F.max("score").over(pool)
        return hits.select("query_id", "id", F.when(low == high, 1.0).otherwise((F.col("score") - low) / (high - low)).alias(name))

    both = scaled(vector_hits, "v").join(scaled(text_hits, "t"), ["query_id", "id"], "full_outer")
    source = F.when(F.col("v").isNull(), "fts").when(F.col("t").isNull(), "vector").otherwise("hybrid")
    both = both.withColumn("source", source).withColumn("score", F.round(w_vector * F.coalesce("v", F.lit(0.0)) + w_text * F.coalesce("t", F.lit(0.0)), 4))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "source", "score", "rank")


def backfill_plan(messages: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows (id, content_hash) whose stored hash is missing or differs."""
    old = stored.select("id", F.col("content_hash").alias("old_hash"))
    return messages.join(old, "id", "left").where(F.col("old_hash").isNull() | (F.col("old_hash") != F.col("content_hash"))).drop("old_hash")

"""Exact top-k inner products over a bit-sliced index.

Vectors become integers.  A block of vectors stores, per attribute, one bitmap for each of the
most significant bits.  A query adds the slices weighted by its own most significant bits with
bitmap arithmetic, finds the k-th best sum from the most significant slice downward, keeps every
row that rounding could still lift to that place, and scores those boundary rows exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block of the index, and queries that meet a block in one task
BLOCK_ROWS, QUERY_ROWS = 1_024, 2_048
PLANES, WEIGHT_BITS, AT_ONCE = 8, 7, 256
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(embedding: Column) -> Column:
    """True for vectors without null or non-finite components (and not null themselves)."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return embedding.isNotNull() & ~F.exists(embedding, bad)


class Block:
    """Slices of one block: planes[d, b] is the bitmap of bit b of attribute d."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, planes: int = PLANES):
        self.ids, self.vectors, self.bits = ids, vectors, planes
        self.low = vectors.min(axis=0)
        reach = int((vectors.max(axis=0) - self.low).max(initial=0))
        self.shift = max(0, reach.bit_length() - planes)
        high = ((vectors - self.low) >> self.shift).astype(np.int64)
        self.words = -(-len(ids) // 64)
        self.planes = np.stack([[self.pack((high[:, d] >> b) & 1) for b in range(planes)] for d in range(vectors.shape[1])]) if vectors.shape[1] else np.zeros((0, planes, self.words), np.uint64)
        self.valid = self.pack(np.ones(len(ids), bool))

    def pack(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(bits.astype(bool), bitorder="little")
        out[: len(packed)] = packed
        return out.view(np.uint64)

    def sums(self, weights: np.ndarray, negative: np.ndarray) -> list[np.ndarray]:
        """Slices of sum_d weight_d * attribute_d for all queries, attributes of negative weights complemented."""
        top = int(weights.sum(axis=1).max(initial=0)) * ((1 << self.bits) - 1)
        total = [np.zeros((len(weights), self.words), np.uint64) for _ in range(max(1, top.bit_length()))]
        for d in range(weights.shape[1]):
            flip = np.where(negative[:, d], ALL, np.uint64(0))[:, None]
            addend = [p ^ flip for p in self.planes[d]]
            for t in range(int(weights[:, d].max(initial=0)).bit_length()):
                on = np.where((weights[:, d] >> t) & 1, ALL, np.uint64(0))[:, None]
                carry = np.zeros_like(total[0])
                for b, a in enumerate(addend):
                    if t + b >= len(total):
                        break
                    a = a & on
                    s = total[t + b]
                    x = s ^ a
                    total[t + b] = x ^ carry
                    carry = (s & a) | (x & carry)
                for j in range(t + len(addend), len(total)):
                    s = total[j]
                    total[j] = s ^ carry
                    carry = s & carry
        return total

    def candidates(self, queries: np.ndarray, k: int, weight_bits: int = WEIGHT_BITS) -> np.ndarray:
        """Booleans (query, row): rows that can be among the k best of the block."""
        size = np.abs(queries)
        t = np.array([max(0, int(m).bit_length() - weight_bits) for m in size.max(axis=1, initial=0)])
        weights, rest = size >> t[:, None], size - ((size >> t[:, None]) << t[:, None])
        total = self.sums(weights, queries < 0)
        # rounding adds between 0 and `above` to a sum and takes up to `below` from it
        cut, full = (1 << self.shift) - 1, (1 << self.bits) - 1
        above = (rest.sum(axis=1) * full << self.shift) + np.where(queries > 0, queries, 0).sum(axis=1) * cut
        below = np.where(queries < 0, -queries, 0).sum(axis=1) * cut
        sure, even, kth = np.zeros_like(total[0]), np.broadcast_to(self.valid, total[0].shape).copy(), np.zeros(len(queries), np.int64)
        for j in range(len(total) - 1, -1, -1):
            both = even & total[j]
            enough = (np.bitwise_count(sure | both).sum(axis=1) >= k)[:, None]
            kth += enough[:, 0].astype(np.int64) << j
            sure = np.where(enough, sure, sure | both)
            even = np.where(enough, both, even & ~total[j])
        unit = 1 << (self.shift + t)
        least = np.maximum(0, kth - -(-(above + below) // unit))
        more, even = np.zeros_like(sure), np.broadcast_to(self.valid, sure.shape).copy()
        for j in range(len(total) - 1, -1, -1):
            bit = np.where((least >> j) & 1, ALL, np.uint64(0))[:, None]
            more |= even & total[j] & ~bit
            even &= ~(total[j] ^ bit)
        found = more | even
        return np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")[:, : len(self.ids)].astype(bool)

    def best(self, query: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
        """The k best rows for each query (numbered by ``query``), without one row equal to it in id and vector."""
        out = [pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query", "vec_id", "score")})]
        for lo in range(0, len(queries), AT_ONCE):
            part = queries[lo : lo + AT_ONCE]
            found = self.candidates(part, k + 1)  # a query may meet itself
            for i, q in enumerate(part):
                rows = np.flatnonzero(found[i])
                same = np.flatnonzero(self.ids[rows] == query_ids[lo + i])
                itself = same[(self.vectors[rows[same]] == q).all(axis=1)]
                rows = np.delete(rows, itself[:1])
                score = self.vectors[rows] @ q
                best = np.lexsort((self.ids[rows], -score))[:k]
                out.append(pd.DataFrame({"query": query[lo + i], "vec_id": self.ids[rows[best]], "score": score[best]}))
        return pd.concat(out, ignore_index=True)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k best of ``vectors`` for each of ``queries`` by integer inner product.

    Both have ``vec_id`` (long) and ``v`` (array of long); rows with null in either take no part and
    vectors meet queries of their own length only.  A query that is among the vectors (same id, same
    vector) does not find itself: one such row is left out.  Rows that repeat an id are candidates
    and queries each; ties go to smaller ids.  Fewer than k candidates give fewer rows, empty tables
    none.  Returns query_id, rank, vec_id, score.  Products are summed in 64 bits: a block and
    queries whose sums could reach 2**62 raise an error.  Other columns are not looked at.

    Blocks of the index and groups of queries have bounded sizes; each query goes once to each
    block, each block once to each group of queries, and k rows per pair come back, of which the
    task keeps k per query.  Of equal rows k + 1 are indexed, as no more can be among the k best.
    """
    alike = lambda df: df.where("vec_id is not null and v is not null").groupBy("vec_id", "v").agg(F.count("*").alias("n")).withColumn("dim", F.size("v"))
    vectors, queries = alike(vectors), alike(queries).withColumn("query", F.xxhash64("vec_id", "v"))
    blocks = max(1, math.ceil(vectors.count() / block_rows))
    groups = max(1, math.ceil(queries.count() / query_rows))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k + 1)).cast("int")))).withColumn("block", deal(blocks)).withColumn("part", every(groups))
    right = queries.withColumn("part", deal(groups)).withColumn("block", every(blocks))

    def search(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        if not len(rows) or not len(asked):
            return none
        v, q = (np.stack(x["v"].to_numpy()).astype(np.int64) for x in (rows, asked))
        reach = lambda x: max(-int(x.min(initial=0)), int(x.max(initial=0)))
        if reach(v) * reach(q) * v.shape[1] >= 1 << 62:
            raise ValueError(f"sums of products of components up to {reach(v)} and {reach(q)} do not fit 64 bits")
        return Block(rows["vec_id"].to_numpy(np.int64), v).best(asked["query"].to_numpy(np.int64), asked["vec_id"].to_numpy(np.int64), q, k).astype(none.dtypes.to_dict())

    keys = ["block", "part", "dim"]
    columns = lambda df, *own: df.select(*keys, "vec_id", "v", *own)
    found = columns(left).groupBy(*keys).cogroup(columns(right, "query").groupBy(*keys)).applyInPandas(search, "query long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    asked = queries.select("query", F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return asked.join(best, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The same search by brute force, for DuckDB
TOP_K_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row_, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row_ AS query, q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.row_ <> c.row_ AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""

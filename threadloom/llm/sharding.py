"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

How many rows of input part p go to block j follows the multivariate hypergeometric law, so every
block has its exact size before any row moves.  Each part permutes its rows and cuts them at the
drawn counts, rows are exchanged, and each block permutes again.  The matrix is never held whole:
its rows hang on a binary tree of draws, each seeded by its place, so the task of a part draws the
numbers on its own way down and no others.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fewest rows aimed at in a part or block; large tables have parts of 2 * sqrt(rows), so a task draws
#: fewer numbers than it has rows
PART_ROWS = 1_024
#: numpy draws hypergeometric numbers for populations below this
NUMPY_LIMIT = 1_000_000_000


def log_factorial(n: int) -> np.longdouble:
    """log(n!) by Stirling's series, to about 1e-19 of its size; small numbers by their product."""
    if n < 64:
        return np.log(np.longdouble(math.factorial(n))) if n > 1 else np.longdouble(0)
    x = np.longdouble(n)
    return (x + np.longdouble(0.5)) * np.log(x) - x + np.longdouble(0.5) * np.log(2 * np.longdouble(np.pi)) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int, limit: int = NUMPY_LIMIT) -> int:
    """Good ones among ``sample`` of ``good + bad``: numpy below ``limit``, beyond it by ratio of uniforms.

    The rejection compares with the exact probabilities (in extended precision), whatever the sizes.
    """
    total = good + bad
    if total < limit:
        return int(rng.hypergeometric(good, bad, sample)) if total else 0
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    mode = min(high, max(low, (sample + 1) * (good + 1) // (total + 2)))
    weight = lambda x: log_factorial(x) + log_factorial(good - x) + log_factorial(sample - x) + log_factorial(bad - sample + x)
    best = weight(mode)
    share = good / total
    centre = sample * share + 0.5
    spread = math.sqrt((total - sample) * sample * share * (1 - share) / (total - 1) + 0.5)
    width = math.sqrt(8 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)  # covers the region of a log-concave law
    while True:
        u, v = 1 - rng.random(), rng.random()
        x = math.floor(centre + width * (v - 0.5) / u)
        if low <= x <= high and 2 * math.log(u) <= best - weight(x):
            return x


def spread_over(rng: np.random.Generator, free: np.ndarray, sample: int, limit: int = NUMPY_LIMIT) -> np.ndarray:
    """How many of ``sample`` rows go to each block with ``free`` places left."""
    total = int(free.sum())
    if total < limit:
        return rng.multivariate_hypergeometric(free, sample, method="marginals")
    out, rest = np.zeros(len(free), np.int64), total
    for j, good in enumerate(map(int, free)):
        rest -= good
        out[j] = hypergeometric(rng, good, rest, sample, limit)
        sample -= int(out[j])
    return out


class Matrix:
    """Rows of a communication matrix, drawn on demand: row sums are ``counts``, column sums ``sizes``."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, seed: int, limit: int = NUMPY_LIMIT):
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.sizes, self.seed, self.limit = sizes.astype(np.int64), seed, limit
        self.node = lru_cache(maxsize=64)(self.draw)

    def __reduce__(self):
        return Matrix, (np.diff(self.before), self.sizes, self.seed, self.limit)

    def draw(self, lo: int, hi: int, a: int, b: int) -> np.ndarray:
        """What parts lo to hi-1 send to each block; a to b-1 are the parts of the node above."""
        if (lo, hi) == (0, len(self.before) - 1):
            return self.sizes
        whole, middle = self.above(a, b), (a + b) // 2
        left = spread_over(np.random.default_rng([self.seed, a, b]), whole, int(self.before[middle] - self.before[a]), self.limit)
        return left if hi == middle else whole - left

    def above(self, lo: int, hi: int) -> np.ndarray:
        a, b = 0, len(self.before) - 1
        up = (a, b)
        while (a, b) != (lo, hi):
            up, middle = (a, b), (a + b) // 2
            a, b = (a, middle) if lo < middle else (middle, b)
        return self.node(lo, hi, *up)

    def row(self, part: int) -> np.ndarray:
        return self.above(part, part + 1)


def block_of(matrix: Matrix, part: Column, rank: Column) -> Column:
    """The block that takes the row with this rank (from 0) in its part."""

    @F.arrow_udf("int")
    def shard_block(parts: pa.Array, ranks: pa.Array) -> pa.Array:
        p, r = parts.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        out = np.zeros(len(p), np.int32)
        for k in np.unique(p):
            mine = p == k
            out[mine] = np.searchsorted(np.cumsum(matrix.row(int(k))), r[mine], "right")
        return pa.array(out)

    return shard_block(part, rank)


def shard(df: DataFrame, n_shards: int = 40, seed: int = 20, doc_id: str = "doc_id", text: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """All rows of ``df`` with ``shard`` (0 to n_shards-1) and ``slot`` (gapless from 0 in a shard).

    Shard sizes differ by one row at most.  Order and shard of a row come from seeded hashes of its
    columns (maps and variants aside) and from the drawn matrix, so reruns agree; rows that agree in
    all of them are interchangeable.  Nulls, empty and very long texts are rows like any other; an
    empty table gives no rows.  Existing columns named shard or slot are replaced, all others keep
    their values.  The driver sees the row counts of the parts, at most sqrt(rows) / 2 beyond a
    million rows.
    """
    own = [c for c in df.columns if c not in ("shard", "slot")]
    n = df.count()
    rows = max(part_rows, 2 * math.isqrt(n))
    parts = max(1, math.ceil(n / rows))
    per_shard = max(1, math.ceil(n / n_shards / rows))
    hashed = [F.col(f"`{c}`") for c, t in df.dtypes if c in own and "map<" not in t and "variant" not in t]
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("input"), F.xxhash64(F.lit(seed), *hashed).alias("key"))
    keyed = keyed.withColumn("part", F.pmod("key", F.lit(parts)).cast("int"))
    counts = np.zeros(parts, np.int64)
    for r in keyed.groupBy("part").count().collect():  # one number a part
        counts[r[0]] = r[1]
    sizes = [n // n_shards + (i < n % n_shards) for i in range(n_shards)]
    blocks = np.array([s // per_shard + (j < s % per_shard) for s in sizes for j in range(per_shard)], np.int64)
    matrix = Matrix(counts, blocks, seed)
    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 1), "key"))
    again = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 2), "key"))
    sent = keyed.withColumn("rank", F.row_number().over(local) - 1).withColumn("block", block_of(matrix, F.col("part"), F.col("rank")))
    placed = sent.withColumn("at", F.row_number().over(again) - 1)
    # the blocks of a shard follow each other, longer ones first
    shard_of, turn = F.floor(F.col("block") / per_shard), F.col("block") % per_shard
    size = F.lit(n // n_shards) + F.when(shard_of < n % n_shards, 1).otherwise(0)
    start = turn * F.floor(size / per_shard) + F.least(turn, size % per_shard)
    return placed.select(*[F.col("input").getField(c).alias(c) for c in own], shard_of.cast("int").alias("shard"), (start + F.col("at")).cast("long").alias("slot"))

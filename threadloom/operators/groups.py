"""Groups of any size dealt into meetings of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block of members, and least number of blocks, so that many tasks share the meetings
BLOCK_ROWS, LEAST_BLOCKS = 2_000_000, 8
#: Pairs of a partition where pairs are joined and added up: the number of partitions grows with the pairs, not the tasks
PART_PAIRS = 1_000_000
#: Groups of a member, on average over the rows and at most, up to which its rows carry the list of them
MEAN_LIST, MOST_LIST = 16, 1_024
#: Members whose pairs are added up at once in a task; terms added at once; rows of a batch of pairs
STRIP, TERMS, OUT_ROWS = 2_048, 1 << 22, 1 << 18


def split_groups(df: DataFrame, key: str, node: str, size: str, chunk: int) -> DataFrame:
    """Deal groups of more than ``chunk`` members into chunks, every pair of which meets once.

    Adds ``lo`` and ``hi`` (the two chunks of a meeting) and ``mine`` (the row's own chunk).
    """
    n = F.ceil(F.col(size) / chunk).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    return (
        df.withColumn("chunks", n)
        .withColumn("mine", F.pmod(F.xxhash64(node), F.col("chunks")).cast("int"))
        .withColumn("other", other)
        .withColumn("lo", F.least("mine", "other"))
        .withColumn("hi", F.greatest("mine", "other"))
        .drop("chunks", "other")
    )


def pair_sums(rows: DataFrame, weighted: bool = False, chunk: int = 256, block_rows: int = BLOCK_ROWS, dense: bool | None = None, strip: int = STRIP) -> DataFrame:
    """(a, b, total), a < b: the members that share a group, with the number of groups they share or the sum of their weights.

    ``rows`` are distinct (group_id, member) without nulls, and w if ``weighted``: the weight of the
    group.  Where groups are small, their pairs are joined and added up.  Where members are in few groups
    besides (without weights), each row carries the groups of its member: a pair is counted in the first
    group it shares and is not shuffled.  Where the pairs would be
    many times the rows (``dense``; decided from the sizes of the groups if not given), no pair is
    shuffled: members are dealt into blocks of about ``block_rows`` rows, every two blocks meet in
    one task, and that task adds up the pairs of its members over all groups.  The rows of one member
    have to fit the memory of a task.
    """
    sizes = rows.groupBy("group_id").agg(F.count("*").alias("n"))
    if dense:
        n = rows.count()
    else:
        n, pairs, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)), F.coalesce(F.max("n"), F.lit(0))).first()
    blocks = max(LEAST_BLOCKS, -(-n // block_rows))
    if dense is None:
        dense = pairs > 2.0 * n * blocks
    if dense:
        return _sums_of_blocks(rows, weighted, blocks, strip)
    # fixed numbers of partitions: those that AQE joins by the size of the rows make many times their size of pairs
    parts = max(LEAST_BLOCKS, -(-int(pairs) // PART_PAIRS))
    meeting = ["group_id"]
    listed = not weighted and _few_groups(rows, pairs)
    if listed:
        own = rows.groupBy("member").agg(F.sort_array(F.collect_list("group_id")).alias("own"))
        rows = own.select("member", "own", F.explode("own").alias("group_id"))
    if most > chunk:
        # a group of at most one chunk needs no row in ``large``, which stays small
        large = sizes.where(F.col("n") > chunk)
        sized = rows.join(large, "group_id", "left").withColumn("n", F.coalesce("n", F.lit(1)))
        rows, meeting = split_groups(sized, "group_id", "member", "n", chunk), ["group_id", "lo", "hi"]
    dealt = rows.repartition(parts, *meeting)
    a, b = dealt.alias("a"), dealt.alias("b")
    met = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in meeting] + [F.col("a.member") < F.col("b.member")]
    if most > chunk:
        met.append((F.col("a.lo") == F.col("a.hi")) | (F.col("a.mine") != F.col("b.mine")))
    met = a.join(b, reduce(and_, met))
    if listed:
        # a generator keeps the lists from being compared twice, by the filter and for the number
        met = met.select(F.col("a.group_id").alias("g"), F.col("a.member").alias("a"), F.col("b.member").alias("b"), F.explode(F.array(F.array_intersect("a.own", "b.own"))).alias("both"))
        return met.where(F.col("both")[0] == F.col("g")).select("a", "b", F.size("both").cast("long").alias("total"))
    # pairs of a task hardly repeat, so they are added up where they meet and not before
    met = met.select(F.col("a.member").alias("a"), F.col("b.member").alias("b"), *([F.col("a.w").alias("w")] if weighted else [])).repartition(parts, "a", "b")
    return met.groupBy("a", "b").agg((F.sum("w") if weighted else F.count("*")).alias("total"))


def _few_groups(rows: DataFrame, pairs: float) -> bool:
    """Whether rows with the lists of their members' groups take less room than the pairs, and the lists are short."""
    n = rows.groupBy("member").agg(F.count("*").alias("n"))
    entries, rows_, most = n.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return most <= MOST_LIST and entries <= min(pairs, MEAN_LIST * rows_)


def _sums_of_blocks(rows: DataFrame, weighted: bool, blocks: int, strip: int) -> DataFrame:
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rows.select("group_id", "member", *(["w"] if weighted else []), F.pmod(F.xxhash64(F.lit(5), "member"), F.lit(blocks)).cast("int").alias("mine")).withColumn("other", other)
    dealt = dealt.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).drop("other")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(list(batches)).combine_chunks()
        member, g = cell["member"].combine_chunks().unique(), cell["group_id"].combine_chunks().unique()
        member = member.take(pc.sort_indices(member))
        m, g = pc.index_in(cell["member"], member).to_numpy(), pc.index_in(cell["group_id"], g).to_numpy()
        w = cell["w"].to_numpy() if weighted else np.ones(len(m))
        mine, alone = cell["mine"].to_numpy(), cell["lo"][0].as_py() == cell["hi"][0].as_py()
        low = mine == cell["lo"][0].as_py()
        left = _strips(m[low], g[low], w[low], strip)
        right = left if alone else _strips(m[~low], g[~low], w[~low], strip)
        for i, x in enumerate(left):
            for j, y in enumerate(right[i:] if alone else right):
                found, total = _meeting(x, y)
                if alone and not j:
                    found = np.triu(found, 1)
                p, q = np.nonzero(found)
                a, b, total = x.members[p], y.members[q], total[p, q]
                a, b = np.minimum(a, b), np.maximum(a, b)
                for at in range(0, len(a), OUT_ROWS):
                    part = slice(at, at + OUT_ROWS)
                    yield pa.RecordBatch.from_arrays([member.take(pa.array(a[part])), member.take(pa.array(b[part])), pa.array(total[part] if weighted else total[part].astype(np.int64))], ["a", "b", "total"])

    kind = rows.schema["member"].dataType.simpleString()
    # a fixed number of partitions: the rows of a meeting are few against its pairs
    spread = dealt.repartition(3 * blocks * (blocks + 1) // 2, "lo", "hi")
    return spread.groupBy("lo", "hi").applyInArrow(meet, f"a {kind}, b {kind}, total {'double' if weighted else 'long'}")


@dataclass
class _Strip:
    """Rows of a bounded number of members, by group: the groups, where each begins and how many rows it has."""

    members: np.ndarray
    m: np.ndarray
    w: np.ndarray
    groups: np.ndarray
    start: np.ndarray
    size: np.ndarray


def _strips(m: np.ndarray, g: np.ndarray, w: np.ndarray, strip: int = STRIP) -> list[_Strip]:
    members, own = np.unique(m, return_inverse=True)
    order = np.lexsort((g, own // strip))
    own, g, w = own[order], g[order], w[order]
    ends = np.searchsorted(own // strip, np.arange(-(-len(members) // strip) + 1))
    out = []
    for k, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])):
        groups, start, size = np.unique(g[lo:hi], return_index=True, return_counts=True)
        out.append(_Strip(members[k * strip : (k + 1) * strip], own[lo:hi] - k * strip, w[lo:hi], groups, start, size))
    return out


def _meeting(x: _Strip, y: _Strip) -> tuple[np.ndarray, np.ndarray]:
    """Whether members of two strips share a group, and the sums of the weights of those groups."""
    _, gx, gy = np.intersect1d(x.groups, y.groups, assume_unique=True, return_indices=True)
    shape = len(x.members), len(y.members)
    total = np.zeros(shape)
    count = total if not len(x.w) or x.w.min() > 0 else np.zeros(shape)  # weights of 0 or less hide a pair
    nx, ny = x.size[gx], y.size[gy]
    if (nx * ny).sum() * 100 > shape[0] * shape[1] * len(gx):  # products of matrices are that much faster a term
        for lo in range(0, len(gx), STRIP):
            a, at = _spans(x.start[gx[lo : lo + STRIP]], nx[lo : lo + STRIP])
            b, to = _spans(y.start[gy[lo : lo + STRIP]], ny[lo : lo + STRIP])
            left, right = np.zeros((shape[0], min(STRIP, len(gx) - lo))), np.zeros((shape[1], min(STRIP, len(gx) - lo)))
            left[x.m[a], at], right[y.m[b], to] = x.w[a], 1
            total += left @ right.T
            if count is not total:
                left[x.m[a], at] = 1
                count += left @ right.T
        return count > 0, total
    a, at = _spans(x.start[gx], nx)
    ends = np.cumsum(ny[at])  # terms up to each row of x
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TERMS)))
        b, row = _spans(y.start[gy][at[lo:hi]], ny[at[lo:hi]])
        flat = x.m[a[lo:hi]][row] * shape[1] + y.m[b]
        total += np.bincount(flat, x.w[a[lo:hi]][row], total.size).reshape(shape)
        if count is not total:
            count += np.bincount(flat, minlength=total.size).reshape(shape)
        lo = hi
    return count > 0, total


def _spans(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places start[k] .. start[k] + size[k] - 1 of all k in turn, and the k of each."""
    k = np.repeat(np.arange(len(size)), size)
    return np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size) + start[k], k

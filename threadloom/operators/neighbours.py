"""Nearest neighbours by cosine, and the graph of similar threads that is built on them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import staged
from .clustering import rare_members, rare_pairs, similarity_graph, thread_similarity
from .groups import _spans, split_groups

#: Vectors of a meeting on either side at least and at most; meetings of everything with everything have this many sides
CHUNK, MOST_CHUNK, SIDES = 512, 65_536, 8
#: Vectors compared at once in a task, of the one side and of the other
STRIP, TILE = 1_024, 8_192
#: Threads of a block whose pairs with another block are scored in one task, at most
MOST_SCORED = 32_768
#: Most cells, so that their centres (a broadcast) stay bounded
MOST_CELLS = 4_096


def _distinct(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each vector of length above 0 once, scaled to length 1 (v_key, v), and its k + 1 smallest ids (v_key, id, copies).

    Equal vectors are equally near to everything, so of many copies only the smallest ids can be
    among the nearest of any vector.
    """
    usable = vectors.select("id", F.transform("v", lambda x: x.cast("double")).alias("v")).where("id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    size = F.sqrt(S.dot(F.col("v"), F.col("v")))
    rows = staged(usable.withColumn("size", size).where("size > 0").withColumn("v_key", F.xxhash64("v", F.lit(1))), "vectors")
    order = Window.partitionBy("v_key").orderBy("id")
    first = rows.select("v_key", "id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    once = rows.groupBy("v_key").agg(F.first(F.struct("v", "size")).alias("f")).select("v_key", F.transform("f.v", lambda x: x / F.col("f.size")).alias("v"))
    return staged(once, "distinct"), rows.select("v_key", "id"), staged(first.select("v_key", "id"), "copies")


def _cells(once: DataFrame, cells: int, probes: int) -> DataFrame:
    """(cell, v_key, v): each vector in the cells of its ``probes`` nearest centres.

    Centres are the vectors with the smallest hashes of their keys: ``MOST_CELLS`` of them at most.
    """
    few = once.orderBy(F.xxhash64("v_key"), "v_key").limit(min(cells, MOST_CELLS)).collect()
    centres = np.array([r.v for r in few])

    @F.pandas_udf("array<int>")
    def nearest_cells(v: pd.Series) -> pd.Series:
        out = []
        for lo in range(0, len(v), 1024):
            near = np.stack(v.iloc[lo : lo + 1024]) @ centres.T
            out += list(np.argsort(-near, axis=1, kind="stable")[:, :probes].astype(np.int32))
        return pd.Series(out, index=v.index)

    return once.select(F.explode(nearest_cells("v")).alias("cell"), "v_key", "v")


def _best(x: np.ndarray, y: np.ndarray, k: int, places: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of x, row of y, similarity) of the k best of each row of x, and what ties with the last of them; ids settle ties later."""
    for at in range(0, len(x), STRIP):
        part, few = x[at : at + STRIP], np.full(len(x[at : at + STRIP]), -2.0)
        a, b, s = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        for to in range(0, len(y), TILE):
            near = part @ y[to : to + TILE].T
            if same:
                both = np.arange(max(at, to), min(at + len(near), to + near.shape[1]))
                near[both - at, both - to] = -9
            least = few
            if to == 0 and near.shape[1] > k:
                least = -np.partition(-near, k - 1, axis=1)[:, k - 1]
            p, q = np.nonzero(near >= (least - 10.0**-places)[:, None])
            p, q, t = p[near[p, q] > -9], q[near[p, q] > -9], near[p, q][near[p, q] > -9]
            a, b, s = np.concatenate([a, p]), np.concatenate([b, q + to]), np.concatenate([s, np.round(t, places)])
            order = np.lexsort((-s, a))
            a, b, s = a[order], b[order], s[order]
            first = np.searchsorted(a, np.arange(len(part) + 1))
            full = np.flatnonzero(np.diff(first) >= k)
            few[full] = s[first[full] + k - 1]
            keep = s >= few[a]
            a, b, s = a[keep], b[keep], s[keep]
        yield a + at, b, s


def nearest(vectors: DataFrame, k: int = 25, cells: int | None = None, probes: int = 12, chunk: int | None = None, places: int = 6) -> DataFrame:
    """(id, other, similarity): the k vectors (id, v) nearest to each by cosine, rounded to some places; ties go to smaller ids.

    ``cells=1`` compares everything with everything, in blocks, and is exact.  Otherwise vectors meet
    inside the cells of the ``probes`` centres nearest to each (by default about the root of their
    number of cells), which finds nine in ten or more of the exact ones.  Cells are dealt into blocks
    of ``chunk`` vectors, every two of which meet once, each block keeps k rows a vector, and copies
    of a vector are compared once.  A vector is sent to as many meetings as there are blocks, so
    blocks are large (by default an eighth of all, ``MOST_CHUNK`` at most), and tasks compare them piece by piece.  Vectors that are null, empty of length or hold null, NaN or
    infinite components take no part; an id that repeats is several vectors.
    """
    once, members, copies = _distinct(vectors, k)
    n = once.count()
    cells = max(1, math.isqrt(n)) if cells is None else cells
    dealt = _cells(once, cells, probes) if cells > 1 else once.select(F.lit(0).alias("cell"), "v_key", "v")
    dealt = dealt.join(dealt.groupBy("cell").agg(F.count("*").alias("n")), "cell") if cells > 1 else dealt.withColumn("n", F.lit(n))
    chunk = chunk or (max(CHUNK, min(MOST_CHUNK, -(-n // SIDES))) if cells == 1 else MOST_CHUNK >> 2)
    meetings = split_groups(dealt, "cell", "v_key", "n", chunk).select("cell", "lo", "hi", "mine", "v_key", "v")

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        v, key, mine = np.stack(rows["v"]), rows["v_key"].to_numpy(), rows["mine"].to_numpy()
        lo, hi = rows["lo"].iloc[0], rows["hi"].iloc[0]
        low, high = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
        sides = [(low, low)] if lo == hi else [(low, high), (high, low)]
        found = [(key[x[a]], key[y[b]], s) for x, y in sides for a, b, s in _best(v[x], v[y], k, places, lo == hi)]
        return pd.DataFrame({name: np.concatenate([f[c] for f in found]) if found else [] for c, name in enumerate(("v_key", "to", "similarity"))})

    if cells == 1:
        # rows are few against the comparisons, so meetings get a fixed number of partitions; no two vectors meet twice
        sides = max(1, -(-n // chunk))
        met = meetings.repartition(3 * sides * (sides + 1) // 2, "cell", "lo", "hi").groupBy("cell", "lo", "hi").applyInPandas(meet, "v_key long, to long, similarity double")
    else:
        met = meetings.groupBy("cell", "lo", "hi").applyInPandas(meet, "v_key long, to long, similarity double").distinct()
    order = Window.partitionBy("v_key").orderBy(F.desc("similarity"))
    met = met.withColumn("place", F.rank().over(order)).where(F.col("place") <= k).select("v_key", "to", "similarity")
    met = met.unionByName(once.select("v_key", F.col("v_key").alias("to"), F.lit(1.0).alias("similarity")))
    reached = met.join(copies.select(F.col("v_key").alias("to"), F.col("id").alias("other")), "to")
    order = Window.partitionBy("v_key").orderBy(F.desc("similarity"), "other")
    listed = reached.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).select("v_key", "other", "similarity")  # one of them may be the vector itself
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    found = members.join(listed, "v_key").where("id <> other")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("id", "other", "similarity")


def candidate_pairs(members: DataFrame, vectors: DataFrame, k: int = 25, most_groups: int = 300, cells: int | None = None) -> DataFrame:
    """(a, b), a < b: threads that share a rare participant (group_id, member) or are near by their vectors (id, v).

    The pairs with a rare participant are many and come once each as they are; only the near ones are
    looked up, so that a pair of both kinds comes once.
    """
    near = nearest(vectors, k, cells).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    near = staged(near.distinct(), "near")
    rare = rare_members(members, most_groups)
    side = lambda c: rare.select(F.col("group_id").alias(c), "member")
    both = near.join(side("a"), "a").join(side("b"), ["b", "member"], "left_semi").select("a", "b")
    return rare_pairs(members, most_groups).select("a", "b").unionByName(near.join(both, ["a", "b"], "left_anti"))


class _Sets:
    """The distinct values of each row of a list column, as sorted codes."""

    def __init__(self, code: np.ndarray, row: np.ndarray, n: int) -> None:
        self.wide = int(code.max(initial=0)) + 1
        self.keys, self.first = np.unique(row * self.wide + code, return_index=True)
        self.size = np.bincount(self.keys // self.wide, minlength=n)
        self.start = np.cumsum(self.size) - self.size

    def shared(self, a: np.ndarray, b: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        """The number of values, or their weight, that rows a and b have in common."""
        at, pair = _spans(self.start[a], self.size[a])
        asked = b[pair] * self.wide + self.keys[at] % self.wide
        place = np.minimum(np.searchsorted(self.keys, asked), max(len(self.keys) - 1, 0))
        hit = self.keys[place] == asked
        return np.bincount(pair[hit], None if weight is None else weight[self.first[at[hit]]], len(a))


def _listed(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the values of a list column, a null one among them, and their rows; a null list is empty."""
    lists = pa.concat_arrays(column.chunks)
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return lists.flatten().dictionary_encode("encode").indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(lists)), size)


def _similarities(a: np.ndarray, b: np.ndarray, rows: pa.Table) -> Iterator[dict[str, np.ndarray]]:
    """Similarities of the participants, vectors, keywords and links of the rows a and b, some pairs at a time."""
    n = rows.num_rows
    (member, row), (weight, _) = _listed(rows["member"]), _listed(rows["weight"])
    w = pa.concat_arrays(rows["weight"].chunks).flatten().to_numpy(zero_copy_only=False)
    people, own = _Sets(member * (int(weight.max(initial=0)) + 1) + weight, row, n), np.bincount(row, w, n)
    words, links = (_Sets(*_listed(rows[c]), n) for c in ("keywords", "links"))
    lists = pa.concat_arrays(rows["v"].chunks)
    size = pc.fill_null(pc.list_value_length(lists), -1).to_numpy().copy()
    at, row = _spans(np.zeros(n, int), np.maximum(size, 0))
    v = np.zeros((n, int(size.max(initial=0).clip(0))))
    v[row, at] = lists.flatten().to_numpy(zero_copy_only=False)
    gaps = np.unique(row[lists.flatten().is_null().to_numpy(zero_copy_only=False)])
    size[gaps] = -1  # a vector with a null is none
    for lo in range(0, len(a), STRIP * 64):
        x, y = a[lo : lo + STRIP * 64], b[lo : lo + STRIP * 64]
        both, every = people.shared(x, y, w), own[x] + own[y]
        in_words, in_links = words.shared(x, y), links.shared(x, y)
        least, union = np.minimum(words.size[x], words.size[y]), links.size[x] + links.size[y] - in_links
        yield {
            "people": np.nan_to_num(np.divide(both, every - both, out=np.zeros(len(x)), where=every != both)),
            "near": np.where((size[x] == size[y]) & (size[x] >= 0), np.einsum("ij,ij->i", v[x], v[y]), 0.0),
            "words": in_words / np.maximum(least, 1),
            "linked": in_links / np.maximum(union, 1),
        }


def scored_pairs(pairs: DataFrame, features: DataFrame, days: float = 14.0, chunk: int | None = None) -> DataFrame:
    """(a, b, w): similarity of the pairs (a, b) of threads by their features.

    ``features`` are id, participants (array of member and weight, each member once), v (of length
    1), keywords, links (arrays of distinct values), start and end (seconds).  Null arrays count as
    empty; pairs without features are left out.  Pairs are many, so they are shuffled as two ids:
    threads are dealt into blocks of about ``chunk`` (by default an eighth of all, ``MOST_SCORED`` at
    most), every two blocks meet in a task, and that task scores the pairs between them.
    """
    n = features.count()
    blocks = -(-n // (chunk or max(CHUNK, min(MOST_SCORED, -(-n // SIDES))))) or 1
    kind, times = features.schema["id"].dataType, [f"{t}_{c}" for c in "ab" for t in ("start", "end")]
    block = lambda c: F.pmod(F.xxhash64(F.lit(7), c), F.lit(blocks)).cast("int")
    asked = pairs.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"))
    asked = asked.select(F.least(block("a"), block("b")).alias("lo"), F.greatest(block("a"), block("b")).alias("hi"), "a", "b")
    held = [F.transform("participants", lambda p: p["member"]).alias("member"), F.transform("participants", lambda p: p["weight"].cast("double")).alias("weight")]
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    dealt = features.select(block("id").alias("mine"), other, "id", *held, F.transform("v", lambda x: x.cast("double")).alias("v"), "keywords", "links", "start", "end")
    dealt = dealt.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).drop("mine", "other")

    def meet(asked: pa.Table, rows: pa.Table) -> pa.Table:
        ids = rows["id"].unique()
        of = pc.index_in(rows["id"], ids).to_numpy()
        order, count = np.argsort(of, kind="stable"), np.bincount(of, minlength=len(ids))
        start = np.cumsum(count) - count
        a, b = (pc.index_in(asked[c], ids) for c in "ab")
        known = pc.and_(a.is_valid(), b.is_valid())
        a, b = a.filter(known).to_numpy(), b.filter(known).to_numpy()
        at, pair = _spans(start[a], count[a])  # an id that repeats is several threads
        to, again = _spans(start[b[pair]], count[b[pair]])
        a, b = order[at[again]], order[to]
        found = list(_similarities(a, b, rows)) if len(a) else []
        scores = {c: np.concatenate([f[c] for f in found]) if found else np.zeros(0) for c in ("people", "near", "words", "linked")}
        ends = {f"{t}_{c}": rows[t].take(pa.array(side)) for c, side in (("a", a), ("b", b)) for t in ("start", "end")}
        return pa.table({"a": rows["id"].take(pa.array(a)), "b": rows["id"].take(pa.array(b))} | scores | ends)

    spread = 3 * blocks * (blocks + 1) // 2  # a fixed number of partitions: the rows of a meeting are few against its pairs
    schema = f"a {kind.simpleString()}, b {kind.simpleString()}, people double, near double, words double, linked double, " + ", ".join(f"{t} {features.schema[t.split('_')[0]].dataType.simpleString()}" for t in times)
    sides = [df.repartition(spread, "lo", "hi").groupBy("lo", "hi") for df in (asked, dealt)]
    met = sides[0].cogroup(sides[1]).applyInArrow(meet, schema)
    time = F.coalesce(S.temporal_affinity(F.col("start_a"), F.col("end_a"), F.col("start_b"), F.col("end_b"), days), F.lit(0.0))
    return met.select("a", "b", thread_similarity(F.col("people"), F.col("near"), F.col("words"), time, F.col("linked")).alias("w"))


def thread_graph(members: DataFrame, features: DataFrame, k: int = 25, least: float = 0.45, most_edges: int = 15, cells: int | None = None) -> DataFrame:
    """Edges (a, b, w) between similar threads: candidates, their similarity, the heaviest of either end."""
    features = staged(features, "features")
    pairs = candidate_pairs(members, features.select("id", "v"), k, cells=cells)
    return similarity_graph(scored_pairs(pairs, features), least, most_edges)

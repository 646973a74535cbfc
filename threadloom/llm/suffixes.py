"""Exact substring dedup with suffix arrays.

Equal strings of LENGTH bytes contain the same anchor: the byte gram with the smallest hash among
the grams of the string.  So equal strings can only meet in the contexts of equal anchors, and
everything else is left out before any sorting.  Equal contexts are one row with a count.  The
contexts of anchors that have several different ones are dealt to shards of bounded size; each shard
sorts its suffixes by Larsson-Sadakane refinement and Kasai's common prefixes tell equal strings.  The
shards of one very common anchor are sorted once, stored, and merged pair by pair with binary searches.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import SLICE_BYTES, U64, map_sorted, mix, powers, prefix_hash, slices, span_hash, text_buffer

#: Bytes of a string, bytes of the grams that anchors are chosen from
LENGTH, GRAM = 200, 24
#: Bytes of contexts in a shard on average; contexts of one anchor that one shard may hold
SHARD_BYTES, SHARD_CONTEXTS = 1 << 21, 2_048
#: Bits of a position: a string column holds less than 2 GiB
_AT_BITS = U64(31)


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all strings of ``length`` bytes, begin and end of the strings that share each, the data's prefix hashes."""
    prefix = prefix_hash(data)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, prefix
    gram = mix((prefix[GRAM:] - prefix[:-GRAM]) * powers(len(data))[1][: len(prefix) - GRAM])
    least = (gram >> _AT_BITS << _AT_BITS) | np.arange(len(gram), dtype=U64)
    width, target = 1, length - GRAM + 1
    while 2 * width <= target:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < target:
        least = np.minimum(least[: len(least) - (target - width)], least[target - width :])
    ends = np.zeros(len(data) + 1, np.int32)  # strings begin in [offset, end - length]
    long = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(ends, offsets[long], 1)
    np.add.at(ends, offsets[long + 1] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(ends[: len(least)]) > 0)
    at = (least[start] & ((U64(1) << _AT_BITS) - U64(1))).astype(np.int64)
    if not len(at):
        return none, none, none, prefix
    head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[head], start[head], start[np.append(head[1:], len(at)) - 1] + length, prefix


def windows(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row, from, to): bytes to look at together; long texts in parts that share length-1 bytes."""
    for lo, hi in slices(offsets):
        low, high = int(offsets[lo]), int(offsets[hi])
        if hi - lo > 1 or high - low <= 2 * SLICE_BYTES:
            yield lo, hi, low, high
        else:
            for at in range(low, high - length + 1, SLICE_BYTES):
                yield lo, hi, at, min(high, at + SLICE_BYTES + length - 1)


def anchors(text: str | Column = "text", length: int = LENGTH) -> Column:
    """Array of a text's anchors: hashes of gram and context, first byte and bytes of the context.

    The context is what the strings with this anchor cover.
    """

    @F.arrow_udf("array<struct<anchor: bigint, context: bigint, start: int, size: int>>")
    def substring_anchors(column: pa.Array) -> pa.Array:
        data, offsets = text_buffer(column)
        parts, counts = [], np.zeros(len(column), np.int64)
        for lo, hi, low, high in windows(offsets, length):
            part = np.clip(offsets[lo : hi + 1], low, high) - low
            at, start, end, prefix = anchor_runs(data[low:high], part, length)
            text = np.searchsorted(part, at, "right") - 1
            gram = span_hash(prefix, at, at + GRAM)
            # the place of the gram in its context counts
            context = mix(span_hash(prefix, start, end) + (at - start).astype(U64) * U64(0x9E3779B97F4A7C15) + (end - start).astype(U64))
            parts.append((gram.view(np.int64), context.view(np.int64), start + low - offsets[lo + text], end - start))
            np.add.at(counts, lo + text, 1)
        fields = ["anchor", "context", "start", "size"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(4)]
        rows = pa.StructArray.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds)], fields)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), rows)

    return substring_anchors(text)


def pieces(text: str | Column, start: Column, size: Column) -> Column:
    """The byte strings of a text that begin at ``start`` and have ``size`` bytes (arrays)."""

    @F.arrow_udf("array<binary>")
    def substring_pieces(column: pa.Array, starts: pa.Array, sizes: pa.Array) -> pa.Array:
        data, offsets = text_buffer(column)
        out = []
        for i, (s, n) in enumerate(zip(starts.to_pylist(), sizes.to_pylist())):
            raw = data[offsets[i] : offsets[i + 1]].tobytes()
            out.append([raw[a : a + b] for a, b in zip(s, n)])
        return pa.array(out, pa.list_(pa.binary()))

    return substring_pieces(text, start, size)


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``data`` (padded by 8 bytes) sorted by their first ``depth`` bytes at least.

    Larsson-Sadakane: sort by 8 bytes, then refine only groups that are still equal, using the
    ranks of the suffixes h bytes later, with h doubling.
    """
    n = len(data) - 8
    key = np.zeros(n, U64)
    for k in range(8):
        key |= data[k : k + n].astype(U64) << U64(56 - 8 * k)
    order = np.argsort(key)
    ranked = key[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    h = 8
    rank = np.zeros(n + depth + 8, np.int64)
    while True:
        group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[order] = group + 1
        single = head & np.concatenate([head[1:], [True]])
        left = np.flatnonzero(~single)
        if h >= depth or not len(left):
            return order
        pair = (group[left].astype(U64) << U64(32)) | rank[order[left] + h].astype(U64)
        by = np.argsort(pair)
        order[left] = order[left][by]
        pair = pair[by]
        head[left[1:]] = pair[1:] != pair[:-1]
        h *= 2


def common_prefixes(data: np.ndarray, borders: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place of ``order`` the bytes shared with the suffix before it, ``length`` at most.

    Kasai's walk, for all contexts at once: a suffix shares at least one byte less than the suffix
    one byte before it did.  (After a value cut at ``length`` the walk starts afresh, because order
    beyond the sorted depth is open.)
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    shared = np.zeros(len(borders) - 1, np.int64)
    sizes = np.diff(borders)
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    word = np.zeros(len(padded) - 8, U64)
    for k in range(8):
        word |= padded[k : k + len(word)].astype(U64) << U64(8 * k)
    for step in range(int(sizes.max(initial=0))):
        live = np.flatnonzero(sizes > step)
        p = borders[live] + step
        q = before[p]
        run = np.where((shared[live] >= length) | (q < 0), 0, np.maximum(shared[live] - 1, 0))
        todo = np.flatnonzero(q >= 0)
        while len(todo):
            differ = word[p[todo] + run[todo]] ^ word[q[todo] + run[todo]]
            equal = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + U64(1))) - U64(1)).astype(np.int64) >> 3)
            run[todo] += equal
            todo = todo[(equal == 8) & (run[todo] < length)]
        run = np.minimum(run, length)
        shared[live] = run
        out[p] = run
    return out[order]


class Shard:
    """Suffix array of some contexts and their groups of equal strings."""

    def __init__(self, contexts: list[bytes], ids: np.ndarray, length: int = LENGTH):
        raw = np.frombuffer(b"".join(contexts), np.uint8)
        self.length, self.data = length, np.concatenate([raw, np.zeros(length + 8, np.uint8)])
        self.borders = np.concatenate([[0], np.cumsum([len(c) for c in contexts])]).astype(np.int64)
        # sorted and compared beyond the longest context, so that Kasai's walk hardly ever starts afresh
        order = suffix_order(self.data[: len(raw) + 8], 2 * length)
        same = common_prefixes(raw, self.borders, order, 2 * length) >= length
        of = np.searchsorted(self.borders, order, "right") - 1
        inside = order + length <= self.borders[of + 1]
        group = np.cumsum(~same)[inside]
        self.at, of = order[inside], of[inside]
        place = ids[of] + (self.at - self.borders[of]).astype(U64)  # where the string stands in its text
        self.first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        self.group = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)])) if len(group) else group
        self.low = np.minimum.reduceat(place, self.first) if len(group) else place
        self.high = np.maximum.reduceat(place, self.first) if len(group) else place

    @classmethod
    def again(cls, state: dict) -> "Shard":
        """A stored shard, without sorting."""
        out = cls.__new__(cls)
        vars(out).update(state)
        return out

    def words(self, groups: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k+7 of the groups' strings as numbers in byte order."""
        at = self.at[self.first[groups]] + 8 * k
        out = np.zeros(len(at), U64)
        for i in range(min(8, self.length - 8 * k)):
            out |= self.data[at + i].astype(U64) << U64(56 - 8 * i)
        return out

    def compare(self, own: np.ndarray, other: "Shard", theirs: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the own strings are less than, equal to or greater than the other shard's."""
        out, todo = np.zeros(len(own), np.int64), np.arange(len(own))
        for k in range(-(-self.length // 8)):
            if not len(todo):
                break
            a, b = self.words(own[todo], k), other.words(theirs[todo], k)
            out[todo] = (a > b).astype(np.int64) - (a < b)
            todo = todo[a == b]
        return out

    def meet(self, other: "Shard") -> tuple[np.ndarray, np.ndarray]:
        """Pairs of groups (own, other's) with equal strings, by binary search."""
        low, high = np.zeros(len(other.first), np.int64), np.full(len(other.first), len(self.first), np.int64)
        mine = np.arange(len(other.first))
        while (low < high).any():
            open_ = np.flatnonzero(low < high)
            middle = (low[open_] + high[open_]) // 2
            less = self.compare(middle, other, mine[open_]) < 0
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)
        there = np.flatnonzero(low < len(self.first))
        there = there[self.compare(low[there], other, there) == 0]
        return low[there], there

    def runs(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, from, to): bytes covered by the strings of ``groups`` (a mask)."""
        change = np.zeros(len(self.data) + 1, np.int64)
        start = self.at[groups[self.group]] if len(self.at) else self.at
        np.add.at(change, start, 1)
        np.add.at(change, start + self.length, -1)
        covered = np.concatenate([[False], np.cumsum(change)[: self.borders[-1]] > 0, [False]])
        edge = covered[1:] != covered[:-1]
        cut = self.borders[1:-1]
        cut = cut[covered[1:-1][cut] & covered[1:-1][cut - 1]]
        begin = np.union1d(np.flatnonzero(edge & covered[1:]), cut)
        end = np.union1d(np.flatnonzero(edge & covered[:-1]), cut)
        of = np.searchsorted(self.borders, begin, "right") - 1
        return of, begin - self.borders[of], end - self.borders[of]


def place_ids(text_key: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix(text_key.view(U64)) + start.astype(U64)


def matches(contexts: DataFrame, length: int, shard_bytes: int, shard_contexts: int) -> DataFrame:
    """(anchor, context, from, to): covered runs of contexts (anchor, context, n, text_key, start, size, bytes)."""
    size = contexts.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-int(size) // shard_bytes))
    hot = F.col("n") > shard_contexts
    dealt = (
        contexts.withColumn("hot", hot)
        .withColumn("shard", F.when(hot, F.col("anchor")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards))))
        .withColumn("chunks", F.ceil(F.col("n") / shard_contexts).cast("int"))
        .withColumn("chunk", F.when(hot, F.pmod(F.xxhash64("context"), F.col("chunks"))).otherwise(0).cast("int"))
    )

    def sort(rows: dict[str, np.ndarray], cuts: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            shard = Shard(list(rows["bytes"][lo:hi]), place_ids(rows["text_key"][lo:hi], rows["start"][lo:hi]), length)
            of, begin, end = shard.runs(shard.low != shard.high)
            blank = np.zeros(len(of), np.int32)
            yield {"anchor": rows["anchor"][lo + of], "context": rows["context"][lo + of], "from": begin, "to": end, "chunk": blank, "chunks": blank, "stored": np.full(len(of), None)}
            if rows["hot"][lo]:
                own = {k: rows[k][lo : lo + 1] for k in ("anchor", "context", "chunk", "chunks")}
                yield own | {"from": np.zeros(1, int), "to": np.zeros(1, int), "stored": np.array([pickle.dumps((rows["context"][lo:hi], vars(shard)), 5)], object)}

    columns = ["shard", "hot", "chunk", "chunks", "anchor", "context", "text_key", "start", "bytes"]
    kinds = "anchor long, context long, from int, to int"
    done = staged(map_sorted(dealt.select(*columns), ["shard", "hot", "chunk"], sort, f"{kinds}, chunk int, chunks int, stored binary"), "sorted")
    stored = done.where("stored is not null").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("other <> chunk")
    stored = stored.select("anchor", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "stored")

    def meet(pair: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"anchor": [], "context": [], "from": [], "to": []}, dtype=np.int64)]
        if len(pair) == 2:
            (left, a), (right, b) = ((context, Shard.again(state)) for context, state in map(pickle.loads, pair.sort_values("chunk")["stored"]))
            i, j = a.meet(b)
            apart = np.minimum(a.low[i], b.low[j]) != np.maximum(a.high[i], b.high[j])
            for context, shard, groups in ((left, a, i[apart]), (right, b, j[apart])):
                mask = np.zeros(len(shard.first), bool)
                mask[groups] = True
                of, begin, end = shard.runs(mask)
                out.append(pd.DataFrame({"anchor": pair["anchor"].iloc[0], "context": context[of], "from": begin, "to": end}))
        return pd.concat(out)

    merged = stored.groupBy("anchor", "lo", "hi").applyInPandas(meet, kinds)
    return done.where("stored is null").select("anchor", "context", "from", "to").unionByName(merged)


def trimmed(text: str | Column, runs: Column) -> Column:
    """Struct (removed, spans, kept) of a text without the bytes in ``runs`` (array of from, to)."""

    @F.arrow_udf("struct<removed: bigint, spans: bigint, kept: binary>")
    def substring_trim(column: pa.Array, covered: pa.Array) -> pa.Array:
        data, offsets = text_buffer(column)
        removed, spans, kept = [], [], []
        for i, pairs in enumerate(covered.to_pylist()):
            raw = data[offsets[i] : offsets[i + 1]]
            change = np.zeros(len(raw) + 2, np.int64)
            if pairs:
                np.add.at(change, [p["from"] + 1 for p in pairs], 1)
                np.add.at(change, [p["to"] + 1 for p in pairs], -1)
            gone = np.cumsum(change)[: len(raw) + 1] > 0
            removed.append(int(gone.sum()))
            spans.append(int((gone[1:] & ~gone[:-1]).sum()))
            kept.append(raw[~gone[1:]].tobytes())
        return pa.StructArray.from_arrays([pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["removed", "spans", "kept"])

    return substring_trim(text, runs)


def dedup_substrings(df: DataFrame, text: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """All rows of ``df`` with ``sd_bytes``, ``sd_removed``, ``sd_spans`` and ``sd_kept``.

    Texts are UTF-8 bytes; each byte covered by a string of ``length`` bytes that also starts
    anywhere else, in the same row too, is removed.  ``sd_spans`` counts maximal removed runs and
    ``sd_kept`` is what remains (bytes: a cut may split a character).  Null texts count as empty;
    texts shorter than ``length`` stay whole; repeated rows are occurrences of each other; an empty
    table gives no rows.  Texts are told apart by a 64-bit hash, contexts of an anchor by another.
    Very long texts are searched in parts.  Columns of ``df`` keep their values whatever their
    names, but for those four.
    """
    own = [c for c in df.columns if c not in ("sd_bytes", "sd_removed", "sd_spans", "sd_kept")]
    docs = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("input"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    found = docs.where(F.octet_length("text") >= length).select("text_key", F.explode(anchors("text", length)).alias("a")).select("text_key", "a.*")
    found = staged(found, "anchors")
    place = F.struct("text_key", "start", "size")
    by_context = found.groupBy("anchor", "context").agg(F.count("*").alias("times"), F.min(place).alias("one"))
    by_anchor = by_context.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("times").alias("total")).where("total > 1")
    contexts = staged(by_context.join(by_anchor.select("anchor", "n"), "anchor").select("anchor", "context", "times", "n", "one.*"), "contexts")
    several = contexts.where("n > 1").groupBy("text_key").agg(F.collect_list(F.struct("anchor", "context", "n", "start", "size")).alias("list"))
    texts = docs.select("text_key", "text").join(several.select("text_key"), "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    cut = several.join(texts, "text_key").select("text_key", "list", pieces("text", F.col("list.start"), F.col("list.size")).alias("bytes"))
    cut = cut.select("text_key", F.explode(F.arrays_zip("list", "bytes")).alias("x")).select("text_key", "x.list.*", "x.bytes")
    cut = staged(cut, "pieces")
    runs = matches(cut, length, shard_bytes, shard_contexts)
    whole_runs = contexts.where("times > 1").select("anchor", "context", F.lit(0).alias("from"), F.col("size").alias("to"))
    covered = staged(runs.unionByName(whole_runs).groupBy("anchor", "context").agg(F.collect_set(F.struct("from", "to")).alias("runs")), "runs")
    spots = found.join(covered, ["anchor", "context"]).select("text_key", F.explode("runs").alias("run"), "start")
    spots = spots.select("text_key", F.struct((F.col("start") + F.col("run.from")).alias("from"), (F.col("start") + F.col("run.to")).alias("to")).alias("run"))
    per_text = spots.groupBy("text_key").agg(F.collect_set("run").alias("runs"))
    rows = docs.join(per_text, "text_key", "left")
    rows = rows.withColumn("cut", F.when(F.col("runs").isNotNull(), trimmed("text", F.coalesce("runs", F.array()))))
    return rows.select(
        *[F.col("input").getField(c).alias(c) for c in own],
        F.octet_length("text").cast("long").alias("sd_bytes"),
        F.coalesce("cut.removed", F.lit(0).cast("long")).alias("sd_removed"),
        F.coalesce("cut.spans", F.lit(0).cast("long")).alias("sd_spans"),
        F.coalesce("cut.kept", F.col("text").cast("binary")).alias("sd_kept"),
    )

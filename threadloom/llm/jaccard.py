"""N-gram Jaccard join with Bayesian pruning of candidate pairs.

Texts become sets of word 5-grams; texts with the same set are one node.  MinHash bands propose
candidates.  Of a candidate pair the MinHash values are compared a few at a time, and the pair is
dropped once the posterior probability that its similarity reaches the threshold is below the
tolerance.  What survives is gathered into groups, whose pairs are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.groups import split_groups
from ..session import staged
from .common import SLICE_BYTES, U64, map_sorted, merge_labels, mix, shingles, slices, text_buffer, within_pairs

#: Words of an n-gram, similarity from which texts are linked
NGRAM, THRESHOLD = 5, 0.8
#: MinHash values of 16 bits, values in a band (24 bands: a pair at 0.8 is proposed all but 3e-6 of times)
HASHES, BAND = 96, 4
#: MinHash values compared at a time; posterior probability below which a pair is dropped
STEP, TOLERANCE = 16, 1e-6
#: Members of a bucket or group that meet in one task; larger ones are split into pairs of chunks
CHUNK = 256
#: Columns of the incidence matrix multiplied at once
COLUMNS = 16_384


def minhash(values: np.ndarray, borders: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """(texts, hashes) of 16 bits; rows of texts without n-grams are zero."""
    rng = np.random.default_rng(5)
    factors, flips = rng.integers(0, 1 << 63, hashes, np.uint64) * U64(2) + U64(1), rng.integers(0, 1 << 63, hashes, np.uint64)
    some = np.flatnonzero(np.diff(borders))
    out = np.zeros((len(borders) - 1, hashes), np.uint16)
    if len(some):
        for k in range(hashes):
            least = np.minimum.reduceat((values ^ flips[k]) * factors[k], borders[some])
            out[some, k] = mix(least) >> U64(48)
    return out


def sketch(text: str | Column = "text", ngram: int = NGRAM, hashes: int = HASHES) -> Column:
    """Struct (node, grams, signature): a hash of the set of n-grams, its size, its MinHash values."""

    @F.arrow_udf("struct<node: bigint, grams: int, signature: binary>")
    def jaccard_sketch(column: pa.Array) -> pa.Array:
        data, offsets = text_buffer(column)
        node, count, sig = np.zeros(len(column), np.int64), np.zeros(len(column), np.int32), np.zeros((len(column), hashes), np.uint16)
        for lo, hi in slices(offsets, SLICE_BYTES >> 1):
            part = offsets[lo : hi + 1]
            values, borders = shingles(data[part[0] : part[-1]], part - part[0], ngram)
            sig[lo:hi] = minhash(values, borders, hashes)
            for t in range(hi - lo):
                own = np.unique(values[borders[t] : borders[t + 1]])
                count[lo + t] = len(own)
                node[lo + t] = mix(own).sum(dtype=U64).view(np.int64)
        raw = sig.tobytes()
        width = 2 * hashes
        return pa.StructArray.from_arrays(
            [pa.array(node), pa.array(count), pa.array([raw[i * width : (i + 1) * width] for i in range(len(column))], pa.binary())], ["node", "grams", "signature"]
        )

    return jaccard_sketch(text)


def gram_set(text: str | Column = "text", ngram: int = NGRAM) -> Column:
    """The sorted distinct n-gram hashes of a text, 8 bytes each."""

    @F.arrow_udf("binary")
    def jaccard_set(column: pa.Array) -> pa.Array:
        data, offsets = text_buffer(column)
        out: list[bytes] = []
        for lo, hi in slices(offsets):
            part = offsets[lo : hi + 1]
            values, borders = shingles(data[part[0] : part[-1]], part - part[0], ngram)
            out += [np.unique(values[borders[t] : borders[t + 1]]).tobytes() for t in range(hi - lo)]
        return pa.array(out, pa.binary())

    return jaccard_set(text)


def least_matches(threshold: float, tolerance: float, step: int = STEP, hashes: int = HASHES) -> dict[int, int]:
    """Compared values -> fewest matches with which a pair stays.

    With a uniform prior the posterior of the similarity after m matches of n is Beta(m+1, n-m+1),
    and P(similarity >= t) equals P(Binomial(n+1, t) <= m).
    """
    out = {}
    for n in range(step, hashes + 1, step):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                out[n] = m
                break
    return out


def surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which pairs of rows of ``sig`` are still likely after each step of the comparison."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, need in least.items():
        matches = matches + (sig[a[alive], done:n] == sig[b[alive], done:n]).sum(axis=1)
        keep = matches >= need
        alive, matches, done = alive[keep], matches[keep], n
    return alive


def signature_rows(column: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), -1)


def candidate_edges(reps: DataFrame, threshold: float, tolerance: float, chunk: int) -> DataFrame:
    """Spanning edges (a, b) of the pairs that share a band and survive the Bayesian pruning."""
    least = least_matches(threshold, tolerance)
    width = 2 * BAND
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("signature", k * width + 1, width)) for k in range(HASHES // BAND)])
    bands = reps.select("node", F.explode(keys).alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = bands.join(shared, "band").join(reps.select("node", "signature"), "node")
    dealt = split_groups(members, "band", "node", "n", chunk)

    def prune(rows: dict[str, np.ndarray], cuts: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        sig, node, mine = signature_rows(rows["signature"]), rows["node"], rows["mine"]
        across = rows["lo"] != rows["hi"]
        none = np.zeros((2, 0), np.int64)
        known, new = [none], [none]
        for x, y in within_pairs(cuts):
            alive = surviving(sig, x, y, least)
            x, y = x[alive], y[alive]
            met = across[x] & (mine[x] == mine[y])  # the chunk's own meeting emits these
            known.append(np.stack([x[met], y[met]]))
            new.append(np.stack([x[~met], y[~met]]))
        base = merge_labels(len(node), *np.concatenate(known, axis=1))
        label = merge_labels(len(node), *base[np.concatenate(new, axis=1)])
        linked = np.flatnonzero(label != np.arange(len(node)))  # one edge a joined part, not one a member
        pairs = np.unique(np.stack([node[label[linked]], node[linked]], 1), axis=0)
        yield {"a": pairs[:, 0], "b": pairs[:, 1]}

    return map_sorted(dealt.select("band", "lo", "hi", "mine", "node", "signature"), ["band", "lo", "hi"], prune, "a long, b long").distinct()


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets."""
    if len(a) < 2 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)], np.int64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.zeros(len(a), np.int64)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for lo in range(0, len(values), COLUMNS):
        s, e = np.searchsorted(column, [lo, lo + COLUMNS])
        block = np.zeros((len(sets), min(COLUMNS, len(values) - lo)), np.float32)
        block[row[s:e], column[s:e] - lo] = 1
        out += np.rint((block @ block.T)[a, b]).astype(np.int64)
    return out


def verified_links(groups: DataFrame, threshold: float, tolerance: float, chunk: int) -> DataFrame:
    """(node, links, to): copies of the texts each node is linked to, and links that join its class.

    ``groups`` has component, node, n (members of the component), copies, signature and grams_set.
    """
    least = least_matches(threshold, tolerance)
    dealt = split_groups(groups, "component", "node", "n", chunk)

    def verify(rows: dict[str, np.ndarray], cuts: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        sig, node, copies = signature_rows(rows["signature"]), rows["node"], rows["copies"]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            sets = [np.frombuffer(x, U64) for x in rows["grams_set"][lo:hi]]
            size = np.array([len(s) for s in sets])
            links, a, b = np.zeros(hi - lo, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x, y in within_pairs(np.array([0, hi - lo]), rows["mine"][lo:hi], 65_536):
                alive = surviving(sig[lo:hi], x, y, least)
                x, y = x[alive], y[alive]
                both = overlaps(sets, x, y) if len(x) else np.zeros(0, np.int64)
                good = both >= threshold * (size[x] + size[y] - both) - 1e-9
                a.append(x[good])
                b.append(y[good])
            x, y = np.concatenate(a), np.concatenate(b)
            np.add.at(links, x, copies[lo:hi][y])
            np.add.at(links, y, copies[lo:hi][x])
            label = merge_labels(hi - lo, x, y)
            some = np.flatnonzero(links)
            yield {"node": node[lo:hi][some], "links": links[some], "to": node[lo:hi][label[some]]}

    columns = ["component", "lo", "hi", "mine", "node", "copies", "signature", "grams_set"]
    return map_sorted(dealt.select(*columns), ["component", "lo", "hi"], verify, "node long, links long, to long")


def jaccard_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, chunk: int = CHUNK) -> DataFrame:
    """All rows of ``df`` as (doc_id, jc_key, class_id, jc_class, links).

    Two rows are linked if the Jaccard similarity of their sets of word 5-grams is at least
    ``threshold``; ``links`` is the number of other rows a row is linked to, and a class is a
    connected group, named by its smallest id.  ``jc_key`` is a hash of the
    text, ``jc_class`` one of the class.  A text of fewer
    than five words is one n-gram; null texts and texts without words are linked to nothing and
    their own id names their class.  Rows with null ids count like others and name a class only if
    it has no other id.  Repeated rows are copies.  An empty table gives no rows.

    Equal sets are one node (64 bits of hash) before any pair is formed, so groups of copies cost
    one row.  Buckets and groups larger than ``chunk`` are split into pairs of chunks.
    """
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    base = staged(docs.select("doc_id", key.alias("jc_key"), sketch("text").alias("s")).select("doc_id", "jc_key", "s.*"), "sketch")
    reps = base.where("grams > 0").groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.min(F.struct("jc_key", "signature")).alias("one"))
    reps = staged(reps.select("node", "copies", "first_id", "one.jc_key", "one.signature"), "nodes")
    near = connected_components(candidate_edges(reps, threshold, tolerance, chunk))
    sizes = near.groupBy("component").agg(F.count("*").alias("n"))
    wanted = near.join(sizes, "component").join(reps, "node").select("component", "n", "node", "copies", "signature", "jc_key")
    texts = docs.select(key.alias("jc_key"), "text").join(wanted.select("jc_key"), "jc_key", "left_semi").groupBy("jc_key").agg(F.min("text").alias("text"))
    groups = wanted.join(texts.select("jc_key", gram_set("text").alias("grams_set")), "jc_key")
    found = staged(verified_links(groups, threshold, tolerance, chunk), "links")
    classes = connected_components(found.select("node", "to"), "node", "to")
    info = found.groupBy("node").agg(F.sum("links").alias("links")).join(classes, "node")
    names = info.join(reps.select("node", "first_id"), "node").groupBy("component").agg(F.min("first_id").alias("class_first"))
    info = info.join(names, "component").select("node", "links", "class_first", "component")
    all_nodes = reps.select("node", "copies", "first_id").join(info, "node", "left")
    all_nodes = all_nodes.select("node", F.when(F.col("component").isNull(), F.col("first_id")).otherwise(F.col("class_first")).alias("class_id"), F.coalesce("component", "node").alias("jc_class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    empty = base.where("grams = 0").select("doc_id", "jc_key", F.col("doc_id").alias("class_id"), F.lit(None).cast("long").alias("jc_class"), F.lit(0).cast("long").alias("links"))
    return base.where("grams > 0").join(all_nodes, "node").select("doc_id", "jc_key", "class_id", "jc_class", "links").unionByName(empty)


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class of near copies, with the columns of ``df``, whatever their names.

    The row with the smallest id stays (then of the smallest text hash, then any of equal rows).
    Rows linked to nothing all stay, so rows with null, empty or blank texts do; an empty table
    gives no rows.
    """
    classes = jaccard_classes(df, doc_id, text, **options)
    alone = classes.where("links = 0").select("doc_id", "jc_key", F.lit(True).alias("alone")).distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "jc_key")).alias("first")
    head = classes.where("links > 0").groupBy("jc_class").agg(first).select("first.doc_id", "first.jc_key", F.lit(False).alias("alone"))
    stay = alone.unionByName(head).select(F.col("doc_id").alias("id"), F.col("jc_key").alias("key"), "alone")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("input"), F.col(f"`{doc_id}`").alias("own_id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("own_key"))
    kept = rows.join(stay, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")))
    once = kept.where("not alone").dropDuplicates(["id", "key"])
    return kept.where("alone").select("input").unionByName(once.select("input")).select(*[F.col("input").getField(c).alias(c) for c in df.columns])

"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact check.

The CGK random walk turns a word sequence into a longer one in such a way that few edits change few
of its places.  Sampling a few places gives a hash; repeated with fresh walks until simulated
windows at the largest allowed distance are found with the target recall.  Windows whose words can
share enough word pairs with some item (a necessary condition for the edit distance, so nothing is
lost) are hashed, and whatever meets an item is verified by exact edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import U64, mix, prefix_hash, slices, span_hash, text_buffer, words

#: Edit similarity (1 - distance / words of the item) from which a passage counts as the item
THRESHOLD = 0.8
#: Shorter items take no part: they are ordinary phrases
LEAST_WORDS = 5
#: Sampled places per hash, recall aimed at for a window at the largest distance, repetitions tried
#: first (doubled until the recall is reached), most repetitions, simulated windows
SAMPLES, RECALL, REPEATS, MOST_REPEATS, TRIALS = 2, 0.99, 96, 6144, 400
#: UTF-8 bytes of items that one pass holds; more items take more passes
PASS_BYTES = 16_000_000
_OUT = "array<struct<item_id: bigint, distance: int, similarity: double, word: int>>"
#: A word of a passage: ASCII letters (as lower case), digits and anything beyond ASCII
BREAKS = np.array([not (chr(c).isalnum() or c > 127) for c in range(256)])
LOWER = np.array([ord(chr(c).lower()) if c < 128 else c for c in range(256)], np.uint8)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the texts' borders among them."""
    low = LOWER[data]
    start, end, first = words(low, offsets, BREAKS)
    return span_hash(prefix_hash(low), start, end), first


def most_edits(n: int, threshold: float) -> int:
    return int((1 - threshold) * n + 1e-9)


def length_classes(longest: int) -> list[int]:
    """Window lengths, each about an eighth above the one before."""
    out = [LEAST_WORDS]
    while out[-1] < longest:
        out.append(max(out[-1] + 1, out[-1] * 9 // 8))
    return out


def cgk_hashes(symbols: np.ndarray, start: np.ndarray, length: int, times: int, samples: int = SAMPLES) -> np.ndarray:
    """(times, windows): hashes of sampled places of CGK embeddings of symbols[start:start+length].

    Every repetition has a walk and places of its own; the first ones are the same for any ``times``.
    """
    rng = np.random.default_rng(length)
    steps = max(samples, 2 * length - 2)
    drawn = [(np.sort(rng.choice(steps, samples, replace=False)), rng.integers(0, 1 << 62, steps, np.uint64) * U64(2) + U64(1)) for _ in range(times)]
    places, factors = np.stack([p for p, _ in drawn]), np.stack([f for _, f in drawn])
    at = np.broadcast_to(start, (times, len(start))).copy()
    out = np.repeat(U64(length << 16) + np.arange(times, dtype=U64), len(start)).reshape(times, -1)
    for t in range(int(places.max()) + 1):
        symbol = symbols[np.minimum(at, len(symbols) - 1)]
        if t >= length:
            symbol[at >= start + length] = 0
        rows = np.flatnonzero((places == t).any(axis=1))
        out[rows] = mix(out[rows] * U64(0x9E3779B97F4A7C15) + symbol[rows])
        at += ((symbol * factors[:, t, None]) >> U64(63)).astype(np.int64)
    return out


def repeats(length: int, threshold: float, recall: float = RECALL, longest: int | None = None) -> int:
    """Repetitions with which simulated windows at the largest distance are found.

    The items have ``longest`` words and edits for that, of which the window of ``length`` words may
    hold all.  Edits anywhere and other words in front each have to reach the recall.
    """
    rng = np.random.default_rng(length)
    longest = longest or length
    edits = most_edits(longest, threshold)
    whole = rng.integers(1, 1 << 62, (TRIALS, longest), np.uint64)
    changed = []
    for trial, row in enumerate(whole):
        row = list(row)
        for k in range(edits):
            kind, i = rng.integers(3), int(rng.integers(len(row)))
            new = int(rng.integers(1, 1 << 62))
            if trial % 2:
                row[k] = new
            elif kind == 0:
                row[i] = new
            elif kind == 1 and len(row) > 1:
                del row[i]
            else:
                row.insert(i, new)
        changed.append((row + [int(x) for x in rng.integers(1, 1 << 62, length)])[:length])
    both = np.concatenate([whole[:, :length].ravel(), np.array(changed, np.uint64).ravel()])
    start, times = np.arange(2 * TRIALS) * length, REPEATS
    while times <= MOST_REPEATS:
        h = cgk_hashes(both, start, length, times)
        met = np.logical_or.accumulate(h[:, :TRIALS] == h[:, TRIALS:], axis=0)
        found = np.minimum(met[:, ::2].mean(axis=1), met[:, 1::2].mean(axis=1)) >= recall
        if found.any():
            return int(found.argmax()) + 1
        times *= 2
    raise ValueError(f"no {MOST_REPEATS} repetitions find items of {longest} words with recall {recall}")


@dataclass
class Index:
    ids: list[int | None]
    symbols: np.ndarray
    first: np.ndarray
    classes: list[tuple[int, int, int, int, int, int]]  # window length, repetitions, run length, least runs, span, words before a run
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # run length -> first bits seen, sorted hashes, bit set of classes
    keys: np.ndarray  # sorted hashes of the items' windows
    owners: np.ndarray


def run_hashes(symbols: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words at each word; zero where a run would leave its text."""
    out = symbols.copy()
    for k in range(1, size):
        out[:-k] = mix(out[:-k] * U64(0x9E3779B97F4A7C15) + symbols[k:])
    for k in range(1, size):
        cut = first[1:] - k
        out[cut[cut >= first[:-1]]] = 0
    return out


def build_index(ids: list[int | None], texts: list[str | None], threshold: float = THRESHOLD) -> Index:
    symbols, first = tokens(*text_buffer(pa.array(texts, pa.string())))
    size = np.diff(first)
    lengths = length_classes(int(size.max(initial=LEAST_WORDS)))
    of = np.searchsorted(lengths, size, "right") - 1
    classes, keys, owners, marks = [], [], [], {2: [], 3: []}
    runs = {q: run_hashes(symbols, first, q) for q in marks}
    for c, length in enumerate(lengths):
        items = np.flatnonzero((of == c) & (size >= LEAST_WORDS))
        if not len(items):
            continue
        n = repeats(length, threshold, longest=int(size[items].max()))
        edits = [most_edits(int(s), threshold) for s in size[items]]
        # an edit breaks at most q runs of q words, so a passage within the distance keeps this many
        least = {q: min(int(s) - (q - 1) - q * e for s, e in zip(size[items], edits)) for q in marks}
        q = 3 if least[3] >= 3 else 2
        span = max(int(s) + e - (q - 1) for s, e in zip(size[items], edits))
        bit = U64(1) << U64(len(classes) % 64)
        for t in items:
            own = runs[q][first[t] : first[t + 1]]
            marks[q].append((own, np.full(len(own), bit)))
        # each edit can break up to q words of common runs before the first that stays
        if least[q] < 1:
            raise ValueError(f"at edit similarity {threshold} an item of {length} words may share no {q} words in a row with its passage")
        classes.append((length, n, q, least[q], span, q * max(edits)))
        keys.append(cgk_hashes(symbols, first[items], length, n).ravel())
        owners.append(np.tile(items, n))
    key, owner = (np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, U64), np.zeros(0, np.int64))
    order = np.argsort(key, kind="stable")
    tables = {}
    for q, parts in marks.items():
        if parts:
            values, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            bits = np.zeros(len(values), U64)
            np.bitwise_or.at(bits, back, np.concatenate([p[1] for p in parts]))
            bits[values == 0] = 0
            seen = np.zeros(1 << 20, bool)
            seen[(values >> U64(44)).astype(np.int64)] = True
            tables[q] = (seen, values, bits)
    return Index(ids, symbols, first, classes, tables, key[order], owner[order])


def passage_distance(item: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of the item to any passage of each row, and where that passage ends."""
    steps = np.arange(regions.shape[1] + 1)
    row = np.zeros((len(regions), regions.shape[1] + 1), np.int64)
    for i, symbol in enumerate(item):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (regions != symbol))
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row.min(axis=1), row.argmin(axis=1)


def candidates(index: Index, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, start, text) of windows that meet an item in at least one hash.

    A window may begin before its text, where words of the item are missing at the front.
    """
    none = np.zeros(0, np.int64)
    most = max((c[-1] for c in index.classes), default=0)
    padded = np.concatenate([np.zeros(most, U64), symbols])
    hits: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for q, (seen, values, bits) in index.tables.items():
        runs = run_hashes(symbols, first, q)
        at = np.flatnonzero(seen[(runs >> U64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(values, runs[at]), len(values) - 1)
        mask = np.where(values[place] == runs[at], bits[place], U64(0))
        hits[q] = (at[mask > 0], mask[mask > 0])
    items, starts, texts = [none], [none], [none]
    for c, (length, n, q, least, span, before) in enumerate(index.classes):
        at, mask = hits[q]
        at = at[(mask >> U64(c % 64)) & U64(1) > 0]
        if len(at) < least:
            continue
        text = np.searchsorted(first, at, "right") - 1
        last = np.searchsorted(at, np.minimum(at + span, first[text + 1]))
        dense = np.flatnonzero(last - np.arange(len(at)) >= least)
        if not len(dense):
            continue
        at, text = at[dense], text[dense]
        # the passage begins before its first common run, if edits broke the runs before
        width = len(padded) + 1
        place = np.unique((text * width + at + most)[:, None] - np.arange(before + 1))
        text, start = place // width, place % width
        for lo in range(0, len(start), 4096):
            part = start[lo : lo + 4096]
            keys = cgk_hashes(padded, part, length, n).ravel()
            low, high = np.searchsorted(index.keys, keys, "left"), np.searchsorted(index.keys, keys, "right")
            count = high - low
            if count.any():
                which = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                items.append(index.owners[which])
                starts.append(np.repeat(np.tile(part - most, n), count))
                texts.append(np.repeat(np.tile(text[lo : lo + 4096], n), count))
    all_of = np.unique(np.stack([np.concatenate(items), np.concatenate(starts), np.concatenate(texts)], 1), axis=0)
    return all_of[:, 0], all_of[:, 1], all_of[:, 2]


def search(index: Index, data: np.ndarray, offsets: np.ndarray, threshold: float) -> list[list[dict]]:
    """Per text the items found in it, each with its least distance."""
    out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    symbols, first = tokens(data, offsets)
    items, starts, texts = candidates(index, symbols, first)
    padded = np.concatenate([symbols, [U64(0)]])
    for item in np.unique(items):
        own = index.symbols[index.first[item] : index.first[item + 1]]
        edits = most_edits(len(own), threshold)
        start, text = starts[items == item], texts[items == item]
        at = start[:, None] - edits - 3 + np.arange(len(own) + 2 * edits + 6)
        inside = (at >= first[text][:, None]) & (at < first[text + 1][:, None])
        best, end = passage_distance(own, padded[np.where(inside, at, len(symbols))])
        for t in np.unique(text[best <= edits]):
            mine = np.flatnonzero(text == t)
            k = mine[best[mine].argmin()]
            word = int(start[k] - edits - 3 + end[k] - first[t])
            out[t].append({"item_id": index.ids[item], "distance": int(best[k]), "similarity": 1 - int(best[k]) / len(own), "word": word})
    return out


def indexes(benchmark: DataFrame, threshold: float, item_id: str, item_text: str, pass_bytes: int) -> Iterator[Index]:
    """Indexes of about ``pass_bytes`` of items each; the driver holds one at a time."""
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-int(total) // pass_bytes))
    for k in range(passes):
        rows = items.where(F.pmod(F.xxhash64("text", "id"), F.lit(passes)) == k).orderBy("id", "text").collect()  # about pass_bytes
        yield build_index([r["id"] for r in rows], [r["text"] for r in rows], threshold)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD, item_id: str = "item_id", item_text: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The columns of ``docs`` and ``leak`` (item_id, distance, similarity, word), a row for each item in each text.

    An item is found where some passage of the text has edit similarity ``threshold`` or more to it,
    in words without case and ASCII punctuation; ``word`` is the word at which the best passage
    ends.  Null or empty texts hold nothing, very long ones are searched whole.  Items of fewer than
    LEAST_WORDS words or without text take no part; items and rows that repeat are found each; an
    empty benchmark or table finds nothing.  An existing column named leak is replaced.  A benchmark
    of more than ``pass_bytes`` takes several passes over ``docs``, each a job of its own.
    """
    docs, out = docs.drop("leak"), None
    for index in indexes(benchmark, threshold, item_id, item_text, pass_bytes):
        found = docs.select("*", F.explode(leak_column(index, text, threshold)).alias("leak"))
        out = found if out is None else staged(out, "leaks").unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD, item_id: str = "item_id", item_text: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of ``docs`` whose texts hold no item of the benchmark, by the rules of ``find_leaks``."""
    for k, index in enumerate(indexes(benchmark, threshold, item_id, item_text, pass_bytes)):
        docs = (staged(docs, "clean") if k else docs).where(F.size(leak_column(index, text, threshold)) == 0)
    return docs


def leak_column(index: Index, text: str | Column, threshold: float) -> Column:
    @F.arrow_udf(_OUT)
    def benchmark_leaks(column: pa.Array) -> pa.Array:
        data, offsets = text_buffer(column)
        found: list[list[dict]] = []
        for lo, hi in slices(offsets):
            part = offsets[lo : hi + 1]
            found += search(index, data[part[0] : part[-1]], part - part[0], threshold)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("similarity", pa.float64()), ("word", pa.int32())]))
        return pa.array(found, kind)

    return benchmark_leaks(text)

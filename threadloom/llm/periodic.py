"""Maximal periodic runs of words, by the runs theorem.

The words of many texts are numbered and stand behind each other, each text closed by a number of
its own that is smaller than all words.  The longest Lyndon word at a place ends where the inverse
suffix array next has a smaller value (in the opposite order of words: a greater one), and every run
has a Lyndon root that is such a word in one of the two orders.  A root is extended to the right by
the common prefix of its place and the place one period on (a range minimum of the LCP array by a
sparse table, kept a level at a time), and to the left word by word, less than a period from the
first root of a run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import SLICE_BYTES

#: Words and periods of a run at least
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Rounds of hops for all places at once, and places that are left to a plain loop
ROUNDS, FEW = 40, 128


def suffix_ranks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse, by doubling in the groups that are still equal (Larsson-Sadakane).

    ``codes`` are not negative and their last number occurs once.
    """
    n = len(codes)
    bits = int(codes.max(initial=0) + 1).bit_length()
    h = max(1, min(8, 63 // bits))
    padded = np.concatenate([codes + 1, np.zeros(h, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(h):
        key = key << bits | padded[k : k + n]
    order = np.argsort(key)
    ranked = key[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    left = np.flatnonzero(~(head & np.concatenate([head[1:], [True]])))
    while len(left):
        at = order[left]
        further = at + h
        pair = rank[at] << 32 | np.where(further < n, rank[np.minimum(further, n - 1)] + 1, 0)
        by = np.argsort(pair)
        at, pair = at[by], pair[by]
        order[left] = at
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank[at] = np.maximum.accumulate(np.where(new, left, 0))
        left = left[~(new & np.concatenate([new[1:], [True]]))]
        h *= 2
    return order, rank


def common_prefixes(codes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """LCP array: words that the suffix at each place of ``order`` shares with the one before it.

    A suffix whose previous word equals the word before its neighbour shares one word less than the
    suffix before it; the others are compared, which takes n log n words in all.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    follows = (place > 0) & (before > 0)
    follows[follows] = codes[place[follows] - 1] == codes[before[follows] - 1]
    own = np.flatnonzero(~follows)
    shared = np.zeros(n, np.int64)
    todo = own[before[own] >= 0]
    padded = np.concatenate([codes, np.full(64, -1, np.int64)])
    width = 1
    while len(todo):
        step = np.arange(width)
        a, b = todo + shared[todo], before[todo] + shared[todo]
        equal = padded[np.minimum(a, n)[:, None] + step] == padded[np.minimum(b, n)[:, None] + step]
        run = np.where(equal.all(1), width, np.argmin(equal, 1))
        shared[todo] += run
        todo = todo[run == width]
        width = min(64, width * 2)
    last = np.maximum.accumulate(np.where(follows, 0, place))
    return (shared[last] - (place - last))[order]


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value, n if there is none."""
    n = len(values)
    padded = np.append(values, values.min(initial=0) - 1)
    at, todo = np.arange(1, n + 2), np.arange(n)
    for _ in range(ROUNDS):
        todo = todo[padded[at[todo]] > values[todo]]
        if len(todo) <= FEW:
            break
        at[todo] = at[at[todo]]  # all values up to there are greater
    if len(todo):
        hop, value = at.tolist(), padded.tolist()
        for i in todo[::-1].tolist():
            j = hop[i]
            while value[j] > value[i]:
                j = hop[j]
            hop[i] = j
        at = np.array(hop)
    return at[:n]


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of ``values[low : high + 1]`` for many ranges; the sparse table is kept a level at a time."""
    out = np.zeros(len(low), np.int64)
    level_of = np.frexp((high - low + 1).astype(float))[1] - 1
    level = values
    for k in range(int(level_of.max(initial=-1)) + 1):
        if k:
            level = np.minimum(level[: -(1 << k - 1)], level[1 << k - 1 :])
        here = np.flatnonzero(level_of == k)
        out[here] = np.minimum(level[low[here]], level[high[here] + 1 - (1 << k)])
    return out


def runs(codes: np.ndarray, ends: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all maximal runs of at least ``least`` words and ``periods`` (2 or more) periods.

    ``codes`` are the numbers of the words, those of the closing places ``ends`` being smaller than
    all others and different.  Runs come by start, then period.
    """
    n = len(codes)
    order, rank = suffix_ranks(codes)
    close = ends[np.searchsorted(ends, np.arange(n))] if n else ends  # the closing place of each place's text
    place = np.arange(n)
    roots = []
    for value in (rank, -rank):
        size = next_smaller(value) - place
        fits = np.flatnonzero(place + size < close)
        fits = fits[codes[fits] == codes[fits + size[fits]]]
        if periods > 2:
            fits = fits[fits + 2 * size[fits] <= close[fits]]
            fits = fits[codes[fits + size[fits] - 1] == codes[fits + 2 * size[fits] - 1]]
        roots.append((fits, size[fits]))
    start, end, period = [], [], []
    if any(len(at) for at, _ in roots):
        shared = common_prefixes(codes, order)
        for at, size in roots:
            a, b = rank[at], rank[at + size]
            same = range_minima(shared, np.minimum(a, b) + 1, np.maximum(a, b))
            enough = same > (periods - 2) * size
            at, size, same = at[enough], size[enough], same[enough]
            root = np.zeros(n, np.int64)
            root[at[same >= size]] = size[same >= size]
            back = at - size
            first = (back < 0) | (root[np.maximum(back, 0)] != size)
            at, size, same = at[first], size[first], same[first]
            low, todo = at.copy(), np.arange(len(at))
            while len(todo):
                todo = todo[(low[todo] > 0) & (codes[low[todo] - 1] == codes[low[todo] + size[todo] - 1])]
                low[todo] -= 1
            start.append(low)
            end.append(at + size + same)
            period.append(size)
    if not start:
        return (np.zeros(0, np.int64),) * 3
    found = np.stack([np.concatenate(x) for x in (start, period, end)])
    found = found[:, found[2] - found[0] >= np.maximum(least, periods * found[1])]
    found = np.unique(found, axis=1)
    return found[0], found[2], found[1]


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all texts and the closing place of each text."""
    flat = [w for words in texts for w in words]
    index = dict(zip(dict.fromkeys(flat), range(len(texts), len(texts) + len(flat))))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1) - 1
    codes = np.empty(len(flat) + len(texts), np.int64)
    inside = np.ones(len(codes), bool)
    inside[ends] = False
    codes[inside] = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
    codes[ends] = np.arange(len(texts))
    return codes, ends


def periodic_runs(text: str | Column = "text", least: int = LEAST_WORDS, periods: int = LEAST_PERIODS, at_once: int = SLICE_BYTES) -> Column:
    """Struct of a text's ``words`` (their number), ``runs`` and ``collapsed``.

    Words are runs of bytes other than ASCII white space, numbered from 0.  ``runs`` has start,
    length and period of each maximal run of ``least`` words and ``periods`` periods or more, by
    start, then period.  ``collapsed`` joins by single spaces the words that no run holds after its
    first period.  Null and empty texts have no words, equal texts equal results; a text of any
    length is taken whole, short ones together up to ``at_once`` bytes (about 150 bytes of memory a word).
    """

    @F.arrow_udf("struct<words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>")
    def runs_of_words(column: pa.Array) -> pa.Array:
        whole = column.to_pylist()
        counts, numbers, places, collapsed = [], [], [np.zeros((3, 0), np.int64)], []
        lo = 0
        while lo < len(whole):
            texts, size, hi = [], 0, lo
            while hi < len(whole) and (size < at_once or hi == lo):
                raw = (whole[hi] or "").encode()
                if texts and size + len(raw) > at_once:
                    break
                texts.append(raw.split())  # bytes are split at ASCII white space alone
                size += len(raw)
                hi += 1
            codes, ends = numbered(texts)
            start, end, period = runs(codes, ends, least, periods)
            of = np.searchsorted(ends, start)
            first = np.concatenate([[0], ends[:-1] + 1])
            change = np.zeros(len(codes) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, end, -1)
            kept = np.cumsum(change) == 0
            cut = np.zeros(len(texts), bool)
            cut[of] = True
            for i, words in enumerate(texts):
                if cut[i]:
                    words = [words[j] for j in np.flatnonzero(kept[first[i] : ends[i]]).tolist()]
                collapsed.append(b" ".join(words).decode())
            counts += [len(t) for t in texts]
            numbers.append(np.bincount(of, minlength=len(texts)))
            places.append(np.stack([start - first[of], end - start, period]))
            lo = hi
        found = np.concatenate(places, axis=1)
        borders = np.concatenate([[0], np.cumsum(np.concatenate(numbers))]) if numbers else np.zeros(1, np.int64)
        rows = pa.StructArray.from_arrays([pa.array(x) for x in found], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), rows)
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), lists, pa.array(collapsed, pa.string())], ["words", "runs", "collapsed"])

    return runs_of_words.asNondeterministic()(text)  # else each field that is used runs the search again


#: The query over ``documents`` in DuckDB: pairs of equal words of each distance, islands of them, the least distance of each
RUNS_SQL = r"""WITH tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, hex(encode(coalesce(doc_id::VARCHAR, ''))) AS h FROM documents),
c AS (SELECT doc_id, len(w) AS n, xor(list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM d, tab),
g AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM c), p AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - a) // (3 + g % 8) END AS p FROM g),
i AS (SELECT doc_id, n, a, p, unnest(range(n)) AS i FROM p), o AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS j FROM d),
x AS (SELECT i.doc_id, i.i, i.n, o.word FROM i JOIN o ON o.doc_id = i.doc_id AND o.j = CASE WHEN p IS NOT NULL AND i.i >= a THEN a + (i.i - a) % p ELSE i.i END),
e AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n), s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
m AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)), r AS (SELECT doc_id, start, length, min(q) AS period FROM m GROUP BY 1, 2, 3),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed, first({'start': start, 'length': length, 'period': period} ORDER BY length DESC, start, period) AS best FROM r GROUP BY 1),
z AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND x.i >= r.start + r.period AND x.i < r.start + r.length) GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, (1000 * best.length) // best.period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM d LEFT JOIN t USING (doc_id) LEFT JOIN z USING (doc_id)"""

"""Shared pieces: Arrow text buffers, word hashes in numpy, maps over sorted groups, hash folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

U64 = np.uint64
#: Bytes between words, as in the pattern [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes of texts handled at once inside a task
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer text stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        _POWERS[:] = [
            np.cumprod(np.concatenate([[U64(1)], np.full(size, U64(x % (1 << 64)), U64)]))
            for x in (_BASE, pow(_BASE, -1, 1 << 64))
        ]
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (fixed multipliers of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h[i]: polynomial hash of data[:i] modulo 2**64."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal for equal bytes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and per text the index of its first word (n+1 entries)."""
    solid = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) if len(solid) else solid
    after = np.concatenate([solid[1:], [False]]) if len(solid) else solid
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def map_sorted(df: DataFrame, keys: list[str], fn: Callable[[dict[str, np.ndarray], np.ndarray], Iterator[dict[str, np.ndarray]]], schema: str, parts: int | None = None, deal: list[str] | None = None) -> DataFrame:
    """Group rows by ``keys`` and hand whole groups to ``fn``, many small ones at a time.

    ``fn(columns, cuts)`` gets arrays of the rows of some groups and the n+1 borders between them,
    and yields columns of output rows.  Rows are streamed from sorted partitions: about a batch and
    one group are in memory, so callers bound the size of a group (they split or salt hot ones).
    Groups that agree in the keys ``deal`` (the first ones; all by default) come one after the other.
    """
    names = schema_names(schema)
    target = to_arrow_schema(T._parse_datatype_string(schema))  # noqa: SLF001

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
            columns = {c: column_array(table.column(c)) for c in table.column_names}
            for out in fn(columns, cuts):
                if len(out[names[0]]):
                    arrays = [pa.array(out[c], target.field(c).type) for c in names]
                    yield pa.RecordBatch.from_arrays(arrays, schema=target)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            edges = run_edges([column_array(table.column(c)) for c in keys])
            if not len(edges):
                continue  # one group so far
            last = int(edges[-1])
            yield from work(table.slice(0, last), np.concatenate([[0], edges]))
            held = table.slice(last).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from work(table, np.concatenate([[0], run_edges([column_array(table.column(c)) for c in keys]), [table.num_rows]]))

    dealt = df.repartition(parts, *(deal or keys)) if parts else df.repartition(*(deal or keys))
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, schema)


def column_array(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy()


def run_edges(columns: list[np.ndarray]) -> np.ndarray:
    """Rows at which the value of any column differs from the row before."""
    change = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    return np.flatnonzero(change) + 1


def merge_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row number of the component of each of ``n`` rows under the links a-b."""
    label = np.arange(n)
    while len(a):
        # only roots are hooked: a link that is left out has both ends in one tree for good
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        a, b = label[a], label[b]
        rest = a != b
        a, b = a[rest], b[rest]
    return label


def within_pairs(cuts: np.ndarray, side: np.ndarray | None = None, limit: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same group, about ``limit`` at a time.

    With ``side``, groups that hold two sides give the pairs across sides only.
    """
    sizes = np.diff(cuts)
    for m in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(int(m), 1)
        starts = cuts[:-1][sizes == m]
        step = max(1, limit // len(i))
        for lo in range(0, len(starts), step):
            base = starts[lo : lo + step, None]
            a, b = (base + i).ravel(), (base + j).ravel()
            if side is not None:
                two = np.repeat((side[a.reshape(len(base), -1)] != side[base]).any(axis=1) | (side[b.reshape(len(base), -1)] != side[base]).any(axis=1), len(i))
                keep = ~two | (side[a] != side[b])
                a, b = a[keep], b[keep]
            yield a, b


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and the texts' n+1 borders among them.

    Words are runs of bytes other than ASCII white space.  A text of fewer words has one shingle of
    all of them, a text without words has none.
    """
    start, end, first = words(data, offsets)
    prefix = prefix_hash(data)
    word = span_hash(prefix, start, end)
    counts = np.diff(first)
    total = np.zeros(len(word), U64)
    padded = np.concatenate([word, np.zeros(size, U64)])
    for j in range(size):
        total += padded[j : j + len(word)] * U64((2 * j + 3) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF | 1)
    left = np.repeat(first[1:], counts) - np.arange(len(word))
    keep = left >= size
    for t in np.flatnonzero((counts > 0) & (counts < size)):
        own = word[first[t] : first[t + 1]]
        value = U64(len(own))
        for w in own:
            value = mix(np.array([value ^ w]))[0]
        total[first[t]] = value
        keep[first[t]] = True
    borders = np.concatenate([[0], np.cumsum(keep)])[first]
    return mix(total[keep]), borders


def schema_names(schema: str) -> list[str]:
    return [x.strip().split(" ")[0] for x in schema.split(",")]

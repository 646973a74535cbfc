"""Byte-level BPE encoding and decoding of whole texts.

A word is held as the ids of its parts beside a contiguous array of the ranks of adjacent pairs:
the least rank is looked up, its boundary deleted, and the two neighbouring ranks refreshed, until
no pair of parts is in the vocabulary.  The arrays of many short words are rows of one matrix, so that
a step is taken in all of them at once.  Words longer than ``SHORT`` bytes, whose array would be
scanned too often, keep the same ranks in a heap.  Words and the pieces between single spaces are
remembered inside a task, up to a fixed number.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import SLICE_BYTES, slices, text_buffer

#: Fixed value: the pattern that splits text into words before the merges of byte-level BPE
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points that became letters or numbers after Unicode 16, the edition of the tokenizers library, for which they are neither
NEWER = "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
#: Bytes of words that are merged many at once; bytes of a word whose ranks are scanned
WIDE, SHORT = 64, 256
#: Pieces remembered in a task, and letters of the longest of them
REMEMBERED, LONGEST = 1 << 17, 64
#: Rank of a pair that is in no merge
NONE = 1 << 30


def latin(text: str) -> bool:
    """Whether a text has only signs of Latin-1, which is much faster to find out than by a pattern."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def word_splitter() -> Callable[[list[str]], Callable[[str], list[str]]]:
    """For some texts the function that splits them into the words whose ranks are merged."""
    newer = "[" + "".join("-".join(chr(int(x, 16)) for x in span.split("-")) for span in NEWER.split()) + "]"
    plain, found = regex.compile(PATTERN).findall, re.compile(newer).search
    other = r"[^\s\p{L}\p{N}]"
    careful = PATTERN.replace(other, f"[{other}||{newer}]").replace(r"?\p{L}", rf"?[\p{{L}}--{newer}]").replace(r"?\p{N}", rf"?[\p{{N}}--{newer}]")
    careful = regex.compile(careful, regex.V1).findall
    return lambda texts: careful if any(found(t) for t in texts if not latin(t)) else plain


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in the vocabulary file, as sign -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Merges by rank, the bytes of every token and the added tokens of a tokenizer file (JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or not before["use_regex"] or before["add_prefix_space"] or spec["normalizer"] or odd:
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary ({', '.join(odd) or 'other parts'})")
        if any(t[flag] for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: added tokens that match more than their own text")
        ids, signs = model["vocab"], byte_signs()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left, self.right, self.merged = (np.array(x, np.int64) for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in pairs)))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [b""] * (1 + max([*ids.values(), *self.added.values()]))
        for token, i in ids.items():
            self.tokens[i] = bytes(map(signs.__getitem__, token))
        for token, i in self.added.items():
            self.tokens[i] = token.encode()
        self.of_byte = [ids[sign] for sign, _ in sorted(signs.items(), key=lambda x: x[1])]


class Encoder:
    """Ids of texts as little-endian 32-bit numbers.

    Text may be cut before any space that no white space follows: whatever stands before it, a word
    begins there.  The pieces between such places, and their words, are remembered.
    """

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.rank = dict(zip((vocabulary.left << 32 | vocabulary.right).tolist(), range(len(vocabulary.left))))
        self.merged, self.of_byte, self.added = vocabulary.merged.tolist(), vocabulary.of_byte, vocabulary.added
        self.ranks = PairRanks(vocabulary)
        self.pieces: dict[str, bytes] = {}  # each follows a single space
        self.words: dict[str, bytes] = {}
        self.splitter = word_splitter()
        self.split_pieces = re.compile(r" (?=\S)").split
        self.split_added = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})").split if self.added else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; about ``SLICE_BYTES`` letters are looked at together."""
        out, lo = [], 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= SLICE_BYTES):
                size += len(texts[hi])
                hi += 1
            out += self.slice(texts[lo:hi])
            lo = hi
        return out

    def slice(self, texts: list[str]) -> list[bytes]:
        split_words = self.splitter(texts)
        cut = [self.segments(t) for t in texts]
        plain = [s for parts in cut for s in parts if isinstance(s, list)]
        missing = [p for p in set().union(*(s[1:] for s in plain)) if p not in self.pieces]
        heads, tails = [split_words(s[0]) for s in plain], [split_words(" " + p) for p in missing]
        self.learn([w for w in set(chain.from_iterable(heads)).union(*tails) if w not in self.words])
        ids_of = self.words.__getitem__
        self.pieces |= {p: b"".join(map(ids_of, words)) for p, words in zip(missing, tails)}
        heads = iter([b"".join(map(ids_of, words)) for words in heads])
        ids_of = self.pieces.__getitem__
        out = [b"".join(chain.from_iterable((next(heads), *map(ids_of, s[1:])) if isinstance(s, list) else (s,) for s in parts)) for parts in cut]
        for memory in (self.pieces, self.words):
            if len(memory) > self.remembered:
                memory.clear()
        for long in [p for p in missing if len(p) > LONGEST]:
            self.pieces.pop(long, None)
        return out

    def segments(self, text: str) -> list[list[str] | bytes]:
        """The pieces of the text between added tokens, and the ids of these."""
        if not self.split_added or not any(t in text for t in self.added):
            return [self.split_pieces(text)]
        return [self.added[t].to_bytes(4, "little") if i % 2 else self.split_pieces(t) for i, t in enumerate(self.split_added(text))]

    def learn(self, words: list[str]) -> None:
        """Remember the ids of new words: short ones many at once."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        for low, high in ((0, 8), (8, 16), (16, 32), (32, WIDE)):
            some = np.flatnonzero((sizes > low) & (sizes <= high))
            for lo in range(0, len(some), 1 << 14):
                at = some[lo : lo + (1 << 14)].tolist()
                self.words |= zip([words[i] for i in at], self.ranks.merge([raw[i] for i in at], high))
        for i in np.flatnonzero(sizes > WIDE).tolist():
            parts = [self.of_byte[b] for b in raw[i]]
            self.words[words[i]] = array("I", self.scanned(parts) if len(parts) <= SHORT else self.heaped(parts)).tobytes()

    def scanned(self, parts: list[int]) -> list[int]:
        """Parts of a short word after all merges."""
        rank, merged = self.rank.get, self.merged
        ranks = [rank(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | parts[i], NONE)
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 32 | parts[i + 1], NONE)
        return parts

    def heaped(self, parts: list[int]) -> list[int]:
        """The same for a long word: least ranks from a heap, parts in a linked list."""
        n, rank = len(parts), self.rank.get
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := rank(parts[i] << 32 | parts[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            least, i = divmod(heapq.heappop(heap), 1 << 32)
            j = after[i]
            if parts[i] < 0 or j >= n or rank(parts[i] << 32 | parts[j], NONE) != least:
                continue  # one of the two parts has changed since
            parts[i], parts[j], after[i] = self.merged[least], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank(parts[a] << 32 | parts[b], NONE)) != NONE:
                    heapq.heappush(heap, r << 32 | a)
        return [p for p in parts if p >= 0]


class PairRanks:
    """Rank arrays of many short words at once, a row each."""

    def __init__(self, vocabulary: Vocabulary):
        key = vocabulary.left << 17 | vocabulary.right
        by = np.argsort(key)
        self.keys, self.by = np.append(key[by], -1), np.append(by, NONE).astype(np.int32)
        self.merged, self.of_byte = vocabulary.merged.astype(np.int32), np.array(vocabulary.of_byte, np.int32)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; -1 stands behind the end of a word."""
        key = left.astype(np.int64) << 17 | right
        at = np.searchsorted(self.keys[:-1], key)
        return np.where((self.keys[at] == key) & (right >= 0), self.by[at], NONE)

    def merge(self, raw: list[bytes], width: int) -> list[bytes]:
        """Ids of words of at most ``width`` bytes after all merges."""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        parts = np.full((len(raw), width), -1, np.int32)
        parts[np.arange(width) < sizes[:, None]] = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        ranks = self.of(parts[:, :-1], parts[:, 1:])
        done, row = np.full_like(parts, -1), np.arange(len(raw))
        column = np.arange(width)
        while True:
            at = ranks.argmin(1)
            least = ranks[np.arange(len(ranks)), at]
            live = least < NONE
            if not live.all():
                done[row[~live], : parts.shape[1]] = parts[~live]
                parts, ranks, row, at, least = parts[live], ranks[live], row[live], at[live], least[live]
            if not len(row):
                break
            n, every = parts.shape[1] - 1, np.arange(len(row))
            parts[every, at] = self.merged[least]
            parts = np.take_along_axis(parts, column[:n] + (column[:n] > at[:, None]), 1)  # without the part behind
            if n == 1:
                done[row, :1] = parts
                break
            ranks = np.take_along_axis(ranks, column[: n - 1] + (column[: n - 1] >= at[:, None]), 1)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.of(parts[left, at[left] - 1], parts[left, at[left]])
            right = np.flatnonzero(at < n - 1)
            ranks[right, at[right]] = self.of(parts[right, at[right]], parts[right, at[right] + 1])
        real = done >= 0
        borders = np.concatenate([[0], 4 * np.cumsum(real.sum(1))]).tolist()
        packed = done[real].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip(borders[:-1], borders[1:])]


def text_slices(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column, about ``SLICE_BYTES`` at a time; null counts as empty."""
    _, offsets = text_buffer(column)
    for lo, hi in slices(offsets):
        yield [t or "" for t in column.slice(lo, hi - lo).to_pylist()]


def packed_lists(packed: list[bytes]) -> pa.Array:
    """Ids as consecutive 32-bit numbers as a list column."""
    borders = np.array(list(accumulate(map(len, packed), initial=0))) // 4
    ids = pa.Array.from_buffers(pa.int32(), int(borders[-1]), [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(borders, pa.int32()), ids)


def encode(vocabulary: Vocabulary, text: str | Column = "text") -> Column:
    """Token ids of whole texts (array of int).

    The text of an added token becomes that token.  Null and empty texts have no ids; equal texts
    have equal ids in whatever rows; texts of any length are encoded whole, a text at a time.
    """

    @F.arrow_udf("array<int>")
    def bpe_encode(column: pa.Array) -> pa.Array:
        encoder = Encoder(vocabulary) if not held else held[0]
        held[:] = [encoder]
        return joined([packed_lists(encoder.encode(texts)) for texts in text_slices(column)], pa.list_(pa.int32()))

    held: list[Encoder] = []
    return bpe_encode.asNondeterministic()(text)  # else several uses of the column encode the text once each


def joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def id_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a list column and its n+1 borders; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def decoded(tokens: list[bytes], ids: np.ndarray) -> str:
    """The text of some ids; those without a token are skipped, bytes that are not UTF-8 become U+FFFD."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(tokens)):
        ids = ids[(ids >= 0) & (ids < len(tokens))]
    return b"".join(map(tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


def decode(vocabulary: Vocabulary, ids: str | Column = "ids") -> Column:
    """Texts of arrays of token ids, added tokens included.

    Bytes that are not UTF-8 become U+FFFD.  Ids without a token are skipped, null and empty arrays give the empty text.
    """

    @F.arrow_udf("string")
    def bpe_decode(column: pa.Array) -> pa.Array:
        values, borders = id_values(column)
        return pa.array([decoded(vocabulary.tokens, values[lo:hi]) for lo, hi in zip(borders[:-1].tolist(), borders[1:].tolist())], pa.string())

    return bpe_decode(ids)


def round_trip(vocabulary: Vocabulary, text: str | Column = "text") -> Column:
    """Struct (packed, decoded) of whole texts: their ids as consecutive little-endian unsigned 32-bit
    numbers, and the text that these ids decode to.

    What ``encode`` and then ``decode`` give, in one pass, for checks of whole tables.
    """

    @F.arrow_udf("struct<packed: binary, decoded: string>")
    def bpe_round_trip(column: pa.Array) -> pa.Array:
        encoder = Encoder(vocabulary) if not held else held[0]
        held[:] = [encoder]
        parts = []
        for texts in text_slices(column):
            packed = encoder.encode(texts)
            back = [decoded(vocabulary.tokens, np.frombuffer(p, "<u4")) for p in packed]
            parts.append(pa.StructArray.from_arrays([pa.array(packed, pa.binary()), pa.array(back, pa.string())], ["packed", "decoded"]))
        return joined(parts, pa.struct([("packed", pa.binary()), ("decoded", pa.string())]))

    held: list[Encoder] = []
    return bpe_round_trip.asNondeterministic()(text)  # else each field that is used makes the trip again

"""Spelling variants by full neighbourhood generation.

Words are counted inside tasks before anything is shuffled.  Each word of the vocabulary emits every
distinct string that one deletion, replacement or insertion over the observed alphabet makes of it,
as 64-bit hashes computed for many words at once; the strings that can be words at all, by a filter
over the hashes of the vocabulary, join the vocabulary by equality.  A match is a neighbour by
construction, so no distance is computed, and a word meets at most its neighbourhood, however
frequent it is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import U64, mix, powers

#: Letters of a word; A to Z are lower-cased first
LETTERS = "a-zA-ZÀ-ÿ"
#: Code points and occurrences of a word at least; a form occurs so many times as often
LEAST_SIZE, LEAST_COUNT, TIMES = 6, 5, 5
#: Words a task counts before it hands its counts on; words that one task of the search takes
HELD, PER_TASK = 400_000, 4_000
#: Bits of a block of the filter, bits a word, and blocks at most (32 MiB in all; a fuller filter lets more strings through to the join)
BLOCK_BITS, BITS_A_WORD, MOST_BLOCKS = 18, 32, 1 << 10
#: Neighbours held at once
AT_ONCE = 1 << 20


def word_counts(df: DataFrame, text: str = "text", key: str | None = None, rewrite: Callable[[str, str], str] | None = None, least: int = LEAST_SIZE, held: int = HELD) -> DataFrame:
    """``(word, n)``: occurrences of each word of at least ``least`` code points in whole texts.

    A word is a maximal run of ``LETTERS`` with A to Z in lower case.  ``rewrite(key, word)`` may
    shorten or exchange a word of a row, whose ``key`` it gets as text (empty for null).  Null and
    empty texts hold no words, repeated rows count each, an empty table gives no rows.
    """
    rows = df.select(F.coalesce(F.col(f"`{key}`").cast("string") if key else F.lit(""), F.lit("")).alias("key"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = re.compile(f"[{LETTERS}]{{{least},}}").findall, Counter()

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for name, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = find(whole.encode().lower().decode()) if whole else ()  # bytes are lower-cased in ASCII alone
                if rewrite is None:
                    total.update(found)
                else:
                    for word, n in Counter(found).items():
                        word = rewrite(name, word)
                        if len(word) >= least:
                            total[word] += n
                if len(total) >= held:
                    yield counted()
        yield counted()

    return rows.where("text is not null").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def by_length(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the words of one length and their code points (a row each)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, np.frombuffer("".join(words[rows]).encode("utf-32-le"), np.uint32).reshape(len(rows), size)


def code_value(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(U64) + U64(1))


def word_hashes(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: polynomials over the values of their code points."""
    out = np.zeros(len(words), U64)
    for rows, codes in by_length(words):
        out[rows] = mix((code_value(codes) * powers(codes.shape[1])[0]).sum(1, dtype=U64))
    return out


def neighbours(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(hashes, rows, place, code point or -1 with the kind): all distinct strings one edit away from words of one length.

    Kinds: ``code >= 0`` at an even place number 2k replaces the k-th code point, at an odd one
    2k+1 is inserted before it; ``code = -1`` deletes.  Of a run of equal code points only the first
    is deleted, and no code point is inserted behind an equal one: the others give the same strings.
    """
    rows, size = np.arange(len(codes)), codes.shape[1]
    power = powers(size + 2)[0]
    inverse = powers(2)[1][1]
    value = code_value(codes)
    prefix = np.zeros((len(codes), size + 1), U64)
    np.cumsum(value * power[:size], axis=1, out=prefix[:, 1:])
    whole = prefix[:, size]
    values = code_value(alphabet)
    letters = [(code, values[i : i + 1]) for i, code in enumerate(alphabet.tolist())]  # arrays: scalars warn when they wrap around
    for k in range(size + 1):
        before = codes[:, k - 1] if k else None
        if k < size:
            first = rows if before is None else np.flatnonzero(codes[:, k] != before)
            yield mix(prefix[first, k] + (whole[first] - prefix[first, k + 1]) * inverse), first, 2 * k, -1
        longer = prefix[:, k] + (whole - prefix[:, k]) * power[1]
        for code, own in letters:
            fresh = rows if before is None else np.flatnonzero(before != code)
            yield mix(longer[fresh] + own * power[k]), fresh, 2 * k + 1, code
            if k < size:
                other = np.flatnonzero(codes[:, k] != code)
                yield mix(whole[other] + (own - value[other, k]) * power[k]), other, 2 * k, code


def edited(word: str, place: int, code: int) -> str:
    k, inserted = place >> 1, place & 1
    return word[:k] + (chr(code) if code >= 0 else "") + word[k + 1 - inserted :]


def probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three bits of a word in its block of ``2 ** bits``."""
    return [(hashes >> U64(shift)) & U64((1 << bits) - 1) for shift in (0, bits - 4, 2 * bits - 8)]


def word_filter(words: DataFrame, n: int, block_bits: int) -> np.ndarray:
    """Blocks of bits (a row of bytes each) in which every word has its bits set.

    A block is filled by one task; all of them together, 32 MiB at most, go to the driver.
    """
    blocks = 1
    while blocks < MOST_BLOCKS and blocks << block_bits < BITS_A_WORD * n:
        blocks *= 2

    @F.arrow_udf("long")
    def spelling_hash(column: pa.Array) -> pa.Array:
        return pa.array(word_hashes(np.array(column.to_pylist(), object)).view(np.int64))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << block_bits, np.uint8)
        for at in probes(group["hash"].to_numpy().view(U64), block_bits):
            bits[at.astype(np.int64)] = 1
        return pd.DataFrame({"block": [group["block"].iloc[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    hashed = words.select(spelling_hash("word").alias("hash"))
    dealt = hashed.select(F.shiftrightunsigned("hash", 64 - 10).bitwiseAND(blocks - 1).cast("int").alias("block"), "hash")
    out = np.zeros((blocks, 1 << (block_bits - 3)), np.uint8)
    for row in dealt.groupBy("block").applyInPandas(fill, "block int, bits binary").collect():
        out[row.block] = np.frombuffer(row.bits, np.uint8)
    return out


def passes(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes whose bits are all set."""
    left = np.arange(len(hashes))
    flat, block_bits = held.reshape(-1), held.shape[1].bit_length() + 2
    base = ((hashes >> U64(64 - 10)) & U64(len(held) - 1)) << U64(block_bits)
    for at in probes(hashes, block_bits):
        bit = base[left] + at[left]
        left = left[(flat[(bit >> U64(3)).astype(np.int64)] >> (bit & U64(7)).astype(np.uint8)) & 1 == 1]
        if not len(left):
            break
    return left


def near_words(words: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``(word, near)``: pairs of distinct words one deletion, replacement or insertion apart, both ways.

    ``words`` has each word once.  Null words have no neighbours, the empty word has those of one
    code point; an empty table gives no rows.
    """
    words = words.select("word").where("word is not null")
    n = words.count()
    alphabet = np.array(sorted(ord(r.sign) for r in words.select(F.explode(F.split("word", "")).alias("sign")).where("sign <> ''").distinct().collect()), np.int64)
    held = words.sparkSession.sparkContext.broadcast(word_filter(words, n, block_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array(batch.column(0).to_pylist(), object)
            for rows, codes in by_length(own):
                step = max(1, AT_ONCE // (2 * len(alphabet) + 1))
                for lo in range(0, len(rows), step):
                    word, near = [], []
                    for hashes, at, place, code in gathered(codes[lo : lo + step], alphabet):
                        left = passes(held.value, hashes)
                        found = own[rows[lo + at[left]]]
                        word += found.tolist()
                        near += [edited(w, p, c) for w, p, c in zip(found, place[left].tolist(), code[left].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string())], ["word", "near"])

    tasks = max(1, -(-n // PER_TASK))
    emitted = words.repartition(tasks, "word").mapInArrow(run, "word string, near string")
    return emitted.join(words.select(F.col("word").alias("near")), "near").select("word", "near")


def gathered(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The neighbourhoods in blocks of about ``AT_ONCE`` strings: hashes, rows, places, code points."""
    held, size = [], 0
    for part in neighbours(codes, alphabet):
        held.append(part)
        size += len(part[0])
        if size >= AT_ONCE:
            yield joined(held)
            held, size = [], 0
    if held:
        yield joined(held)


def joined(parts: list[tuple[np.ndarray, np.ndarray, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = [len(p[0]) for p in parts]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.repeat([p[2] for p in parts], sizes), np.repeat([p[3] for p in parts], sizes)


def followed(forms: DataFrame) -> DataFrame:
    """``(word, root)``: from each word along ``(word, form)`` to the last, by doubling the steps.

    A word has one form at most and the steps never lead back; the rounds are the logarithm of the
    longest way, and only a flag of each reaches the driver.
    """
    steps = staged(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = staged(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        if steps.where("moved").isEmpty():
            return steps.select("word", "root")
        steps = steps.select("word", "root")


def variants(counts: DataFrame, least: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of the words that occur ``least`` times or more.

    ``counts`` has ``(word, n)``.  Words one edit apart are near; the form of a word is the near word
    of largest n, the smaller word of equals, if that occurs ``times`` as often at least, else null;
    the root is where the forms lead, the word itself if it has none.  Repeated words add up, null
    words are left out, an empty table gives no rows.
    """
    words = staged(counts.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "words")
    pairs = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(-F.col("best.n") >= times * F.col("n"), F.col("best")).alias("best"))
    found = staged(found.select("word", F.col("best.near").alias("form"), "n", "n_near", (-F.col("best.n")).alias("form_n")), "forms")
    roots = followed(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The query over ``documents`` in DuckDB; CRC-32 byte by byte with its table
VARIANTS_SQL = r"""WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{6,}')) AS run FROM documents),
keyed AS (SELECT run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM keyed, tab),
typed AS (SELECT n, CASE WHEN crc % 199 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5), a AS (SELECT DISTINCT unnest(string_split(word, '')) AS a FROM v), k AS (SELECT word, n, unnest(range(length(word) + 1)) AS k FROM v),
e AS (SELECT word, substr(word, 1, k) || substr(word, k + 2) AS near FROM k WHERE k < length(word) UNION SELECT word, substr(word, 1, k) || a || substr(word, k + 2) FROM k, a WHERE k < length(word) UNION SELECT word, substr(word, 1, k) || a || substr(word, k + 1) FROM k, a),
p AS (SELECT e.word, e.near, v.n AS near_n, row_number() OVER (PARTITION BY e.word ORDER BY v.n DESC, e.near) AS r, count(*) OVER (PARTITION BY e.word) AS n_near FROM e JOIN v ON v.word = e.near WHERE e.word <> e.near),
f AS (SELECT v.word, CASE WHEN near_n >= 5 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM v LEFT JOIN p ON p.word = v.word AND r = 1),
walk AS (SELECT word, word AS root FROM f UNION SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word JOIN f last ON last.word = walk.root WHERE last.form IS NULL"""

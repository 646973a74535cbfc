"""Texts beyond the slices that tasks work in, against brute force."""

import hashlib
import random

from threadloom.llm import suffixes
from threadloom.llm.common import SLICE_BYTES

LENGTH = 200


def covered(texts):
    """Bytes of each text covered by a string of LENGTH bytes that starts elsewhere too."""
    seen, raw = {}, [t.encode() for t in texts]
    for i, t in enumerate(raw):
        for j in range(len(t) - LENGTH + 1):
            key = hashlib.md5(t[j : j + LENGTH]).digest()
            seen[key] = "many" if key in seen else (i, j)
    out = []
    for i, t in enumerate(raw):
        gone, until = bytearray(len(t)), 0
        for j in range(len(t)):
            if j + LENGTH <= len(t) and seen[hashlib.md5(t[j : j + LENGTH]).digest()] == "many":
                until = j + LENGTH
            gone[j] = j < until
        out.append(gone)
    return out


def test_repeats_across_slices_of_a_long_text(spark):
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("abcdefghij klmn") for _ in range(n))
    passage = letters(700)
    long = letters(SLICE_BYTES - 300) + passage + letters(SLICE_BYTES - 100) + passage[:450] + letters(SLICE_BYTES // 4)
    assert len(long) > 2 * SLICE_BYTES
    texts = [long, letters(3000) + passage[100:] + letters(50), letters(400), "z" * 900, ""]
    rows = {r.doc_id: r for r in suffixes.dedup_substrings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, gone in enumerate(covered(texts)):
        kept = bytes(b for b, g in zip(texts[i].encode(), gone) if not g)
        assert rows[i].sd_removed == sum(gone) and bytes(rows[i].sd_kept) == kept


def test_shards_of_a_common_anchor_are_merged(spark):
    """One passage among different words: its contexts are dealt to many stored shards."""
    rng = random.Random(7)
    letters = lambda n: "".join(rng.choice("abcdefghij klmn") for _ in range(n))
    passage = letters(260)
    texts = [letters(rng.randrange(5, 120)) + passage + letters(rng.randrange(5, 120)) for _ in range(40)]
    rows = {r.doc_id: r for r in suffixes.dedup_substrings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shard_contexts=3).collect()}
    for i, gone in enumerate(covered(texts)):
        assert rows[i].sd_removed == sum(gone) >= 260

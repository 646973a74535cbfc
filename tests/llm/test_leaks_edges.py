"""Leaks whose edits are all at the front, or lie where they break the most word runs."""

import random

import pyarrow as pa
import pytest

from threadloom.llm import leaks
from threadloom.llm.common import text_buffer


@pytest.mark.parametrize("n", [12, 30, 57, 62, 120])
def test_edits_at_the_front(n):
    rng = random.Random(n)
    word = lambda: f"w{rng.randrange(10**6)}"
    edits = leaks.most_edits(n, 0.8)
    items = [[word() for _ in range(n)] for _ in range(40)]
    index = leaks.build_index(list(range(40)), [" ".join(x) for x in items])
    front = [[word() for _ in range(edits)] + x[edits:] for x in items]
    broken = [[word() if i % 3 == 2 and i < 3 * edits else w for i, w in enumerate(x)] for x in items]
    for passages in (front, [x[edits:] for x in items], broken):
        texts = [" ".join(p + [word() for _ in range(20)]) for p in passages] + [" ".join([word() for _ in range(50)] + p) for p in passages]
        got = leaks.search(index, *text_buffer(pa.array(texts)), 0.8)
        assert all(x["item_id"] == t % 40 and x["distance"] <= edits for t, xs in enumerate(got) for x in xs)
        assert sum(map(len, got)) >= 0.97 * len(texts)

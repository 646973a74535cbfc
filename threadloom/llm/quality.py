"""Quality classifier: a byte-level convolutional network in numpy.

A document is cut into overlapping chunks that cover all its bytes.  Learned filters slide over
the bytes of a chunk, each filter keeps its maximum, and the chunk maxima are combined (mean,
highest and lowest chunk) into one probability.  Training needs a bounded sample of labelled
documents and runs on the driver; scoring is one pass over the table without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, fold, slices, text_buffer

#: Filters, their width in bytes, the step between positions
FILTERS, WIDTH, STEP = 16, 8, 2
#: A block is 64 bytes; a chunk is 8 blocks and the next one starts 7 blocks later
BLOCK, CHUNK, HOP = 64, 8, 7
#: Labelled documents of each class in the training sample, and bytes of them at most
SAMPLE_PER_CLASS, SAMPLE_BYTES = 1_200, 16_000_000
EPOCHS, BATCH, RATE, SEED = 5, 24, 0.02, 7


@dataclass
class Net:
    filters: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (3 * FILTERS,)
    shift: float


def new_net(seed: int = SEED) -> Net:
    rng = np.random.default_rng(seed)
    return Net(rng.normal(0, 0.2, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 3 * FILTERS).astype(np.float32), 0.0)


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts on block borders with at least WIDTH zero bytes after each, and their first blocks."""
    lengths = np.diff(offsets)
    first = np.concatenate([[0], np.cumsum(-(-(lengths + WIDTH) // BLOCK))])
    out = np.zeros(first[-1] * BLOCK + WIDTH, np.uint8)
    out[np.arange(len(data)) + np.repeat(first[:-1] * BLOCK - offsets[:-1], lengths)] = data
    return out, first


def block_maxima(net: Net, data: np.ndarray, blocks: int, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Largest response of each filter in each block, and the position it comes from."""
    best = np.empty((blocks, FILTERS), np.float32)
    at = np.empty((blocks, FILTERS), np.int64) if where else None
    per = BLOCK // STEP
    for lo in range(0, blocks, 512):
        hi = min(blocks, lo + 512)
        part = data[lo * BLOCK : hi * BLOCK + WIDTH]
        sums = np.take(net.filters[0], part[: (hi - lo) * BLOCK : STEP], axis=0)
        for j in range(1, WIDTH):
            sums += np.take(net.filters[j], part[j : j + (hi - lo) * BLOCK : STEP], axis=0)
        sums = sums.reshape(hi - lo, per, FILTERS)
        if where:
            arg = sums.argmax(axis=1)
            best[lo:hi] = np.take_along_axis(sums, arg[:, None], 1)[:, 0]
            at[lo:hi] = (np.arange(lo, hi)[:, None] * per + arg) * STEP
        else:
            best[lo:hi] = sums.max(axis=1)
    return best, at


def chunks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block ranges of all chunks, and each text's first chunk."""
    blocks = np.diff(first)
    count = np.maximum(1, -(-(blocks - CHUNK) // HOP) + 1)
    of = np.concatenate([[0], np.cumsum(count)])
    turn = np.arange(of[-1]) - np.repeat(of[:-1], count)
    start = np.repeat(first[:-1], count) + turn * HOP
    return start, np.minimum(start + CHUNK, np.repeat(first[1:], count)), of


def features(net: Net, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, 3 * FILTERS): mean, highest and lowest chunk for every filter."""
    buf, first = padded(data, offsets)
    best, _ = block_maxima(net, buf, int(first[-1]))
    start, end, of = chunks(first)
    best = np.concatenate([best, best[-1:]])
    top = np.maximum.reduceat(best, np.stack([start, end], 1).ravel(), axis=0)[::2]
    top = np.maximum(top + net.bias, 0)
    mean = np.add.reduceat(top, of[:-1], axis=0) / np.diff(of)[:, None]
    return np.concatenate([mean, np.maximum.reduceat(top, of[:-1], axis=0), np.minimum.reduceat(top, of[:-1], axis=0)], axis=1)


def probabilities(net: Net, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.empty(len(offsets) - 1)
    for lo, hi in slices(offsets, SLICE_BYTES >> 2):
        part = offsets[lo : hi + 1]
        logit = features(net, data[part[0] : part[-1]], part - part[0]) @ net.out.astype(np.float64) + net.shift
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return out


def gradients(net: Net, texts: list[bytes], labels: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Gradients of the mean logistic loss; through a maximum they reach one position only."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    buf, first = padded(data, offsets)
    best, at = block_maxima(net, buf, int(first[-1]), where=True)
    start, end, of = chunks(first)
    top, src = np.empty((len(start), FILTERS), np.float32), np.empty((len(start), FILTERS), np.int64)
    for c, (s, e) in enumerate(zip(start, end)):
        arg = best[s:e].argmax(axis=0) + s
        top[c], src[c] = best[arg, np.arange(FILTERS)], at[arg, np.arange(FILTERS)]
    live = top + net.bias
    hidden = np.maximum(live, 0)
    g_hidden, g_out, g_shift, cols = np.zeros_like(hidden), np.zeros_like(net.out), 0.0, np.arange(FILTERS)
    for i in range(len(texts)):
        h = hidden[of[i] : of[i + 1]]
        hi, lo = h.argmax(axis=0), h.argmin(axis=0)
        x = np.concatenate([h.mean(axis=0), h[hi, cols], h[lo, cols]])
        error = (1 / (1 + np.exp(-np.clip(x @ net.out + net.shift, -30, 30))) - labels[i]) / len(texts)
        g_out += error * x
        g_shift += error
        back = error * net.out.reshape(3, FILTERS)
        g_hidden[of[i] : of[i + 1]] += back[0] / len(h)
        np.add.at(g_hidden, (of[i] + hi, cols), back[1])
        np.add.at(g_hidden, (of[i] + lo, cols), back[2])
    g_hidden *= live > 0
    g_filters = np.zeros_like(net.filters)
    for j in range(WIDTH):
        np.add.at(g_filters[j], (buf[src + j], np.broadcast_to(cols, src.shape)), g_hidden)
    return [g_filters, g_hidden.sum(axis=0), g_out], g_shift


def train(texts: list[bytes], labels: list[int], prior: float, epochs: int = EPOCHS, seed: int = SEED) -> Net:
    """Adam on class-balanced batches; the final shift restores the labels' ``prior`` of class 1."""
    net = new_net(seed)
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:  # nothing to tell apart: every text gets the prior
        net.out[:] = 0
        net.shift = float(np.log(prior / (1 - prior)))
        return net
    rng = np.random.default_rng(seed)
    params = [net.filters, net.bias, net.out]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    classes = [np.flatnonzero(y == c) for c in (0, 1)]
    steps = max(60, epochs * len(texts) // BATCH)
    for step in range(steps):
        pick = np.concatenate([rng.choice(c, BATCH // 2) for c in classes])
        grads, g_shift = gradients(net, [texts[i] for i in pick], y[pick])
        t += 1
        rate = RATE * (1 - step / steps)
        for p, g, a, b in zip(params, grads, m, v):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-6)
        net.shift -= rate * 2 * g_shift
    net.shift += float(np.log(prior / (1 - prior)))
    return net


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Net:
    """Train on at most ``per_class`` labelled documents of each class, chosen by hash of the id.

    Only ids whose crc32 as text is not 0 modulo 5 are used.  Rows with null labels or ids are left
    out, texts that are null count as empty, of repeated ids one row is used.  A text that would
    take the sample beyond SAMPLE_BYTES is left out of training.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & (fold(doc_id, 5) != 0)).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    sample = [known.where(F.col("y") == c).orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(sample[0].unionByName(sample[1]).dropDuplicates(["id"]))  # 2 * per_class rows at most
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(chosen, "id").orderBy("id", "text").limit(2 * per_class)
    texts, y, seen, size = [], [], set(), 0
    for r in rows.toLocalIterator():
        raw = r["text"].encode()
        if r["id"] not in seen and size + len(raw) <= SAMPLE_BYTES:
            seen.add(r["id"])
            size += len(raw)
            texts.append(raw)
            y.append(r["y"])
    total = sum(totals.values())
    return train(texts, y, (totals.get(1, 0) + 0.5) / (total + 1.0))


def score(net: Net, text: str | Column = "text") -> Column:
    """Probability that a text is good: 0 to 1, empty and null texts too."""

    @F.arrow_udf("double")
    def quality_score(column: pa.Array) -> pa.Array:
        return pa.array(probabilities(net, *text_buffer(column)))

    return quality_score(text)

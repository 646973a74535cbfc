"""Licence scan: a trained paragraph classifier, a calibrated unknown class, template comparison.

Paragraphs (lines; long ones in overlapping windows of words) get sparse word n-gram features and a
multinomial logistic regression over licence families and "none".  It is trained on passages drawn
from templates and on corpus paragraphs that resemble no template.  A prediction counts only if the
family's templates confirm it.  What looks like a licence but is not confirmed, or falls below the
confidence that passages of families left out of training have, is "unknown".
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, U64, mix, run_edges, slices, text_buffer
from .leaks import tokens

#: Words of a window and words from one window to the next
WINDOW, HOP = 48, 24
FEATURE_BITS = 16
#: Corpus rows in the training sample, lines of each, characters of a line (from a random place of a
#: longer one), passages drawn per family
SAMPLE_ROWS, SAMPLE_LINES, SAMPLE_CHARS, PER_FAMILY = 1_500, 12, 1_000, 300
EPOCHS, BATCH, RATE, SEED = 12, 256, 0.5, 3
#: Passes over the passages when some families are left out to calibrate the unknown class
EPOCHS_LEFT_OUT = 4
#: False alarms allowed among held-out corpus paragraphs; template overlap beyond which a family is
#: confirmed, and confirmed without confidence; overlap with any template that an unknown licence needs
FALSE_ALARMS, CONFIRM, CERTAIN, HINT = 0.002, 0.5, 0.8, 0.1

# Standard notices of the licence families.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "GPL-2.0": [
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "BSD": [
        "Distributed under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.",
        "SPDX-License-Identifier: ISC",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the CC0 1.0 Universal Public Domain Dedication.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "SPDX-License-Identifier: Zlib",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "Proprietary": [
        "All rights reserved. Proprietary and confidential.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
    ],
}
FAMILIES = ["none", *TEMPLATES]


@dataclass
class Scanner:
    weights: np.ndarray  # (features, families)
    bias: np.ndarray
    limit: float  # least probability of a licence
    sure: float  # least share of the best family among all families
    grams: dict[str, list[np.ndarray]]  # family -> word 3-grams of each template


def features(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words and of the word pairs that begin at each word."""
    pair = mix(symbols * U64(0x9E3779B97F4A7C15) + np.concatenate([symbols[1:], np.zeros(min(1, len(symbols)), U64)]))
    shift = U64(64 - FEATURE_BITS)
    return (mix(symbols ^ U64(9)) >> shift).astype(np.int64), (pair >> shift).astype(np.int64)


def trigrams(symbols: np.ndarray) -> np.ndarray:
    if len(symbols) < 3:
        return np.unique(mix(symbols))
    return np.unique(mix(mix(symbols[:-2]) * U64(5) + mix(symbols[1:-1]) * U64(3) + symbols[2:]))


def words_of(text: str) -> np.ndarray:
    return tokens(*text_buffer(pa.array([text])))[0]


def template_overlap(grams: list[np.ndarray], own: np.ndarray) -> float:
    """Share of a template found in the window, or of the window found in a template, at most."""
    best = 0.0
    for t in grams:
        both = len(np.intersect1d(t, own, assume_unique=True))
        best = max(best, both / max(1, len(t)), both / max(3, len(own)))
    return best


def unit_features(symbols: np.ndarray) -> np.ndarray:
    one, two = features(symbols)
    return np.concatenate([one, two[:-1]])


def regression(rows: list[np.ndarray], y: np.ndarray, learn: np.ndarray, epochs: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of the multinomial logistic regression over sparse rows of feature numbers."""
    weights, bias = np.zeros((1 << FEATURE_BITS, len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    power, learn = np.full(1 << FEATURE_BITS, 1e-2, np.float32), learn.copy()
    for _ in range(epochs):
        rng.shuffle(learn)
        for lo in range(0, len(learn), BATCH):
            batch = learn[lo : lo + BATCH]
            own = [rows[i] for i in batch]
            row = np.repeat(np.arange(len(batch)), [len(x) for x in own])
            column, scale = np.concatenate(own), 1 / np.sqrt([max(1, len(x)) for x in own])
            logits = np.zeros((len(batch), len(FAMILIES)))
            np.add.at(logits, row, weights[column])
            logits = logits * scale[:, None] + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            bias -= 0.02 * p.mean(axis=0).astype(np.float32)
            slope = (p * scale[:, None])[row].astype(np.float32)
            np.add.at(power, column, (slope**2).sum(axis=1))
            np.add.at(weights, column, -RATE * slope / np.sqrt(power[column])[:, None])
    return weights, bias


def confidence(scanner: Scanner, units: list[np.ndarray]) -> np.ndarray:
    """Share of the best family in the probability of all families, for each unit."""
    p = np.stack([scores(scanner, u, np.array([0]), np.array([len(u)]))[0] for u in units])
    return p[:, 1:].max(axis=1) / np.maximum(1e-12, p[:, 1:].sum(axis=1))


def train(negatives: list[str], seed: int = SEED, per_family: int = PER_FAMILY) -> Scanner:
    rng = np.random.default_rng(seed)
    grams = {f: [trigrams(words_of(t)) for t in ts] for f, ts in TEMPLATES.items()}
    everything = [g for gs in grams.values() for g in gs]
    clean = []
    for line in [x for text in negatives for x in text.split("\n")]:
        symbols = words_of(line)
        for lo in range(0, max(1, len(symbols)), WINDOW):
            part = symbols[lo : lo + WINDOW]
            if len(part) and template_overlap(everything, trigrams(part)) < 0.2:
                clean.append(part)
    filler = np.concatenate(clean) if clean else words_of("a few plain words that belong to no licence at all")
    units, labels = list(clean), [0] * len(clean)
    for y, family in enumerate(FAMILIES[1:], 1):
        sources = [words_of(t) for t in TEMPLATES[family]]
        for i in range(per_family):
            part = sources[i % len(sources)]
            if len(part) > 12 and rng.random() < 0.5:  # a piece, as in wrapped lines
                size = int(rng.integers(8, len(part)))
                lo = int(rng.integers(0, len(part) - size + 1))
                part = part[lo : lo + size]
            part = part[rng.random(len(part)) > 0.03]
            pad = int(rng.integers(0, 24)) if rng.random() < 0.5 else 0
            lo = int(rng.integers(0, max(1, len(filler) - pad)))
            around = filler[lo : lo + pad]
            cut = int(rng.integers(0, len(around) + 1))
            units.append(np.concatenate([around[:cut], part, around[cut:]])[:WINDOW])
            labels.append(y)
    order = rng.permutation(len(units))
    held = order[: len(order) // 5]
    learn, rows, y = order[len(order) // 5 :], [unit_features(u) for u in units], np.array(labels)
    scanner = Scanner(*regression(rows, y, learn, EPOCHS, rng), 0.5, 0.0, grams)
    quiet = [1 - scores(scanner, units[i], np.array([0]), np.array([len(units[i])]))[0, 0] for i in held if y[i] == 0]
    if len(quiet) >= 20:
        scanner.limit = max(0.5, float(np.quantile(quiet, 1 - FALSE_ALARMS)))
    known = confidence(scanner, [units[i] for i in held if y[i]])
    strange = []
    for fold in range(2):  # every second family is left out, its passages are unknown licences
        out = (y > 0) & (y % 2 == fold)
        part = Scanner(*regression(rows, y, learn[~out[learn]], EPOCHS_LEFT_OUT, rng), 0.5, 0.0, grams)
        strange.append(confidence(part, [units[i] for i in held if out[i]]))
    strange = np.concatenate(strange)
    steps = np.linspace(0, 1, 101)
    scanner.sure = float(max(steps, key=lambda t: (known >= t).mean() + (strange < t).mean()))
    return scanner


def scores(scanner: Scanner, symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(units, families) probabilities of symbols[start:end]."""
    one, two = features(symbols)
    sums = [np.concatenate([np.zeros((1, len(FAMILIES))), np.cumsum(scanner.weights[x], axis=0, dtype=np.float64)]) for x in (one, two)]
    logits = sums[0][end] - sums[0][start] + sums[1][np.maximum(start, end - 1)] - sums[1][start]
    logits = logits / np.sqrt(np.maximum(1, 2 * (end - start) - 1))[:, None] + scanner.bias
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS, sample_lines: int = SAMPLE_LINES, sample_chars: int = SAMPLE_CHARS) -> Scanner:
    """Train on templates and on ``sample_lines`` lines of each of ``sample_rows`` corpus rows.

    Rows and lines are chosen by hash, of a line of more than ``sample_chars`` characters a piece at
    a random place; nothing else reaches the driver.  Null texts are left out, without rows
    templates alone are used.
    """
    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t"), F.xxhash64(F.lit(SEED), text).alias("h"))
    last = rows.select("h").orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    if last is None:
        return train([])
    mixed = F.transform(F.split("t", "\n"), lambda x: F.struct(F.xxhash64(F.lit(SEED + 1), x).alias("turn"), x.alias("line")))
    some = F.slice(F.array_sort(F.array_distinct(mixed)), 1, sample_lines)
    room = lambda x: F.greatest(F.lit(1), F.length(x["line"]) - sample_chars + 1)
    lines = F.transform(some, lambda x: F.substr(x["line"], F.lit(1) + F.pmod(x["turn"], room(x).cast("long")).cast("int"), F.lit(sample_chars)))
    chosen = rows.where(F.col("h") <= last).dropDuplicates(["h"]).select("h", F.array_join(lines, "\n").alias("t"))
    return train([r["t"] for r in chosen.orderBy("h").limit(sample_rows).collect()])  # sample_rows x sample_lines x sample_chars at most


def scan(scanner: Scanner, text: str | Column = "text") -> Column:
    """Array of the licence passages of a text: paragraph, family, probability, similarity, start, end.

    A paragraph is a line, counted from 0, and ``start`` to ``end`` are the words of it that the
    passage spans; every passage of a line counts.  ``family`` is ``unknown`` where the classifier
    sees a licence that no template of the family confirms.  Null and empty texts have no passages,
    very long ones are scanned whole; repeated rows are scanned each, an empty table gives no rows.
    """
    kind = "array<struct<paragraph: int, family: string, probability: double, similarity: double, start: int, end: int>>"

    @F.arrow_udf(kind)
    def licence_scan(column: pa.Array) -> pa.Array:
        data, offsets = text_buffer(column)
        out: list[list[dict]] = [[] for _ in range(len(column))]
        for lo, hi in slices(offsets, SLICE_BYTES >> 1):
            part = offsets[lo : hi + 1]
            for t, found in scan_slice(scanner, data[part[0] : part[-1]], part - part[0]):
                out[lo + t].append(found)
        fields = pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])
        return pa.array(out, pa.list_(fields))

    return licence_scan(text)


def scan_slice(scanner: Scanner, data: np.ndarray, offsets: np.ndarray):
    feeds = np.flatnonzero(data == 10) + 1
    borders = np.unique(np.concatenate([offsets, feeds]))  # every line is a text of its own
    symbols, first = tokens(data, borders)
    size = np.diff(first)
    line = np.repeat(np.arange(len(size)), np.maximum(0, -(-(size - WINDOW) // HOP)) + (size > 0))
    if not len(line):
        return
    turn = np.arange(len(line)) - np.searchsorted(line, line)
    start = first[line] + turn * HOP
    end = np.minimum(start + WINDOW, first[line + 1])
    p = scores(scanner, symbols, start, end)
    likely = np.flatnonzero(1 - p[:, 0] >= scanner.limit)
    for own in np.split(likely, run_edges([line[likely]])) if len(likely) else []:
        k = line[own[0]]
        text = int(np.searchsorted(offsets, borders[k], "right")) - 1
        paragraph = int(k - np.searchsorted(borders, offsets[text]))
        found = [x for w in own for x in window_passages(scanner, symbols, int(start[w]), int(end[w]))]
        for x in distinct_passages(found):
            place = {"start": x.start - int(first[k]), "end": x.end - int(first[k])}
            yield text, {"paragraph": paragraph, "family": x.family, "probability": x.probability, "similarity": x.similarity, **place}


@dataclass
class Passage:
    family: str
    start: int  # words that the template shares, of a passage without template all of the window
    end: int
    low: int  # the windows it was seen in
    high: int
    probability: float
    similarity: float


def template_span(grams: list[np.ndarray], symbols: np.ndarray) -> tuple[int, int]:
    """Words from the first to the last one shared with the template that shares the most."""
    if len(symbols) < 3:
        return 0, len(symbols)
    own = mix(mix(symbols[:-2]) * U64(5) + mix(symbols[1:-1]) * U64(3) + symbols[2:])
    at = max((np.flatnonzero(np.isin(own, t)) for t in grams), key=len)
    return (int(at[0]), int(at[-1]) + 3) if len(at) else (0, len(symbols))


def window_passages(scanner: Scanner, symbols: np.ndarray, low: int, high: int) -> list[Passage]:
    """The licence passages of a window; what lies beside a confirmed one is looked at again."""
    out, todo = [], [(low, high)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 3 and (lo, hi) != (low, high):
            continue
        part = symbols[lo:hi]
        p = scores(scanner, part, np.array([0]), np.array([hi - lo]))[0]
        if 1 - p[0] < scanner.limit:
            continue
        family, grams = FAMILIES[1 + int(p[1:].argmax())], trigrams(part)
        overlap = template_overlap(scanner.grams[family], grams)
        if overlap > CONFIRM and (overlap >= CERTAIN or p[1:].max() >= scanner.sure * p[1:].sum()):
            a, b = template_span(scanner.grams[family], part)
            out.append(Passage(family, lo + a, lo + b, low, high, float(1 - p[0]), float(overlap)))
            todo += [(lo, lo + a), (lo + b, hi)]
        elif max(template_overlap(g, grams) for g in scanner.grams.values()) >= HINT:
            out.append(Passage("unknown", lo, hi, low, high, float(1 - p[0]), float(overlap)))
    return out


def distinct_passages(found: list[Passage]) -> list[Passage]:
    """Passages of a line in their order: overlapping windows of a family are one passage.

    Where families claim the same words the one most similar to its template has them, and words of
    a confirmed passage are no unknown licence.
    """
    out: list[Passage] = []
    for x in sorted(found, key=lambda x: (x.family == "unknown", -x.similarity, x.start)):
        shared = [min(x.end, y.end) - max(x.start, y.start) for y in out]
        if any(y.family != x.family and (s > 0 if x.family == "unknown" else 2 * s > min(x.end - x.start, y.end - y.start)) for y, s in zip(out, shared)):
            continue
        out.append(x)
    merged: list[Passage] = []
    for x in sorted(out, key=lambda x: (x.family, x.low, x.start)):
        y = merged[-1] if merged else None
        if y and y.family == x.family and x.low < y.high:
            y.start, y.end, y.high = min(x.start, y.start), max(x.end, y.end), max(x.high, y.high)
            y.probability, y.similarity = max(x.probability, y.probability), max(x.similarity, y.similarity)
        else:
            merged.append(x)
    return sorted(merged, key=lambda x: (x.start, x.end, x.family))

"""Term weights, labels, hashed embeddings, linkage and grounded events against plain Python."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict
from datetime import datetime

import pytest

from threadloom.operators import grounding, linkage, textfeatures

TEXTS = [(1, "The quick fox and the quick dog"), (2, "quick brown fox2 fox_3 éclair a bb"), (3, ""), (4, None), (5, "Fox. DOG! dog; dog"), (6, "the and of")]


def test_tfidf(spark):
    docs = spark.createDataFrame(TEXTS, "id long, text string")
    counts = {}
    for i, t in TEXTS:
        w = [x for x in re.findall(r"\w+", (t or "").lower()) if re.fullmatch("[a-z]{2,}", x) and x not in textfeatures.STOP]
        counts[i] = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    df = Counter(t for c in counts.values() for t in c)
    want = {}
    for i, c in counts.items():
        raw = {t: n * (math.log((1 + len(TEXTS)) / (1 + df[t])) + 1) for t, n in c.items()}
        size = math.sqrt(sum(x * x for x in raw.values()))
        want |= {(i, t): x / size for t, x in raw.items()}
    got = {(r.id, r.term): r.weight for r in textfeatures.tfidf(docs).collect()}
    assert got == pytest.approx(want, abs=1e-6) and ("quick dog" in counts[1]) and ("fox quick" in counts[1])
    top = textfeatures.top_weights(textfeatures.tfidf(docs), 2).where("id = 5").orderBy("rank").collect()
    assert [r.term for r in top] == [t for t, _ in sorted(((t, -round(x, 6)) for (i, t), x in want.items() if i == 5), key=lambda p: (p[1], p[0]))[:2]]
    assert textfeatures.tfidf(docs.limit(0)).count() == 0


def test_labels(spark):
    bags = spark.createDataFrame([("p", "alpha", 5), ("p", "Nexus", 1), ("q", "alpha", 2), ("q", "soc audit", 1), ("r", "beta", 3), ("r", "alpha", 1), ("s", "zeta", 1)], "project string, term string, tf long")
    projects = spark.createDataFrame([(p, "Ann", datetime(2024, 3, 5)) for p in "pqrstu"] + [("v", None, None)], "project string, top string, start timestamp")
    own = spark.createDataFrame([("s", "mine")], "project string, label string")
    got = {r.project: (r.label, r.label_source) for r in textfeatures.project_labels(bags, projects, own).collect()}
    assert got == {"p": ("Nexus", "entity"), "q": ("Soc Audit", "entity"), "r": ("Beta · Alpha", "ctfidf"), "s": ("mine", "user"), "t": ("Ann · Mar 2024", "fallback"), "u": ("Ann · Mar 2024", "fallback"), "v": ("unknown", "fallback")}


def embedded(text, dim):
    v = [0.0] * dim
    for token in (text or "").lower().split():
        token = "".join(c for c in token if c.isalnum())
        if len(token) >= 3:
            h, s = (hashlib.sha256(x.encode()).digest() for x in (token, token + "#sign"))
            v[int.from_bytes(h[:4], "big") % dim] += 1.0 if s[0] & 1 else -1.0
    size = math.sqrt(sum(x * x for x in v))
    if not size:
        v[int.from_bytes(hashlib.sha256((text or "").encode()).digest()[:4], "big") % dim] = size = 1.0
    return [x / size for x in v]


def test_hashed_vectors(spark):
    texts = ["Budget review, budget REVIEW 2024!", "", None, "a an of", "naïve Ünïcode-words x2y", "one\ttwo\n three  four"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for dim in (8, 64):
        got = {r.id: r.v for r in textfeatures.hashed_vectors(docs, dim).collect()}
        assert all(got[i] == pytest.approx(embedded(t, dim)) for i, t in enumerate(texts)) and len(got) == len(texts)


def sequential(items, d, cut):
    clusters, merges = {i: [i] for i in items}, set()
    mean = lambda a, b: sum(d.get((min(x, y), max(x, y)), 1.0) for x in clusters[a] for y in clusters[b]) / len(clusters[a]) / len(clusters[b])
    while len(clusters) > 1:
        height, a, b = min((round(mean(a, b), 9), a, b) for a, b in itertools.combinations(sorted(clusters), 2))
        if height > cut:
            break
        clusters[a] += clusters.pop(b)
        merges.add((a, b, height, len(clusters[a])))
    return {i: c for c, members in clusters.items() for i in members}, merges


def test_average_linkage(spark):
    rng = random.Random(2)
    groups = {g: {(a, b): rng.random() for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.8} for g, n in enumerate([1, 2, 9, 14, 20])}
    sizes = dict(enumerate([1, 2, 9, 14, 20]))
    items = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "grp long, item long")
    pairs = spark.createDataFrame([(g, *rng.sample(p, 2), x) for g, d in groups.items() for p, x in d.items()], "grp long, a long, b long, d double")
    of, merges = linkage.average_linkage(items, pairs, 0.62)
    got, heights = defaultdict(dict), defaultdict(set)
    for r in of.collect():
        got[r.grp][r.item] = r.cluster
    for r in merges.collect():
        heights[r.grp].add((r.a, r.b, round(r.height, 9), r.size))
    for g, n in sizes.items():
        want, wanted = sequential(range(n), groups[g], 0.62)
        assert got[g] == want and heights[g] == wanted
    of, merges = linkage.average_linkage(items.limit(0), pairs, 0.5)
    assert of.count() == merges.count() == 0


def test_small_mailboxes_are_linked_large_ones_split_by_communities(spark):
    small = [("s", i) for i in range(4)]
    large = [("l", 100 + i) for i in range(12)]
    threads = spark.createDataFrame(small + large, "mailbox string, thread long")
    scored = spark.createDataFrame([("s", 0, 1, 0.9), ("s", 2, 3, 0.8), ("s", 1, 2, 0.1)], "mailbox string, a long, b long, w double")
    edges = [(100 + a, 100 + b, 1.0) for k in (0, 6) for a, b in itertools.combinations(range(k, k + 6), 2)] + [(105, 106, 0.2)]
    got = {r.thread: (r.cluster, r.strategy) for r in linkage.clustered(threads, scored, spark.createDataFrame(edges, "a long, b long, w double"), small=10).collect()}
    assert got == {i: (i - i % 2, "agglomerative") for i in range(4)} | {100 + i: (100 + i - i % 6, "leiden") for i in range(12)}


def test_grounding(spark):
    messages = spark.createDataFrame(
        [("m1", 1, "Ann.Lee@x.com", "hello", ["none"]), ("m2", 1, "bob@x.com", " ", ["none"]), ("m3", 2, "bob@x.com", "hi", ["none"]), ("m4", 2, "bobby@y.com", "hi", ["none"]), ("m5", 3, "ann.lee@x.com", "pay", ["hr"]), ("m6", 1, "stranger@z.com", "x", ["none"])],
        "message_id string, thread_id long, sender string, text string, sensitivity array<string>",
    )
    people = spark.createDataFrame([("ann.lee@x.com", "A"), ("bob@x.com", "B"), ("bobby@y.com", "Y"), (None, "N")], "email string, person string")
    raw = [
        (1, 1, " ANN.lee@x.com ", "did", " did it ", ["m1", "m3", "m2"], 0.9),  # exact; a citation outside goes
        (2, 1, "Lee", "did", "s", ["m1"], None),  # a part of the name
        (3, 2, "bob", "did", "s", ["m3"], 0.5),  # two people it can be
        (4, 1, "bob", "outcome", "s", ["m2"], 0.8),  # the owner without text
        (5, 2, "bob@x.com", "proposed", "s", ["m3", "m3"], 0.8),  # the owner with text
        (6, 3, "ann.lee@x.com", "did", "s", ["m5"], 0.5),  # sensitive thread
        (7, 1, "ann.lee@x.com", "guess", "s", ["m1"], 0.5),
        (8, 1, "ann.lee@x.com", "did", "s", ["m3"], 0.5),  # nothing cited in the thread
        (9, 1, "  ", "did", "s", ["m1"], 0.5),
        (10, 1, "stranger", "did", "s", ["m6"], 0.5),  # unknown sender
        (11, 1, None, "did", "s", None, 0.5),
    ]
    raws = spark.createDataFrame(raw, "raw_id long, thread_id long, actor string, type string, summary string, cites array<string>, confidence double")
    projects = spark.createDataFrame([(1, "p")], "thread_id long, project string")
    got = {r.raw_id: (r.actor, r.summary, r.project, r.cites, r.confidence) for r in grounding.grounded_events(raws, messages, people, projects, "B").collect()}
    assert got == {1: ("A", "did it", "p", ["m1", "m2"], 0.9), 2: ("A", "s", "p", ["m1"], 0.6), 5: ("B", "s", None, ["m3", "m3"], 0.3)}
    assert grounding.grounded_events(raws.limit(0), messages, people, projects, "B").count() == 0


def test_hashed_features_add_up_before_the_shuffle(spark):
    import hashlib
    import math

    texts = [(1, "Red red fox-es"), (1, "red"), (2, None), (2, ""), (3, "a b \u00a0cd!"), (4, "été\u00a0mer 123")]
    cell = lambda t, dim=16: int(hashlib.sha256(t.encode()).hexdigest()[:8], 16) % dim
    sums = {}
    for i, t in texts:
        for token in ("".join(c for c in w if c.isalnum()) for w in (t or "").lower().split(" ")):
            if len(token) >= 3:
                sign = 1 if int(hashlib.sha256(f"{token}#sign".encode()).hexdigest()[:2], 16) % 2 else -1
                sums.setdefault(i, {}).setdefault(cell(token), []).append(sign)
    want = []
    for i, cells in sums.items():
        size = math.sqrt(sum(sum(x) ** 2 for x in cells.values()))
        want += [(i, c, round(sum(x) / size, 6)) for c, x in cells.items() if sum(x)]
    want += [(i, cell(t or ""), 1.0) for i, t in texts if i not in sums]
    found = textfeatures.hashed_features(spark.createDataFrame(texts, "id long, text string"), 16)
    assert sorted((r.id, r.bucket, round(r.value, 6)) for r in found.collect()) == sorted(want)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_tfidf_adds_up_terms_in_parts_and_shuffles_no_row_of_a_text_and_a_term(spark):
    rng = random.Random(5)
    text = lambda: rng.choice([None, "", "the 12 É", " ".join(rng.choices(["Alpha", "beta", "gamma!", "the", "dé", "x", "delta-eps", "zeta"], k=rng.randrange(40)))])
    rows = [(rng.choice([None, *range(50)]), text()) for _ in range(120)]
    docs = spark.createDataFrame(rows, "id long, text string")
    tf = defaultdict(Counter)
    for i, t in rows:
        w = [x for x in re.findall(r"\w+", (t or "").lower()) if re.fullmatch("[a-z]{2,}", x) and x != "the"]
        tf[i].update(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    df, n = Counter(t for c in tf.values() for t in c), len({i for i, _ in rows if i is not None})
    want = {}
    for i, c in tf.items():
        raw = {t: k * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in c.items()}
        want |= {(i, t): (c[t], x / math.sqrt(sum(y * y for y in raw.values()))) for t, x in raw.items()}
    found = textfeatures.tfidf(docs, ["the"], part_chars=60)
    got = {(r.id, r.term): (r.tf, r.weight) for r in found.collect()}
    assert found.count() == len(got) == len(want) and all(got[k] == (v[0], pytest.approx(v[1], abs=1e-6)) for k, v in want.items())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan and "hashpartitioning(term" in plan

"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import bitsliced, jaccard, langid, leaks, licences, linededup, mixing, quality, queries, sharding, suffixes
from threadloom.session import table

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, shard int, node string, extra int"


def texts(seed=3, n=70):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 120, 400]))]
        if i % 3 == 1:
            words = out[-1].split(" ")
            words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with null ids, null and empty texts, repeated rows, one very long text."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, 1, "x", i) for i, t in enumerate(texts())]
    rows += [rows[5], rows[5], (900, rows[7][1], "en", "s1", 0, None, None), (None, rows[7][1], None, None, None, None, None), (None, None, None, None, None, None, 1), (901, "", "en", "s0", 1, "y", 2)]
    rows += [(902, "ab" * 500, "en", "s0", 1, "y", 2), (903, " ".join(texts(9, 60)), "en", "s0", 1, "y", 2), (904, "one two", "en", "s0", 1, "y", 2)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_join(odd, nothing):
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    sets = [shingles(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    name = collections.defaultdict(list)
    for i, (k, _) in enumerate(rows):
        name[root(i)].append(k)
    first = {r: min((k for k in ks if k is not None), default=None) for r, ks in name.items()}
    want = sorted(((k, first[root(i)], links[i]) for i, (k, _) in enumerate(rows)), key=repr)
    for chunk in (256, 2):
        got = jaccard.jaccard_classes(odd, chunk=chunk)
        assert sorted(((r.doc_id, r.class_id, r.links) for r in got.collect()), key=repr) == want
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(name)
    assert jaccard.jaccard_classes(nothing).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    assert all(m < n for n, m in jaccard.least_matches(0.8, 1e-6).items())


def test_leaks(spark, odd):
    rng = random.Random(5)
    items = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (6, 15, 30, 57)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None), (10, "too short"), (None, items[1])], "item_id long, text string")
    docs = [(i, "before " + t.upper().replace(" ", ", ") + " after") for i, t in enumerate(items)]
    edited = items[2].split()
    edited[3], edited[20] = "other", "another"
    docs += [(20, "x y z " + " ".join(edited)), (21, None), (22, ""), (23, items[3][: len(items[3]) // 2])]
    table_ = spark.createDataFrame(docs, "doc_id long, text string")
    got = leaks.find_leaks(table_, bench).select("doc_id", "leak.item_id", "leak.distance").collect()
    few = leaks.find_leaks(table_, bench, pass_bytes=120)  # several passes
    assert sorted(map(tuple, few.select("doc_id", "leak.item_id", "leak.distance").collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert sorted(r.doc_id for r in leaks.without_leaks(table_, bench, pass_bytes=120).collect()) == sorted({d for d, _ in docs} - {r.doc_id for r in got})
    assert sorted(map(tuple, got), key=repr) == sorted([(0, 0, 0), (1, 1, 0), (1, None, 0), (2, 2, 0), (3, 3, 0), (20, 2, 2)], key=repr)
    assert leaks.find_leaks(odd, bench).count() == leaks.find_leaks(odd, bench.where("item_id > 99")).count() == 0
    with pytest.raises(ValueError):
        leaks.build_index([1], ["one two three four five six seven"], 0.3)


def test_line_dedup(spark, nothing):
    line = "a long line of many words that somebody copied from one page to another and then once more"
    rows = [(2, f"own words\n{line}\n\n"), (1, f"{line.upper()}\nfirst"), (3, line.replace(" ", "  ")), (4, None), (5, ""), (None, "null first\nown words"), (3, line.replace(" ", "  "))]
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.text, r.ld_lines, r.ld_removed) for r in out.collect()), key=repr)
    want = [(2, "\n", 4, 2), (1, f"{line.upper()}\nfirst", 2, 0), (3, "", 1, 1), (3, "", 1, 1), (4, None, 0, 0), (5, "", 1, 0), (None, "null first\nown words", 2, 0)]
    assert got == sorted(want, key=repr)
    assert linededup.dedup_lines(nothing).count() == 0


def test_fuzzy_lines(spark):
    """Lines with one changed letter meet where their SimHashes share a block; others never do."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(30):
        line = " ".join(word() for _ in range(200))
        rows += [(i, line), (100 + i, line + "s"), (200 + i, " ".join(word() for _ in range(200)))]
    for chunk in (256, 1):
        gone = [r.doc_id for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk).where("ld_removed > 0").collect()]
        assert len(gone) >= 12 and all(100 <= i < 200 for i in gone)
    assert linededup.similar("abcdefghij" * 9, "abcdefghij" * 8 + "xyz") and not linededup.similar("abc", "xyz")


def test_suffixes(odd, nothing):
    rows = [(r.text or "").encode() for r in odd.collect()]
    count = collections.Counter(t[i : i + 200] for t in rows for i in range(len(t) - 199))
    want = []
    for t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        want.append((len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), bytes(c for c, x in zip(t, gone) if not x)))
    for options in ({}, {"shard_contexts": 40, "shard_bytes": 20_000}):
        got = suffixes.dedup_substrings(odd, **options).collect()
        assert sorted((r.sd_bytes, r.sd_removed, r.sd_spans, bytes(r.sd_kept)) for r in got) == sorted(want)
    assert suffixes.dedup_substrings(nothing).count() == 0


def test_sharding(odd, nothing):
    out = sharding.shard(odd, 7, part_rows=10)
    rows = out.collect()
    sizes = collections.Counter(r.shard for r in rows)
    assert len(rows) == odd.count() and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert sorted(map(tuple, out.select("doc_id", "shard", "slot").collect()), key=repr) == sorted(map(tuple, sharding.shard(odd.repartition(5), 7, part_rows=10).select("doc_id", "shard", "slot").collect()), key=repr)
    assert sharding.shard(nothing, 4).count() == 0


def test_mixing(odd, nothing):
    mixed = mixing.mix(odd).collect()
    assert len(mixed) == odd.count() and all(r.mix_epochs * r.mix_size + r.mix_part <= 2 * r.mix_size for r in mixed)
    taken = collections.Counter()
    for r in mixed:
        taken[r.source] += r.mix_epochs * r.mix_size + r.mix_part
    assert all(abs(taken[r.source] - r.mix_target) < 1 for r in mixed)
    copies = mixing.materialised(mixing.mix(odd))
    assert copies.columns == odd.columns and sum(len((r.text or "").split()) for r in copies.collect()) == sum(taken.values())
    assert mixing.mix(nothing).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = queries.queries()[name](spark, DATA).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_top_k_ties_and_bad_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [-3.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").where(bitsliced.usable(F.col("embedding"))).select("vec_id", bitsliced.quantised(F.col("embedding")).alias("v"))
    got = [(r.query_id, r.rank, r.vec_id) for r in bitsliced.top_k(df, df.where("vec_id = 0"), 2).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 2)]


def test_quality_on_held_out_rows(spark, odd, nothing):
    d = "/root/testdata/sf0.01"
    out = queries.op1_quality_classifier(spark, d).join(table(spark, d, "labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in out) / len(out) > 0.9
    net = quality.fit(nothing.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, quality int"))
    assert odd.where(quality.score(net).between(0, 1)).count() == odd.count()


def test_languages_on_held_out_rows(spark, odd, nothing):
    d = "/root/testdata/sf0.01"
    out = queries.op8_language_id(spark, d).join(table(spark, d, "documents"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.97
    found = odd.select("text", langid.predict(langid.fit(odd)).alias("x")).collect()
    assert all((r.x.lang == "und") == (not r.text) for r in found)
    assert langid.fit(nothing) is None


def test_licences(spark, nothing):
    scanner = licences.fit(table(spark, DATA, "documents"))
    rows = [(1, "some words\nReleased under the MIT License.\nmore"), (2, "Licensed under CC BY-NC 4.0."), (3, None), (4, ""), (5, "plain words of no interest")]
    out = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.explode(licences.scan(scanner)).alias("x")).collect()
    assert [(r.doc_id, r.x.paragraph, r.x.family) for r in out] == [(1, 1, "MIT"), (2, 0, "CC-BY-NC")]


def test_leaks_against_brute_force(spark):
    """All items against all documents by the table of distances, passages edited at will."""
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (8, 12, 20, 33, 48) for _ in range(6)]
    docs = []
    for i in range(60):
        item = list(items[i % len(items)])
        for _ in range(rng.randrange(0, int(0.3 * len(item)) + 1)):
            k, kind = rng.randrange(len(item)), rng.random()
            item[k : k + (kind < 0.7)] = [] if kind < 0.3 else [rng.choice(vocabulary)]
        docs.append([rng.choice(vocabulary) for _ in range(rng.randrange(30))] + item + [rng.choice(vocabulary) for _ in range(rng.randrange(30))])

    def distance(item, doc):
        row = [0] * (len(doc) + 1)
        for i, w in enumerate(item):
            new = [i + 1]
            for j, d in enumerate(doc):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (w != d)))
            row = new
        return min(row)

    want = {(d, i): x for d, doc in enumerate(docs) for i, item in enumerate(items) if (x := distance(item, doc)) <= int(0.2 * len(item) + 1e-9)}
    frame = lambda rows, key: spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], f"{key} long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in leaks.find_leaks(frame(docs, "doc_id"), frame(items, "item_id")).select("doc_id", "leak.*").collect()}
    assert all(want[k] == x for k, x in got.items()) and len(got) >= 0.95 * len(want) and len(want) > 30


def test_matrix_rows_and_columns():
    """Row and column sums are exact, and the law beyond numpy's limit is the same."""
    counts, sizes = np.array([5, 0, 13, 7, 9]), np.array([10, 12, 0, 12])
    for limit in (10**9, 1):
        drawn = np.array([[sharding.Matrix(counts, sizes, seed, limit).row(p) for p in range(5)] for seed in range(300)])
        assert (drawn.sum(axis=2) == counts).all() and (drawn.sum(axis=1) == sizes).all()
        assert np.abs(drawn.mean(axis=0) - np.outer(counts, sizes) / 34).max() < 0.4
    rng = np.random.default_rng(1)
    big = np.array([sharding.hypergeometric(rng, 3_000_000_000, 9_000_000_000, 1_000_000) for _ in range(400)])
    assert abs(big.mean() - 250_000) < 5 * 433 / 20 and 0.85 < big.std() / 433 < 1.15
    small = np.array([sharding.hypergeometric(rng, 6, 9, 5, 1) for _ in range(4000)])
    for x in range(6):
        p = math.comb(6, x) * math.comb(9, 5 - x) / math.comb(15, 5)
        assert abs((small == x).mean() - p) < 5 * (p / 4000) ** 0.5 + 1e-3


def test_top_k_repeats_and_large_components(spark):
    """Against brute force: ids that repeat with equal and other vectors, an empty table, sums beyond 64 bits."""
    rng = random.Random(2)
    rows = [(i, [rng.randrange(-900, 900) for _ in range(4)]) for i in range(30)]
    rows += [rows[0]] * 25 + [(0, [5, 5, 5, 5]), (0, [9, -9, 9, 9]), (7, None)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    want = []
    for a, (i, q) in enumerate(rows):
        if q is not None and i % 10 == 0:
            best = sorted(((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(rows) if b != a and v is not None))[:10]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    got = bitsliced.top_k(df, df.where("vec_id % 10 = 0"), block_rows=8, query_rows=5).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert bitsliced.top_k(df.limit(0), df).count() == bitsliced.top_k(df, df.limit(0)).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        bitsliced.top_k(spark.createDataFrame([(1, [1 << 40]), (2, [1 << 40])], df.schema), df.sparkSession.createDataFrame([(1, [1 << 40])], df.schema)).collect()


WORKING = ["row", "input", "key", "part", "block", "rank", "at", "size", "src", "range", "before", "copy", "id", "own_id", "own_key", "alone", "text_key", "runs", "cut", "node", "check", "gone", "turn", "kept", "first", "leak", "jc_key", "jc_class", "jc_hash", "sh_part", "ld_key", "sd_key", "mix_range"]


def test_clashing_columns(spark):
    """Columns named like the operators' own working columns come through with their values."""
    rows = spark.createDataFrame([(i, f"some words of text number {i % 3} {i % 3} {i % 3} and more of them\nline {i}", "en", "s0") for i in range(8)], "doc_id long, text string, lang string, source string")
    for c in WORKING:
        rows = rows.withColumn(c, F.concat(F.lit(f"{c}-"), "doc_id"))
    bench = spark.createDataFrame([(1, "words of text number 1 1 1 and more of them")], "item_id long, text string")
    outs = {
        "shard": sharding.shard(rows, 3, part_rows=2), "mix": mixing.mix(rows), "mixed": mixing.materialised(mixing.mix(rows)), "keep_one": jaccard.keep_one(rows),
        "lines": linededup.dedup_lines(rows), "substrings": suffixes.dedup_substrings(rows, length=30), "clean": leaks.without_leaks(rows, bench), "leaks": leaks.find_leaks(rows, bench),
    }
    for name, out in outs.items():
        got = out.collect()
        assert got, name
        for r in got:
            assert all(r[c] == f"{c}-{r.doc_id}" for c in WORKING if not (name == "leaks" and c == "leak")), name


def test_pipeline_stages(spark):
    """What each stage keeps on documents with planted junk, copies and leaks, against plain Python."""
    import corpus_pipeline

    docs = table(spark, DATA, "documents").cache()
    bench = [r.text for r in table(spark, DATA, "benchmark").collect()]
    rng = random.Random(3)
    fresh = lambda n: " ".join("".join(rng.choice("abcdeghilmnorst") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    clean = [fresh(60) for _ in range(12)]
    copies = [clean[0] + " end", clean[0], clean[1]]
    leaky = [f"{fresh(10)} {bench[k]} {fresh(10)}" for k in range(3)]
    texts_ = clean + copies + leaky
    planted = spark.createDataFrame([(10_000 + i, t, "en", "src0", len(t)) for i, t in enumerate(texts_)], docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in stages["near_duplicates"](spark, planted, DATA).collect()}
    assert kept == {10_000 + i for i in range(len(texts_)) if i not in (12, 13, 14)}
    kept = {r.doc_id for r in stages["decontaminated"](spark, planted, DATA).collect()}
    assert kept == {10_000 + i for i in range(15)}
    net = quality.fit(docs, table(spark, DATA, "labels"))
    scores = {r.doc_id: r.s for r in docs.select("doc_id", quality.score(net).alias("s")).collect()}
    good = stages["quality_filter"](spark, docs, DATA)
    assert {r.doc_id for r in good.collect()} == {d for d, s in scores.items() if s >= 0.3}
    mixed = stages["mixed"](spark, good, DATA).cache()
    sizes = collections.Counter()
    for r in good.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    taken = collections.Counter()
    for r in mixed.collect():
        taken[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= len(sizes) and all(taken[s] <= 2 * n for s, n in sizes.items())
    out = stages["sharded"](spark, mixed, DATA).collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted((r.doc_id, r.text) for r in mixed.collect())
    assert len({(r.shard, r.slot) for r in out}) == len(out)
    assert mixed.columns == docs.columns
    for stage in stages.values():
        assert stage(spark, docs.limit(0), DATA).count() == 0

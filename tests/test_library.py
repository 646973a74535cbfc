"""Operators on small tables with nulls, repeated rows and clashing columns; streams against tables."""

import random

from pyspark.sql import functions as F

from threadloom.operators.components import connected_components
from threadloom.operators.mailbox import indel_ratio, owner_edges, rebuild_threads
from threadloom.functions import scalars as S
from threadloom.sources.readers import read_mailbox, read_mime
from threadloom.streaming import windows


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(None, 1), (7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_threads_conflict_and_synthetic(spark):
    rows = [("a", "p", []), ("b", "p", ["a"]), ("c", "p", ["gone"]), ("d", "q", ["gone"]), ("synthetic:1", "r", ["a"])]
    got = {r.message_id: (r.thread, r.lineage_conflict) for r in rebuild_threads(spark.createDataFrame(rows, "message_id string, provider_thread_id string, refs array<string>")).collect()}
    assert got["a"] == got["b"] == ("a", True) and got["c"][0] == got["d"][0] == "c" and got["c"][1]
    assert got["synthetic:1"] == ("synthetic:1", False)


def test_edges_of_nothing(spark):
    assert owner_edges(spark.createDataFrame([(None, True, None, None)], "person int, sent boolean, ts timestamp, noise boolean")).count() == 0


def test_uuid_and_luhn(spark):
    import uuid

    row = spark.createDataFrame([("näme",)], "x string").select(S.uuid5(F.col("x")).alias("u"), S.luhn_ok(F.lit("4111111111111111")).alias("good"), S.luhn_ok(F.lit("4111111111111112")).alias("bad")).first()
    assert row.u == str(uuid.uuid5(uuid.UUID(S.UUID_DNS), "näme")) and row.good and not row.bad


def test_indel_ratio():
    assert indel_ratio("", "") == 100 and round(indel_ratio("jon", "john"), 2) == 85.71


def test_readers(spark, tmp_path):
    (tmp_path / "box.json").write_text('{"owner_email":"o@x.org","internal_domains":["x.org"],"messages":[{"provider_id":"1","provider_thread_id":"t","headers":{"From":"a@b.c"},"body_text":"hi","attachments":[]}]}')
    assert read_mailbox(spark, str(tmp_path / "box.json")).first().body_text == "hi"
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "1.eml").write_bytes(b"From: a@b.c\nSubject: =?utf-8?q?caf=C3=A9?=\n\nhello\n")
    row = read_mime(spark, str(tmp_path / "m")).first()
    assert row.headers["Subject"] == "café" and row.body_text == "hello\n"


def test_stream_gives_the_table_s_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "1 hour", late="1 day")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    table = windows.windowed_counts(events, "1 hour")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, table.collect()))


def test_weighted_jaccard_of_a_hot_item(spark):
    from threadloom.operators import clustering

    sets = {i: {0} | {1 + i % 5} for i in range(60)}
    rows = spark.createDataFrame([(i, x) for i, xs in sets.items() for x in xs] * 2 + [(None, 0), (1, None)], "id long, item long")
    got = {(r.a, r.b): r.similarity for r in clustering.weighted_jaccard(rows, spark.createDataFrame([(0, 3.0)], "item long, weight double"), chunk=7).collect()}
    assert len(got) == 60 * 59 // 2 and got[0, 5] == 1.0 and got[0, 1] == 0.6


def test_weighted_jaccard_of_classes_gives_every_pair(spark):
    import random

    from threadloom.operators import clustering

    rng = random.Random(7)
    rows = spark.createDataFrame([(i, x) for i in range(60) for x in rng.sample("abcde", rng.randint(1, 3))] + [(None, "a"), (1, None)], "id long, item string")
    weights = spark.createDataFrame([("a", 2.5), ("c", 0.25)], "item string, weight double")
    found = clustering.weighted_jaccard_classes(rows, weights).collect()
    home = {r.b: r.a for r in found if r.kind == "member"}
    between = {(r.a, r.b): r.similarity for r in found if r.kind == "pair"}
    assert len(home) == 60 and len(set(home.values())) <= 25
    want = {(r.a, r.b): r.similarity for r in clustering.weighted_jaccard(rows, weights).collect()}
    got = {(a, b): 1.0 if home[a] == home[b] else between.get((min(home[a], home[b]), max(home[a], home[b]))) for a in range(60) for b in range(a + 1, 60)}
    assert {p: s for p, s in got.items() if s is not None} == want


def test_sim_03_reads_every_order(spark):
    """Its items are priorities again, over all orders; every customer with an order has a class."""
    import __spark_entry__ as entry

    found = entry.queries()["SIM_03_weighted_jaccard"](spark, "/root/testdata/sf0.001")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert found.where("kind = 'member'").count() == orders.select("o_custkey").distinct().count()


def test_sim_03_gives_every_pair_of_customers(spark):
    """No pair is left to a class: every two customers that share a priority have a row with their similarity."""
    import __spark_entry__ as entry

    found = entry.queries()["SIM_03_weighted_jaccard"](spark, "/root/testdata/sf0.001")
    sets = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_custkey", "o_orderpriority").collect():
        sets.setdefault(r.o_custkey, set()).add(r.o_orderpriority)
    weigh = lambda s: sum({"1-URGENT": 2.5, "5-LOW": 0.25}.get(x, 1.0) for x in s)
    want = sorted((a, b, round(weigh(sets[a] & sets[b]) / weigh(sets[a] | sets[b]), 6)) for a in sets for b in sets if a < b and sets[a] & sets[b])
    assert sorted((r.a, r.b, r.similarity) for r in found.where("kind = 'pair'").collect()) == want


def test_weighted_jaccard_of_all_in_small_lists(spark):
    import random

    from threadloom.operators import clustering

    rng = random.Random(8)
    rows = spark.createDataFrame([(i, x) for i in range(60) for x in rng.sample("abc", rng.randint(1, 2))] + [(None, "a"), (1, None)], "id long, item string")
    weights = spark.createDataFrame([("a", 2.5), ("c", 0.0)], "item string, weight double")
    pairs = clustering.weighted_jaccard_all(rows, weights, chunk=4).where("kind = 'pair'").drop("kind")
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, clustering.weighted_jaccard(rows, weights).collect()))


def test_soft_membership_in_blocks(spark):
    import random

    from threadloom.operators import relations

    rng = random.Random(1)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(30)], "id long, v array<double>")
    profiles = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(20)], "community long, centroid array<double>")
    rows = lambda n: sorted(map(tuple, relations.soft_membership(vectors, profiles, at_once=n).collect()))
    assert rows(3) == rows(2_000) and len(rows(3)) > 30

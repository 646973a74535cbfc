"""Edge cases of the mailbox operators: empty tables, ties, agreement of equal clusterings, refusals."""

import pytest
from pyspark.sql import functions as F

from threadloom.operators import clustering, ranking, relationships, report, scope


@pytest.fixture(scope="module")
def mail(spark):
    rows = [(1, 10, 1, 2, "2020-01-01", False, ["none"]), (2, 10, 2, 1, "2020-01-02", True, ["none"]), (3, 11, 1, 3, "2020-01-03", False, ["hr"]), (4, 11, 3, 1, "2020-01-04", False, ["none"]), (5, 12, 2, 2, "2020-01-05", True, ["none"]), (6, 13, 2, 3, "2020-02-01", False, ["none"])]
    return spark.createDataFrame(rows, "message_id long, thread_id long, sender long, recipient long, ts string, noise boolean, sensitivity array<string>").withColumn("ts", F.col("ts").cast("timestamp"))


def ids(df, c="message_id"):
    return sorted(r[c] for r in df.collect())


def test_gates(mail):
    assert ids(scope.open_threads(mail), "thread_id") == [10, 13]  # a thread of noise alone stays out
    assert ids(scope.open_threads(mail, need_clean=False), "thread_id") == [10, 12, 13]
    assert ids(scope.safe_sources(mail, mail)) == [1, 2, 5, 6]
    assert ids(scope.in_scope(mail, "2020-01-01", "2020-01-31")) == [1]
    none = mail.limit(0)
    assert scope.empty_reason(mail, scope.in_scope(mail, "2020-01-03", "2020-01-05"), "2020-01-03", "2020-01-05").first().code == "filtered"
    assert scope.empty_reason(none, none, None, None).first().code == "empty_window"
    assert scope.in_scope(none).count() == scope.open_threads(none).count() == 0


def test_exchange_counts_a_header_once_and_no_mail_to_oneself(mail):
    got = {(r.a, r.b): r.evidence for r in relationships.direct_exchange(mail.union(mail), mail).collect()}
    assert got == {(1, 2): 2, (1, 3): 2, (2, 3): 1}


def test_claims_lose_citations_and_fall_without_any(spark, mail):
    events = spark.createDataFrame([(1, "decision", "p", [1, 3]), (2, "note", None, [3]), (3, "blocker", "q", [1]), (4, "deadline", None, [6, 6])], "event_id long, type string, project string, cites array<long>")
    allowed = scope.in_scope(mail)
    got = {r.event_id: (r.kind, r.cites) for r in scope.claims(events, allowed, ["p"]).collect()}
    assert got == {1: ("decision", [1]), 4: ("deadline", [6])}
    assert scope.leaked(scope.claims(events, allowed), scope.exclusions(mail, mail.limit(0), mail.limit(0))).count() == 0


def test_equal_clusterings_agree_fully(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(12)] + [(0, 2)], "item long, cluster long")
    assert report.omega_index(a, a).first().omega == 1.0
    assert report.pairwise_f1(a, a).first().f1 == 1.0
    b = spark.createDataFrame([(i, 100 + i) for i in range(12)], "item long, cluster long")
    row = report.pairwise_f1(b, a).first()
    assert (row.precision, row.recall, row.f1) == (0.0, 0.0, 0.0)


def test_rates_without_rows_are_null(spark):
    rows = spark.createDataFrame([("x", False, False)], "k string, predicted boolean, truth boolean")
    row = report.confusion(rows, "k").first()
    assert (row.precision, row.recall, row.fpr, row.precision_trust) == (None, None, 0.0, "low")
    assert report.confusion(rows.limit(0), "k").count() == 0
    assert report.density(rows.limit(0), rows).first().density == 0.0


def test_clusters_carry_their_ids_on(spark):
    new = spark.createDataFrame([(i, i // 4) for i in range(12)], "item long, community long")
    old = spark.createDataFrame([(i, 70 + i // 4) for i in range(6)] + [(9, 99)], "item long, community long")
    assert [(r.new, r.old) for r in clustering.carried_over(new, old).collect()] == [(0, 70), (1, 71)]
    assert sorted(r.community for r in clustering.renumbered(new.withColumn("community", 5 - F.col("community"))).select("community").distinct().collect()) == [0, 1, 2]


def test_ties_and_refusals(spark):
    aff = spark.createDataFrame([(1, 7, 0.5), (1, 3, 0.5), (2, 1, 0.4)], "thread_id long, community long, affinity double")
    assert {r.thread_id: r.community for r in ranking.main_community(aff).collect()} == {1: 3, 2: 1}
    out, ratio = clustering.attached(aff)
    assert {r.thread_id: r.community for r in out.collect()} == {1: 3, 2: None} and ratio.first().recluster
    with pytest.raises(ValueError):
        relationships.of_types(aff, ["love"])
    apart = clustering.separation(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0])], "community long, vector array<double>"))
    assert {r.community: r.separation for r in apart.collect()} == {1: 0.4, 2: 0.4, 3: 1.0}
    assert [r.more for r in ranking.page(aff, [F.col("thread_id"), F.col("community")], 2).collect()] == [True, True]
    assert ranking.sample(aff, 2, 1, "thread_id", "community").collect() == ranking.sample(aff.repartition(3), 2, 1, "thread_id", "community").collect()

"""Queries of the mailbox model: scopes, reports, rankings, clusterings and the relationship map.

The driver's tables stand for a mailbox: orders are messages, their customers threads, suppliers and
customers people, brands projects, parts events that cite the orders of their line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import clustering, ranking, relationships, report, scope
from ..session import table
from .registry import query

MSG = """msg AS (SELECT o_orderkey AS message_id, o_custkey AS thread_id, o_orderkey % 37 AS sender, (o_orderkey * 7 + 3) % 41 AS recipient, o_orderdate AS ts,
  o_orderpriority = '5-LOW' AS noise, CASE WHEN o_custkey % 23 = 0 AND o_orderkey % 3 = 0 THEN 'hr' WHEN o_custkey % 29 = 0 THEN 'legal' ELSE 'none' END AS tag FROM orders),
bad AS (SELECT DISTINCT thread_id FROM msg WHERE tag <> 'none')"""
AFF = """aff AS (SELECT thread_id, community, round(q / sum(q) OVER (PARTITION BY thread_id), 6) AS affinity FROM (
  SELECT l_orderkey AS thread_id, p_size % 12 AS community, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2))"""
MEM = """mem AS (SELECT p_brand AS project, l_suppkey AS person, sum(l_quantity) AS involvement, count(*) AS messages, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS weight
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
EVT = """evt AS (SELECT p_partkey AS event_id, ['decision', 'blocker', 'commitment', 'status_change', 'deadline', 'note'][p_size % 6 + 1] AS type, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_brand END AS project,
  p_size % 5 AS actor, p_size % 7 > 2 AS evidenced, p_size / 50.0 AS confidence FROM part),
cit AS (SELECT DISTINCT l_partkey AS event_id, l_orderkey AS message_id FROM lineitem)"""
EDG = f"""{MSG}, edg AS (SELECT least(sender, recipient) AS a, greatest(sender, recipient) AS b, count(*) AS evidence, min(ts) AS first_seen, max(ts) AS last_seen FROM msg WHERE sender <> recipient GROUP BY 1, 2),
wed AS (SELECT *, round(evidence / (SELECT max(evidence) FROM edg), 6) AS weight, ['vendor', 'lead', 'peer', 'report'][(a + b) % 4 + 1] AS role FROM edg)"""


def joined(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


def day(column: str):
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def messages(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    thread, key = F.col("o_custkey"), F.col("o_orderkey")
    tag = F.when((thread % 23 == 0) & (key % 3 == 0), "hr").when(thread % 29 == 0, "legal").otherwise("none")
    return o.select(key.alias("message_id"), thread.alias("thread_id"), (key % 37).alias("sender"), ((key * 7 + 3) % 41).alias("recipient"), F.col("o_orderdate").alias("ts"), (F.col("o_orderpriority") == "5-LOW").alias("noise"), F.array(tag).alias("sensitivity"))


def affinity(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    q = rows.groupBy(F.col("l_orderkey").alias("thread_id"), (F.col("p_size") % 12).alias("community")).agg(F.sum("l_quantity").alias("q"))
    return q.select("thread_id", "community", F.round(F.col("q") / F.sum("q").over(Window.partitionBy("thread_id")), 6).alias("affinity"))


def members(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_brand").alias("project"), F.col("l_suppkey").alias("person")).agg(F.sum("l_quantity").alias("involvement"), F.count("*").alias("messages"), F.round(F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity"), 6).alias("weight"))


def events(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    kinds = F.array(*[F.lit(x) for x in ("decision", "blocker", "commitment", "status_change", "deadline", "note")])
    p = table(spark, d, "part").select(F.col("p_partkey").alias("event_id"), F.element_at(kinds, size % 6 + 1).alias("type"), F.when(size % 9 != 0, F.col("p_brand")).alias("project"), (size % 5).alias("actor"), (size % 7 > 2).alias("evidenced"), (size / 50.0).alias("confidence"))
    cites = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("event_id")).agg(F.collect_set("l_orderkey").alias("cites"))
    return p.join(cites, "event_id")


def edges(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    found = relationships.direct_exchange(m, m)
    top = found.agg(F.max("evidence").alias("most"))
    roles = F.array(*[F.lit(x) for x in ("vendor", "lead", "peer", "report")])
    return found.join(F.broadcast(top), how="cross").select("a", "b", "evidence", "first_seen", "last_seen", F.round(F.col("evidence") / F.col("most"), 6).alias("weight"), F.element_at(roles, ((F.col("a") + F.col("b")) % 4 + 1).cast("int")).alias("role"))


# ---- gates and scopes -------------------------------------------------------------------------------------


@query("FLT_05_readable", f"WITH {MSG} SELECT message_id FROM msg WHERE NOT noise AND tag = 'none'")
def _(spark, d):
    return scope.readable(messages(spark, d)).select("message_id")


@query("FLT_06_open_threads", f"WITH {MSG} SELECT DISTINCT thread_id FROM msg WHERE NOT noise AND thread_id NOT IN (SELECT thread_id FROM bad)")
def _(spark, d):
    return scope.open_threads(messages(spark, d))


@query("FLT_07_threads_of_noise_pass", f"WITH {MSG} SELECT DISTINCT thread_id FROM msg WHERE thread_id NOT IN (SELECT thread_id FROM bad)")
def _(spark, d):
    return scope.open_threads(messages(spark, d), need_clean=False)


@query("FLT_08_safe_sources", f"WITH {MSG} SELECT message_id, thread_id FROM msg WHERE message_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND tag = 'none' AND thread_id NOT IN (SELECT thread_id FROM bad)")
def _(spark, d):
    asked = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("message_id"))
    return scope.safe_sources(messages(spark, d), asked).select("message_id", "thread_id")


_SCOPE = """WITH {MSG} SELECT message_id FROM msg WHERE NOT noise AND ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1997-07-01' AND thread_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment = 'FURNITURE')
  AND sender IN (SELECT n_nationkey FROM nation) AND message_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_tax = 0.08) AND thread_id NOT IN (SELECT thread_id FROM bad)""".replace("{MSG}", MSG)


def scoped(spark: SparkSession, d: str) -> DataFrame:
    threads = table(spark, d, "customer").where("c_mktsegment in ('BUILDING', 'FURNITURE')").select(F.col("c_custkey").alias("thread_id"))
    people = table(spark, d, "nation").select(F.col("n_nationkey").alias("person_id"))
    out = table(spark, d, "lineitem").where("l_tax = 0.08").select(F.col("l_orderkey").alias("message_id"))
    return scope.in_scope(messages(spark, d), "1995-01-01", "1997-06-30", threads, None, people, out)


@query("FLT_09_scope", _SCOPE)
def _(spark, d):
    return scoped(spark, d).select("message_id")


@query("FLT_10_window_only", f"WITH {MSG} SELECT message_id FROM msg WHERE ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1997-07-01'")
def _(spark, d):
    return scope.in_window(messages(spark, d), "1995-01-01", "1997-06-30").select("message_id")


@query("FLT_11_empty_reason", f"WITH {MSG}, s AS ({_SCOPE.split('bad AS (SELECT DISTINCT thread_id FROM msg WHERE tag <> ' + chr(39) + 'none' + chr(39) + ') ')[1]}) SELECT (SELECT count(*) FROM s) AS scoped, (SELECT count(*) FROM msg WHERE ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1997-07-01') AS windowed, CASE WHEN (SELECT count(*) FROM s) > 0 THEN 'ok' ELSE 'filtered' END AS code")
def _(spark, d):
    return scope.empty_reason(messages(spark, d), scoped(spark, d), "1995-01-01", "1997-06-30")


@query("FLT_12_edge_filter", f"WITH {EDG} SELECT a, b, evidence FROM wed WHERE evidence >= 2 AND weight >= 0.2 AND last_seen >= (SELECT max(ts) FROM msg) - INTERVAL 900 DAY")
def _(spark, d):
    threads = messages(spark, d).select(F.col("ts").alias("t_end"))
    return relationships.filtered_edges(edges(spark, d), threads, 2, 0.2, 900).select("a", "b", "evidence")


@query("FLT_13_orphan_nodes", f"WITH {EDG}, k AS (SELECT a, b FROM wed WHERE weight >= 0.6) SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey = 0 OR c_custkey IN (SELECT a FROM k) OR c_custkey IN (SELECT b FROM k)")
def _(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return relationships.without_orphans(nodes, edges(spark, d).where("weight >= 0.6"), F.lit(0))


@query("FLT_14_roles", f"WITH {EDG} SELECT a AS person, b, role, weight, c_name AS name FROM wed JOIN customer ON a = c_custkey WHERE role IN ('lead', 'peer') AND weight >= 0.3 AND a <> 5")
def _(spark, d):
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("person"), F.col("c_name").alias("name"))
    return relationships.role_edges(edges(spark, d).withColumnRenamed("a", "person"), people, ["lead", "peer"], 0.3, F.lit(5)).select("person", "b", "role", "weight", "name")


@query("FLT_19_event_gate", f"WITH {MSG}, {EVT} SELECT event_id FROM evt WHERE event_id IN (SELECT event_id FROM cit) AND event_id NOT IN (SELECT event_id FROM cit JOIN msg USING (message_id) JOIN bad USING (thread_id))")
def _(spark, d):
    m = messages(spark, d)
    cited = events(spark, d).select("event_id", F.explode("cites").alias("message_id")).join(m, "message_id")
    gated = cited.join(scope.sensitive_threads(m), "thread_id", "left_semi").select("event_id")
    return events(spark, d).select("event_id").join(gated, "event_id", "left_anti")


@query("FLT_20_sole_actor", f"WITH {EVT} SELECT event_id, CASE WHEN actor = 2 THEN least(confidence, 0.3) ELSE confidence END AS confidence FROM evt WHERE event_id IN (SELECT event_id FROM cit) AND (actor <> 2 OR evidenced)")
def _(spark, d):
    return scope.sole_actor(events(spark, d), F.lit(2)).select("event_id", F.col("confidence").cast("double").alias("confidence"))


_PACKAGES = """pk AS (SELECT c_custkey AS package_id, c_nationkey AS mailbox, c_nationkey % 5 AS tenant_id, CASE WHEN c_acctbal > 0 THEN 'published' ELSE 'draft' END AS status, CASE WHEN c_custkey % 11 = 0 THEN TIMESTAMP '2020-01-01' END AS revoked,
  CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2019-12-31' + INTERVAL (c_custkey % 4) DAY END AS expires, CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2020-01-01' END AS consumed, c_mktsegment AS lineage, c_name AS name, c_custkey % 17 AS version FROM customer)"""


def packages(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    at = lambda x: F.lit(x).cast("timestamp")
    expires = F.when(k % 3 == 0, at("2019-12-31") + F.make_interval(days=(k % 4).cast("int")))
    return c.select(
        k.alias("package_id"), F.col("c_nationkey").alias("mailbox"), (F.col("c_nationkey") % 5).alias("tenant_id"), F.when(F.col("c_acctbal") > 0, "published").otherwise("draft").alias("status"), F.when(k % 11 == 0, at("2020-01-01")).alias("revoked"),
        expires.alias("expires"), F.when(k % 4 == 0, at("2020-01-01")).alias("consumed"), F.col("c_mktsegment").alias("lineage"), F.col("c_name").alias("name"), (k % 17).alias("version"),
    )


_NOW = "2020-01-01"


@query("FLT_21_live_packages", f"WITH {_PACKAGES} SELECT package_id FROM pk WHERE status = 'published' AND revoked IS NULL AND (expires IS NULL OR expires > TIMESTAMP '{_NOW}')")
def _(spark, d):
    return packages(spark, d).where(scope.live(F.col("status"), F.col("revoked"), F.col("expires"), F.lit(_NOW).cast("timestamp"))).select("package_id")


@query("FLT_22_tenant", f"WITH {_PACKAGES} SELECT package_id FROM pk WHERE mailbox IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def _(spark, d):
    boxes = table(spark, d, "nation").select(F.col("n_nationkey").alias("mailbox"), F.col("n_regionkey").alias("tenant_id"))
    return scope.of_tenant(packages(spark, d), boxes, 2).select("package_id")


@query("FLT_23_masked", f"WITH {_PACKAGES} SELECT package_id, CASE WHEN tenant_id = 1 THEN name ELSE left(name, 1) || '***' END AS name FROM pk")
def _(spark, d):
    return packages(spark, d).select("package_id", scope.masked(F.col("name"), F.col("tenant_id") == 1).alias("name"))


@query("FLT_25_owned", "SELECT n_nationkey AS mailbox, n_name AS owner FROM nation WHERE n_nationkey = 7 AND n_name = 'NATION_7' AND n_regionkey = 2")
def _(spark, d):
    boxes = table(spark, d, "nation").select(F.col("n_nationkey").alias("mailbox"), F.col("n_name").alias("owner"), F.col("n_regionkey").alias("tenant_id"))
    return scope.owned(boxes, F.lit(7), F.lit("NATION_7"), F.lit(2)).select("mailbox", "owner")


# ---- packages ---------------------------------------------------------------------------------------------

_CLAIMS = f"""{MSG}, {EVT}, ok AS (SELECT message_id FROM msg WHERE NOT noise AND thread_id NOT IN (SELECT thread_id FROM bad)),
cl AS (SELECT event_id, CASE type WHEN 'status_change' THEN 'status' WHEN 'note' THEN 'update' ELSE type END AS kind, project, c.message_id FROM evt JOIN cit c USING (event_id) JOIN ok USING (message_id) WHERE project IS NULL OR project IN ('Brand#13', 'Brand#22', 'Brand#31'))"""


def claimed(spark: SparkSession, d: str) -> DataFrame:
    return scope.claims(events(spark, d), scope.in_scope(messages(spark, d)), ["Brand#13", "Brand#22", "Brand#31"])


@query("PKG_02_claims", f"WITH {_CLAIMS} SELECT event_id, kind, project, string_agg(message_id::VARCHAR, ',' ORDER BY message_id) AS cites FROM cl GROUP BY 1, 2, 3")
def _(spark, d):
    return claimed(spark, d).select("event_id", "kind", "project", joined("cites"))


@query("PKG_03_evidence", f"WITH {_CLAIMS} SELECT message_id, thread_id, strftime(ts, '%Y-%m-%d') AS ts, count(DISTINCT event_id) AS claims FROM cl JOIN msg USING (message_id) GROUP BY 1, 2, 3")
def _(spark, d):
    return scope.evidence(claimed(spark, d), messages(spark, d)).select("message_id", "thread_id", day("ts"), "claims")


@query("PKG_04_frozen_labels", "SELECT o_orderkey AS thread_id, o_custkey AS project_id, c_mktsegment AS label FROM orders JOIN customer ON o_custkey = c_custkey AND o_orderkey % 25 = c_nationkey WHERE c_custkey % 6 <> 0")
def _(spark, d):
    assigned = table(spark, d, "orders").select(F.col("o_orderkey").alias("thread_id"), (F.col("o_orderkey") % 25).alias("mailbox"), F.col("o_custkey").alias("project_id"))
    label = F.when(F.col("c_custkey") % 6 == 0, "  ").otherwise(F.col("c_mktsegment"))
    projects = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("mailbox"), F.col("c_custkey").alias("project_id"), label.alias("label"))
    return scope.frozen_labels(assigned, projects).select("thread_id", "project_id", "label")


_EXCLUDED = "ex AS (SELECT message_id, CASE WHEN thread_id % 13 = 0 THEN 'user_thread' WHEN message_id % 19 = 0 THEN 'user_message' ELSE 'sensitivity' END AS reason FROM msg WHERE thread_id % 13 = 0 OR message_id % 19 = 0 OR thread_id IN (SELECT thread_id FROM bad))"


def excluded(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    return scope.exclusions(m, m.where("thread_id % 13 = 0").select("thread_id"), m.where("message_id % 19 = 0").select("message_id"))


@query("PKG_05_exclusions", f"WITH {MSG}, {_EXCLUDED} SELECT * FROM ex")
def _(spark, d):
    return excluded(spark, d)


@query("SET_05_excluded_but_cited", f"WITH {_CLAIMS}, {_EXCLUDED} SELECT DISTINCT event_id FROM cl WHERE message_id IN (SELECT message_id FROM ex)")
def _(spark, d):
    return scope.leaked(claimed(spark, d), excluded(spark, d))


_FINDINGS = "f AS (SELECT l_orderkey AS package_id, l_linenumber AS finding_id, CASE WHEN l_tax > 0.06 THEN 'high' WHEN l_tax > 0.03 THEN 'medium' ELSE 'low' END AS severity, l_returnflag AS category, CASE WHEN l_discount > 0.03 THEN 'seen' ELSE ' ' END AS reason FROM lineitem)"


def findings(spark: SparkSession, d: str) -> DataFrame:
    severity = F.when(F.col("l_tax") > 0.06, "high").when(F.col("l_tax") > 0.03, "medium").otherwise("low")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("package_id"), F.col("l_linenumber").alias("finding_id"), severity.alias("severity"), F.col("l_returnflag").alias("category"), F.when(F.col("l_discount") > 0.03, "seen").otherwise(" ").alias("reason"))


@query("SET_09_publish_gate", f"WITH {_FINDINGS}, h AS (SELECT DISTINCT package_id, finding_id FROM f WHERE severity = 'high'), a AS (SELECT DISTINCT package_id, finding_id FROM f WHERE reason = 'seen') SELECT p.package_id, count(h.finding_id) AS open, count(h.finding_id) = 0 AS may_publish FROM (SELECT DISTINCT package_id FROM f) p LEFT JOIN (SELECT * FROM h EXCEPT SELECT * FROM a) h USING (package_id) GROUP BY 1")
def _(spark, d):
    return scope.may_publish(findings(spark, d), findings(spark, d))


@query("WIN_23_finding_order", f"WITH {_FINDINGS} SELECT package_id, finding_id, category, row_number() OVER (PARTITION BY package_id ORDER BY CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, category, finding_id) AS place FROM (SELECT DISTINCT package_id, finding_id, category, severity FROM f)")
def _(spark, d):
    return ranking.finding_order(findings(spark, d).drop("reason").distinct()).select("package_id", "finding_id", "category", "place")


@query("AGG_38_next_version", f"WITH {_PACKAGES} SELECT lineage, max(version) + 1 AS next_version FROM pk GROUP BY 1")
def _(spark, d):
    return report.next_versions(packages(spark, d))


@query("AGG_39_recipient_states", f"WITH {_PACKAGES} SELECT state, count(*) AS n FROM (SELECT CASE WHEN revoked IS NOT NULL THEN 'revoked' WHEN expires <= TIMESTAMP '{_NOW}' THEN 'expired' WHEN consumed IS NOT NULL THEN 'consumed' ELSE 'granted' END AS state FROM pk) GROUP BY 1")
def _(spark, d):
    p = packages(spark, d)
    return report.counts_by(p.select(report.recipient_state(F.col("revoked"), F.col("expires"), F.col("consumed"), F.lit(_NOW).cast("timestamp")).alias("state")), "state")


# ---- reports ----------------------------------------------------------------------------------------------


@query("AGG_16_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def _(spark, d):
    return report.counts_by(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("AGG_17_global_counts", f"WITH {EDG} SELECT (SELECT count(*) FROM msg) AS messages, (SELECT count(*) FROM msg WHERE noise) AS noise, (SELECT count(DISTINCT thread_id) FROM msg) AS threads, 0 AS synthetic, (SELECT count(*) FROM customer) AS people, (SELECT count(*) FROM edg) AS edges")
def _(spark, d):
    return report.global_counts(messages(spark, d), people=table(spark, d, "customer"), edges=edges(spark, d))


@query("AGG_19_top_domains", "SELECT domain, count(*) AS n FROM (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS domain FROM pages) WHERE domain IS NOT NULL GROUP BY 1 ORDER BY n DESC, domain LIMIT 25")
def _(spark, d):
    return report.top_values(table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("domain")), "domain")


@query("AGG_22_owner_threads", f"WITH {MSG} SELECT sender, count(DISTINCT thread_id) AS threads FROM msg GROUP BY 1")
def _(spark, d):
    return messages(spark, d).groupBy("sender").agg(F.count_distinct("thread_id").alias("threads"))


@query("AGG_23_density", f"WITH {EDG} SELECT e AS edges, n AS nodes, round(e / (n * (n - 1) / 2), 6) AS density FROM (SELECT (SELECT count(*) FROM edg) AS e, (SELECT count(*) FROM customer) AS n)")
def _(spark, d):
    return report.density(edges(spark, d), table(spark, d, "customer"))


@query("AGG_24_many_identities", "SELECT o_custkey AS person_id, count(DISTINCT o_orderdate) AS identities FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderdate) > 3 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return report.many_identities(table(spark, d, "orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderdate").alias("email")))


@query("AGG_25_duplicate_names", r"SELECT lower(trim(regexp_replace(p_name, '\s+', ' ', 'g'))) AS name, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS people FROM part GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return report.duplicate_names(table(spark, d, "part").select(F.col("p_partkey").alias("person_id"), F.col("p_name").alias("name"))).select("name", joined("people"))


@query("AGG_26_weight_by_role", f"WITH {EDG} SELECT role, count(*) AS n, round(avg(weight), 4) AS mean_weight, round(sum(weight), 4) AS total_weight FROM wed GROUP BY 1")
def _(spark, d):
    return report.weight_by_role(edges(spark, d))


@query("AGG_27_thread_people", f"WITH {MSG} SELECT thread_id, string_agg(sender::VARCHAR, ',' ORDER BY sender) AS people FROM (SELECT DISTINCT thread_id, sender FROM msg) GROUP BY 1")
def _(spark, d):
    return messages(spark, d).groupBy("thread_id").agg(F.sort_array(F.collect_set("sender")).alias("people")).select("thread_id", joined("people"))


@query("AGG_28_last_export", "SELECT user_id, strftime(max(ts) FILTER (WHERE event_type ILIKE 'p%'), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY 1")
def _(spark, d):
    last = F.max(F.when(F.lower("event_type").like("p%"), F.col("ts")))
    return table(spark, d, "events").groupBy("user_id").agg(F.date_format(last, "yyyy-MM-dd HH:mm:ss").alias("last"))


#: Rates of a confusion matrix and how far to trust them
_RATES = """, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall, CASE WHEN fp + tn > 0 THEN round(fp / (fp + tn), 6) END AS fpr,
CASE WHEN tp + fp < 10 THEN 'low' WHEN tp + fp < 20 THEN 'weak' ELSE 'ok' END AS precision_trust, CASE WHEN tp + fn < 10 THEN 'low' WHEN tp + fn < 20 THEN 'weak' ELSE 'ok' END AS recall_trust"""
#: Cells of a confusion matrix
_COUNTED = "count(*) FILTER (WHERE predicted AND truth) AS tp, count(*) FILTER (WHERE predicted AND NOT truth) AS fp, count(*) FILTER (WHERE NOT predicted AND truth) AS fn, count(*) FILTER (WHERE NOT predicted AND NOT truth) AS tn"


@query("AGG_29_confusion_with_trust", f"WITH t AS (SELECT l_suppkey AS k, l_tax >= 0.07 AS predicted, l_discount >= 0.05 AS truth FROM lineitem), c AS (SELECT k, {_COUNTED} FROM t GROUP BY k) SELECT k, tp, fp, fn, tn{_RATES} FROM c")
def _(spark, d):
    return report.confusion(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_tax") >= 0.07).alias("predicted"), (F.col("l_discount") >= 0.05).alias("truth")), "k")


@query("AGG_30_class_rates", f"""WITH x AS (SELECT [CASE WHEN l_tax > 0.06 THEN 'hr' ELSE 'none' END, CASE WHEN l_tax < 0.02 THEN 'legal' ELSE 'none' END] AS p, [CASE WHEN l_discount > 0.05 THEN 'hr' ELSE 'none' END, CASE WHEN l_discount < 0.02 THEN 'legal' ELSE 'none' END] AS g FROM lineitem),
t AS (SELECT class, list_contains(p, class) AS predicted, list_contains(g, class) AS truth FROM x, (VALUES ('hr'), ('legal'), ('privileged')) v(class)), c AS (SELECT class, {_COUNTED} FROM t GROUP BY class) SELECT class, tp, fp, fn, tn{_RATES} FROM c""")
def _(spark, d):
    tags = lambda c, hi, lo: F.array(F.when(F.col(c) > hi, "hr").otherwise("none"), F.when(F.col(c) < lo, "legal").otherwise("none"))
    rows = table(spark, d, "lineitem").select(tags("l_tax", 0.06, 0.02).alias("predicted_tags"), tags("l_discount", 0.05, 0.02).alias("true_tags"))
    return report.class_rates(rows, ["hr", "legal", "privileged"])


@query("AGG_31_false_noise", "SELECT p_brand AS project, count(*) AS clean, count(*) FILTER (WHERE l_tax >= 0.07) AS flagged, round(count(*) FILTER (WHERE l_tax >= 0.07) / count(*), 6) AS rate FROM lineitem JOIN part ON l_partkey = p_partkey WHERE NOT l_returnflag = 'R' GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return report.false_rate(rows.select(F.col("p_brand").alias("project"), (F.col("l_tax") >= 0.07).alias("noise"), (F.col("l_returnflag") == "R").alias("is_noise")), "noise", "is_noise", "project")


@query("AGG_32_checks", """WITH m AS (SELECT o_orderpriority AS metric, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS value FROM orders GROUP BY 1),
t AS (SELECT * FROM (VALUES ('1-URGENT', 'least', 0.1, true), ('2-HIGH', 'most', 0.05, true), ('5-LOW', 'least', 0.99, false), ('none', 'least', 0.5, false), ('gone', 'most', 0.5, true)) v(metric, direction, bound, hard))
SELECT metric, direction, bound::DOUBLE AS bound, hard, value, CASE WHEN CASE WHEN direction = 'least' THEN value >= bound ELSE value <= bound END THEN 'pass' WHEN value IS NULL AND NOT hard THEN 'no_data' WHEN hard THEN 'fail' ELSE 'miss' END AS status FROM t LEFT JOIN m USING (metric)""")
def _(spark, d):
    m = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("metric")).agg(F.round(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)), 6).alias("value"))
    return report.checked(m, {"1-URGENT": ("least", 0.1, True), "2-HIGH": ("most", 0.05, True), "5-LOW": ("least", 0.99, False), "none": ("least", 0.5, False), "gone": ("most", 0.5, True)})


@query("AGG_33_rank_metrics", "WITH f AS (SELECT l_orderkey, min(l_linenumber) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) SELECT count(*) AS cases, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr, round(avg(CASE WHEN r = 1 THEN 1.0 ELSE 0.0 END), 6) AS top1 FROM f")
def _(spark, d):
    return report.rank_metrics(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("rank"), (F.col("l_returnflag") == "R").alias("relevant")))


_CLUSTERS = """f AS (SELECT DISTINCT c_custkey AS item, c_nationkey AS cluster FROM customer UNION SELECT c_custkey, 100 + c_custkey % 40 FROM customer WHERE c_custkey % 3 = 0),
g AS (SELECT DISTINCT c_custkey AS item, c_nationkey - c_nationkey % 2 AS cluster FROM customer UNION SELECT c_custkey, 100 + c_custkey % 50 FROM customer WHERE c_custkey % 2 = 0),
fp AS (SELECT a.item AS a, b.item AS b, count(*) AS x FROM f a JOIN f b ON a.cluster = b.cluster AND a.item < b.item GROUP BY 1, 2), gp AS (SELECT a.item AS a, b.item AS b, count(*) AS y FROM g a JOIN g b ON a.cluster = b.cluster AND a.item < b.item GROUP BY 1, 2),
p AS (SELECT coalesce(x, 0) AS x, coalesce(y, 0) AS y, count(*) AS n FROM fp FULL JOIN gp USING (a, b) GROUP BY 1, 2)"""


def clusterings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c, k, n = table(spark, d, "customer"), F.col("c_custkey"), F.col("c_nationkey")
    both = lambda first, second, where: c.select(k.alias("item"), first.cast("long").alias("cluster")).union(c.where(where).select(k, second.cast("long"))).distinct()
    return both(n, 100 + k % 40, k % 3 == 0), both(n - n % 2, 100 + k % 50, k % 2 == 0)


@query("AGG_36_pairwise_f1", f"WITH {_CLUSTERS}, t AS (SELECT sum(n) FILTER (WHERE x > 0 AND y > 0) AS tp, sum(n) FILTER (WHERE y = 0) AS fp, sum(n) FILTER (WHERE x = 0) AS fn FROM p) SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM t")
def _(spark, d):
    return report.pairwise_f1(*clusterings(spark, d))


@query("AGG_35_omega_index", f"""WITH {_CLUSTERS}, c AS (SELECT (SELECT count(DISTINCT item) FROM f) AS items), s AS (SELECT items * (items - 1) / 2.0 AS al, (SELECT sum(n) FROM p) AS som, (SELECT sum(n) FROM p WHERE x = y) AS same FROM c),
h AS (SELECT k, sum(nx) AS nx, sum(ny) AS ny FROM (SELECT x AS k, n AS nx, 0 AS ny FROM p WHERE x > 0 UNION ALL SELECT y, 0, n FROM p WHERE y > 0) GROUP BY 1), z AS (SELECT sum(nx * ny) AS cross_, sum(nx) AS xs, sum(ny) AS ys FROM h),
o AS (SELECT (same + al - som) / al AS seen, (cross_ + (al - xs) * (al - ys)) / (al * al) AS chance FROM s, z) SELECT round((seen - chance) / (1 - chance), 6) AS omega FROM o""")
def _(spark, d):
    return report.omega_index(*clusterings(spark, d))


@query("AGG_44_worst_of", "SELECT l_orderkey AS key, CASE max(CASE WHEN l_tax > 0.06 THEN 3 WHEN l_tax > 0.03 THEN 2 ELSE 1 END) WHEN 3 THEN 'blocked' WHEN 2 THEN 'warn' ELSE 'ready' END AS overall FROM lineitem GROUP BY 1")
def _(spark, d):
    status = F.when(F.col("l_tax") > 0.06, "blocked").when(F.col("l_tax") > 0.03, "warn").otherwise("ready")
    return report.worst_of(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), status.alias("status")), ["ready", "warn", "blocked"])


@query("AGG_45_backfill_plan", "WITH t AS (SELECT doc_id, coalesce(length(text), 0) AS chars, doc_id % 3 = 0 AND text IS NOT NULL AS have FROM documents) SELECT count(*) AS total, count(*) FILTER (WHERE have) AS already, count(*) FILTER (WHERE NOT have) AS to_embed, coalesce(sum(chars // 4) FILTER (WHERE NOT have), 0)::BIGINT AS tokens, round(coalesce(sum(chars // 4) FILTER (WHERE NOT have), 0) / 1000 * 0.000006, 8) AS cost FROM t")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("message_id"), "text")
    done = docs.where("message_id % 3 = 0").select("message_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    return report.backfill_plan(docs, done)


@query("AGG_46_stuck_jobs", "WITH m AS (SELECT max(o_orderdate) AS l FROM orders) SELECT strftime(l, '%Y-%m-%d') AS last_started, count(*) FILTER (WHERE o_orderstatus = 'O' AND epoch(l) - epoch(o_orderdate) > 8640000) AS stuck, count(*) FILTER (WHERE o_orderstatus = 'O') AS running FROM orders, m GROUP BY l")
def _(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_orderdate").alias("started"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"))
    return report.stuck_jobs(jobs, 8_640_000).select(day("last_started"), "stuck", "running")


# ---- rankings ---------------------------------------------------------------------------------------------


@query("WIN_05_main_community", f"WITH {AFF} SELECT thread_id, community, affinity FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY affinity DESC, community) AS r FROM aff) WHERE r = 1")
def _(spark, d):
    return ranking.main_community(affinity(spark, d))


@query("WIN_06_primary", f"WITH {AFF} SELECT thread_id, community, affinity, row_number() OVER (PARTITION BY thread_id ORDER BY affinity DESC, community) = 1 AS is_primary FROM aff")
def _(spark, d):
    return ranking.with_primary(affinity(spark, d))


@query("WIN_11_who_to_ask", f"WITH {MEM} SELECT project, person, weight, involvement, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY weight DESC, involvement DESC, person) AS r FROM mem) WHERE r <= 4")
def _(spark, d):
    return ranking.who_to_ask(members(spark, d)).select("project", "person", "weight", "involvement", "rank")


@query("WIN_12_asked_with_headers", f"""WITH {MEM}, h AS (SELECT DISTINCT p_brand AS project, l_suppkey AS person, l_orderkey AS header FROM lineitem JOIN part ON l_partkey = p_partkey), k AS (SELECT *, row_number() OVER (PARTITION BY project, person ORDER BY header) AS r FROM h),
s AS (SELECT project, person, string_agg(header::VARCHAR, ',' ORDER BY header) AS headers FROM k WHERE r <= 3 GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY involvement DESC, person) AS rank FROM mem) SELECT project, person, rank, headers FROM t JOIN s USING (project, person) WHERE rank <= 3""")
def _(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    cites = rows.select(F.col("p_brand").alias("project"), F.col("l_suppkey").alias("person"), F.col("l_orderkey").alias("header"))
    return ranking.asked_with_headers(members(spark, d), cites).select("project", "person", "rank", joined("headers"))


@query("WIN_13_recent_threads", "SELECT o_custkey AS person, o_orderkey AS thread_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 10")
def _(spark, d):
    return ranking.recent(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", 10).select(F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("thread_id"), "rank")


_LATEST = f"{MSG}, {EVT}, lat AS (SELECT event_id, project, coalesce(max(ts), TIMESTAMP '1970-01-01') AS seen FROM evt LEFT JOIN cit USING (event_id) LEFT JOIN msg USING (message_id) GROUP BY 1, 2)"


def latest(spark: SparkSession, d: str) -> DataFrame:
    """Events with the time of the last message they cite, the epoch without any."""
    e = table(spark, d, "part").select(F.col("p_partkey").alias("event_id"), F.when(F.col("p_size") % 9 != 0, F.col("p_brand")).alias("project"))
    cited = events(spark, d).select("event_id", F.explode("cites").alias("message_id")).join(messages(spark, d), "message_id")
    return e.join(cited.groupBy("event_id").agg(F.max("ts").alias("seen")), "event_id", "left").withColumn("seen", F.coalesce("seen", F.lit("1970-01-01").cast("timestamp")))


@query("JOIN_08_last_cited", f"WITH {_LATEST} SELECT event_id, strftime(seen, '%Y-%m-%d') AS seen FROM lat")
def _(spark, d):
    return latest(spark, d).select("event_id", day("seen"))


@query("JOIN_09_recent_projects", f"WITH {_LATEST} SELECT DISTINCT project FROM lat WHERE project IS NOT NULL AND seen >= TIMESTAMP '2001-06-01'")
def _(spark, d):
    return latest(spark, d).where(F.col("project").isNotNull() & (F.col("seen") >= F.lit("2001-06-01").cast("timestamp"))).select("project").distinct()


@query("WIN_14_cited_events", f"WITH {_LATEST} SELECT project, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY seen DESC, event_id) AS rank FROM lat WHERE project IS NOT NULL) WHERE rank <= 20")
def _(spark, d):
    return ranking.recent(latest(spark, d).where("project is not null"), ["project"], "seen", "event_id", 20).select("project", "event_id", "rank")


@query("WIN_15_default_project", "SELECT mailbox, project_id FROM (SELECT p_size AS mailbox, p_partkey AS project_id, row_number() OVER (PARTITION BY p_size ORDER BY round(p_retailprice / 100) DESC, p_name, p_partkey) AS r FROM part) WHERE r = 1")
def _(spark, d):
    rows = table(spark, d, "part").select(F.col("p_size").alias("mailbox"), F.col("p_partkey").alias("project_id"), F.col("p_name").alias("label"), F.round(F.col("p_retailprice") / 100).alias("confidence"))
    return ranking.default_project(rows).select("mailbox", "project_id")


@query("WIN_16_capped_graph", f"WITH {EDG}, n AS (SELECT c_custkey AS id FROM customer ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END, c_name, c_custkey LIMIT 40) SELECT a, b, weight FROM wed WHERE a IN (SELECT id FROM n) AND b IN (SELECT id FROM n) ORDER BY weight DESC, a, b LIMIT 100")
def _(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type"), F.col("c_name").alias("label"))
    nodes = nodes.withColumn("type", F.when(F.col("type").isin("MACHINERY", "BUILDING"), F.col("type")).otherwise("other"))
    return ranking.capped_graph(nodes, edges(spark, d), ["MACHINERY", "BUILDING", "other"], 40, 100)[1].select("a", "b", "weight")


@query("WIN_17_first_citations", f"WITH {EVT}, k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY message_id) AS r, count(*) OVER (PARTITION BY event_id) AS total FROM cit) SELECT event_id, any_value(total) AS total, string_agg(message_id::VARCHAR, ',' ORDER BY message_id) AS citations FROM k WHERE r <= 25 GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("event_id"), F.col("l_orderkey").alias("message_id"))
    return ranking.first_citations(rows, ["event_id"], "message_id").select("event_id", "total", joined("citations"))


@query("WIN_18_seeded_sample", "SELECT o_orderkey FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 50")
def _(spark, d):
    return ranking.sample(table(spark, d, "orders"), 50, 42, "o_orderkey").select("o_orderkey")


@query("WIN_19_stratified_sample", "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('7|' || o_orderpriority || '|' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 12")
def _(spark, d):
    return ranking.stratified(table(spark, d, "orders"), "o_orderpriority", 12, 7, "o_orderkey").select("o_orderpriority", "o_orderkey")


@query("WIN_25_thread_order", f"WITH {MSG} SELECT message_id, thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY ts, message_id) AS place FROM msg")
def _(spark, d):
    return ranking.in_thread_order(messages(spark, d)).select("message_id", "thread_id", "place")


@query("WIN_27_page", "SELECT o_orderkey, (SELECT count(*) FROM orders) > 100 AS more FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def _(spark, d):
    return ranking.page(table(spark, d, "orders"), [F.desc("o_orderdate"), F.col("o_orderkey")], 100).select("o_orderkey", "more")


@query("WIN_28_candidate_labels", "SELECT p_brand AS label, row_number() OVER (ORDER BY CASE p_brand WHEN 'Brand#22' THEN 2 WHEN 'Brand#13' THEN 1 ELSE 0 END, lower(p_brand), p_brand) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def _(spark, d):
    return ranking.candidate_labels(table(spark, d, "part").select(F.col("p_brand").alias("label")), "Brand#13", "Brand#22")


# ---- clusterings ------------------------------------------------------------------------------------------

_VEC = "vec AS (SELECT vec_id AS id, label AS community, embedding AS v FROM embeddings)"
_MEAN = f"""{_VEC}, e AS (SELECT community, unnest(v)::DOUBLE AS x, generate_subscripts(v, 1) AS i FROM vec), m AS (SELECT community, i, sum(x) / count(*) AS m FROM e GROUP BY 1, 2), n AS (SELECT community, sqrt(sum(m * m)) AS n FROM m GROUP BY 1)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("community"), F.col("embedding").alias("v"))


@query("AGG_08_mean_vectors", """WITH e AS (SELECT label AS community, 1 + vec_id % 3 AS w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT community, i, sum(x * w) / sum(w) AS m FROM e GROUP BY 1, 2),
n AS (SELECT community, sqrt(sum(m * m)) AS n FROM m GROUP BY 1) SELECT community, i - 1 AS i, round(m / n, 4) AS x FROM m JOIN n USING (community)""")
def _(spark, d):
    weighted = vectors(spark, d).withColumn("w", 1 + F.col("id") % 3)
    return clustering.mean_vectors(weighted, "community", "w").select("community", F.posexplode("vector").alias("i", "x")).withColumn("x", F.round("x", 4))


@query("AGG_09_sent_counts", f"WITH {MSG}, c AS (SELECT thread_id, sender, count(*) AS n FROM msg GROUP BY 1, 2) SELECT thread_id, string_agg(sender || ':' || n, ',' ORDER BY sender) AS sent, coalesce(string_agg(sender::VARCHAR, ',' ORDER BY sender) FILTER (WHERE sender <> 3), '') AS participants FROM c GROUP BY 1")
def _(spark, d):
    out = clustering.sent_counts(messages(spark, d), F.lit(3))
    pairs = F.transform(F.array_sort(F.map_entries("sent")), lambda p: F.concat_ws(":", p["key"], p["value"]))
    return out.select("thread_id", F.array_join(pairs, ",").alias("sent"), joined("participants"))


@query("AGG_11_project_members", f"WITH {AFF} SELECT community AS project, l_suppkey AS person, round(sum(affinity * n), 6) AS involvement, sum(n)::BIGINT AS message_count FROM aff JOIN (SELECT l_orderkey AS thread_id, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) USING (thread_id) GROUP BY 1, 2")
def _(spark, d):
    sent = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("thread_id"), F.col("l_suppkey").alias("person")).agg(F.count("*").alias("n"))
    return clustering.project_members(affinity(spark, d).withColumnRenamed("community", "project"), sent)


@query("AGG_12_cohesion", f"""WITH {_VEC}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY md5('0|' || community || '|' || id), id) AS r FROM vec) WHERE r <= 200),
p AS (SELECT a.community, avg(list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[])) AS c FROM k a JOIN k b ON a.community = b.community AND a.id < b.id GROUP BY 1) SELECT k.community, round(coalesce(any_value(c), 1.0), 4) AS cohesion FROM k LEFT JOIN p USING (community) GROUP BY 1""")
def _(spark, d):
    return clustering.cohesion(vectors(spark, d))


_SEP = f"{_MEAN}, u AS (SELECT community, i, m / n AS x FROM m JOIN n USING (community)), s AS (SELECT a.community, b.community AS other, sum(a.x * b.x) AS c FROM u a JOIN u b ON a.i = b.i AND a.community <> b.community GROUP BY 1, 2)"


@query("AGG_13_separation", f"WITH {_SEP} SELECT community, round(1 - max(c), 4) AS separation FROM s GROUP BY 1")
def _(spark, d):
    return clustering.separation(clustering.mean_vectors(vectors(spark, d), "community"))


@query("GRF_11_confidence", f"""WITH {_SEP}, z AS (SELECT community, count(*) AS size FROM vec GROUP BY 1), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY md5('0|' || community || '|' || id), id) AS r FROM vec) WHERE r <= 200),
p AS (SELECT a.community, avg(list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[])) AS c FROM k a JOIN k b ON a.community = b.community AND a.id < b.id GROUP BY 1)
SELECT z.community, round(greatest(0, least(1, 0.5 * round(coalesce(any_value(p.c), 1.0), 4) + 0.3 * round(1 - max(s.c), 4) + 0.2 * least(1, any_value(size) / 10))), 3) AS confidence FROM s JOIN z USING (community) LEFT JOIN p USING (community) GROUP BY 1""")
def _(spark, d):
    v = vectors(spark, d)
    rows = clustering.separation(clustering.mean_vectors(v, "community")).join(v.groupBy("community").agg(F.count("*").alias("size")), "community").join(clustering.cohesion(v), "community")
    return rows.select("community", clustering.project_confidence(F.col("cohesion"), F.col("separation"), F.col("size")).alias("confidence"))


@query("SIM_03_weighted_jaccard", """WITH s AS (SELECT DISTINCT o_custkey AS id, o_orderpriority AS item FROM orders), w AS (SELECT * FROM (VALUES ('1-URGENT', 2.5), ('5-LOW', 0.25)) v(item, weight)), k AS (SELECT id, list(item ORDER BY item) AS items FROM s GROUP BY 1),
c AS (SELECT id, min(id) OVER (PARTITION BY items) AS class FROM k), r AS (SELECT id, item, coalesce(weight, 1.0)::DOUBLE AS w FROM s LEFT JOIN w USING (item)), o AS (SELECT id, sum(w) AS own FROM r GROUP BY 1),
p AS (SELECT a.id AS a, b.id AS b, sum(a.w) AS both_ FROM r a JOIN r b ON a.item = b.item AND a.id < b.id GROUP BY 1, 2)
SELECT 'member' AS kind, class AS a, id AS b, 1.0::DOUBLE AS similarity FROM c UNION ALL SELECT 'pair', a, b, round(both_ / (x.own + y.own - both_), 6) FROM p JOIN o x ON a = x.id JOIN o y ON b = y.id""")
def _(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("item"))
    return clustering.weighted_jaccard_all(rows, spark.createDataFrame([("1-URGENT", 2.5), ("5-LOW", 0.25)], "item string, weight double"))


@query("SIM_05_thread_similarity", "SELECT l_orderkey AS a, l_linenumber AS b, round(0.35 * l_discount + 0.30 * greatest(0.05 - l_tax, 0) + 0.20 * l_quantity / 50 + 0.10 * l_tax + 0.05 * (l_linenumber % 2), 6) AS w FROM lineitem")
def _(spark, d):
    score = clustering.thread_similarity(F.col("l_discount"), 0.05 - F.col("l_tax"), F.col("l_quantity") / 50, F.col("l_tax"), F.col("l_linenumber") % 2)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.round(score, 6).alias("w"))


@query("JOIN_17_rare_pairs", """WITH m AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS m FROM lineitem), d AS (SELECT m, count(*) AS df FROM m GROUP BY 1), r AS (SELECT m.* FROM m JOIN d USING (m) WHERE df <= 300 AND NOT df > 0.5 * (SELECT count(DISTINCT g) FROM m)) SELECT a.g AS a, b.g AS b, count(*) AS shared FROM r a JOIN r b ON a.m = b.m AND a.g < b.g GROUP BY 1, 2""")
def _(spark, d):
    return clustering.rare_pairs(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("member")))


_GRAPH = f"{EDG}, th AS (SELECT a, b, weight AS w FROM wed WHERE weight >= 0.4), r AS (SELECT a, b, w, row_number() OVER (PARTITION BY node ORDER BY w DESC, other) AS r FROM (SELECT *, a AS node, b AS other FROM th UNION ALL SELECT *, b, a FROM th))"


@query("GRF_04_similarity_graph", f"WITH {_GRAPH} SELECT DISTINCT a, b, w FROM r WHERE r <= 15")
def _(spark, d):
    return clustering.similarity_graph(edges(spark, d).withColumnRenamed("weight", "w"), 0.4)


@query("GRF_07_renumbered", "WITH c AS (SELECT o_custkey AS item, max(o_orderkey % 19) AS community FROM orders GROUP BY 1), f AS (SELECT community, row_number() OVER (ORDER BY min(item)) - 1 AS n FROM c GROUP BY 1) SELECT item, n AS community FROM c JOIN f USING (community)")
def _(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("item")).agg(F.max(F.col("o_orderkey") % 19).alias("community"))
    return clustering.renumbered(rows)


_TOP = f"{AFF}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY affinity DESC, community) AS r FROM aff) WHERE r = 1)"


@query("GRF_12_attached", f"WITH {_TOP} SELECT thread_id, CASE WHEN affinity >= 0.45 THEN community END AS community, affinity FROM top")
def _(spark, d):
    return clustering.attached(affinity(spark, d))[0]


@query("GRF_12_orphan_ratio", f"WITH {_TOP} SELECT round(count(*) FILTER (WHERE affinity < 0.45) / count(*), 6) AS orphan_ratio, round(count(*) FILTER (WHERE affinity < 0.45) / count(*), 6) > 0.15 AS recluster FROM top")
def _(spark, d):
    return clustering.attached(affinity(spark, d))[1]


_CARRY = """new_ AS (SELECT c_custkey AS item, c_nationkey::BIGINT AS c FROM customer), old_ AS (SELECT c_custkey AS item, 500 + CASE WHEN c_custkey % 4 = 0 THEN 99 ELSE c_nationkey END AS c FROM customer WHERE c_custkey % 10 <> 3),
b AS (SELECT n.c AS n, o.c AS o, count(*) AS k FROM new_ n JOIN old_ o USING (item) GROUP BY 1, 2), j AS (SELECT n, o, k / ((SELECT count(*) FROM new_ WHERE c = n) + (SELECT count(*) FROM old_ WHERE c = o) - k) AS jaccard FROM b)"""


def both_clusterings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    new = c.select(k.alias("item"), F.col("c_nationkey").cast("long").alias("community"))
    old = c.where(k % 10 != 3).select(k.alias("item"), (500 + F.when(k % 4 == 0, 99).otherwise(F.col("c_nationkey"))).cast("long").alias("community"))
    return new, old


@query("GRF_13_carried_over", f"WITH {_CARRY} SELECT n AS new, o AS old, round(jaccard, 6) AS jaccard FROM j WHERE jaccard >= 0.5 QUALIFY row_number() OVER (PARTITION BY n ORDER BY jaccard DESC, o) = 1 AND row_number() OVER (PARTITION BY o ORDER BY jaccard DESC, n) = 1")
def _(spark, d):
    return clustering.carried_over(*both_clusterings(spark, d))


@query("GRF_14_sticky_labels", f"WITH {_CARRY} SELECT n AS new, (SELECT n_name FROM nation WHERE 500 + n_nationkey = o) AS label FROM j WHERE jaccard >= 0.5 AND o IN (SELECT 500 + n_nationkey FROM nation WHERE n_nationkey % 2 = 0) QUALIFY row_number() OVER (PARTITION BY n ORDER BY jaccard DESC, o) = 1")
def _(spark, d):
    own = table(spark, d, "nation").where("n_nationkey % 2 = 0").select((500 + F.col("n_nationkey")).cast("long").alias("community"), F.col("n_name").alias("label"))
    new, old = both_clusterings(spark, d)
    return clustering.sticky_labels(new, old.join(own, "community"))


# ---- the relationship map ---------------------------------------------------------------------------------


@query("GRF_15_direct_exchange", f"WITH {MSG} SELECT least(sender, recipient) AS a, greatest(sender, recipient) AS b, count(*) AS evidence, strftime(min(ts), '%Y-%m-%d') AS first_seen, strftime(max(ts), '%Y-%m-%d') AS last_seen FROM msg WHERE sender <> recipient AND tag = 'none' AND thread_id NOT IN (SELECT thread_id FROM bad) GROUP BY 1, 2")
def _(spark, d):
    m = messages(spark, d)
    return relationships.direct_exchange(m, scope.safe_sources(m, m)).select("a", "b", "evidence", day("first_seen"), day("last_seen"))


@query("GRF_16_owner_exchange", f"WITH {MSG} SELECT CASE WHEN sender = 3 THEN recipient ELSE sender END AS person, count(*) AS headers, strftime(min(ts), '%Y-%m-%d') AS first_seen, strftime(max(ts), '%Y-%m-%d') AS last_seen FROM msg WHERE (sender = 3) <> (recipient = 3) GROUP BY 1")
def _(spark, d):
    return relationships.owner_exchange(messages(spark, d), F.lit(3)).select("person", "headers", day("first_seen"), day("last_seen"))


@query("GRF_17_relevant_people", f"WITH {EDG}, {MEM} SELECT a AS person FROM edg UNION SELECT b FROM edg UNION SELECT person FROM mem")
def _(spark, d):
    return relationships.relevant_people(edges(spark, d), members(spark, d))


_PEOPLE = "pp AS (SELECT c_custkey AS person, CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'mail.example' ELSE 'Org' || c_nationkey || '.example' END AS domain FROM customer)"


def people(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    domain = F.when(k % 8 == 0, None).when(k % 5 == 0, "mail.example").otherwise(F.concat(F.lit("Org"), "c_nationkey", F.lit(".example")))
    return table(spark, d, "customer").select(k.alias("person"), domain.alias("domain"))


@query("GRF_18_affiliations", f"WITH {_PEOPLE} SELECT person, 'org:' || lower(domain) AS node FROM pp WHERE domain IS NOT NULL AND domain <> 'mail.example'")
def _(spark, d):
    return relationships.affiliations(people(spark, d), ["mail.example"])


@query("GRF_20_org_groups", f"WITH {_PEOPLE} SELECT lower(domain) AS domain, count(*) AS members, count(*) >= 5 AND lower(domain) <> 'org3.example' AS folded FROM pp WHERE domain IS NOT NULL GROUP BY 1 HAVING count(*) >= 2")
def _(spark, d):
    return relationships.org_groups(people(spark, d).where("domain is not null"), "org3.example")


@query("AGG_42_org_groups", f"WITH {_PEOPLE} SELECT lower(domain) AS domain, count(*) AS members, count(*) >= 9 AND lower(domain) <> 'org3.example' AS folded FROM pp WHERE domain IS NOT NULL GROUP BY 1 HAVING count(*) >= 3")
def _(spark, d):
    return relationships.org_groups(people(spark, d).where("domain is not null"), "org3.example", 3, 9)


@query("JOIN_16_co_members", f"WITH {MEM} SELECT x.person AS a, y.person AS b, count(*) AS projects FROM mem x JOIN mem y ON x.project = y.project AND x.person < y.person GROUP BY 1, 2")
def _(spark, d):
    return relationships.co_members(members(spark, d))


@query("GRF_21_project_star", f"WITH {MEM} SELECT 'project:' || project AS a, 'person:' || person AS b, round(involvement, 6) AS weight FROM mem")
def _(spark, d):
    return relationships.project_star(members(spark, d))


_UNION = f"{EDG}, {MEM}, un AS (SELECT 'direct' AS type, a::VARCHAR AS a, b::VARCHAR AS b, weight FROM wed UNION ALL SELECT 'project', 'project:' || project, 'person:' || person, round(involvement, 6) FROM mem UNION ALL SELECT 'copresence', x.person::VARCHAR, y.person::VARCHAR, count(*)::DOUBLE FROM mem x JOIN mem y ON x.project = y.project AND x.person < y.person GROUP BY x.person, y.person)"


def all_edges(spark: SparkSession, d: str) -> DataFrame:
    m = members(spark, d)
    return relationships.edge_union(direct=edges(spark, d), project=relationships.project_star(m), copresence=relationships.co_members(m).withColumnRenamed("projects", "weight"))


@query("SET_08_edge_union", f"WITH {_UNION} SELECT * FROM un")
def _(spark, d):
    return all_edges(spark, d)


@query("FLT_28_edge_types", f"WITH {_UNION} SELECT * FROM un WHERE type IN ('direct', 'project')")
def _(spark, d):
    return relationships.of_types(all_edges(spark, d), ["direct", "project"])


@query("GRF_22_shown_edges", f"WITH {EDG} SELECT a, b, left(sha256('direct|' || a || '|' || b), 16) AS edge_id, weight < 0.2 OR date_diff('day', last_seen, TIMESTAMP '2001-12-31') > 180 AS muted, evidence || CASE WHEN evidence = 1 THEN ' message' ELSE ' messages' END AS explanation FROM wed")
def _(spark, d):
    rows = edges(spark, d).withColumn("type", F.lit("direct"))
    return relationships.shown_edges(rows, F.lit("2001-12-31").cast("date")).select("a", "b", "edge_id", "muted", "explanation")

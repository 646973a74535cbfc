"""Queries of similarity graphs, communities and agreement of clusterings, over the driver's tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import areas, clustering, communities, neighbours, relations, relmap, report, views
from ..session import table
from .registry import query

# ---- communities: the lines of an order know each other well, neighbouring orders hardly --------------------

_LINES = """n AS (SELECT DISTINCT l_orderkey AS o, l_orderkey * 10 + l_linenumber AS node FROM lineitem), f AS (SELECT o, min(node) AS first, count(*) AS c FROM n GROUP BY 1 HAVING count(*) > 1),
e AS (SELECT a.node AS a, b.node AS b, 1.0::DOUBLE AS w FROM n a JOIN n b ON a.o = b.o AND a.node < b.node UNION ALL SELECT x.first, y.first, 0.05 FROM f x JOIN f y ON y.o = x.o + 1)"""


def line_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(nodes (o, node), edges): cliques of lines, and a light edge from an order's first line to the next order's."""
    n = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("node")).distinct()
    n = n.hint("merge")  # packed files look small enough to be broadcast
    first = n.groupBy("o").agg(F.min("node").alias("first"), F.count("*").alias("c")).where("c > 1")
    light = first.select((F.col("o") + 1).alias("o"), F.col("first").alias("a")).join(first, "o").select("a", F.col("first").alias("b"), F.lit(0.05).alias("w"))
    a, b = n.select("o", F.col("node").alias("a")), n.select("o", F.col("node").alias("b"))
    return n, a.join(b, "o").where("a < b").select("a", "b", F.lit(1.0).alias("w")).unionByName(light)


@query("GRF_05_leiden", f"WITH {_LINES} SELECT n.node, f.first AS community FROM n JOIN f USING (o)")
def _(spark, d):
    edges = line_graph(spark, d)[1]
    weight = edges.agg(F.sum("w")).first()[0] or 0
    return communities.leiden(edges, gamma=2 * weight / 80)  # two pairs of lines with a light edge between them stay apart


@query("GRF_05_modularity", f"""WITH {_LINES}, s AS (SELECT a AS u, b AS v, w FROM e UNION ALL SELECT b, a, w FROM e), c AS (SELECT node, o // 3 AS c FROM n), x AS (SELECT cu.c AS c, sum(w) AS total, coalesce(sum(w) FILTER (WHERE cu.c = cv.c), 0) AS inside
  FROM s JOIN c cu ON u = cu.node JOIN c cv ON v = cv.node GROUP BY 1), t AS (SELECT sum(total) AS t FROM x) SELECT (SELECT count(DISTINCT c) FROM c) AS communities, round(sum(inside / t - (total / t) ** 2), 6) AS modularity FROM x, t""")
def _(spark, d):
    nodes, edges = line_graph(spark, d)
    return communities.modularity(edges, nodes.select("node", F.expr("o div 3").alias("community")))


# ---- candidates of the similarity graph ---------------------------------------------------------------------

_THREADS = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), sim AS (SELECT a.id AS id, b.id AS other, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM v a JOIN v b ON a.id <> b.id),
near AS (SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) <= 25),
m AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS m FROM lineitem WHERE l_orderkey IN (SELECT id FROM v)), d AS (SELECT m, count(*) AS df, round(ln((SELECT count(DISTINCT g) FROM m) / count(*)), 6) AS idf FROM m GROUP BY 1),
rare AS (SELECT m.* FROM m JOIN d USING (m) WHERE df <= 300 AND df <= 0.5 * (SELECT count(DISTINCT g) FROM m)),
cand AS (SELECT least(id, other) AS a, greatest(id, other) AS b FROM near UNION SELECT x.g, y.g FROM rare x JOIN rare y ON x.m = y.m AND x.g < y.g)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def thread_lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items of the orders that have a vector: the messages of the threads."""
    return table(spark, d, "lineitem").join(vectors(spark, d).select(F.col("id").alias("l_orderkey")), "l_orderkey", "left_semi")


def thread_members(spark: SparkSession, d: str) -> DataFrame:
    return thread_lines(spark, d).select(F.col("l_orderkey").alias("group_id"), F.col("l_suppkey").alias("member")).distinct()


@query("JOIN_18_neighbours", f"WITH {_THREADS} SELECT * FROM near")
def _(spark, d):
    return neighbours.nearest(vectors(spark, d), 25, cells=1)


@query("SET_01_candidates", f"WITH {_THREADS} SELECT a, b FROM cand")
def _(spark, d):
    return neighbours.candidate_pairs(thread_members(spark, d), vectors(spark, d), 25, cells=1)


_LINED = _THREADS.replace("FROM embeddings)", "FROM embeddings WHERE vec_id IN (SELECT l_orderkey FROM lineitem))")


@query("GRF_04_thread_graph", f"""WITH {_LINED}, p AS (SELECT g AS id, list(m) AS people, sum(idf) AS own FROM m JOIN d USING (m) GROUP BY 1),
t AS (SELECT l_orderkey AS id, list(DISTINCT l_returnflag || l_linenumber) AS words, list(DISTINCT l_partkey % 50) AS links, epoch(min(l_shipdate)) AS s, epoch(max(l_shipdate)) AS e FROM lineitem WHERE l_orderkey IN (SELECT id FROM v) GROUP BY 1),
f AS (SELECT * FROM v JOIN t USING (id) JOIN p USING (id)), i AS (SELECT x.g AS a, y.g AS b, sum(idf) AS shared FROM m x JOIN m y ON x.m = y.m AND x.g < y.g JOIN d ON d.m = x.m GROUP BY 1, 2),
w AS (SELECT c.a, c.b, round(0.35 * coalesce(coalesce(shared, 0) / nullif(x.own + y.own - coalesce(shared, 0), 0), 0) + 0.30 * greatest(list_cosine_similarity(x.v, y.v), 0)
  + 0.20 * len(list_intersect(x.words, y.words)) / least(len(x.words), len(y.words))
  + 0.10 * CASE WHEN least(x.e, y.e) - greatest(x.s, y.s) > 0 THEN (least(x.e, y.e) - greatest(x.s, y.s)) / (greatest(x.e, y.e) - least(x.s, y.s)) ELSE 0.3 * exp(-pow((greatest(x.s, y.s) - least(x.e, y.e)) / (86400.0 * 14), 2)) END
  + 0.05 * len(list_intersect(x.links, y.links)) / len(list_distinct(list_concat(x.links, y.links))), 6) AS w FROM cand c JOIN f x ON c.a = x.id JOIN f y ON c.b = y.id LEFT JOIN i ON i.a = c.a AND i.b = c.b),
k AS (SELECT * FROM w WHERE w >= 0.25), r AS (SELECT a, b, w, row_number() OVER (PARTITION BY node ORDER BY w DESC, other) AS r FROM (SELECT *, a AS node, b AS other FROM k UNION ALL SELECT *, b, a FROM k)) SELECT DISTINCT a, b, w FROM r WHERE r <= 15""")
def _(spark, d):
    return thread_graph(spark, d)


def thread_graph(spark: SparkSession, d: str) -> DataFrame:
    lines, members = thread_lines(spark, d), thread_members(spark, d)
    weights = relations.idf(members).select("member", F.col("idf").alias("weight"))
    people = members.join(weights, "member").groupBy(F.col("group_id").alias("id")).agg(F.collect_list(F.struct("member", "weight")).alias("participants"))
    told = lines.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.collect_set(F.concat("l_returnflag", F.col("l_linenumber").cast("string"))).alias("keywords"), F.collect_set(F.col("l_partkey") % 50).alias("links"), F.unix_timestamp(F.min("l_shipdate")).alias("start"), F.unix_timestamp(F.max("l_shipdate")).alias("end")
    )
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    unit = vectors(spark, d).withColumn("size", size).select("id", F.transform("v", lambda x: x / F.col("size")).alias("v"))
    return neighbours.thread_graph(members, unit.join(told, "id").join(people, "id"), least=0.25, cells=1)


# ---- agreement of overlapping clusterings -------------------------------------------------------------------

_BOTH = """f AS (SELECT DISTINCT c_custkey AS item, c_nationkey AS cluster FROM customer UNION SELECT c_custkey, 100 + c_custkey % 40 FROM customer WHERE c_custkey % 3 = 0),
g AS (SELECT DISTINCT c_custkey AS item, c_nationkey - c_nationkey % 2 AS cluster FROM customer UNION SELECT c_custkey, 100 + c_custkey % 50 FROM customer WHERE c_custkey % 2 = 0),
x AS (SELECT a.item AS a, b.item AS b, count(*) AS x FROM f a JOIN f b ON a.cluster = b.cluster GROUP BY 1, 2), y AS (SELECT a.item AS a, b.item AS b, count(*) AS y FROM g a JOIN g b ON a.cluster = b.cluster GROUP BY 1, 2),
z AS (SELECT a, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM x FULL JOIN y USING (a, b))"""


@query("AGG_34_extended_bcubed", f"WITH {_BOTH}, e AS (SELECT a, avg(least(x, y) / x) FILTER (WHERE x > 0) AS p, avg(least(x, y) / y) FILTER (WHERE y > 0) AS r FROM z GROUP BY 1), s AS (SELECT avg(coalesce(p, 0)) AS p, avg(coalesce(r, 0)) AS r FROM e) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM s")
def _(spark, d):
    from .mail import clusterings

    return report.extended_bcubed(*clusterings(spark, d))


# ---- ids and labels that go on from one clustering to the next ----------------------------------------------
# Old sets are ranges of 40 customers that overlap by half; new ones are the same with a few more customers, in
# an order of ids that makes two new ones want the same old one.

_OVERLAP = """ranges AS (SELECT DISTINCT c_custkey // 20 AS k FROM customer), new_ AS (SELECT 2 * k + j AS c, c_custkey AS item FROM ranges, (VALUES (0, 0), (1, 6)) s(j, shift), customer WHERE c_custkey >= 20 * k + shift AND c_custkey < 20 * k + shift + 40),
old_ AS (SELECT 10000 + 3 * k + j AS c, c_custkey AS item FROM ranges, (VALUES (0, 2), (1, 14)) s(j, shift), customer WHERE c_custkey >= 20 * k + shift AND c_custkey < 20 * k + shift + 40),
nn AS (SELECT c, count(*) AS n FROM new_ GROUP BY 1), nold AS (SELECT c, count(*) AS n FROM old_ GROUP BY 1), jac AS (SELECT n.c AS new, o.c AS old, count(*) / (any_value(nn.n) + any_value(nold.n) - count(*)) AS j FROM new_ n JOIN old_ o USING (item) JOIN nn ON nn.c = n.c JOIN nold ON nold.c = o.c GROUP BY 1, 2 HAVING j >= 0.5)"""


def overlapping(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("item"))
    ranges = c.select(F.expr("item div 20").alias("k")).distinct()

    def sets(name, *shifts):
        spans = ranges.select("k", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(s).alias("shift")) for j, s in enumerate(shifts)])).alias("s"))
        spans = spans.select(name.alias("community"), F.explode(F.sequence(20 * F.col("k") + F.col("s.shift"), 20 * F.col("k") + F.col("s.shift") + 39)).alias("item"))
        return spans.join(c, "item")

    k, j = F.col("k"), F.col("s.j")
    return sets(2 * k + j, 0, 6), sets(10000 + 3 * k + j, 2, 14)


_GREEDY = """WITH RECURSIVE {o}, ord AS (SELECT new, row_number() OVER (ORDER BY new) AS r FROM (SELECT DISTINCT new FROM jac)),
step AS (SELECT 0 AS r, NULL::BIGINT AS new, NULL::BIGINT AS old, NULL::DOUBLE AS j, []::BIGINT[] AS used UNION ALL
  SELECT s.r + 1, o.new, b.old, b.j, CASE WHEN b.old IS NULL THEN s.used ELSE list_append(s.used, b.old) END FROM step s JOIN ord o ON o.r = s.r + 1
  LEFT JOIN LATERAL (SELECT jac.old, jac.j FROM jac WHERE jac.new = o.new AND NOT list_contains(s.used, jac.old) ORDER BY jac.j DESC, jac.old LIMIT 1) b ON true)
SELECT new, old, round(j, 6) AS jaccard FROM step WHERE old IS NOT NULL""".replace("{o}", _OVERLAP)


@query("WIN_09_greedy_ids", _GREEDY)
def _(spark, d):
    return clustering.carried_over(*overlapping(spark, d))


@query("GRF_14_override_labels", f"WITH {_OVERLAP} SELECT new, 'named ' || old AS label FROM jac WHERE old % 3 = 1 QUALIFY row_number() OVER (PARTITION BY new ORDER BY j DESC, old) = 1")
def _(spark, d):
    new, old = overlapping(spark, d)
    named = old.where("community % 3 = 1").withColumn("label", F.concat(F.lit("named "), F.col("community").cast("string")))
    return clustering.sticky_labels(new, named)


# ---- coverage areas: parts as claims of their brand's package, orders as the evidence they cite --------------

_CLAIMS = """claims AS (SELECT p_brand AS package_id, p_partkey AS claim_id, split_part(p_name, ' ', 2) || ' of batch' || p_partkey % 331 || ' ' || CASE WHEN p_partkey % 7 = 0 THEN 'the status' ELSE 'crate' || p_size % 20 END AS text, ['decision', 'open_loop', 'did'][p_partkey % 3 + 1] AS kind FROM part),
cites AS (SELECT DISTINCT p_brand AS package_id, p_partkey AS claim_id, l_orderkey AS header FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 7 AND l_quantity > 45),
evidence AS (SELECT p_brand AS package_id, l_orderkey AS header, min(l_extendedprice) AS place FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 7 AND l_orderkey % 5 <> 0 GROUP BY 1, 2),
told AS (SELECT e.*, CASE WHEN header % 4 = 0 THEN ' ' ELSE 'Lot' || header % 9 || ' ' || substr(o_orderpriority, 3) END AS subject, CASE WHEN header % 3 = 0 THEN 'D' || header % 4 || '.com' ELSE '' END AS sender_domain, 'Anna' || header % 3 AS sender_display FROM evidence e JOIN orders ON o_orderkey = header),
cited AS (SELECT c.package_id, claim_id, header, subject, place, sender_domain, sender_display FROM cites c JOIN told t USING (package_id, header)),
texts AS (SELECT package_id, claim_id, text FROM claims UNION ALL SELECT package_id, claim_id, subject FROM cited),
words AS (SELECT DISTINCT package_id, claim_id, w FROM (SELECT package_id, claim_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM texts) WHERE length(w) >= 3 AND w NOT IN ({common})),
df AS (SELECT package_id, w, count(*) AS df FROM words GROUP BY 1, 2),
links AS (SELECT DISTINCT a.package_id, a.claim_id AS a, b.claim_id AS b FROM cited a JOIN cited b ON a.package_id = b.package_id AND a.header = b.header AND a.claim_id <> b.claim_id
  UNION SELECT x.package_id, x.claim_id, y.claim_id FROM words x JOIN words y ON x.package_id = y.package_id AND x.w = y.w AND x.claim_id <> y.claim_id JOIN df ON df.package_id = x.package_id AND df.w = x.w GROUP BY 1, 2, 3 HAVING count(*) >= 2 OR min(df.df) <= 2),
reach AS (SELECT package_id, claim_id, claim_id AS r FROM claims UNION SELECT l.package_id, l.b, reach.r FROM reach JOIN links l ON l.package_id = reach.package_id AND l.a = reach.claim_id),
areas AS (SELECT package_id, claim_id, min(r) AS area FROM reach GROUP BY 1, 2)""".replace("{common}", ", ".join(f"'{w}'" for w in areas.COMMON))


def claims_and_evidence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p, key = table(spark, d, "part"), F.col("p_partkey")
    text = F.concat(F.substring_index("p_name", " ", -1), F.lit(" of batch"), key % 331, F.lit(" "), F.when(key % 7 == 0, "the status").otherwise(F.concat(F.lit("crate"), F.col("p_size") % 20)))
    kind = F.element_at(F.array(F.lit("decision"), F.lit("open_loop"), F.lit("did")), (key % 3 + 1).cast("int"))
    claims = p.select(F.col("p_brand").alias("package_id"), key.alias("claim_id"), text.alias("text"), kind.alias("kind"))
    lines = table(spark, d, "lineitem").where("l_linenumber = 7").join(p, F.col("l_partkey") == key)
    cites = lines.where("l_quantity > 45").groupBy(key.alias("claim_id")).agg(F.collect_set("l_orderkey").alias("cites"))
    header = F.col("header")
    evidence = lines.where("l_orderkey % 5 <> 0").groupBy(F.col("p_brand").alias("package_id"), F.col("l_orderkey").alias("header")).agg(F.min("l_extendedprice").alias("place"))
    subject = F.when(header % 4 == 0, " ").otherwise(F.concat(F.lit("Lot"), header % 9, F.lit(" "), F.expr("substr(o_orderpriority, 3)")))
    told = evidence.join(table(spark, d, "orders"), header == F.col("o_orderkey")).select(
        "package_id", "header", "place", subject.alias("subject"), F.when(header % 3 == 0, F.concat(F.lit("D"), header % 4, F.lit(".com"))).otherwise("").alias("sender_domain"), F.concat(F.lit("Anna"), header % 3).alias("sender_display")
    )
    return claims.join(cites, "claim_id", "left"), told


@query("JOIN_28_claim_areas", f"WITH RECURSIVE {_CLAIMS} SELECT package_id, claim_id, area FROM areas")
def _(spark, d):
    return areas.claim_areas(*claims_and_evidence(spark, d))


@query("AGG_40_coverage_areas", f"""WITH RECURSIVE {_CLAIMS}, k AS (SELECT package_id, area, count(*) AS claims, count(*) FILTER (WHERE kind = 'decision') AS decisions, count(*) FILTER (WHERE kind = 'open_loop') AS open_loops, arg_min(text, claim_id) AS text FROM claims JOIN areas USING (package_id, claim_id) GROUP BY 1, 2),
h AS (SELECT package_id, area, count(*) AS evidence, count(DISTINCT lower(coalesce(nullif(trim(sender_domain), ''), nullif(trim(sender_display), '')))) AS people, arg_min(trim(subject), place) FILTER (WHERE trim(subject) <> '') AS subject FROM (SELECT DISTINCT package_id, area, header, subject, place, sender_domain, sender_display FROM cited JOIN areas USING (package_id, claim_id)) GROUP BY 1, 2),
o AS (SELECT package_id, area, coalesce(subject, substr(text, 1, 60)) AS label, claims, decisions, open_loops, coalesce(people, 0) AS people, coalesce(evidence, 0) AS evidence FROM k LEFT JOIN h USING (package_id, area))
SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY decisions + open_loops DESC, claims DESC, label, area) AS rank FROM o""")
def _(spark, d):
    return areas.coverage_areas(*claims_and_evidence(spark, d))


# ---- views: customers as contacts and owners, orders as threads, parts as events of brands ------------------

_VIEWS = """p AS (SELECT 0 AS mailbox, s_suppkey AS person, CASE WHEN s_suppkey % 3 = 0 THEN [] ELSE [s_name, 'x'] END AS names, 's' || s_suppkey || '@x.com' AS email, CASE WHEN s_suppkey % 4 = 0 THEN 'vendor' ELSE 'peer' END AS role, s_nationkey AS org FROM supplier),
ident AS (SELECT s_suppkey AS person, 's' || s_suppkey || '@x.com' AS email FROM supplier WHERE s_suppkey % 5 > 0 UNION ALL SELECT s_suppkey, 't' || s_suppkey || '@y.com' FROM supplier WHERE s_suppkey % 2 = 0),
e AS (SELECT l_suppkey AS person, count(*) AS message_count, round(sum(l_discount), 4) AS weight FROM lineitem WHERE l_suppkey % 7 > 0 GROUP BY 1),
c AS (SELECT p.*, e.message_count, e.weight, n_name AS org_domain, coalesce((SELECT list(DISTINCT i.email ORDER BY i.email) FROM ident i WHERE i.person = p.person), []) AS all_emails FROM p JOIN e USING (person) LEFT JOIN nation ON org = n_nationkey),
t AS (SELECT l_orderkey AS thread, list(DISTINCT CASE WHEN l_suppkey % 2 = 0 AND l_linenumber % 2 = 0 THEN 't' || l_suppkey || '@y.com' WHEN l_linenumber = 7 THEN 'me@x.com' ELSE 's' || l_suppkey || '@x.com' END) AS participants, max(l_shipdate) AS last, count(*) AS messages FROM lineitem GROUP BY 1),
pr AS (SELECT p_brand AS project, 'Label ' || p_brand[7:7] AS label, floor(avg(p_size)) / 50 AS confidence FROM part GROUP BY 1), a AS (SELECT DISTINCT p_brand AS project, l_orderkey AS thread FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 40 AND p_brand <> 'Brand#3'),
mem AS (SELECT p_brand AS project, l_suppkey AS person, sum(l_quantity) AS involvement, count(*) AS messages FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
ev AS (SELECT p_brand AS project, p_partkey AS event, ['proposed', 'did', 'outcome', 'other'][p_partkey % 4 + 1] AS type, list(l_orderkey ORDER BY l_orderkey) AS cites FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem WHERE l_linenumber = 1) ON l_partkey = p_partkey AND p_partkey % 6 > 0 GROUP BY 1, 2, 3),
act AS (SELECT project, event, type, array_to_string(cites, ',') AS cites, (SELECT coalesce(max(o_orderdate), TIMESTAMP '1970-01-01') FROM orders WHERE list_contains(cites, o_orderkey) AND o_orderkey % 3 > 0) AS seen FROM ev WHERE cites[1] IS NOT NULL)"""


def mailbox_people(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    key = F.col("s_suppkey")
    own, other = F.concat(F.lit("s"), key, F.lit("@x.com")), F.concat(F.lit("t"), key, F.lit("@y.com"))
    s = table(spark, d, "supplier").withColumn("mailbox", F.lit(0))
    people = s.select("mailbox", key.alias("person"), F.when(key % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("s_name", F.lit("x"))).alias("names"), own.alias("email"), F.when(key % 4 == 0, "vendor").otherwise("peer").alias("role"), F.col("s_nationkey").alias("org"))
    identities = s.where("s_suppkey % 5 > 0").select("mailbox", key.alias("person"), own.alias("email")).unionByName(s.where("s_suppkey % 2 = 0").select("mailbox", key.alias("person"), other.alias("email")))
    edges = table(spark, d, "lineitem").where("l_suppkey % 7 > 0").groupBy(F.lit(0).alias("mailbox"), F.col("l_suppkey").alias("person")).agg(F.count("*").alias("message_count"), F.round(F.sum("l_discount"), 4).alias("weight"))
    return people, identities, edges, table(spark, d, "nation").select(F.col("n_nationkey").alias("org"), F.col("n_name").alias("domain"))


def mailbox_threads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Threads, and a row for each of their messages."""
    key, line = F.col("l_suppkey"), F.col("l_linenumber")
    address = F.when((key % 2 == 0) & (line % 2 == 0), F.concat(F.lit("t"), key, F.lit("@y.com"))).when(line == 7, "me@x.com").otherwise(F.concat(F.lit("s"), key, F.lit("@x.com")))
    lines = table(spark, d, "lineitem").select(F.lit(0).alias("mailbox"), F.col("l_orderkey").alias("thread"), address.alias("address"), "l_shipdate")
    return lines.groupBy("mailbox", "thread").agg(F.collect_set("address").alias("participants"), F.max("l_shipdate").alias("last")).withColumn("subject", F.concat(F.lit("order "), F.col("thread"))), lines


@query("QRY_02_contacts", f"WITH {_VIEWS} SELECT person, coalesce(names[1], email) AS name, email, array_to_string(all_emails, ',') AS all_emails, role, org_domain, weight, message_count FROM c")
def _(spark, d):
    from .mail import joined

    return views.contacts(*mailbox_people(spark, d)).select("person", "name", "email", joined("all_emails"), "role", "org_domain", "weight", "message_count")


@query("QRY_02_contact_threads", f"""WITH {_VIEWS}, x AS (SELECT person, unnest(CASE WHEN len(all_emails) > 0 THEN all_emails ELSE [email] END) AS address FROM c), o AS (SELECT * FROM t WHERE list_contains(participants, 'me@x.com')),
m AS (SELECT DISTINCT person, thread FROM (SELECT thread, unnest(participants) AS address FROM o) JOIN x USING (address)), r AS (SELECT person, thread, row_number() OVER (PARTITION BY person ORDER BY last DESC, thread) AS rank FROM m JOIN o USING (thread))
SELECT person, rank, thread, 'order ' || thread AS subject, array_to_string(list_sort(list_filter(participants, lambda z: z <> 'me@x.com' AND NOT list_contains(own, z))), ',') AS others, strftime(last, '%Y-%m-%d') AS last, messages FROM r JOIN o USING (thread) JOIN (SELECT person, list(address) AS own FROM x GROUP BY 1) USING (person) WHERE rank <= 10""")
def _(spark, d):
    from .mail import day, joined

    threads, messages = mailbox_threads(spark, d)
    owners = spark.range(1).select(F.lit(0).alias("mailbox"), F.lit("me@x.com").alias("owner"))
    found = views.contact_threads(views.contacts(*mailbox_people(spark, d)), threads, messages, owners)
    return found.select("person", "rank", "thread", "subject", joined("others"), day("last"), "messages")


def project_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    parts, key = table(spark, d, "part"), F.col("p_partkey")
    lines = table(spark, d, "lineitem").join(parts, F.col("l_partkey") == key)
    cites = table(spark, d, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_partkey").alias("event")).agg(F.array_sort(F.collect_set("l_orderkey")).alias("cites")).where("event % 6 > 0")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("proposed", "did", "outcome", "other")]), (key % 4 + 1).cast("int"))
    events = parts.select(F.col("p_brand").alias("project"), key.alias("event"), kind.alias("type"), F.lit(1).alias("actor"), F.lit(0.5).alias("confidence")).join(cites, "event", "left").withColumn("cites", F.coalesce("cites", F.array().cast("array<long>")))
    return {
        "projects": parts.groupBy(F.col("p_brand").alias("project")).agg((F.floor(F.avg("p_size")) / 50).alias("confidence")).select("project", F.concat(F.lit("Label "), F.substring("project", 7, 1)).alias("label"), "confidence", F.lit(None).cast("timestamp").alias("end")),
        "assigned": lines.where("l_quantity > 40 and p_brand <> 'Brand#3'").select(F.col("p_brand").alias("project"), F.col("l_orderkey").alias("thread")),
        "members": lines.groupBy(F.col("p_brand").alias("project"), F.col("l_suppkey").alias("person")).agg(F.sum("l_quantity").alias("involvement"), F.count("*").alias("messages")),
        "threads": mailbox_threads(spark, d)[0], "events": events, "messages": table(spark, d, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("message"), F.col("o_orderdate").alias("ts")),
    }


@query("QRY_05_activity", f"WITH {_VIEWS} SELECT project, row_number() OVER (PARTITION BY project ORDER BY CASE type WHEN 'outcome' THEN 0 WHEN 'did' THEN 1 WHEN 'proposed' THEN 2 ELSE 99 END, seen DESC, event) AS place, event, type, cites, strftime(seen, '%Y-%m-%d') AS at FROM act")
def _(spark, d):
    from .mail import day, joined

    t = project_tables(spark, d)
    return views.activity(t["events"], t["messages"]).select("project", "place", "event", "type", joined("cites"), day("at"))


@query("QRY_03_project_list", f"""WITH {_VIEWS}, s AS (SELECT project, count(*) AS threads, max(last) AS last FROM a JOIN t USING (thread) GROUP BY 1), n AS (SELECT project, count(*) AS members FROM mem GROUP BY 1), f AS (SELECT DISTINCT project FROM act WHERE type = 'outcome' AND seen >= TIMESTAMP '2001-08-20' - INTERVAL 30 DAY)
SELECT project, label, CASE WHEN last IS NULL OR floor((epoch(TIMESTAMP '2001-08-20') - epoch(last)) / 86400) > 30 THEN 'stale' WHEN project IN (SELECT project FROM f) THEN 'shipping' ELSE 'active' END AS state, confidence, coalesce(members, 0) AS members, coalesce(threads, 0) AS threads, strftime(last, '%Y-%m-%d') AS last_activity,
  row_number() OVER (ORDER BY confidence DESC, label, project) AS place FROM pr LEFT JOIN s USING (project) LEFT JOIN n USING (project)""")
def _(spark, d):
    from .mail import day

    t = project_tables(spark, d)
    listed = views.project_list(t["projects"], t["assigned"], t["members"], t["threads"], t["events"], t["messages"], datetime(2001, 8, 20, tzinfo=timezone.utc))
    placed = views.in_order(listed, t["projects"].select("project", F.lit(0).alias("mailbox")))
    return placed.select("project", "label", "state", "confidence", "members", "threads", day("last_activity"), "place")


@query("QRY_04_project_people", f"""WITH {_VIEWS}, x AS (SELECT project, person, coalesce(names[1], email) AS name, role, mem.messages, involvement, round(coalesce(weight, 0), 4) AS weight FROM mem LEFT JOIN p USING (person) LEFT JOIN e USING (person))
SELECT project, person, coalesce(name, person::VARCHAR) AS name, coalesce(role, 'unknown') AS role, messages, involvement, weight, row_number() OVER (PARTITION BY project ORDER BY involvement DESC, person) AS place, CASE WHEN row_number() OVER (PARTITION BY project ORDER BY weight DESC, involvement DESC, person) <= 4 THEN row_number() OVER (PARTITION BY project ORDER BY weight DESC, involvement DESC, person) END AS ask FROM x""")
def _(spark, d):
    people, _, edges, _ = mailbox_people(spark, d)
    return views.project_people(project_tables(spark, d)["members"], people, edges)


@query("QRY_04_project_threads", f"WITH {_VIEWS} SELECT project, rank, thread, 'order ' || thread AS subject, array_to_string(list_sort(participants), ',') AS participants, strftime(last, '%Y-%m-%d') AS last FROM (SELECT project, thread, participants, last, row_number() OVER (PARTITION BY project ORDER BY last DESC, thread) AS rank FROM a JOIN t USING (thread)) WHERE rank <= 10")
def _(spark, d):
    from .mail import day

    t = project_tables(spark, d)
    found = views.project_threads(t["assigned"], t["threads"])
    return found.select("project", "rank", "thread", "subject", F.array_join(F.array_sort("participants"), ",").alias("participants"), day("last"))


# ---- the relationship map: suppliers as people, orders as threads, parts as projects -------------------------

_MAP = """dx AS (SELECT l_suppkey AS person, count(*) AS headers, min(l_shipdate) AS f, max(l_shipdate) AS l FROM lineitem WHERE l_linenumber = 7 AND l_quantity > 20 GROUP BY 1), th AS (SELECT l_orderkey AS g, l_suppkey AS person, min(l_shipdate) AS s, max(l_shipdate) AS e FROM lineitem WHERE l_quantity > 42 GROUP BY 1, 2),
mb AS (SELECT l_partkey AS g, l_suppkey AS person, max(l_quantity) AS w FROM lineitem WHERE l_quantity > 47 GROUP BY 1, 2), pj AS (SELECT p_partkey AS g, p_name AS label, p_size / 50 AS confidence, (SELECT min(o_orderdate) FROM orders WHERE o_orderkey = p_partkey) AS s FROM part), pp AS (SELECT s_suppkey AS person, 'd' || s_nationkey || '.com' AS domain FROM supplier WHERE s_suppkey % 6 > 0),
rel AS (SELECT person FROM dx UNION SELECT person FROM th UNION SELECT person FROM mb), tc AS (SELECT 'thread_copresence' AS type, a.person AS x, b.person AS y, count(*) AS n, max(greatest(a.e, b.e)) AS l FROM th a JOIN th b ON a.g = b.g AND a.person < b.person GROUP BY 2, 3),
pc AS (SELECT 'project_copresence' AS type, a.person AS x, b.person AS y, count(*) AS n, min(pj.s) AS f, max(pj.s) AS l FROM mb a JOIN mb b ON a.g = b.g AND a.person < b.person JOIN pj ON pj.g = a.g GROUP BY 2, 3), br AS (SELECT person, count(*) AS n FROM mb GROUP BY 1 HAVING count(*) >= 2)"""
_MAP_GRAPH = """SELECT 'direct_exchange' AS type, 'owner' AS a, 'person:' || person AS b, headers::DOUBLE AS weight, headers AS evidence, l AS seen FROM dx UNION ALL SELECT type, 'person:' || x, 'person:' || y, n::DOUBLE, n, l FROM tc UNION ALL SELECT type, 'person:' || x, 'person:' || y, n::DOUBLE, n, l FROM pc
UNION ALL SELECT 'org_affiliation', 'person:' || person, 'org:' || domain, 1.0, 1, NULL FROM pp WHERE person IN (SELECT person FROM rel) UNION ALL SELECT 'bridge', 'person:' || person, 'project:' || mb.g, n::DOUBLE, n, s FROM br JOIN mb USING (person) JOIN pj ON pj.g = mb.g"""


def map_tables(spark: SparkSession, d: str) -> list[DataFrame]:
    lines, person = table(spark, d, "lineitem"), F.col("l_suppkey").alias("person")
    direct = lines.where("l_linenumber = 7 and l_quantity > 20").groupBy(person).agg(F.count("*").alias("headers"), F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"))
    threads = lines.where("l_quantity > 42").groupBy(F.col("l_orderkey").alias("thread"), person).agg(F.min("l_shipdate").alias("start"), F.max("l_shipdate").alias("end"))
    members = lines.where("l_quantity > 47").groupBy(F.col("l_partkey").alias("project"), person).agg(F.max("l_quantity").alias("involvement"))
    start = table(spark, d, "orders").groupBy(F.col("o_orderkey").alias("p_partkey")).agg(F.min("o_orderdate").alias("start"))
    projects = table(spark, d, "part").join(start, "p_partkey", "left").select(F.col("p_partkey").alias("project"), F.col("p_name").alias("label"), (F.col("p_size") / 50).alias("confidence"), "start", F.col("start").alias("end"))
    people = table(spark, d, "supplier").where("s_suppkey % 6 > 0").select(F.col("s_suppkey").alias("person"), F.concat(F.lit("D"), "s_nationkey", F.lit(".com")).alias("domain"))
    return [direct, threads, members, projects, people]


@query("QRY_06_map_graph", f"WITH {_MAP}, e AS ({_MAP_GRAPH}) SELECT type, a, b, weight, evidence, strftime(seen, '%Y-%m-%d') AS last_seen, weight < 0.2 OR coalesce(seen < TIMESTAMP '2001-08-20' - INTERVAL 180 DAY, false) AS muted FROM e")
def _(spark, d):
    from .mail import day

    found, _ = relmap.relationship_map("graph", *map_tables(spark, d), now=datetime(2001, 8, 20, tzinfo=timezone.utc))
    return found.select("type", "a", "b", "weight", "evidence", day("last_seen"), "muted")


@query("GRF_23_map_nodes", f"""WITH {_MAP}, c AS (SELECT g, s FROM pj ORDER BY confidence DESC, label, g LIMIT 1), who AS (SELECT DISTINCT person FROM mb WHERE g = (SELECT g FROM c)), co AS (SELECT person FROM dx),
ow AS (SELECT 'owner' AS id UNION SELECT 'person:' || person FROM dx), pr AS (SELECT 'project:' || g AS id FROM c UNION SELECT 'person:' || person FROM who UNION SELECT 'org:' || domain FROM pp WHERE person IN (SELECT person FROM who)),
og AS (SELECT 'org:' || domain AS id FROM pp WHERE person IN (SELECT person FROM rel) UNION SELECT 'person:' || person FROM pp WHERE person IN (SELECT person FROM rel)), n AS (SELECT 'owner' AS mode, id FROM ow UNION ALL SELECT 'project', id FROM pr UNION ALL SELECT 'org', id FROM og)
SELECT mode, id, CASE split_part(id, ':', 1) WHEN 'org' THEN 'organization' ELSE split_part(id, ':', 1) END AS node_type FROM n""")
def _(spark, d):
    out = None
    for mode in ("owner", "project", "org"):
        nodes = relmap.relationship_map(mode, *map_tables(spark, d))[1].select(F.lit(mode).alias("mode"), "id", "node_type")
        out = nodes if out is None else out.unionByName(nodes)
    return out

"""Queries of search, term weights, embeddings, header grammars, linkage and grounded events."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers
from ..operators import evidence, grounding, linkage, returns, search, textfeatures
from ..session import table
from .registry import query


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


# ---- web searches: for each benchmark item a phrase, its words, an alternative, an exclusion ------------------

_WORD = r"[\p{L}\p{N}]+"
_STOPS = ", ".join(f"'{w}'" for w in search.STOP)


def web_queries(spark: SparkSession, d: str) -> DataFrame:
    w = [F.get("w", F.lit(i)) for i in range(6)]
    asked = F.array(F.concat(F.lit('"'), F.concat_ws(" ", *w[:3]), F.lit('"')), F.concat_ws(" ", *w[:3]), F.concat_ws(" ", w[0], F.lit("or"), *w[3:5]), F.concat(w[0], F.lit(" -"), w[5]))
    items = table(spark, d, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0)).alias("w")).where("size(w) >= 6")
    return items.select("item_id", F.posexplode(asked).alias("kind", "text")).select((F.col("item_id") * 4 + F.col("kind")).alias("query_id"), "text")


@query("RET_02_web_search", f"""WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM benchmark), q AS (SELECT * FROM i WHERE len(w) >= 6),
l AS (SELECT item_id * 4 AS q, 0 AS alt, 0 AS lit, false AS neg, j - 1 AS off, w[j] AS word FROM q, generate_series(1, 3) s(j) UNION ALL SELECT item_id * 4 + 1, 0, j - 1, false, 0, w[j] FROM q, generate_series(1, 3) s(j)
  UNION ALL SELECT item_id * 4 + 2, CASE WHEN j = 1 THEN 0 ELSE 1 END, j, false, 0, w[j] FROM q, (VALUES (1), (4), (5)) s(j) UNION ALL SELECT item_id * 4 + 3, 0, j, j = 6, 0, w[j] FROM q, (VALUES (1), (6)) s(j)),
lit AS (SELECT * EXCLUDE (off), off - min(off) OVER (PARTITION BY q, lit) AS off FROM l WHERE word NOT IN ({_STOPS})), size AS (SELECT q, alt, lit, neg, count(*) AS n FROM lit GROUP BY ALL),
p AS (SELECT doc_id AS id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM documents)), f AS (SELECT * FROM p WHERE word IN (SELECT word FROM lit)),
h AS (SELECT DISTINCT q, alt, lit, neg, id FROM (SELECT lit.q, lit.alt, lit.lit, f.id, pos - off AS b, count(*) AS k FROM f JOIN lit USING (word) GROUP BY ALL) JOIN size USING (q, alt, lit) WHERE k = n),
want AS (SELECT q, alt, count(*) FILTER (WHERE NOT neg) AS n FROM size GROUP BY ALL), met AS (SELECT q, alt, id, count(*) FILTER (WHERE NOT neg) AS k, count(*) FILTER (WHERE neg) AS bad FROM h GROUP BY ALL),
alone AS (SELECT q, alt, doc_id AS id FROM want, documents WHERE n = 0), m AS (SELECT q, id FROM met JOIN want USING (q, alt) WHERE k = n AND bad = 0 AND n > 0 UNION SELECT q, o.id FROM alone o WHERE NOT EXISTS (SELECT 1 FROM met WHERE met.q = o.q AND met.alt = o.alt AND met.id = o.id AND bad > 0)),
kind AS (SELECT q, count(DISTINCT word) AS terms, count(DISTINCT alt) = 1 AND count(DISTINCT word) > 1 AS near FROM lit GROUP BY 1), t AS (SELECT DISTINCT q, word FROM lit), pl AS (SELECT t.q, f.id, f.word, f.pos, terms, near FROM f JOIN t USING (word) JOIN m ON m.q = t.q AND m.id = f.id JOIN kind ON kind.q = t.q),
o AS (SELECT q, id, sum(0.1 * list_sum(list_transform(generate_series(1, least(n, 255)), lambda j: 1.0::DOUBLE / (j * j))) / 1.64493406685 / terms) AS s FROM (SELECT q, id, word, terms, count(*) AS n FROM pl WHERE NOT near GROUP BY ALL) GROUP BY 1, 2),
c AS (SELECT a.q, a.id, 1 - exp(sum(ln(1 - 0.1 * sqrt(1.0 / (1.005 + 0.05 * exp(abs(a.pos - b.pos) / 1.5 - 2)))))) AS s FROM pl a JOIN pl b ON a.q = b.q AND a.id = b.id AND a.word < b.word AND abs(a.pos - b.pos) <= 100 WHERE a.near GROUP BY 1, 2),
r AS (SELECT m.q AS query_id, m.id, round(coalesce(o.s, c.s, 0), 6) AS score FROM m LEFT JOIN o ON o.q = m.q AND o.id = m.id LEFT JOIN c ON c.q = m.q AND c.id = m.id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r) WHERE rank <= 20""")
def _(spark, d):
    return search.web_search(documents(spark, d), web_queries(spark, d), stems=False)


@query("RET_02_web_search_stems")
def _(spark, d):
    return search.web_search(documents(spark, d), web_queries(spark, d))


# ---- term weights and labels --------------------------------------------------------------------------------

_TFIDF = f"""w AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{2,}}') AND x NOT IN ({_STOPS})) AS w FROM documents WHERE text IS NOT NULL),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM w UNION ALL SELECT id, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) > 1) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
raw AS (SELECT id, term, tf, tf * (ln((1 + (SELECT count(DISTINCT doc_id) FROM documents)) / (1 + df)) + 1) AS raw FROM tf JOIN df USING (term)), v AS (SELECT id, term, tf, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)), 6) AS weight FROM raw)"""


@query("AGG_15_tfidf", f"WITH {_TFIDF} SELECT * FROM v")
def _(spark, d):
    return textfeatures.tfidf(documents(spark, d))


@query("WIN_07_thread_terms", f"WITH {_TFIDF} SELECT id, rank, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) AS rank FROM v) WHERE rank <= 12")
def _(spark, d):
    return textfeatures.top_weights(textfeatures.tfidf(documents(spark, d)))


@query("WIN_08_labels", """WITH b AS (SELECT o_custkey AS project, CASE WHEN p_size % 5 = 0 THEN p_name WHEN p_size % 5 = 1 THEN upper(p_name[1]) || lower(p_type[2:]) ELSE lower(p_type) || p_size END AS term, count(*) AS tf FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_custkey % 4 <> 1 OR p_size % 5 > 1 GROUP BY 1, 2),
d AS (SELECT term, count(*) AS cdf FROM b GROUP BY 1), s AS (SELECT project, term, round(tf * ln((1 + (SELECT count(*) FROM customer)) / (1 + cdf)), 9) AS score, contains(term, ' ') OR regexp_full_match(term, '[A-Z][^A-Z]*') AS telling FROM b JOIN d USING (term)),
f AS (SELECT project, first(term ORDER BY score DESC, term) FILTER (WHERE telling) AS entity, list(term ORDER BY score DESC, term)[1:2] AS two FROM s GROUP BY 1), t AS (SELECT c_custkey AS project, entity, two, c_name, (SELECT min(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS start FROM customer LEFT JOIN f ON project = c_custkey),
i AS (SELECT *, coalesce(entity, array_to_string(two, ' · ')) AS raw FROM t)
SELECT project, CASE WHEN project % 10 = 0 THEN 'own ' || project WHEN raw IS NOT NULL THEN array_to_string(list_transform(string_split(lower(raw), ' '), lambda x: upper(x[1]) || x[2:]), ' ') ELSE concat_ws(' · ', c_name, strftime(start, '%b %Y')) END AS label,
  CASE WHEN project % 10 = 0 THEN 'user' WHEN entity IS NOT NULL THEN 'entity' WHEN raw IS NOT NULL THEN 'ctfidf' ELSE 'fallback' END AS label_source FROM i""")
def _(spark, d):
    size, lines = F.col("p_size") % 5, table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    term = F.when(size == 0, F.col("p_name")).when(size == 1, F.concat(F.upper(F.substring("p_name", 1, 1)), F.lower(F.expr("substr(p_type, 2)")))).otherwise(F.concat(F.lower("p_type"), F.col("p_size").cast("string")))
    bags = lines.where((F.col("o_custkey") % 4 != 1) | (size > 1)).select(F.col("o_custkey").alias("project"), term.alias("term"), F.lit(1).cast("long").alias("tf"))
    parts = max(8, table(spark, d, "lineitem").count() // 500_000)
    start = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("start"))
    projects = table(spark, d, "customer").join(start, "c_custkey", "left").select(F.col("c_custkey").alias("project"), F.col("c_name").alias("top"), "start")
    own = projects.where("project % 10 = 0").select("project", F.concat(F.lit("own "), F.col("project").cast("string")).alias("label"))
    return textfeatures.project_labels(bags, projects, own, parts)


@query("SCAL_25_hashed_features", r"""WITH t AS (SELECT doc_id AS id, regexp_replace(unnest(regexp_split_to_array(lower(coalesce(text, '')), '\s+')), '[^\p{L}\p{N}]', '', 'g') AS token FROM documents), n AS (SELECT id, token, count(*) AS n FROM t WHERE length(token) >= 3 GROUP BY 1, 2),
s AS (SELECT id, (('0x' || substr(sha256(token), 1, 8))::BIGINT % 64)::INT AS bucket, sum(n * CASE WHEN ('0x' || substr(sha256(token || '#sign'), 1, 2))::BIGINT % 2 = 1 THEN 1 ELSE -1 END) AS s FROM n GROUP BY 1, 2 HAVING s <> 0)
SELECT id, bucket, round(s / sqrt(sum(s * s) OVER (PARTITION BY id)), 6) AS value FROM s UNION ALL SELECT doc_id, (('0x' || substr(sha256(coalesce(text, '')), 1, 8))::BIGINT % 64)::INT, 1.0 FROM documents WHERE doc_id NOT IN (SELECT id FROM s)""")
def _(spark, d):
    return textfeatures.hashed_features(documents(spark, d), 64).select("id", "bucket", F.round("value", 6).alias("value"))


# ---- header grammars ----------------------------------------------------------------------------------------


@query("SCAL_02_addresses", """WITH r AS (SELECT c_custkey AS id, unnest([0, 1, 2]) AS i, c_name, c_mktsegment, c_nationkey FROM customer)
SELECT id, i, CASE WHEN i = 0 THEN 'last, ' || c_name || ' <' || c_custom || '>' WHEN i = 1 THEN c_custom ELSE c_mktsegment || 'é <' || c_custom || '>' END AS raw, CASE WHEN i = 0 THEN 'a' || id || '@x.com' WHEN i = 1 THEN 'b' || c_nationkey || '@y.com' ELSE 'c@z.com' END AS email, CASE WHEN i = 0 THEN 'last, ' || c_name WHEN i = 2 THEN c_mktsegment || 'é' END AS name
FROM (SELECT *, CASE WHEN i = 0 THEN 'A' || id || '+t@X.com' WHEN i = 1 THEN 'b' || c_nationkey || '@y.com' ELSE 'c@z.com' END AS c_custom FROM r)""")
def _(spark, d):
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    encoded = F.concat(F.lit("=?utf-8?b?"), F.base64(F.concat("c_mktsegment", F.lit("é")).cast("binary")), F.lit("?="))
    listed = F.concat(F.lit('"last, '), "c_name", F.lit('" <A'), key, F.lit("+t@X.com>, b"), nation, F.lit("@y.com, "), encoded, F.lit(" <c@z.com>"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.posexplode(headers.parse_addresses(listed)).alias("i", "x"))
    return rows.select("id", "i", "x.raw", "x.email", F.get("x.display_names", F.lit(0)).alias("name"))


@query("SCAL_03_encoded_words", "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'Re: ' || lang || ' – ' || source ELSE lang END AS subject FROM documents")
def _(spark, d):
    word = F.concat(F.lit("=?utf-8?b?"), F.base64(F.encode(F.concat("lang", F.lit(" – ")), "utf-8")), F.lit("?= =?us-ascii?q?"), F.col("source"), F.lit("?="))
    subject = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Re: "), word)).otherwise(F.col("lang"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), headers.decode_words(subject).alias("subject"))


@query("SCAL_07_dates", "SELECT o_orderkey AS id, strftime(o_orderdate - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS at FROM orders")
def _(spark, d):
    day, iso = F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    header = F.when(F.col("o_orderkey") % 3 == 0, F.concat(iso, F.lit("+01:30"))).when(F.col("o_orderkey") % 3 == 1, F.concat(day, F.lit(" +0130 (X)"))).otherwise(F.concat(day, F.lit(" +0130")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(headers.parse_date(header), "yyyy-MM-dd HH:mm:ss").alias("at"))


# ---- linkage: the lines of each order by price -------------------------------------------------------------


def line_distances(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("item")).agg(F.min("l_extendedprice").alias("p"))
    a, b = lines.select("grp", F.col("item").alias("a"), F.col("p").alias("pa")), lines.select("grp", F.col("item").alias("b"), F.col("p").alias("pb"))
    return lines.select("grp", "item"), a.join(b, "grp").where("a < b").select("grp", "a", "b", F.abs(F.col("pa") - F.col("pb")).alias("d"))


@query("GRF_06_linkage", """WITH RECURSIVE l AS (SELECT l_orderkey AS grp, l_linenumber AS item, min(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2),
s AS (SELECT grp, 0 AS step, list([item] ORDER BY item) AS c, list([p] ORDER BY item) AS ps FROM l GROUP BY 1 UNION ALL
  SELECT grp, step + 1, list_concat(list_filter(c, lambda x, i: i <> m.i AND i <> m.j), [list_sort(list_concat(c[m.i], c[m.j]))]), list_concat(list_filter(ps, lambda x, i: i <> m.i AND i <> m.j), [list_concat(ps[m.i], ps[m.j])])
  FROM (SELECT *, (SELECT {'d': d, 'i': i, 'j': j} FROM (SELECT a.i, b.j, round(list_avg(list_transform(ps[a.i], lambda x: list_avg(list_transform(ps[b.j], lambda y: abs(x - y))))), 6) AS d, least(c[a.i][1], c[b.j][1]) AS u, greatest(c[a.i][1], c[b.j][1]) AS v FROM generate_series(1, len(c)) a(i), generate_series(1, len(c)) b(j) WHERE a.i < b.j) ORDER BY d, u, v LIMIT 1) AS m FROM s WHERE len(c) > 1) WHERE m.d <= 15000),
e AS (SELECT grp, c FROM s QUALIFY row_number() OVER (PARTITION BY grp ORDER BY step DESC) = 1) SELECT grp, unnest(x) AS item, x[1] AS cluster FROM (SELECT grp, unnest(c) AS x FROM e)""")
def _(spark, d):
    return linkage.average_linkage(*line_distances(spark, d), cut=15_000, far=1e9)[0]


# ---- events of conversations on the ground of their threads --------------------------------------------------

_GROUND = """m AS (SELECT conv_id * 1000 + turn AS message_id, conv_id AS thread_id, CASE WHEN turn % 3 = 0 THEN 'Ann.Lee' WHEN role = 'user' THEN 'bob' || conv_id % 5 ELSE 'helper_bot' END || '@x.com' AS sender, CASE WHEN turn % 5 = 4 THEN ' ' ELSE text END AS text, CASE WHEN conv_id % 11 = 3 AND turn = 1 THEN 'hr' ELSE 'none' END AS tag FROM conversations),
people AS (SELECT 'ann.lee@x.com' AS email, 1 AS person UNION ALL SELECT 'BOB' || k || '@x.com', 10 + k FROM generate_series(0, 4) s(k) UNION ALL SELECT 'helper_bot@x.com', 99),
raw AS (SELECT message_id AS raw_id, thread_id, CASE message_id % 6 WHEN 0 THEN ' ANN.LEE@x.com' WHEN 1 THEN 'Lee' WHEN 2 THEN 'Bob' WHEN 3 THEN 'b' WHEN 4 THEN 'Nobody Known' ELSE 'helper' END AS actor, ['proposed', 'did', 'outcome', 'guess'][message_id % 4 + 1] AS type, [message_id, message_id + 1, 5] AS cites, CASE WHEN message_id % 3 > 0 THEN 0.25 * (message_id % 3 + 1) END AS confidence FROM m)"""


def conversation_mail(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    conv, turn = F.col("conv_id"), F.col("turn")
    sender = F.concat(F.when(turn % 3 == 0, "Ann.Lee").when(F.col("role") == "user", F.concat(F.lit("bob"), (conv % 5).cast("string"))).otherwise("helper_bot"), F.lit("@x.com"))
    tag = F.when((conv % 11 == 3) & (turn == 1), "hr").otherwise("none")
    m = table(spark, d, "conversations").select((conv * 1000 + turn).alias("message_id"), conv.alias("thread_id"), sender.alias("sender"), F.when(turn % 5 == 4, " ").otherwise(F.col("text")).alias("text"), F.array(tag).alias("sensitivity"))
    people = spark.createDataFrame([("ann.lee@x.com", 1), *((f"BOB{k}@x.com", 10 + k) for k in range(5)), ("helper_bot@x.com", 99)], "email string, person long")
    i = F.col("message_id")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (i % n + 1).cast("int"))
    raw = m.select(i.alias("raw_id"), "thread_id", pick(6, " ANN.LEE@x.com", "Lee", "Bob", "b", "Nobody Known", "helper").alias("actor"), pick(4, "proposed", "did", "outcome", "guess").alias("type"), F.lit(" said so ").alias("summary"), F.array(i, i + 1, F.lit(5)).alias("cites"), F.when(i % 3 > 0, 0.25 * (i % 3 + 1)).alias("confidence"))
    projects = m.where("thread_id % 4 > 0").select("thread_id", (F.col("thread_id") % 7).alias("project")).distinct()
    return raw, m, people, projects


@query("UDF_04_grounded_events", f"""WITH {_GROUND}, open_ AS (SELECT * FROM raw WHERE type <> 'guess' AND thread_id NOT IN (SELECT thread_id FROM m WHERE tag <> 'none')),
exact AS (SELECT raw_id, min(person) AS person FROM open_ JOIN people ON lower(trim(actor)) = lower(email) GROUP BY 1), s AS (SELECT DISTINCT thread_id, split_part(lower(sender), '@', 1) AS local, person FROM m JOIN people ON lower(sender) = lower(email)),
part AS (SELECT raw_id, min(person) AS person FROM (SELECT DISTINCT raw_id, person FROM open_ o JOIN s USING (thread_id) WHERE raw_id NOT IN (SELECT raw_id FROM exact) AND len(list_filter(string_split(replace(lower(trim(actor)), '.', ' '), ' '), lambda t: t <> '' AND contains(local, t))) > 0) GROUP BY 1 HAVING count(*) = 1),
who AS (SELECT * FROM exact UNION ALL SELECT * FROM part), c AS (SELECT raw_id, list(x.message_id ORDER BY place) AS cites, bool_or(trim(x.text) <> '') AS said FROM (SELECT raw_id, thread_id, unnest(cites) AS message_id, generate_subscripts(cites, 1) AS place FROM open_) k JOIN m x USING (thread_id, message_id) GROUP BY 1)
SELECT raw_id, thread_id, person AS actor, type, 'said so' AS summary, CASE WHEN thread_id % 4 > 0 THEN thread_id % 7 END AS project, array_to_string(cites, ',') AS cites, CASE WHEN person = 1 THEN least(coalesce(confidence, 0.6), 0.3) ELSE coalesce(confidence, 0.6) END::DOUBLE AS confidence FROM open_ o JOIN who USING (raw_id) JOIN (SELECT raw_id, cites, said FROM c) c USING (raw_id) WHERE person <> 1 OR said""".replace("SELECT raw_id, thread_id, person AS actor, type, 'said so' AS summary, CASE WHEN thread_id % 4 > 0 THEN thread_id % 7 END AS project, array_to_string(cites, ',')", "SELECT o.raw_id, thread_id, person AS actor, type, 'said so' AS summary, CASE WHEN thread_id % 4 > 0 THEN thread_id % 7 END AS project, array_to_string(c.cites, ',')"))
def _(spark, d):
    from .mail import joined

    raw, m, people, projects = conversation_mail(spark, d)
    found = grounding.grounded_events(raw, m, people, projects, 1)
    return found.select("raw_id", "thread_id", "actor", "type", "summary", "project", joined("cites"), "confidence")


# ---- evidence of both searches; what returns start from -----------------------------------------------------

from .registry import _BM25, _VECTOR  # noqa: E402

_LINKED = """m AS (SELECT doc_id AS id, doc_id // 5 AS thread, o_orderdate AS ts FROM documents JOIN orders ON o_orderkey = doc_id WHERE doc_id % 9 > 0 AND doc_id % 13 > 0)"""


@query("RET_03_evidence", f"""WITH {_VECTOR}, {_BM25}, {_LINKED}, a AS (SELECT query_id, id, score FROM v JOIN m USING (id) WHERE rank <= 20 AND score >= 0.1), tr AS (SELECT query_id * 50 AS query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM t),
b AS (SELECT query_id, id, score FROM tr JOIN m USING (id) WHERE rank <= 20 AND score >= 0), x AS (SELECT query_id, id, score AS vector_score, CASE WHEN min(score) OVER w = max(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS v FROM a WINDOW w AS (PARTITION BY query_id)),
y AS (SELECT query_id, id, score AS text_score, CASE WHEN min(score) OVER w = max(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS t FROM b WINDOW w AS (PARTITION BY query_id)),
z AS (SELECT query_id, id, CASE WHEN v IS NULL THEN 'fts' WHEN t IS NULL THEN 'vector' ELSE 'hybrid' END AS source, vector_score, text_score, CASE WHEN thread % 3 = 0 THEN (thread % 4)::VARCHAR ELSE '' END AS projects, CASE WHEN id % 7 < 4 THEN (id % 7)::VARCHAR ELSE '' END AS people,
  0.6 * coalesce(v, 0) + 0.4 * coalesce(t, 0) + CASE WHEN thread % 3 = 0 THEN 0.15 ELSE 0 END + CASE WHEN id % 7 < 4 THEN 0.1 ELSE 0 END + 0.05 * exp(-greatest(0, (epoch(TIMESTAMP '2001-08-20') - epoch(ts)) / 86400) / 180) AS s FROM x FULL JOIN y USING (query_id, id) JOIN m USING (id)),
r AS (SELECT * EXCLUDE (s), round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id) AS rank FROM z) SELECT * FROM r WHERE rank <= 10""")
def _(spark, d):
    from . import registry
    from .mail import joined

    i = F.col("doc_id")
    sender = F.concat(F.lit("a"), i % 7, F.lit("@x.com"))
    messages = table(spark, d, "documents").join(table(spark, d, "orders"), i == F.col("o_orderkey")).select(i.alias("id"), F.expr("doc_id div 5").alias("thread"), F.col("o_orderdate").alias("ts"), (i % 9 == 0).alias("noise"), F.array(F.when(i % 13 == 0, "hr").otherwise("none")).alias("sensitivity"), sender.alias("sender"), F.array().cast("array<string>").alias("recipients"))
    assigned = messages.where("thread % 3 = 0").select("thread", (F.col("thread") % 4).alias("project"))
    people = spark.range(4).select(F.concat(F.lit("a"), F.col("id"), F.lit("@x.com")).alias("email"), F.col("id").alias("person"))
    questions = table(spark, d, "benchmark").select((F.col("item_id") * 50).alias("query_id"), "text")
    pools = (registry.vector_search(spark, d).drop("rank"), registry.retrieval.text_search(documents(spark, d), questions).drop("rank"))
    hits = [evidence.readable_hits(evidence.linked(p, messages, assigned, people)) for p in pools]
    found = evidence.evidence(*hits, datetime(2001, 8, 20, tzinfo=timezone.utc), least_vector=0.1)
    return found.select("query_id", "id", "rank", "source", "vector_score", "text_score", "score", joined("projects"), joined("people"))


_RETURN = """k AS (SELECT n_nationkey AS k, n_regionkey AS original, (n_regionkey + n_nationkey % 3) % 5 AS coverer FROM nation), pr AS (SELECT p_size % 5 AS mailbox, p_partkey AS project, p_name || ' ' || p_partkey % 9 || 'xx' AS label FROM part WHERE p_partkey % 4 > 0),
ids AS (SELECT s_suppkey % 5 AS mailbox, s_suppkey AS person, 's' || s_suppkey % 40 || '@D' || s_suppkey % 11 || '.com' AS email FROM supplier),
cp AS (SELECT k, p_partkey AS project FROM k JOIN part ON p_partkey % 500 = k UNION SELECT l_orderkey % 25, l_partkey FROM lineitem WHERE l_quantity >= 50 AND l_linenumber = 1 AND l_orderkey % 25 < 6), pe AS (SELECT k, s_suppkey AS person FROM k JOIN supplier ON s_nationkey = k AND s_suppkey % 2 = 0),
dm AS (SELECT k, 'd' || k % 20 || '.com' AS domain FROM k UNION SELECT c_nationkey, 'd' || c_custkey % 30 || '.com' FROM customer WHERE c_custkey % 100 = 7), ow AS (SELECT cp.k, coverer, label FROM cp JOIN k USING (k) JOIN pr ON pr.mailbox = original AND pr.project = cp.project),
w AS (SELECT DISTINCT k, coverer, unnest(regexp_extract_all(lower(label), '[a-z0-9]{3,}')) AS word FROM ow), tw AS (SELECT DISTINCT mailbox, project, unnest(regexp_extract_all(lower(label), '[a-z0-9]{3,}')) AS word FROM pr), fp AS (SELECT DISTINCT k, project FROM w JOIN tw ON mailbox = coverer AND w.word = tw.word),
em AS (SELECT DISTINCT k, coverer, lower(email) AS email FROM pe JOIN k USING (k) JOIN ids ON ids.mailbox = original AND ids.person = pe.person), fu AS (SELECT k, ids.person FROM em JOIN ids ON ids.mailbox = coverer AND lower(ids.email) = em.email UNION SELECT dm.k, ids.person FROM dm JOIN k USING (k) JOIN ids ON ids.mailbox = coverer AND split_part(lower(ids.email), '@', 2) = dm.domain),
l AS (SELECT k, (SELECT string_agg(project::VARCHAR, ',' ORDER BY project) FROM fp WHERE fp.k = k.k) AS fp, (SELECT string_agg(person::VARCHAR, ',' ORDER BY person) FROM fu WHERE fu.k = k.k) AS fu, (SELECT string_agg(project::VARCHAR, ',' ORDER BY project) FROM cp WHERE cp.k = k.k) AS cp, (SELECT string_agg(domain, ',' ORDER BY domain) FROM dm WHERE dm.k = k.k) AS dm, (SELECT count(DISTINCT label) FROM ow WHERE ow.k = k.k) AS labels FROM k)"""


@query("PKG_11_return_scope", f"WITH {_RETURN} SELECT k AS return_id, coalesce(fp, '') AS projects, CASE WHEN fp IS NULL THEN coalesce(fu, '') ELSE '' END AS people, coalesce(cp, '') AS carried_projects, dm AS domains, labels, CASE WHEN fp IS NOT NULL THEN CASE WHEN fu IS NULL THEN 'structured' ELSE 'mixed' END WHEN fu IS NOT NULL AND cp IS NOT NULL THEN 'mixed' ELSE 'snapshot_hints' END AS method FROM l")
def _(spark, d):
    from .mail import joined

    n, parts, s, c = table(spark, d, "nation"), table(spark, d, "part"), table(spark, d, "supplier"), table(spark, d, "customer")
    k, key = F.col("n_nationkey"), F.col("p_partkey")
    own = parts.groupBy((key % 500).cast("int").alias("n_nationkey")).agg(F.collect_set(key).alias("projects"))
    people = s.where("s_suppkey % 2 = 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.collect_set("s_suppkey").alias("people"))
    scopes = n.join(own, "n_nationkey", "left").join(people, "n_nationkey", "left").select(k.alias("package"), F.col("n_regionkey").alias("mailbox"), "projects", "people", F.array(F.concat(F.lit("D"), k % 20, F.lit(".com"))).alias("domains"))
    claims = table(spark, d, "lineitem").where("l_quantity >= 50 and l_linenumber = 1 and l_orderkey % 25 < 6").select((F.col("l_orderkey") % 25).cast("int").alias("package"), F.col("l_partkey").alias("project"))
    seen = c.where("c_custkey % 100 = 7").select(F.col("c_nationkey").alias("package"), F.concat(F.lit("D"), F.col("c_custkey") % 30, F.lit(".com")).alias("sender_domain"))
    projects = parts.where(key % 4 > 0).select((F.col("p_size") % 5).alias("mailbox"), key.alias("project"), F.concat("p_name", F.lit(" "), key % 9, F.lit("xx")).alias("label"))
    u = F.col("s_suppkey")
    identities = s.select((u % 5).cast("int").alias("mailbox"), u.alias("person"), F.concat(F.lit("s"), u % 40, F.lit("@D"), u % 11, F.lit(".com")).alias("email"))
    asked = n.select(k.alias("return_id"), k.alias("package"), ((F.col("n_regionkey") + k % 3) % 5).alias("mailbox"))
    found = returns.return_scope(asked, scopes, claims, seen, projects, identities)
    return found.select("return_id", joined("projects"), joined("people"), joined("carried_projects"), joined("domains"), F.size("labels").cast("long").alias("labels"), "method")


from .mail import EVT, MSG  # noqa: E402


@query("PKG_01_candidate", f"""WITH {MSG}, {EVT}, reach AS (SELECT * FROM msg WHERE NOT noise AND ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1997-07-01' AND thread_id % 13 <> 0 AND message_id % 19 <> 0), ok AS (SELECT * FROM reach WHERE thread_id NOT IN (SELECT thread_id FROM bad)),
cl AS (SELECT event_id, project, message_id FROM evt JOIN cit USING (event_id) JOIN ok USING (message_id)), named AS (SELECT DISTINCT p_brand AS project, 'Area ' || p_brand AS label FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2'))
SELECT 'claim' AS part, event_id::VARCHAR AS ref, coalesce(any_value(label), '') || ':' || string_agg(message_id::VARCHAR, ',' ORDER BY message_id) AS detail FROM cl LEFT JOIN named USING (project) GROUP BY event_id
UNION ALL SELECT 'evidence', message_id::VARCHAR, count(DISTINCT event_id)::VARCHAR FROM cl GROUP BY message_id UNION ALL SELECT DISTINCT 'user_removed', thread_id::VARCHAR, 'thread' FROM msg WHERE thread_id % 13 = 0 UNION ALL SELECT 'user_removed', message_id::VARCHAR, 'message' FROM msg WHERE message_id % 19 = 0
UNION ALL SELECT DISTINCT 'sensitivity', thread_id::VARCHAR, 'thread' FROM reach WHERE thread_id IN (SELECT thread_id FROM bad)""")
def _(spark, d):
    from . import mail

    m = mail.messages(spark, d)
    labels = table(spark, d, "part").select(F.col("p_brand").alias("project"), F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), " ").otherwise(F.concat(F.lit(" Area "), "p_brand")).alias("label")).distinct()
    got = returns.assembled(mail.events(spark, d), m, labels, "1995-01-01", "1997-06-30", None, m.where("thread_id % 13 = 0"), m.where("message_id % 19 = 0"))
    row = lambda rows, part, ref, detail: rows.select(part.alias("part"), F.col(ref).cast("string").alias("ref"), detail.cast("string").alias("detail"))
    claims = row(got["claims"], F.lit("claim"), "event_id", F.concat(F.coalesce("label", F.lit("")), F.lit(":"), F.array_join(F.col("cites").cast("array<string>"), ",")))
    out = row(got["exclusions"], F.col("exclusion"), "ref", F.col("target"))
    return claims.unionByName(row(got["evidence"], F.lit("evidence"), "message_id", F.col("claims"))).unionByName(out)

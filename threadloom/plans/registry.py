"""Registered queries: every operator over the driver's tables, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import mailbox, package, relations, retrieval
from ..session import table
from ..sources import sinks
from ..streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages out of conversations: a thread per conversation, a reference to the turn before."""
    c = table(spark, d, "conversations")
    name = lambda turn: F.concat(F.lit("c"), "conv_id", F.lit("-"), turn, F.lit("@x"))
    refs = F.when(F.col("turn") > 0, F.array(name(F.col("turn") - 1))).otherwise(F.array().cast("array<string>"))
    return c.select(name(F.col("turn")).alias("message_id"), F.col("conv_id").alias("thread"), F.col("turn").alias("at"), F.col("role").alias("sender"), "text", refs.alias("refs"))


# ---- edges, people, threads -------------------------------------------------------------------------------


@query(
    "AGG_01_owner_edges",
    """
WITH r AS (SELECT o_custkey AS person, o_orderstatus = 'O' AS sent, o_orderdate AS ts FROM orders WHERE o_orderstatus <> 'P'),
e AS (SELECT person, count(*) AS message_count, count(*) FILTER (WHERE sent) AS sent_to_count, count(*) FILTER (WHERE NOT sent) AS received_count,
             min(ts) AS f, max(ts) AS l, (SELECT max(ts) FROM r) AS now FROM r GROUP BY person)
SELECT person, message_count, sent_to_count, received_count, strftime(f, '%Y-%m-%d') AS first_contact, strftime(l, '%Y-%m-%d') AS last_contact,
       round(0.5 * ln(1 + message_count) + 0.3 * exp(-floor((epoch(now) - epoch(l)) / 86400) / 45.0)
             + 0.2 * (1 - abs(sent_to_count - received_count) / greatest(message_count, 1)), 4) AS weight
FROM e""",
)
def owner_edges(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("person"), (F.col("o_orderstatus") == "O").alias("sent"), F.col("o_orderdate").alias("ts"), (F.col("o_orderstatus") == "P").alias("noise"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return mailbox.owner_edges(o).select("person", "message_count", "sent_to_count", "received_count", day("first_contact"), day("last_contact"), "weight")


@query(
    "GRF_01_threads",
    """SELECT 'c' || conv_id || '-' || turn || '@x' AS message_id, conv_id AS provider_thread_id,
              min('c' || conv_id || '-' || turn || '@x') OVER (PARTITION BY conv_id) AS thread, FALSE AS lineage_conflict FROM conversations""",
)
def rebuilt_threads(spark: SparkSession, d: str) -> DataFrame:
    return mailbox.rebuild_threads(messages(spark, d).withColumnRenamed("thread", "provider_thread_id"))


@query(
    "AGG_02_thread_rollup",
    """SELECT conv_id AS thread, count(*) AS n_messages, min(turn) AS t_start, max(turn) AS t_end, arg_min(text, turn) AS root_text,
              array_to_string(list_sort(list(DISTINCT role)), ',') AS participants FROM conversations GROUP BY conv_id""",
)
def thread_rollup(spark: SparkSession, d: str) -> DataFrame:
    return mailbox.thread_rollup(messages(spark, d)).withColumn("participants", F.array_join("participants", ","))


_MARKED = """SELECT conv_id AS thread, regexp_matches(lower(text), 'the ther') AS noise, regexp_matches(lower(text), 'disgusting|trash|worthless') AS bad FROM conversations"""


def marked(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    tags = F.when(low.rlike("disgusting|trash|worthless"), F.array(F.lit("hr"))).otherwise(F.array(F.lit("none")))
    return messages(spark, d).select("thread", low.rlike("the ther").alias("noise"), tags.alias("sensitivity"))


@query("FLT_06_eligible_threads", f"WITH m AS ({_MARKED}) SELECT thread FROM m GROUP BY thread HAVING bool_or(NOT noise AND NOT bad) AND NOT bool_or(bad)")
def eligible(spark: SparkSession, d: str) -> DataFrame:
    return mailbox.eligible_threads(marked(spark, d))


@query("FLT_07_weak_thread_gate", f"WITH m AS ({_MARKED}) SELECT thread FROM m GROUP BY thread HAVING NOT bool_or(bad)")
def weakly_eligible(spark: SparkSession, d: str) -> DataFrame:
    return mailbox.eligible_threads(marked(spark, d), strict=False)


def people(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("|", "p_brand", "p_type").alias("block"), F.col("p_name").alias("name"))


# all pairs of different names of a block, the longest common subsequence letter by letter
_NAMES = """people AS (SELECT p_partkey AS id, concat_ws('|', p_brand, p_type) AS block, lower(p_name) AS name FROM part), nm AS (SELECT block, name, min(id) AS id FROM people WHERE name <> '' GROUP BY 1, 2),
np AS (SELECT DISTINCT a.name AS x, b.name AS y FROM nm a JOIN nm b ON a.block = b.block AND a.name < b.name),
lcs AS (SELECT x, y, 0 AS i, list_transform(range(length(y) + 1), lambda j: 0) AS row FROM np UNION ALL SELECT x, y, i + 1, list_transform(range(length(y) + 1), lambda j: list_max(list_concat([row[j + 1]], list_transform(list_filter(range(1, j + 1), lambda k: y[k] = x[i + 1]), lambda k: row[k] + 1)))) FROM lcs WHERE i < length(x)),
sim AS (SELECT x, y, round(200.0 * list_last(row) / (length(x) + length(y)), 4) AS similarity FROM lcs WHERE i = length(x)),
sn AS (SELECT a.id AS a, b.id AS b, a.name AS name_a, b.name AS name_b, similarity FROM nm a JOIN nm b ON a.block = b.block AND a.name < b.name JOIN sim ON a.name = x AND b.name = y WHERE similarity >= 92)"""
_PERSONS = f"""{_NAMES}, lk AS (SELECT p.id AS a, n.id AS b FROM people p JOIN nm n USING (block, name) UNION SELECT a, b FROM sn), both_ AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk),
reach AS (SELECT id AS node, id AS r FROM people UNION SELECT both_.b, reach.r FROM reach JOIN both_ ON both_.a = reach.node), person AS (SELECT node AS id, min(r) AS person FROM reach GROUP BY 1)"""


@query("JOIN_14_similar_names", f"WITH RECURSIVE {_NAMES} SELECT * FROM sn")
def similar_names(spark: SparkSession, d: str) -> DataFrame:
    return mailbox.similar_names(people(spark, d))


@query("JOIN_14_name_members", "SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_brand, p_type, lower(p_name)) AS representative FROM part WHERE p_name IS NOT NULL")
def name_members(spark: SparkSession, d: str) -> DataFrame:
    return mailbox.name_members(people(spark, d))


@query("GRF_03_identities", f"WITH RECURSIVE {_PERSONS} SELECT id, person FROM person")
def identities(spark: SparkSession, d: str) -> DataFrame:
    return mailbox.identities(people(spark, d))


@query("AGG_03_display_names", "SELECT email, string_agg(name, '|' ORDER BY seen, name) AS names FROM (SELECT o_custkey AS email, o_orderpriority AS name, min(o_orderkey) AS seen FROM orders GROUP BY 1, 2) GROUP BY 1")
def display_names(spark: SparkSession, d: str) -> DataFrame:
    mentions = table(spark, d, "orders").select(F.col("o_custkey").alias("email"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("at"))
    return mailbox.display_names(mentions).select("email", F.array_join("names", "|").alias("names"))


@query("AGG_04_persons", f"WITH RECURSIVE {_PERSONS} SELECT person, array_to_string(list_sort(list(DISTINCT p_name)), '|') AS names, array_to_string(list_sort(list(DISTINCT id)), ',') AS identities FROM person JOIN part ON p_partkey = id GROUP BY 1")
def persons(spark: SparkSession, d: str) -> DataFrame:
    rows = people(spark, d)
    found = mailbox.persons(rows, mailbox.identities(rows))
    return found.select("person", F.array_join("names", "|").alias("names"), F.array_join(F.col("identities").cast("array<string>"), ",").alias("identities"))


@query("AGG_05_orgs", "SELECT DISTINCT lower(p_brand) AS domain, lower(p_brand) IN ('brand#11', 'brand#23') AS internal FROM part WHERE p_brand <> ''")
def orgs(spark: SparkSession, d: str) -> DataFrame:
    return mailbox.orgs(table(spark, d, "part").select(F.col("p_brand").alias("block")), ["Brand#11", "Brand#23"])


# ---- filters and scalar functions -------------------------------------------------------------------------


@query(
    "FLT_01_noise",
    """SELECT c_custkey AS id, (c_mktsegment = 'MACHINERY' OR c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR c_custkey % 13 = 0) AS noise FROM customer""",
)
def noise(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    headers = F.map_filter(
        F.create_map(F.lit("Precedence"), F.when(F.col("c_mktsegment") == "MACHINERY", "Bulk"), F.lit("List-Unsubscribe"), F.when(k % 7 == 0, "<x>"), F.lit("X-Mailer"), F.when(k % 11 == 0, "SendGrid 2")),
        lambda a, b: b.isNotNull(),
    )
    sender = F.when(k % 13 == 0, F.lit("no-reply@x.org")).otherwise(F.lit("ann@x.org"))
    return c.select(k.alias("id"), S.noise(headers, sender).alias("noise"))


@query(
    "FLT_02_sensitivity",
    r"""WITH t AS (SELECT event_id, event_type || CASE event_id % 4 WHEN 0 THEN ' salary review' WHEN 1 THEN ' Legal Hold notice' WHEN 2 THEN ' salaryman' ELSE ' Offer letter, legal hold' END AS x FROM events)
SELECT event_id, array_to_string(CASE WHEN p OR h THEN list_filter([CASE WHEN p THEN 'privileged' END, CASE WHEN h THEN 'hr' END], lambda v: v IS NOT NULL) ELSE ['none'] END, ',') AS tags
FROM (SELECT event_id, regexp_matches(lower(x), '\b(attorney-client|privileged and confidential|legal hold|outside counsel)\b') AS p,
             regexp_matches(lower(x), '\b(compensation|salary|performance review|performance improvement plan|termination|severance|offer letter|benefits enrollment)\b') AS h FROM t)""",
)
def sensitivity(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    tail = F.when(k == 0, " salary review").when(k == 1, " Legal Hold notice").when(k == 2, " salaryman").otherwise(" Offer letter, legal hold")
    e = table(spark, d, "events").withColumn("x", F.concat("event_type", tail))
    return e.select("event_id", F.array_join(S.sensitivity(F.col("x"), F.lit("a@b.org")), ",").alias("tags"))


@query("FLT_08_window", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS people FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'")
def window(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.readers import in_window

    return in_window(table(spark, d, "orders"), "o_orderdate", "1996-01-01", "1996-12-31").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("people"))


@query("FLT_24_pii_cells", "SELECT count(*) FILTER (WHERE contains(text, '@')) AS cells, count(*) AS n_rows FROM documents")
def pii(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count_if(F.contains("text", F.lit("@"))).alias("cells"), F.count("*").alias("n_rows"))


@query(
    "SCAL_01_addresses",
    r"""WITH a AS (SELECT c_custkey, ' ' || upper(replace(c_name, '#', '+tag')) || '@Mail.Example.ORG ' AS raw FROM customer)
SELECT c_custkey, regexp_replace(lower(trim(raw)), '\+[^@]*@', '@') AS email, lower(string_split(raw, '@')[-1]) AS domain,
       regexp_replace(regexp_replace(lower(trim(raw)), '\+[^@]*@', '@'), '^(.).*(@.*)$', '\1***\2') AS masked FROM a""",
)
def addresses(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(" "), F.upper(F.replace("c_name", F.lit("#"), F.lit("+tag"))), F.lit("@Mail.Example.ORG "))
    c = table(spark, d, "customer").select("c_custkey", raw.alias("raw"))
    return c.select("c_custkey", S.norm_email(F.col("raw")).alias("email"), S.domain_of(F.col("raw")).alias("domain"), S.mask_email(S.norm_email(F.col("raw"))).alias("masked"))


@query(
    "SCAL_08_subjects",
    r"""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Re: FW: ' WHEN 1 THEN ' fwd :re:' ELSE '' END || o_orderpriority || ' ' AS x FROM orders)
SELECT o_orderkey, lower(trim(regexp_replace(x, '^(\s*(re|fwd?|fw)\s*:\s*)+', '', 'i'))) AS subject FROM s""",
)
def subjects(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    x = F.concat(F.when(k == 0, "Re: FW: ").when(k == 1, " fwd :re:").otherwise(""), "o_orderpriority", F.lit(" "))
    return table(spark, d, "orders").select("o_orderkey", S.norm_subject(x).alias("subject"))


@query(
    "SCAL_09_ids",
    """SELECT doc_id, sha256(lang || chr(10) || chr(10) || text) AS content_hash, substr(sha256('salt' || doc_id), 1, 16) AS hashed, substr(sha1('dup|' || doc_id), 1, 12) AS finding FROM documents""",
)
def ids(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select(
        "doc_id",
        F.sha2(F.concat("lang", F.lit("\n\n"), "text"), 256).alias("content_hash"),
        F.substring(F.sha2(F.concat(F.lit("salt"), i), 256), 1, 16).alias("hashed"),
        F.substring(F.sha1(F.concat(F.lit("dup|"), i)), 1, 12).alias("finding"),
    )


@query("SCAL_09_uuid5", "WITH m AS (SELECT 'c' || conv_id || '-' || turn || '@x' AS message_id FROM conversations), h AS (SELECT message_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('mailbox:' || message_id)) AS h FROM m) SELECT message_id, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], ['8', '9', 'a', 'b'][('0x' || h[17])::INT % 4 + 1] || h[18:20], h[21:32]) AS id FROM h")
def uuids(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).select("message_id", S.uuid5(F.concat(F.lit("mailbox:"), "message_id")).alias("id"))


_CLEAN = [(r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), (r"(?s)<[^>]*>", " "), (r"(?is)\nOn [^\n]*wrote:.*$", ""), (r"(?s)\n-- ?\n.*$", ""), (r"(?m)^>[^\n]*$", ""), (r"\s+", " ")]


@query("SCAL_10_clean_body", "SELECT page_id, substr(trim(" + "regexp_replace(" * len(_CLEAN) + "html" + "".join(f", '{p}', '{put}', 'g')" for p, put in _CLEAN) + "), 1, 50000) AS clean_text FROM pages")
def bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", S.clean_body(F.col("html")).alias("clean_text"))


@query("SCAL_13_link_domains", r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'https?://([A-Za-z0-9.-]+)', 1)) AS h FROM pages), g AS (SELECT DISTINCT page_id, lower(array_to_string(list_slice(string_split(h, '.'), -2, NULL), '.')) AS x FROM h)
SELECT page_id, coalesce(string_agg(x, ',' ORDER BY x), '') AS domains FROM pages LEFT JOIN g USING (page_id) GROUP BY 1""")
def hosts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.array_join(S.link_domains(F.col("html")), ",").alias("domains"))


def _first_match(rules: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p.replace(chr(39), chr(39) * 2)}') THEN '{name}'" for name, p in rules) + f" ELSE '{otherwise}' END"


@query("SCAL_30_intents", f"SELECT 'c' || conv_id || '-' || turn || '@x' AS message_id, {_first_match(S.INTENTS, 'general')} AS intent, {_first_match(S.ROLE_RULES, 'unknown')} AS role FROM conversations WHERE text IS NOT NULL")
def intents(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).where("text is not null").select("message_id", S.intent(F.col("text")).alias("intent"), S.role(F.col("text")).alias("role"))


# runs of digits with single spaces or hyphens between them; from each the first stretch of whole groups of 13 to 19 digits, the longest, and so on
_CARDS = r"""seq AS (SELECT doc_id, row_number() OVER () AS sid, regexp_split_to_array(s, '[ -]') AS g FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\d(?:[ -]?\d)*')) AS s FROM documents) WHERE length(regexp_replace(s, '[ -]', '', 'g')) >= 13),
walk AS (SELECT doc_id, sid, g, 1 AS f, NULL::VARCHAR AS digits FROM seq UNION ALL SELECT doc_id, sid, g, p.b + 1, array_to_string(g[p.a:p.b], '') FROM (SELECT *, (SELECT {'a': a, 'b': b} FROM (SELECT x.a, y.b FROM generate_series(1, len(g)) x(a), generate_series(1, len(g)) y(b) WHERE x.a >= f AND y.b >= x.a AND length(array_to_string(g[x.a:y.b], '')) BETWEEN 13 AND 19) ORDER BY a, b DESC LIMIT 1) AS p FROM walk) WHERE p IS NOT NULL),
card AS (SELECT doc_id, digits, list_sum(list_transform(range(length(digits)), lambda i: CASE WHEN i % 2 = 0 THEN digits[length(digits) - i]::INT WHEN digits[length(digits) - i]::INT > 4 THEN 2 * digits[length(digits) - i]::INT - 9 ELSE 2 * digits[length(digits) - i]::INT END)) % 10 = 0 AS valid FROM walk WHERE digits IS NOT NULL)"""


@query("SCAL_38_luhn", f"WITH RECURSIVE {_CARDS} SELECT doc_id, digits, valid FROM card")
def luhn(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id", F.explode(S.card_candidates(F.col("text"))).alias("digits"))
    return found.select("doc_id", "digits", S.luhn_ok(F.col("digits")).alias("valid"))


_TERMS = "unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: len(x) >= 3)))"


@query(
    "SIM_01_set_similarity",
    f"""WITH t AS (SELECT doc_id, {_TERMS} AS term FROM documents), b AS (SELECT item_id, {_TERMS} AS term FROM benchmark), n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1), m AS (SELECT item_id, count(*) AS m FROM b GROUP BY 1),
s AS (SELECT doc_id, item_id, count(*) AS k FROM t JOIN b USING (term) GROUP BY 1, 2) SELECT doc_id, item_id, k::INT AS shared, round(k / (n + m - k), 6) AS jaccard, round(k / least(n, m), 6) AS overlap FROM s JOIN n USING (doc_id) JOIN m USING (item_id)""",
)
def set_similarity(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "documents").select(F.col("doc_id").alias("id"), S.tokens(F.col("text")).alias("terms"))
    return relations.set_similarity(sets, table(spark, d, "benchmark").select("item_id", S.tokens(F.col("text")).alias("terms"))).withColumnRenamed("id", "doc_id")


@query(
    "SIM_04_temporal_affinity",
    """WITH u AS (SELECT user_id, epoch(min(ts)) AS s, epoch(max(ts)) AS e FROM events GROUP BY user_id)
SELECT a.user_id AS a, b.user_id AS b, round(CASE WHEN least(a.e, b.e) - greatest(a.s, b.s) > 0 THEN (least(a.e, b.e) - greatest(a.s, b.s)) / (greatest(a.e, b.e) - least(a.s, b.s))
  ELSE 0.3 * exp(-power((greatest(a.s, b.s) - least(a.e, b.e)) / (86400.0 * 14), 2)) END, 4) AS affinity FROM u a JOIN u b ON a.user_id + 1 = b.user_id""",
)
def temporal(spark: SparkSession, d: str) -> DataFrame:
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    u = table(spark, d, "events").groupBy("user_id").agg(F.min(sec).alias("s"), F.max(sec).alias("e"))
    a, b = u.alias("a"), u.alias("b")
    j = a.join(b, F.col("a.user_id") + 1 == F.col("b.user_id"))
    return j.select(F.col("a.user_id").alias("a"), F.col("b.user_id").alias("b"), F.round(S.temporal_affinity(F.col("a.s"), F.col("a.e"), F.col("b.s"), F.col("b.e")), 4).alias("affinity"))


# ---- relations ----------------------------------------------------------------------------------------------

_MEMBERS = "SELECT DISTINCT l_orderkey AS group_id, l_suppkey AS member FROM lineitem"


def members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_suppkey").alias("member"))


@query("JOIN_15_copresence", f"WITH m AS ({_MEMBERS}) SELECT a.member AS a, b.member AS b, count(*) AS shared FROM m a JOIN m b ON a.group_id = b.group_id AND a.member < b.member GROUP BY 1, 2")
def copresence(spark: SparkSession, d: str) -> DataFrame:
    return relations.copresence(members(spark, d))


@query(
    "WIN_04_knn_cap",
    f"""WITH m AS ({_MEMBERS}), e AS (SELECT a.member AS a, b.member AS b, count(*) AS w FROM m a JOIN m b ON a.group_id = b.group_id AND a.member < b.member GROUP BY 1, 2),
r AS (SELECT a, b, w, row_number() OVER (PARTITION BY node ORDER BY w DESC, other) AS r FROM (SELECT *, a AS node, b AS other FROM e UNION ALL SELECT *, b, a FROM e))
SELECT DISTINCT a, b, w FROM r WHERE r <= 15""",
)
def knn(spark: SparkSession, d: str) -> DataFrame:
    return relations.knn_cap(relations.copresence(members(spark, d)).withColumnRenamed("shared", "w"))


@query(
    "GRF_19_bridges",
    "SELECT l_suppkey AS member, count(DISTINCT p_brand) AS projects FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2",
)
def bridges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return relations.bridges(rows.select(F.col("p_brand").alias("project"), F.col("l_suppkey").alias("member")))


@query(
    "AGG_07_idf",
    f"""WITH m AS ({_MEMBERS}), n AS (SELECT count(DISTINCT group_id) AS n FROM m)
SELECT member, count(*) AS df, round(ln(any_value(n) / count(*)), 6) AS idf, count(*) > 0.5 * any_value(n) AS ubiquitous FROM m, n GROUP BY member""",
)
def idf(spark: SparkSession, d: str) -> DataFrame:
    return relations.idf(members(spark, d))


@query(
    "AGG_14_top_terms",
    """WITH t AS (SELECT source AS group_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: len(x) >= 3)) AS term FROM documents),
tf AS (SELECT group_id, term, count(*) AS tf FROM t GROUP BY 1, 2), c AS (SELECT term, count(*) AS cdf FROM tf GROUP BY 1),
s AS (SELECT group_id, tf.term, tf, round(tf * ln((1 + (SELECT count(DISTINCT source) FROM documents)) / (1 + cdf)), 6) AS score FROM tf JOIN c ON tf.term = c.term),
r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, term) AS rank FROM s) SELECT group_id, rank, term, tf, score FROM r WHERE rank <= 12""",
)
def top_terms(spark: SparkSession, d: str) -> DataFrame:
    return relations.top_terms(table(spark, d, "documents").select(F.col("source").alias("group_id"), "text"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("community"))


_CENTROID = """c AS (SELECT label AS community, list(m ORDER BY i) AS centroid, any_value(n) AS n FROM (
  SELECT label, i, avg(embedding[i]::DOUBLE) AS m, count(*) AS n FROM embeddings, generate_series(1, 64) AS g(i) GROUP BY label, i) GROUP BY label)"""


@query(
    "GRF_09_soft_membership",
    f"""WITH {_CENTROID}, a AS (SELECT vec_id AS id, community, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), centroid) AS aff FROM embeddings, c),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY aff DESC, community) AS r, max(aff) OVER (PARTITION BY id) AS top FROM a)
SELECT id, community, round(greatest(aff, 1e-3), 4) AS weight, r = 1 AS is_primary FROM r WHERE r = 1 OR (aff >= 0.35 AND aff >= 0.65 * top)""",
)
def soft(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return relations.soft_membership(v.select("id", "v"), relations.centroids(v))


@query(
    "AGG_34_bcubed",
    """WITH m AS (SELECT p_partkey AS item, p_brand AS p, p_type AS g FROM part), c AS (SELECT p, g, count(*) AS n FROM m GROUP BY 1, 2),
x AS (SELECT n, sum(n) OVER (PARTITION BY p) AS np, sum(n) OVER (PARTITION BY g) AS ng FROM c), s AS (SELECT sum(n * n / np) / sum(n) AS pr, sum(n * n / ng) / sum(n) AS re FROM x)
SELECT round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re), 6) AS f1 FROM s""",
)
def bcubed(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return relations.bcubed(p.select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("label")), p.select(F.col("p_partkey").alias("item"), F.col("p_type").alias("label")))


# ---- retrieval ----------------------------------------------------------------------------------------------

_VECTOR = """v AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(list_transform(e.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE)), 4) AS score
  FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0))"""


@query("RET_01_vector_search", f"WITH {_VECTOR} SELECT query_id, id, score, rank FROM v WHERE rank <= 20")
def vector_search(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    asked = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return retrieval.vector_search(v.select("id", "v"), asked)


_BM25 = """w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
p AS (SELECT term, id, any_value(len) AS len, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM w) GROUP BY 1, 2),
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: len(x) >= 3)) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w),
t AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 4) AS score
      FROM p JOIN q USING (term) JOIN df USING (term), st GROUP BY 1, 2)"""


def searched(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query("RET_02_text_search", f"WITH {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM t) SELECT query_id, id, score, rank FROM r WHERE rank <= 20")
def text_search(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.text_search(searched(spark, d), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query(
    "RET_03_hybrid",
    f"""WITH {_VECTOR}, {_BM25}, a AS (SELECT query_id, id, CASE WHEN min(score) OVER w = max(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS v FROM v WHERE rank <= 20 WINDOW w AS (PARTITION BY query_id)),
r AS (SELECT query_id * 50 AS query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM t),
b AS (SELECT query_id, id, CASE WHEN min(score) OVER w = max(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS t FROM r WHERE rank <= 20 WINDOW w AS (PARTITION BY query_id)),
m AS (SELECT query_id, id, CASE WHEN v IS NULL THEN 'fts' WHEN t IS NULL THEN 'vector' ELSE 'hybrid' END AS source, round(0.6 * coalesce(v, 0) + 0.4 * coalesce(t, 0), 4) AS score FROM a FULL JOIN b USING (query_id, id)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM m) SELECT query_id, id, source, score, rank FROM k WHERE rank <= 10""",
)
def hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth vector and every benchmark item asks; item i goes with vector 50 i."""
    questions = table(spark, d, "benchmark").select((F.col("item_id") * 50).alias("query_id"), "text")
    return retrieval.hybrid(vector_search(spark, d).drop("rank"), retrieval.text_search(searched(spark, d), questions).drop("rank"))


@query("RET_07_backfill", "SELECT doc_id AS id, sha256(text) AS content_hash FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def backfill(spark: SparkSession, d: str) -> DataFrame:
    now = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))
    old = now.where("id % 3 <> 0").withColumn("content_hash", F.when(F.col("id") % 5 == 0, "old").otherwise(F.col("content_hash")))
    return retrieval.backfill_plan(now, old)


# ---- packages -----------------------------------------------------------------------------------------------


_RULES = " UNION ALL ".join(f"SELECT doc_id AS ref, '{name}' AS category, {('high', 'medium', 'low').index(level)} AS s FROM documents WHERE regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')" for name, level, p in [*S.SAFETY, ("blocker_or_dependency", "medium", S.BLOCKER), ("stale_or_conflicting", "medium", S.STALE)])


@query("PKG_06_safety", f"WITH RECURSIVE {_CARDS}, r AS ({_RULES} UNION ALL SELECT doc_id, 'payment_financial', 0 FROM card WHERE valid) SELECT ref, category, ['high', 'medium', 'low'][min(s) + 1] AS severity, substr(sha1(category || '|' || ref), 1, 12) AS finding_id FROM r GROUP BY 1, 2")
def safety(spark: SparkSession, d: str) -> DataFrame:
    return package.safety_scan(table(spark, d, "documents").select(F.col("doc_id").alias("ref"), "text"))


@query(
    "FLT_18_grounded_claims",
    """WITH a AS (SELECT DISTINCT event_id FROM events WHERE event_type <> 'error'), c AS (SELECT user_id, event_id FROM events)
SELECT user_id AS claim_id, array_to_string(list_sort(list(event_id)), ',') AS cites FROM c SEMI JOIN a USING (event_id) GROUP BY 1""",
)
def grounded(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    claims = e.groupBy(F.col("user_id").alias("claim_id")).agg(F.collect_list("event_id").alias("cites"))
    return package.grounded(claims, e.where("event_type <> 'error'").select(F.col("event_id").alias("cite"))).withColumn("cites", F.array_join("cites", ","))


@query(
    "PKG_07_coverage",
    """SELECT user_id AS label, count(*) FILTER (WHERE event_type = 'purchase') AS decisions, count(*) FILTER (WHERE event_type = 'click') AS open_loops,
              count(*) FILTER (WHERE event_type = 'view') AS actions, count(DISTINCT event_id) AS evidence FROM events GROUP BY 1""",
)
def coverage(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "outcome").when(F.col("event_type") == "click", "proposed").when(F.col("event_type") == "view", "did")
    return package.coverage(table(spark, d, "events").select(F.col("user_id").alias("label"), kind.alias("kind"), F.array("event_id").alias("cites")))


@query(
    "PKG_08_ask",
    """WITH k AS (SELECT coalesce(lang, 'none') AS p, doc_id AS c, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: len(x) >= 3))) AS t FROM documents),
q AS (SELECT p, item_id AS q, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: len(x) >= 3))) AS t FROM benchmark, (SELECT DISTINCT coalesce(lang, 'none') AS p FROM documents)),
s AS (SELECT q.p AS package_id, q AS question_id, c AS claim_id, count(*) AS overlap FROM q JOIN k ON q.p = k.p AND q.t = k.t GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY package_id, question_id ORDER BY overlap DESC, claim_id) AS rank FROM s) SELECT package_id, question_id, claim_id, overlap, rank FROM r WHERE rank <= 6""",
)
def ask(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item is asked in every package; a package holds the documents of a language."""
    claims = table(spark, d, "documents").select(F.coalesce("lang", F.lit("none")).alias("package_id"), F.col("doc_id").alias("claim_id"), "text")
    asked = claims.select("package_id").distinct().join(table(spark, d, "benchmark"), how="cross")  # packages x questions
    return package.ask(claims, asked.select("package_id", F.col("item_id").alias("question_id"), "text"))


@query(
    "PKG_09_lifecycle",
    """WITH p AS (SELECT o_custkey AS lineage, o_orderkey AS version, CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'draft' ELSE 'revoked' END AS status FROM orders)
SELECT lineage, version, CASE WHEN status = 'published' AND version < max(CASE WHEN status = 'published' THEN version END) OVER (PARTITION BY lineage) THEN 'superseded' ELSE status END AS status FROM p""",
)
def lifecycle(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "draft").otherwise("revoked")
    return package.latest_versions(table(spark, d, "orders").select(F.col("o_custkey").alias("lineage"), F.col("o_orderkey").alias("version"), status.alias("status")))


# ---- serving, quality, writes -------------------------------------------------------------------------------


@query("QRY_01_network_map", "SELECT c_custkey, c_name, n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('FURNITURE', 'MACHINERY') GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def network_map(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where(F.col("c_mktsegment").isin("FURNITURE", "MACHINERY"))
    edges = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")).where("n >= 2")
    named = edges.join(c, "c_custkey").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return named.select("c_custkey", "c_name", "n_name", "n")


@query("AGG_18_unnest_counts", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS word FROM part) GROUP BY 1")
def unnest_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.explode(F.split("p_type", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("AGG_20_rate_having", "SELECT user_id, count(*) AS n, round(avg((event_type = 'error')::INT), 6) AS rate FROM events GROUP BY 1 HAVING count(*) >= 5")
def rates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg((F.col("event_type") == "error").cast("int")), 6).alias("rate")).where("n >= 5")


@query(
    "AGG_21_size_histogram",
    "SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '21+' END AS bucket, count(*) AS threads FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) GROUP BY 1",
)
def histogram(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    bucket = F.when(F.col("n") == 1, "1").when(F.col("n") <= 5, "2-5").when(F.col("n") <= 20, "6-20").otherwise("21+")
    return n.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("threads"))


@query(
    "AGG_29_confusion",
    r"""WITH x AS (SELECT regexp_matches(text, '(\*\*\*|!!|&&&| \| )') AS p, quality = 0 AS a FROM labels JOIN documents USING (doc_id)),
m AS (SELECT count(*) FILTER (WHERE p AND a) AS tp, count(*) FILTER (WHERE p AND NOT a) AS fp, count(*) FILTER (WHERE NOT p AND a) AS fn, count(*) FILTER (WHERE NOT p AND NOT a) AS tn FROM x)
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM m""",
)
def confusion(spark: SparkSession, d: str) -> DataFrame:
    p, a = F.col("text").rlike(r"(\*\*\*|!!|&&&| \| )"), F.col("quality") == 0
    x = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    return x.withColumn("precision", F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6)).withColumn("recall", F.round(F.col("tp") / (F.col("tp") + F.col("fn")), 6))


@query(
    "SNK_01_upsert",
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderstatus END AS status, o_orderdate AS created_at FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0",
)
def upserted(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return sinks.upsert(o.where("id % 3 <> 0"), o.where("id % 2 = 0").withColumn("status", F.lit("new")), ["id"], keep="created_at")


@query("SNK_05_scoped_replace", "SELECT user_id AS id, 'old' AS state FROM events GROUP BY 1 HAVING NOT bool_or(event_type = 'error') UNION ALL SELECT user_id, 'new' FROM events WHERE event_type = 'error' GROUP BY 1")
def scoped(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    old = e.groupBy(F.col("user_id").alias("id")).agg(F.collect_set("event_type").alias("cites")).withColumn("state", F.lit("old"))
    new = old.where(F.array_contains("cites", "error")).withColumn("state", F.lit("new"))
    hit = spark.range(1).select(F.lit("error").alias("cite"))
    return sinks.replace_scoped(old, new, "id", "cites", hit).select("id", "state")


@query("SET_04_removed", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def removed(spark: SparkSession, d: str) -> DataFrame:
    return sinks.removed_keys(table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query("STR_12_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    return windows.windowed_counts(table(spark, d, "events"), "1 hour")


@query(
    "STR_12_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
)
def sessions(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(table(spark, d, "events"))


from . import graphs, mail, texts  # noqa: E402, F401  their queries register themselves

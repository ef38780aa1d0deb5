"""Queries over the given tables, each with the SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import expressions as X
from palimpsest.operators import conversation as C
from palimpsest.operators import dedup as P
from palimpsest.operators import graph as G
from palimpsest.operators import retrieval as R
from palimpsest.operators import similarity as Y
from palimpsest.operators import versions as V
from palimpsest.operators.components import components
from palimpsest.operators.evaluation import evaluation, recalls
from palimpsest.operators.intervals import as_of
from palimpsest.operators.lineage import shared_dir, written
from palimpsest.operators.orderstats import order_statistics
from palimpsest.plans.registry import QUERIES, SQL, query  # noqa: F401
from palimpsest.sources import inputs as I
from palimpsest.sources.rows import regular
from palimpsest.streaming import jobs as S

THRESHOLD, K = 0.15, 10
STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
ACTIVE = "status = 'active' AND is_latest"
VEC = f"""{I.MEMORY}, {I.REQUESTS},
vec AS (SELECT query_id, node_id, layer, round(list_cosine_similarity(query_vector, embedding), 6) AS score FROM req JOIN mem USING (user_id)
        WHERE {ACTIVE} AND round(list_cosine_similarity(query_vector, embedding), 6) >= {THRESHOLD})"""
TERMS = r"[a-z0-9]+|[\x{4e00}-\x{9fff}]+"
BM = f"""{I.MEMORY}, {I.REQUESTS},
live AS (SELECT user_id, node_id, regexp_extract_all(lower(content), '{TERMS}') AS terms FROM mem WHERE {ACTIVE}),
post AS (SELECT user_id, node_id, len(terms) AS dl, t.term, count(*) AS tf FROM live, unnest(terms) t(term) GROUP BY ALL),
size AS (SELECT user_id, count(*) AS n, avg(len(terms)) AS mean FROM live GROUP BY 1),
freq AS (SELECT user_id, term, count(*) AS df FROM post GROUP BY ALL),
ask AS (SELECT query_id, user_id, list_distinct(regexp_extract_all(lower(query_text), '{TERMS}')) AS terms FROM req),
askt AS (SELECT query_id, user_id, len(terms) AS n_terms, t.term FROM ask, unnest(terms) t(term)),
bm AS (SELECT query_id, node_id, n_terms, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS bm25
       FROM askt JOIN freq USING (user_id, term) JOIN size USING (user_id) JOIN post USING (user_id, term) GROUP BY ALL)"""


def live(s, d) -> DataFrame:
    return R.scoped(I.memory(s, d))


def vector(s, d) -> DataFrame:
    pairs = I.requests(s, d).select("query_id", "user_id", "query_vector").join(live(s, d).select("user_id", "node_id", "layer", "embedding"), "user_id")
    return pairs.select("query_id", "node_id", "layer", F.round(X.cosine(F.col("query_vector"), F.col("embedding")), 6).alias("score")).where(F.col("score") >= THRESHOLD)


def words(s, d) -> DataFrame:
    return R.bm25_hits(I.requests(s, d), live(s, d))


# sources and sinks


NAMES = ["Profile", " l5_schema", "l6_intention", "dialogue", "l2_fact", "nothing", "L3_SUMMARY", "raw"]
RAW = f"""{I.MEMORY}, al AS (SELECT unnest({[*I.ALIASES, *I.LAYERS]}) AS old, unnest({[*I.ALIASES.values(), *I.LAYERS]}) AS layer),
rw AS (SELECT num, node_id, CASE WHEN num % 9 < 8 THEN {NAMES}[num % 9 + 1] END AS old, CASE num % 4 WHEN 0 THEN ' Archived' WHEN 1 THEN 'gone' WHEN 2 THEN status END AS status, CASE WHEN num % 3 = 0 THEN gmt_created - INTERVAL 1 DAY END AS memory_at, CASE WHEN num % 2 = 0 THEN gmt_created - INTERVAL 2 DAY END AS created_at,
CASE WHEN num % 5 = 0 THEN gmt_created END AS observed_at, CASE num % 6 WHEN 0 THEN 'Future ' WHEN 1 THEN 'someday' WHEN 2 THEN ' ' WHEN 3 THEN 'past' END AS relation, CASE num % 7 WHEN 0 THEN 'high' WHEN 1 THEN '1.5' WHEN 2 THEN '-1' WHEN 3 THEN NULL ELSE '0.25' END AS confidence, CASE WHEN num % 8 = 0 THEN gmt_created + INTERVAL 1 DAY END AS valid_from, gmt_created, CASE WHEN num % 2 = 0 THEN is_latest END AS is_latest, CASE WHEN num % 3 > 0 THEN access_count END AS access_count FROM mem)"""


@query("src_memory", f"""WITH {RAW}, rl AS (SELECT rw.*, coalesce(al.layer, 'l1_raw') AS name, coalesce(memory_at, created_at) AS at_ FROM rw LEFT JOIN al ON al.old = lower(trim(rw.old)))
SELECT node_id, name AS layer, CASE WHEN lower(trim(status)) IN ('active', 'superseded', 'archived', 'deleted') THEN lower(trim(status)) ELSE 'active' END AS status, at_ AS memory_at, coalesce(observed_at, CASE WHEN name IN ('l2_fact', 'l7_intention') THEN at_ END) AS observed_at,
CASE WHEN lower(trim(relation)) IN ('past', 'present', 'future', 'recurring', 'atemporal', 'unknown') THEN lower(trim(relation)) WHEN trim(relation) <> '' THEN 'unknown' END AS temporal_relation, CASE WHEN TRY_CAST(confidence AS DOUBLE) IS NOT NULL THEN greatest(0, least(1, TRY_CAST(confidence AS DOUBLE))) END AS confidence, coalesce(valid_from, gmt_created) AS valid_from, coalesce(is_latest, true) AS is_latest, coalesce(access_count, 0) AS access_count FROM rl""")
def src_memory(s, d):
    """Rows with older layer names, odd states, missing times and values out of bounds."""
    n, created = F.col("num"), F.col("gmt_created")
    before = lambda days: F.timestamp_seconds(F.unix_timestamp("gmt_created") - days * 86400)
    raw = I.memory(s, d).select(
        "node_id",
        F.when(n % 9 < 8, F.get(F.array(*map(F.lit, NAMES)), (n % 9).cast("int"))).alias("layer"),
        F.when(n % 4 == 0, " Archived").when(n % 4 == 1, "gone").when(n % 4 == 2, F.col("status")).alias("status"),
        F.when(n % 3 == 0, before(1)).alias("memory_at"),
        F.when(n % 2 == 0, before(2)).alias("created_at"),
        F.when(n % 5 == 0, created).alias("observed_at"),
        F.when(n % 6 == 0, "Future ").when(n % 6 == 1, "someday").when(n % 6 == 2, " ").when(n % 6 == 3, "past").alias("temporal_relation"),
        F.when(n % 7 == 0, "high").when(n % 7 == 1, "1.5").when(n % 7 == 2, "-1").when(n % 7 > 3, "0.25").alias("normalization_confidence"),
        F.when(n % 8 == 0, before(-1)).alias("valid_from"),
        "gmt_created",
        F.when(n % 2 == 0, F.col("is_latest")).alias("is_latest"),
        F.when(n % 3 > 0, F.col("access_count")).alias("access_count"),
    )
    return regular(raw).withColumnRenamed("normalization_confidence", "confidence").drop("gmt_created")


@query("src_payload", f"WITH {I.MEMORY}, w AS (SELECT *, content || ' ' || array_to_string(tags, ' ') AS said FROM mem) SELECT node_id, concat_ws('::', user_id, agent_id, session_id) AS isolation_key, coalesce(array_to_string(list_filter(regexp_extract_all(lower(said), '{TERMS}'), lambda t: CASE WHEN regexp_matches(t, '^[a-z0-9]') THEN t NOT IN ({STOP}) ELSE length(t) >= 2 END), ' '), '') AS search_text FROM w")
def src_payload(s, d):
    said = F.concat_ws(" ", "content", F.array_join("tags", " "))
    return I.memory(s, d).select("node_id", F.concat_ws("::", "user_id", "agent_id", "session_id").alias("isolation_key"), X.normal_words(said).alias("search_text"))


@query("src_list", f"WITH {I.MEMORY} SELECT node_id, user_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gmt_created DESC, node_id) AS nth FROM mem WHERE status = 'active' AND layer = 'l2_fact') WHERE nth <= 5")
def src_list(s, d):
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("gmt_created").desc(), "node_id"))
    return R.scoped(I.memory(s, d), latest=None, layers=["l2_fact"]).select("node_id", "user_id", nth.alias("nth")).where("nth <= 5")


@query("src_datetime", "SELECT o_orderkey, o_orderdate + INTERVAL 13 HOUR + INTERVAL 56 MINUTE AS parsed FROM orders")
def src_datetime(s, d):
    said = F.concat(F.lit("1:56 pm on "), F.date_format("o_orderdate", "d MMMM, yyyy"))
    return I.table(s, d, "orders").select("o_orderkey", F.try_to_timestamp(F.regexp_replace(said, " on ", " "), F.lit("h:mm a d MMMM, yyyy")).alias("parsed"))


@query("snk_upsert", f"WITH {I.MEMORY}, dl AS (SELECT num + k.k * 1000000 AS id, 'new ' || k.k || ' ' || num AS content, num * 2 + k.k AS seq, CASE (num + k.k) % 4 WHEN 0 THEN NULL WHEN 1 THEN [] ELSE embedding END AS e FROM mem, (SELECT unnest([0, 0, 1]) AS k) k UNION ALL SELECT num, 'last ' || num, num * 2 + 9, embedding FROM mem WHERE num % 5 = 0), up AS (SELECT id, arg_max(content, seq) AS content FROM dl WHERE len(e) > 0 GROUP BY 1) SELECT id, content FROM up UNION ALL SELECT num, content FROM mem WHERE num NOT IN (SELECT id FROM up)")
def snk_upsert(s, d):
    """Each row once more, and as a new one, some of them without a vector; every fifth a third time."""
    rows = I.memory(s, d).select(F.col("num").alias("id"), "content", "embedding")
    delta = rows.withColumn("k", F.explode(F.array(F.lit(0), F.lit(0), F.lit(1))))
    part = (F.col("id") + F.col("k")) % 4
    vector = F.when(part == 0, None).when(part == 1, F.array().cast("array<double>")).otherwise(F.col("embedding"))
    delta = delta.select((F.col("id") + F.col("k") * 1000000).alias("id"), F.concat_ws(" ", F.lit("new"), "k", "id").alias("content"), vector.alias("embedding"), (F.col("id") * 2 + F.col("k")).alias("seq"))
    again = rows.where("id % 5 = 0").select("id", F.concat_ws(" ", F.lit("last"), "id").alias("content"), "embedding", (F.col("id") * 2 + 9).alias("seq"))
    return V.upsert(rows, delta.unionByName(again), "id", needs="embedding").select("id", "content")


@query("snk_patch", "SELECT c.c_custkey, coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal, c.c_mktsegment FROM customer c LEFT JOIN (SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0) n USING (c_custkey)")
def snk_patch(s, d):
    base = I.table(s, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return V.patch(base, base.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), "c_custkey", ["c_acctbal"])


@query("snk_delete", f"""WITH {I.MEMORY}, kd AS (SELECT *, concat_ws('::', user_id, agent_id, session_id) AS isolation_key FROM mem), dl AS (SELECT item_id AS i, 'm' || item_id * 3 AS m, 'u' || item_id % 20 AS u, 'a' || item_id % 3 AS a, 's' || item_id % 7 AS s FROM benchmark)
SELECT node_id FROM kd WHERE node_id NOT IN (SELECT m FROM dl WHERE i % 4 = 0) AND isolation_key NOT IN (SELECT concat_ws('::', u, a, s) FROM dl WHERE i % 12 = 1) AND user_id NOT IN (SELECT u FROM dl WHERE i % 20 = 6) AND (user_id, agent_id) NOT IN (SELECT (u, a) FROM dl WHERE i % 20 = 3) AND (user_id, agent_id, session_id) NOT IN (SELECT (u, a, s) FROM dl WHERE i % 20 = 7)""")
def snk_delete(s, d):
    """Deletions of all forms at once: by id, by key, by user, by user and agent, and by session."""
    i = F.col("item_id")
    user, agent, session = F.concat(F.lit("u"), i % 20), F.concat(F.lit("a"), i % 3), F.concat(F.lit("s"), i % 7)
    owned = (i % 20).isin(3, 6, 7)
    ids = I.table(s, d, "benchmark").select(F.when(i % 4 == 0, F.concat(F.lit("m"), i * 3)).alias("node_id"), F.when(i % 12 == 1, F.concat_ws("::", user, agent, session)).alias("isolation_key"), F.lit(None).cast("string").alias("user_id"), F.lit(None).cast("string").alias("agent_id"), F.lit(None).cast("string").alias("session_id"))
    scopes = I.table(s, d, "benchmark").where(owned).select(F.lit(None).cast("string").alias("node_id"), F.lit(None).cast("string").alias("isolation_key"), user.alias("user_id"), F.when((i % 20).isin(3, 7), agent).alias("agent_id"), F.when(i % 20 == 7, session).alias("session_id"))
    rows = I.memory(s, d).select("node_id", "user_id", "agent_id", "session_id").withColumn("isolation_key", F.concat_ws("::", "user_id", "agent_id", "session_id"))
    return V.without(rows, ids.unionByName(scopes)).select("node_id")


@query("snk_edge_add", "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey IN (SELECT p_partkey FROM part WHERE p_size > 10) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10) UNION SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey <= 20")
def snk_edge_add(s, d):
    part = I.table(s, d, "part")
    old = part.where("p_partkey <= 20").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"))
    return G.add_edges(old, I.table(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")), part.where("p_size > 10").select(F.col("p_partkey").alias("node")))


@query("snk_topic_tag", f"WITH {I.MEMORY} SELECT DISTINCT user_id, t.tag, sha256(user_id || ':' || t.tag) AS topic_id, node_id FROM mem, unnest(tags) t(tag) WHERE t.tag IS NOT NULL")
def snk_topic_tag(s, d):
    rows = I.memory(s, d).select("user_id", "node_id", F.explode("tags").alias("tag")).where("tag is not null")
    return rows.select("user_id", "tag", F.sha2(F.concat_ws(":", "user_id", "tag"), 256).alias("topic_id"), "node_id").distinct()


# filters


SCOPES = f"""{I.REQUESTS}, sc AS (SELECT query_id, CASE WHEN query_id % 4 = 0 THEN [user_id || '::a0::s1', user_id || '::a1::s2', 'u3::a2::s0'] ELSE [] END AS keys, CASE WHEN query_id % 4 <= 1 THEN user_id || '::a1::s1' END AS key,
CASE WHEN query_id % 8 IN (2, 3, 6) THEN [user_id, 'u5'] ELSE [] END AS users, CASE WHEN query_id % 8 IN (2, 7) THEN ['a1'] ELSE [] END AS agents,
CASE WHEN query_id % 3 = 0 THEN ['l2_fact', 'l4_identity'] ELSE [] END AS layers, CASE WHEN query_id % 5 = 0 THEN ['superseded', 'active'] ELSE [] END AS statuses, CASE WHEN query_id % 7 = 0 THEN false END AS latest, CASE WHEN query_id % 2 = 0 THEN TIMESTAMP '2024-01-01 02:00:00' END AS after_ FROM req),
ky AS (SELECT *, concat_ws('::', user_id, agent_id, session_id) AS isolation_key FROM mem)"""


@query("flt_scope", f"""WITH {I.MEMORY}, {SCOPES} SELECT query_id, node_id, layer FROM sc JOIN ky ON CASE WHEN len(keys) > 0 THEN list_contains(keys, isolation_key) WHEN key IS NOT NULL THEN isolation_key = key
ELSE len(users) + len(agents) > 0 AND (len(users) = 0 OR list_contains(users, user_id)) AND (len(agents) = 0 OR list_contains(agents, agent_id)) END
WHERE (len(layers) = 0 OR list_contains(layers, layer)) AND list_contains(CASE WHEN len(statuses) > 0 THEN statuses ELSE ['active'] END, status) AND is_latest = coalesce(latest, true) AND (after_ IS NULL OR gmt_created > after_)""")
def flt_scope(s, d):
    """Requests of all tiers: by keys, by one key (and keys before it), by users, by users and agents, by agents."""
    q = F.col("query_id")
    strings = lambda *x: F.array(*(F.lit(v) if isinstance(v, str) else v for v in x)).cast("array<string>")
    owned = lambda tail: F.concat("user_id", F.lit(tail))
    scopes = I.requests(s, d).select(
        "query_id",
        F.when(q % 4 == 0, strings(owned("::a0::s1"), owned("::a1::s2"), "u3::a2::s0")).otherwise(strings()).alias("keys"),
        F.when(q % 4 <= 1, owned("::a1::s1")).alias("key"),
        F.when((q % 8).isin(2, 3, 6), strings(F.col("user_id"), "u5")).otherwise(strings()).alias("users"),
        F.when((q % 8).isin(2, 7), strings("a1")).otherwise(strings()).alias("agents"),
        F.when(q % 3 == 0, strings("l2_fact", "l4_identity")).otherwise(strings()).alias("layers"),
        F.when(q % 5 == 0, strings("superseded", "active")).otherwise(strings()).alias("statuses"),
        F.when(q % 7 == 0, F.lit(False)).alias("latest"),
        F.when(q % 2 == 0, F.to_timestamp(F.lit("2024-01-01 02:00:00"))).alias("created_after"),
    )
    rows = I.memory(s, d).withColumn("isolation_key", F.concat_ws("::", "user_id", "agent_id", "session_id"))
    return R.tiered(rows, scopes).select("query_id", "node_id", "layer")


@query("flt_tags_any", f"WITH {I.MEMORY} SELECT node_id FROM mem WHERE list_has_any(tags, ['src1', 'src2', 'fr'])")
def flt_tags_any(s, d):
    return I.memory(s, d).where(F.arrays_overlap("tags", F.array(F.lit("src1"), F.lit("src2"), F.lit("fr")))).select("node_id")


CONTEXTS = f"{I.REQUESTS}, cx AS (SELECT query_id, 'u' || query_id % {I.USERS} AS user_id, CASE WHEN query_id % 4 < 3 THEN 'w' || query_id % 3 END AS workspace, CASE WHEN query_id % 5 < 4 THEN 'b' || query_id % 2 END AS branch, query_vector FROM req)"
PLACES = "CASE {0} % 5 WHEN 0 THEN 'user' WHEN 1 THEN 'global' WHEN 2 THEN 'project' WHEN 3 THEN 'strict' ELSE 'elsewhere' END AS scope, CASE WHEN {0} % 7 > 0 THEN 'w' || {0} % 3 END AS workspace, CASE WHEN {0} % 11 > 0 THEN 'b' || {0} % 2 END AS branch"
SEEN = "r.user_id = cx.user_id AND (scope IN ('user', 'global') OR (scope = 'project' AND r.workspace = cx.workspace) OR (scope = 'strict' AND r.workspace = cx.workspace AND r.branch = cx.branch))"


def contexts(s, d):
    q = F.col("query_id")
    return I.requests(s, d).select("query_id", "user_id", F.when(q % 4 < 3, F.concat(F.lit("w"), q % 3)).alias("workspace"), F.when(q % 5 < 4, F.concat(F.lit("b"), q % 2)).alias("branch"), "query_vector")


def placed(rows, n):
    """rows with the scope, workspace and branch that follow from a number."""
    scope = F.when(n % 5 == 0, "user").when(n % 5 == 1, "global").when(n % 5 == 2, "project").when(n % 5 == 3, "strict").otherwise("elsewhere")
    return rows.withColumns({"scope": scope, "workspace": F.when(n % 7 > 0, F.concat(F.lit("w"), n % 3)), "branch": F.when(n % 11 > 0, F.concat(F.lit("b"), n % 2))})


@query("flt_boundary", f"WITH {CONTEXTS}, r AS (SELECT p_partkey, 'u' || p_partkey % {I.USERS} AS user_id, {PLACES.format('p_partkey')} FROM part) SELECT query_id, p_partkey FROM cx JOIN r ON {SEEN}")
def flt_boundary(s, d):
    """The parts, as code memories, that each request's context sees."""
    rows = I.table(s, d, "part").select("p_partkey", F.concat(F.lit("u"), F.col("p_partkey") % I.users(s, d)).alias("user_id"))
    return R.visible(placed(rows, F.col("p_partkey")), contexts(s, d)).select("query_id", "p_partkey")


@query("flt_expired_window", f"WITH {I.MEMORY} SELECT node_id FROM mem LEFT JOIN (VALUES ('l2_fact', 300), ('l1_raw', 60)) w(layer, minutes) USING (layer) WHERE gmt_created < TIMESTAMP '2024-01-01 08:00:00' - coalesce(w.minutes, 200) * INTERVAL 1 MINUTE")
def flt_expired_window(s, d):
    windows = s.createDataFrame([("l2_fact", 300), ("l1_raw", 60)], "layer string, minutes int")
    limit = F.unix_timestamp(F.to_timestamp(F.lit("2024-01-01 08:00:00"))) - F.coalesce("minutes", F.lit(200)) * 60
    return I.memory(s, d).join(F.broadcast(windows), "layer", "left").where(F.unix_timestamp("gmt_created") < limit).select("node_id")


@query("flt_ops_log", f"WITH {I.OPERATIONS} SELECT id, op, memory_id FROM ops WHERE user_id = 'u7' AND op IN ('ADD', 'DELETE') ORDER BY id LIMIT 50")
def flt_ops_log(s, d):
    return I.operations(s, d).where("user_id = 'u7' and op in ('ADD', 'DELETE')").select("id", "op", "memory_id").orderBy("id").limit(50)


@query("flt_valid_asof", f"WITH {I.VERSIONS}, q AS (SELECT DISTINCT date_trunc('quarter', o_orderdate)::TIMESTAMP AS as_of FROM orders) SELECT node, owner, as_of FROM ver JOIN q ON at_ <= as_of AND (valid_until IS NULL OR valid_until > as_of)")
def flt_valid_asof(s, d):
    """The versions that were valid at the beginning of each quarter."""
    quarters = I.table(s, d, "orders").select(F.date_trunc("quarter", "o_orderdate").alias("as_of")).distinct()
    return as_of(I.versions(s, d), quarters, "at", "valid_until", "as_of").select("node", "owner", "as_of")


@query("flt_min_score", f"WITH {VEC} SELECT query_id, node_id FROM vec WHERE score >= 0.25")
def flt_min_score(s, d):
    return vector(s, d).where("score >= 0.25").select("query_id", "node_id")


ASKED = f"""{I.REQUESTS}, asked AS (SELECT query_id, user_id, CASE query_id % 4 WHEN 0 THEN ['a0', 'a1'] WHEN 1 THEN ['a0', 'a1'] WHEN 2 THEN ['a2'] ELSE [] END AS agents, CASE query_id % 4 WHEN 0 THEN ['s0', 's1'] WHEN 1 THEN ['s0'] WHEN 2 THEN ['s0', 's1', 's2'] ELSE [] END AS rooms FROM req)"""


@query("flt_request_scope", f"""WITH {ASKED}, ok AS (SELECT * FROM asked WHERE NOT (len(agents) > 1 AND len(rooms) > 1)),
a AS (SELECT query_id, user_id, rooms, CASE WHEN len(agents) = 0 THEN [NULL] ELSE agents END AS agents FROM ok), b AS (SELECT query_id, user_id, unnest(agents) AS agent, CASE WHEN len(rooms) = 0 THEN [NULL] ELSE rooms END AS rooms FROM a), c AS (SELECT query_id, user_id, agent, unnest(rooms) AS room FROM b)
SELECT query_id, concat_ws('::', user_id, agent, room) AS isolation_key, NULL::VARCHAR AS error FROM c UNION ALL SELECT query_id, NULL, 'several agents and several sessions' FROM asked WHERE len(agents) > 1 AND len(rooms) > 1""")
def flt_request_scope(s, d):
    """A request may name several agents or several sessions, but not both: that gives a row with an error."""
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    kind = F.col("query_id") % 4
    rows = I.requests(s, d).select("query_id", "user_id", F.when(kind <= 1, strings("a0", "a1")).when(kind == 2, strings("a2")).otherwise(strings()).alias("agents"), F.when(kind == 0, strings("s0", "s1")).when(kind == 1, strings("s0")).when(kind == 2, strings("s0", "s1", "s2")).otherwise(strings()).alias("rooms"))
    return R.request_scopes(rows)


# projections


@query("prj_owner", f"WITH {I.TURNS} SELECT turn_id, CASE WHEN role = 'user' THEN 'user' WHEN role IN ('agent', 'assistant') THEN 'agent' END AS owner FROM turns")
def prj_owner(s, d):
    return I.turns(s, d).select("turn_id", X.owner(F.col("role")).alias("owner"))


_secret = X.SECRET_KEYS.replace("'", "''")


@query("prj_redact", rf"""SELECT doc_id, regexp_replace(regexp_replace(text, '((?:{_secret})\s*[=:]\s*)[''"]?([^\s''"<>]+)[''"]?', '\1<REDACTED>', 'gi'), '(--(?:password|api[_-]?key|token)\s+)([^\s]+)', '\1<REDACTED>', 'gi') AS text FROM documents""")
def prj_redact(s, d):
    return I.table(s, d, "documents").select("doc_id", X.redact(F.col("text")).alias("text"))


@query("prj_truncate", "SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE left(text, 200) || '...[' || (length(text) - 400) || ' omitted]...' || right(text, 200) END AS text FROM documents")
def prj_truncate(s, d):
    return I.table(s, d, "documents").select("doc_id", X.head_tail(F.col("text"), 200, 200).alias("text"))


@query("prj_strip_tools", f"WITH {I.TURNS} SELECT turn_id, role FROM turns WHERE role <> 'tool' AND NOT (role = 'assistant' AND trim(text) = '')")
def prj_strip_tools(s, d):
    return I.turns(s, d).where("role <> 'tool' and not (role = 'assistant' and trim(text) = '')").select("turn_id", "role")


TIMED = "tm AS (SELECT node_id, CASE num % 5 WHEN 0 THEN 'future' WHEN 1 THEN 'past' WHEN 2 THEN 'unknown' WHEN 3 THEN 'atemporal' END AS relation, CASE WHEN num % 3 > 0 THEN gmt_created END AS event_start, CASE WHEN num % 2 > 0 THEN gmt_created + (num % 4) * INTERVAL 1 DAY END AS event_end FROM mem)"


@query("prj_context_line", f"""WITH {VEC}, {TIMED} SELECT query_id, '[' || row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) || '] ' || concat_ws(' ', 'layer=' || v.layer, 'observed=' || strftime(gmt_created, '%Y-%m-%d'), CASE WHEN relation NOT IN ('unknown', 'atemporal') THEN 'time_relation=' || relation END,
'event=' || strftime(event_start, '%Y-%m-%d') || CASE WHEN event_end IS NOT NULL AND strftime(event_end, '%Y-%m-%d') <> strftime(event_start, '%Y-%m-%d') THEN '..' || strftime(event_end, '%Y-%m-%d') ELSE '' END) || ' | ' || trim(content) AS line FROM vec v JOIN mem USING (node_id) JOIN tm USING (node_id)""")
def prj_context_line(s, d):
    """Each fifth row is of the future, the past, or of no told time; two in three have an event, some over several days."""
    n = F.col("num")
    memory = I.memory(s, d).select(
        "node_id",
        "gmt_created",
        "content",
        F.when(n % 5 == 0, "future").when(n % 5 == 1, "past").when(n % 5 == 2, "unknown").when(n % 5 == 3, "atemporal").alias("temporal_relation"),
        F.when(n % 3 > 0, F.col("gmt_created")).alias("event_start"),
        F.when(n % 2 > 0, F.timestamp_seconds(F.unix_timestamp("gmt_created") + n % 4 * 86400)).alias("event_end"),
    )
    rows = R.ranked(vector(s, d)).join(memory.hint("merge"), "node_id")
    return rows.select("query_id", X.context_line(*map(F.col, ("rank", "layer", "gmt_created", "temporal_relation", "event_start", "event_end", "content"))).alias("line"))


@query("prj_kv_clean", f"""WITH k AS (SELECT c_custkey, unnest(['name', 'location', 'other', 'age', 'occupation', 'employer']) AS key, unnest([c_name, CASE WHEN c_custkey % 5 = 0 THEN ' None ' ELSE 'n' || c_nationkey END, 'x', CASE WHEN c_custkey % 7 = 0 THEN 'about ten' WHEN c_custkey % 7 = 1 THEN c_custkey % 90 || '.0' ELSE ' ' || c_custkey % 90 END, CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'False' END, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '  ' END]) AS v FROM customer)
SELECT c_custkey, key, CASE WHEN lower(trim(v)) = 'true' THEN 'yes' WHEN lower(trim(v)) = 'false' THEN 'no' WHEN key = 'age' THEN coalesce(floor(TRY_CAST(trim(v) AS DOUBLE))::BIGINT::VARCHAR, trim(v)) ELSE trim(v) END AS value FROM k WHERE key IN ('name', 'age', 'location', 'occupation', 'employer') AND lower(trim(v)) NOT IN ('', 'null', 'none')""")
def prj_kv_clean(s, d):
    n = F.col("c_custkey")
    where = F.when(n % 5 == 0, " None ").otherwise(F.concat(F.lit("n"), "c_nationkey"))
    age = F.when(n % 7 == 0, "about ten").when(n % 7 == 1, F.concat((n % 90).cast("string"), F.lit(".0"))).otherwise(F.concat(F.lit(" "), (n % 90).cast("string")))
    pairs = {"name": F.col("c_name"), "location": where, "other": F.lit("x"), "age": age, "occupation": F.when(n % 2 == 0, "true").otherwise("False"), "employer": F.when(n % 3 != 0, "  ")}
    rows = I.table(s, d, "customer").select("c_custkey", F.explode(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()))).alias("kv")).select("c_custkey", "kv.*")
    return rows.withColumn("value", X.profile_value(F.col("key"), F.col("value"))).where("value is not null")


@query("prj_profile_text", "SELECT c_custkey, 'The user''s name is ' || c_name || ', location is n' || c_nationkey || '.' AS text FROM customer")
def prj_profile_text(s, d):
    kv = F.array(F.struct(F.lit("name").alias("k"), F.col("c_name").alias("v")), F.struct(F.lit("location").alias("k"), F.concat(F.lit("n"), "c_nationkey").alias("v")))
    return I.table(s, d, "customer").select("c_custkey", F.concat(F.lit("The user's "), F.array_join(F.transform(kv, lambda x: F.concat(x["k"], F.lit(" is "), x["v"])), ", "), F.lit(".")).alias("text"))


# joins and graph


@query("jn_hydrate", f"WITH {VEC} SELECT query_id, node_id, content, access_count FROM vec JOIN mem USING (node_id)")
def jn_hydrate(s, d):
    return vector(s, d).join(I.memory(s, d).select("node_id", "content", "access_count"), "node_id").select("query_id", "node_id", "content", "access_count")


@query("jn_vec", f"WITH {VEC} SELECT query_id, node_id, score FROM vec")
def jn_vec(s, d):
    return vector(s, d).select("query_id", "node_id", "score")


@query("jn_evidence_fwd", f"WITH {I.EVIDENCE} SELECT schema_id, count(DISTINCT fact_id) AS n_evidence FROM ev GROUP BY 1")
def jn_evidence_fwd(s, d):
    return G.evidence_counts(I.evidence(s, d))


FACTS = "facts AS (SELECT p_size AS query_id, p_partkey AS fact_id FROM part)"


@query("jn_evidence_rev", f"WITH {I.EVIDENCE}, {FACTS} SELECT query_id, schema_id, support, round(support / max(support) OVER (PARTITION BY query_id), 6) AS score FROM (SELECT query_id, schema_id, count(DISTINCT fact_id) AS support FROM facts JOIN ev USING (fact_id) WHERE schema_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) GROUP BY 1, 2)")
def jn_evidence_rev(s, d):
    facts = I.table(s, d, "part").select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("fact_id"))
    active = I.table(s, d, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("schema_id"))
    return G.reverse_evidence(facts, I.evidence(s, d), active).withColumn("score", F.round("score", 6))


@query("jn_tag_bridge", "SELECT DISTINCT p.p_brand AS topic, l.l_suppkey AS node FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey WHERE p.p_size < 5 AND l.l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)")
def jn_tag_bridge(s, d):
    topics = I.table(s, d, "part").where("p_size < 5").select("p_brand", "p_partkey")
    tagged = topics.join(I.table(s, d, "lineitem").select("l_partkey", "l_suppkey"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("topic"), F.col("l_suppkey").alias("node")).distinct()
    return tagged.join(I.table(s, d, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("node")), "node", "left_semi").select("topic", "node")


EDGES = "e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, l_returnflag AS kind FROM lineitem)"


def edges(s, d):
    return I.table(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("kind")).distinct()


def anchors(s, d):
    return I.table(s, d, "supplier").where("s_suppkey % 25 = 0").select(F.col("s_suppkey").alias("node"))


@query("jn_neighbours", f"WITH {EDGES}, a AS (SELECT s_suppkey AS node FROM supplier WHERE s_suppkey % 25 = 0) SELECT node, min(kind) AS kind FROM (SELECT dst AS node, kind FROM e WHERE src IN (FROM a) UNION ALL SELECT src, kind FROM e WHERE dst IN (FROM a)) WHERE node NOT IN (FROM a) AND node IN (SELECT p_partkey FROM part WHERE p_size <= 40) GROUP BY 1")
def jn_neighbours(s, d):
    active = I.table(s, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("node"))
    return G.neighbours(anchors(s, d), edges(s, d), active)


@query("jn_kbfs", f"""WITH {EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), tp AS (SELECT p_partkey AS node, p_brand AS topic FROM part),
n AS (SELECT src, dst FROM b UNION SELECT x.node, y.node FROM tp x JOIN tp y USING (topic)), a AS (SELECT DISTINCT s_nationkey AS q, s_suppkey AS node FROM supplier),
h1 AS (SELECT q, node FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY node) AS nth FROM (SELECT DISTINCT q, dst AS node FROM a JOIN n ON src = node EXCEPT FROM a)) WHERE nth <= 20),
h2 AS (SELECT q, node FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY node) AS nth FROM (SELECT DISTINCT q, dst AS node FROM h1 JOIN n ON src = node EXCEPT FROM a EXCEPT FROM h1)) WHERE nth <= 20)
SELECT q AS query_id, node, 0 AS hop FROM a UNION ALL SELECT q, node, 1 FROM h1 UNION ALL SELECT q, node, 2 FROM h2""")
def jn_kbfs(s, d):
    """A request for each nation, from its suppliers over parts and brands."""
    start = I.table(s, d, "supplier").select(F.col("s_nationkey").alias("query_id"), F.col("s_suppkey").alias("node"))
    topics = I.table(s, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("topic"))
    return G.expand(start, edges(s, d), topics, 2, 20)


@query("jn_orphan_refs", f"WITH {I.EVIDENCE} SELECT schema_id, fact_id FROM ev WHERE fact_id IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def jn_orphan_refs(s, d):
    return I.evidence(s, d).join(I.table(s, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("fact_id")), "fact_id", "left_semi").select("schema_id", "fact_id")


LINKS = """n AS (SELECT c_custkey AS node, c_nationkey % 3 AS owner, CASE c_custkey % 5 WHEN 0 THEN 'l2_fact' WHEN 1 THEN 'l7_intention' ELSE 'l6_schema' END AS layer FROM customer),
c AS (SELECT DISTINCT o_custkey AS src, o_orderkey % 2000 AS dst FROM orders), e AS (SELECT src, dst FROM (SELECT o_custkey AS src, o_orderkey % 2000 AS dst FROM orders WHERE o_orderstatus = 'F') UNION SELECT dst, src FROM (SELECT o_custkey AS src, o_orderkey % 2000 AS dst FROM orders WHERE o_orderstatus = 'F')),
jd AS (SELECT c.src, c.dst, CASE WHEN c.src = c.dst THEN 'self' WHEN a.owner IS NULL OR b.owner IS NULL THEN 'missing' WHEN a.owner <> b.owner THEN 'isolation' WHEN NOT (a.layer IN ('l6_schema', 'l7_intention') AND b.layer IN ('l6_schema', 'l7_intention')) THEN 'layer' WHEN EXISTS (FROM e WHERE e.src = c.src AND e.dst = c.dst) OR (c.src > c.dst AND EXISTS (FROM c x WHERE x.src = c.dst AND x.dst = c.src)) THEN 'exists' END AS reason FROM c LEFT JOIN n a ON a.node = c.src LEFT JOIN n b ON b.node = c.dst)"""


def links(s, d):
    """Candidates, nodes and known edges: an order leads from its customer to another one; those of finished orders are known."""
    n = F.col("c_custkey")
    nodes = I.table(s, d, "customer").select(n.alias("node"), (F.col("c_nationkey") % 3).alias("owner"), F.when(n % 5 == 0, "l2_fact").when(n % 5 == 1, "l7_intention").otherwise("l6_schema").alias("layer"))
    made = I.table(s, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 2000).alias("dst"), "o_orderstatus")
    known = made.where("o_orderstatus = 'F'").select("src", "dst")
    return made.select("src", "dst"), nodes, known.union(known.select("dst", "src")).distinct()


@query("jn_edge_valid", f"WITH {LINKS} SELECT src, dst, reason FROM jd")
def jn_edge_valid(s, d):
    return G.judged_edges(*links(s, d))


@query("jn_edge_insert", f"WITH {LINKS} SELECT src, dst FROM e UNION ALL SELECT src, dst FROM jd WHERE reason IS NULL UNION ALL SELECT dst, src FROM jd WHERE reason IS NULL")
def jn_edge_insert(s, d):
    return G.related(*links(s, d))


@query("grf_components", "WITH RECURSIVE l AS (SELECT c_custkey AS a, c_custkey + 3 AS b FROM customer WHERE c_custkey % 10 < 5), u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r(n, m) AS (SELECT a, a FROM u UNION SELECT r.n, u.b FROM r JOIN u ON u.a = r.m) SELECT n AS id, min(m) AS component_id FROM r GROUP BY 1")
def grf_components(s, d):
    return components(I.table(s, d, "customer").where("c_custkey % 10 < 5").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 3).alias("b")))


# aggregates


@query("agg_op_counts", f"WITH {I.OPERATIONS} SELECT request_id, count_if(op = 'ADD' AND n_supersedes = 0) AS adds, count_if(op = 'UPDATE') AS updates, count_if(op = 'SUPERSEDE' OR (op = 'ADD' AND n_supersedes > 0)) AS supersedes, count_if(op = 'DELETE') AS deletes, count_if(op = 'ADD' AND n_supersedes = 0) - count_if(op = 'DELETE') AS net FROM ops GROUP BY 1")
def agg_op_counts(s, d):
    op = F.when((F.col("op") == "ADD") & (F.col("n_supersedes") > 0), "SUPERSEDE").otherwise(F.col("op"))
    counts = I.operations(s, d).withColumn("op", op).groupBy("request_id").agg(*(F.count_if(F.col("op") == k).alias(n) for n, k in (("adds", "ADD"), ("updates", "UPDATE"), ("supersedes", "SUPERSEDE"), ("deletes", "DELETE"))))
    return counts.withColumn("net", F.col("adds") - F.col("deletes"))


@query("agg_user_ops", f"WITH {I.OPERATIONS} SELECT user_id, count(*) AS total, count(DISTINCT request_id) AS requests, min(created_at) AS first_at, max(created_at) AS last_at, count_if(op = 'ADD') AS adds, count_if(op = 'UPDATE') AS updates, count_if(op = 'SUPERSEDE') AS supersedes, count_if(op = 'DELETE') AS deletes FROM ops GROUP BY 1")
def agg_user_ops(s, d):
    kinds = {"adds": "ADD", "updates": "UPDATE", "supersedes": "SUPERSEDE", "deletes": "DELETE"}
    per = I.operations(s, d).groupBy("user_id", "request_id").agg(F.count("*").alias("n"), F.min("created_at").alias("a"), F.max("created_at").alias("b"), *(F.count_if(F.col("op") == k).alias(n) for n, k in kinds.items()))
    return per.groupBy("user_id").agg(F.sum("n").alias("total"), F.count("*").alias("requests"), F.min("a").alias("first_at"), F.max("b").alias("last_at"), *(F.sum(n).alias(n) for n in kinds))


@query("agg_inventory", f"WITH {I.MEMORY} SELECT coalesce(layer, 'all') AS layer, count(*) AS n FROM mem GROUP BY GROUPING SETS ((layer), ())")
def agg_inventory(s, d):
    rows = I.memory(s, d)
    return rows.rollup("layer").agg(F.count("*").alias("n")).select(F.coalesce("layer", F.lit("all")).alias("layer"), "n")


@query("agg_latency", f"WITH {I.OPERATIONS} SELECT op, count(*) AS n, round(sum(elapsed_ms), 4) AS total, round(avg(elapsed_ms), 6) AS mean, min(elapsed_ms) AS least, max(elapsed_ms) AS most, list_sort(list(elapsed_ms))[count(*) // 2 + 1] AS p50, CASE WHEN count(*) >= 20 THEN list_sort(list(elapsed_ms))[floor(0.95 * count(*))::INT + 1] ELSE max(elapsed_ms) END AS p95 FROM ops GROUP BY 1")
def agg_latency(s, d):
    rows = I.operations(s, d)
    n = F.col("n")
    ranks = order_statistics(rows, ["op"], "elapsed_ms", {"p50": F.floor(n / 2), "high": F.floor(0.95 * n)})
    sums = rows.groupBy(F.col("op").alias("of")).agg(F.round(F.sum("elapsed_ms"), 4).alias("total"), F.round(F.avg("elapsed_ms"), 6).alias("mean"), F.min("elapsed_ms").alias("least"), F.max("elapsed_ms").alias("most"))
    return ranks.join(sums.hint("merge"), F.col("op") == F.col("of")).select("op", "n", "total", "mean", "least", "most", "p50", F.when(n >= 20, F.col("high")).otherwise(F.col("most")).alias("p95"))


@query("agg_minute_metrics", "WITH m AS (SELECT date_trunc('minute', ts) AS minute, 'stage' || user_id % 3 AS stage, count_if(event_type <> 'error') AS completed, count_if(event_type = 'error') AS failed, sum(value) AS total FROM events GROUP BY 1, 2), l AS (SELECT * FROM m WHERE minute > (SELECT max(minute) FROM m) - INTERVAL 2000 MINUTE) SELECT stage, count(*) AS minutes, sum(completed)::BIGINT AS completed, sum(failed)::BIGINT AS failed, round(sum(total), 4) AS total, round(sum(total) / nullif(sum(completed + failed), 0), 4) AS mean FROM l GROUP BY 1")
def agg_minute_metrics(s, d):
    """The last 2000 minutes by stage; a stage's mean is over all that it completed or failed."""
    rows = I.table(s, d, "events").withColumn("stage", F.concat(F.lit("stage"), F.col("user_id") % 3))
    failed = F.col("event_type") == "error"
    minutes = rows.groupBy(F.date_trunc("minute", "ts").alias("minute"), "stage").agg(F.count_if(~failed).alias("completed"), F.count_if(failed).alias("failed"), F.sum("value").alias("total"))
    return R.last_minutes(minutes, 2000)


@query("agg_tags", f"WITH {I.MEMORY} SELECT user_id, list_sort(list(DISTINCT t.tag)) AS tags FROM mem, unnest(tags) t(tag) WHERE t.tag IS NOT NULL GROUP BY 1")
def agg_tags(s, d):
    return I.memory(s, d).select("user_id", F.explode("tags").alias("tag")).groupBy("user_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


@query("agg_tag_refs", f"WITH {I.MEMORY} SELECT user_id, t.tag, count(*) AS refs, count_if({ACTIVE}) AS live_refs FROM mem, unnest(tags) t(tag) WHERE t.tag IS NOT NULL GROUP BY 1, 2")
def agg_tag_refs(s, d):
    rows = I.memory(s, d).select("user_id", F.explode("tags").alias("tag"), ((F.col("status") == "active") & F.col("is_latest")).alias("live"))
    return rows.where("tag is not null").groupBy("user_id", "tag").agg(F.count("*").alias("refs"), F.count_if("live").alias("live_refs"))


@query("agg_profile_fold", "SELECT o_custkey, o_orderpriority AS key, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1, 2")
def agg_profile_fold(s, d):
    return I.table(s, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("key")).agg(F.max_by("o_totalprice", "o_orderkey").alias("value"))


@query("agg_profile_history", "SELECT o_custkey, string_agg(strftime(o_orderdate, '%Y-%m-%d') || ' ' || o_orderstatus, ' -> ' ORDER BY o_orderdate, o_orderkey) AS history FROM orders GROUP BY 1")
def agg_profile_history(s, d):
    steps = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")))
    return I.table(s, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(steps, lambda x: F.concat_ws(" ", F.date_format(x["o_orderdate"], "yyyy-MM-dd"), x["o_orderstatus"])), " -> ").alias("history"))


@query("agg_token_count", f"WITH {I.TURNS} SELECT conv_id, sum(greatest(1, length(role || ': ' || text) // 4)) AS tokens FROM turns GROUP BY 1")
def agg_token_count(s, d):
    return I.turns(s, d).groupBy("conv_id").agg(F.sum(X.token_estimate(F.concat_ws(": ", "role", "text"))).alias("tokens"))


@query("agg_char_buckets", f"WITH {I.TURNS}, f AS (SELECT conv_id, min(turn) FILTER (role = 'user') AS first FROM turns GROUP BY 1) SELECT conv_id, coalesce(sum(length(text)) FILTER (role = 'system'), 0) AS system, coalesce(sum(length(text)) FILTER (role = 'user' AND turn = first), 0) AS first_user, coalesce(sum(length(text)) FILTER (role = 'user' AND turn > first), 0) AS later_user, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS assistant FROM turns JOIN f USING (conv_id) GROUP BY 1")
def agg_char_buckets(s, d):
    return C.character_buckets(I.turns(s, d))


TOOLED = f"{I.TURNS}, tt AS (SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN 'user' WHEN length(text) % 4 = 1 THEN 'tool' ELSE role END AS role, CASE WHEN role = 'user' THEN [] WHEN length(text) % 4 = 1 THEN ['t' || length(text) % 3] WHEN length(text) % 2 = 0 THEN ['c' || length(text) % 3, 't' || length(text) % 5, 'c' || length(text) % 3] ELSE [] END AS tools FROM turns)"


@query("agg_turn_summary", f"""WITH {TOOLED}, r AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS round FROM tt), b AS (SELECT *, round - min(round) OVER (PARTITION BY conv_id) AS nth FROM r),
u AS (SELECT conv_id, nth, t.tool, min((b.turn, t.at_)) AS first FROM b, unnest(tools) WITH ORDINALITY t(tool, at_) GROUP BY 1, 2, 3), l AS (SELECT conv_id, nth, string_agg(tool, ',' ORDER BY first) AS tools FROM u GROUP BY 1, 2)
SELECT conv_id, nth::BIGINT AS nth, coalesce(max(trim(text)) FILTER (role = 'user'), '') AS asked, count_if(role <> 'user') AS n_answers, coalesce(max(l.tools), '') AS tools, bool_or(role = 'tool') AS has_result FROM b LEFT JOIN l USING (conv_id, nth) GROUP BY 1, 2""")
def agg_turn_summary(s, d):
    """Turns with calls and results of tools, by the lengths of their texts."""
    n, user = F.length("text"), F.col("role") == "user"
    named = lambda kind, k: F.concat(F.lit(kind), n % k)
    none = F.array().cast("array<string>")
    tools = F.when(user, none).when(n % 4 == 1, F.array(named("t", 3))).when(n % 2 == 0, F.array(named("c", 3), named("t", 5), named("c", 3))).otherwise(none)
    rows = I.turns(s, d).select("conv_id", "turn", "text", tools.alias("tools"), F.when(~user & (n % 4 == 1), "tool").otherwise(F.col("role")).alias("role"))
    return C.user_rounds(rows).withColumn("tools", F.array_join("tools", ","))


@query("agg_counts", f"""WITH {I.MEMORY}, {I.OPERATIONS}, {EDGES} SELECT 'key' AS kind, concat_ws('::', user_id, agent_id, session_id) AS name, count(*) AS n FROM mem GROUP BY 2 UNION ALL SELECT 'user', user_id, count(*) FROM mem GROUP BY 2 UNION ALL SELECT 'store', NULL, count(*) FROM mem
UNION ALL SELECT 'history', memory_id, count(*) FROM ops GROUP BY 2 UNION ALL SELECT 'graph', NULL, count(*) FROM (SELECT src AS n FROM e UNION SELECT dst FROM e)""")
def agg_counts(s, d):
    """Rows by isolation key, by user and in all, operations by memory, and nodes of the graph."""
    rows = I.memory(s, d).withColumn("isolation_key", F.concat_ws("::", "user_id", "agent_id", "session_id"))
    return C.counts(rows, I.operations(s, d).select(F.col("memory_id").alias("key")), edges(s, d))


JUDGED = "judged AS (SELECT doc_id, doc_id % 5 + 1 AS category, quality = 1 AS correct, (doc_id % 12) + 1 AS rank FROM labels)"


GOLD = """gd AS (SELECT doc_id AS q, doc_id % 5 + 1 AS category, quality = 1 AS correct, unnest(range(doc_id % 3 + 1)) AS e FROM labels),
ht AS (SELECT doc_id AS q, t.r AS rank, (doc_id * 7 + t.r * t.r) % 9 AS e FROM labels, unnest(range(1, 13)) t(r)),
mt AS (SELECT gd.q, e, min(rank) AS rank FROM gd LEFT JOIN ht USING (q, e) GROUP BY 1, 2),
rc AS (SELECT q, avg((coalesce(rank, 99) <= 1)::INT) AS r1, avg((coalesce(rank, 99) <= 5)::INT) AS r5, avg((coalesce(rank, 99) <= 10)::INT) AS r10 FROM mt GROUP BY 1)"""


@query("agg_eval", f"WITH {GOLD}, j AS (SELECT doc_id AS q, doc_id % 5 + 1 AS category, quality = 1 AS correct, CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 / 3.0 END AS coverage, doc_id % 90 * 1.5 AS ms FROM labels) SELECT category, count(*) AS n, round(avg(coalesce(correct, false)::INT), 4) AS accuracy, " + ", ".join(f"round(avg((coalesce(r{k}, 0) > 0)::INT) FILTER (category <> 5), 4) AS hit{k}, round(avg((r{k} >= 1)::INT) FILTER (category <> 5), 4) AS exact{k}, round(avg(r{k}) FILTER (category <> 5), 4) AS recall{k}" for k in (1, 5, 10)) + ", round(avg(coverage), 4) AS coverage, round(avg(coalesce(ms, 0)), 2) AS mean_ms FROM j LEFT JOIN rc USING (q) GROUP BY GROUPING SETS ((), (category))")
def agg_eval(s, d):
    """One to three pieces of gold evidence for a question, and twelve hits."""
    q = F.col("doc_id")
    labels = I.table(s, d, "labels")
    gold = labels.select(q.alias("question_id"), F.explode(F.sequence(F.lit(0).cast("long"), q % 3)).alias("evidence"))
    hits = labels.select(q.alias("question_id"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("rank")).withColumn("evidence", (F.col("question_id") * 7 + F.col("rank") * F.col("rank")) % 9)
    judged = labels.select(q.alias("question_id"), (q % 5 + 1).alias("category"), (F.col("quality") == 1).alias("correct"), F.when(q % 4 > 0, q % 4 / 3).alias("coverage"), (q % 90 * 1.5).alias("elapsed_ms"))
    return evaluation(judged.join(recalls(gold, hits).hint("merge"), "question_id", "left"))


@query("agg_recall_buckets", f"WITH {JUDGED}, b AS (SELECT CASE WHEN rank <= 4 THEN 'full' WHEN rank <= 8 THEN 'partial' ELSE 'none' END AS bucket, count(*) AS n, avg(correct::INT) AS p FROM judged GROUP BY 1) SELECT bucket, n, round(p, 6) AS accuracy, round(avg(p) OVER (), 6) AS macro, round((p + 1.9208 / n - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) AS low, round((p + 1.9208 / n + 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) AS high FROM b")
def agg_recall_buckets(s, d):
    rank = F.col("doc_id") % 12 + 1
    rows = I.table(s, d, "labels").groupBy(F.when(rank <= 4, "full").when(rank <= 8, "partial").otherwise("none").alias("bucket")).agg(F.count("*").alias("n"), F.avg((F.col("quality") == 1).cast("int")).alias("p"))
    n, p = F.col("n"), F.col("p")
    spread = 1.96 * F.sqrt(p * (1 - p) / n + 0.9604 / (n * n))
    # a window over three rows
    macro = F.round(F.avg("p").over(Window.partitionBy()), 6).alias("macro")
    return rows.select("bucket", "n", F.round("p", 6).alias("accuracy"), macro, *(F.round((p + 1.9208 / n + sign * spread) / (1 + 3.8416 / n), 6).alias(name) for name, sign in (("low", -1), ("high", 1))))


@query("agg_channel_sizes", f"WITH {VEC}, c AS (SELECT layer, query_id, count(*) AS n FROM vec GROUP BY 1, 2) SELECT layer, round(avg(n), 6) AS mean, median(n) AS median, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS most FROM c GROUP BY 1")
def agg_channel_sizes(s, d):
    per = vector(s, d).groupBy("layer", "query_id").agg(F.count("*").alias("n"))
    return per.groupBy("layer").agg(F.round(F.avg("n"), 6).alias("mean"), F.percentile("n", 0.5).alias("median"), F.round(F.percentile("n", 0.95), 6).alias("p95"), F.max("n").alias("most"))


# windows over turns and versions


@query("win_turn_ids", f"WITH {I.TURNS} SELECT turn_id, 100 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM turns")
def win_turn_ids(s, d):
    return I.turns(s, d).select("turn_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) + 99).alias("idx"))


@query("win_context", f"WITH {I.TURNS} SELECT conv_id, turn, concat_ws(chr(10), nullif(trim(lag(text) OVER w), '') , nullif(trim(text), ''), nullif(trim(lead(text) OVER w), '')) AS context FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def win_context(s, d):
    return C.context(I.turns(s, d).withColumn("text", F.trim("text")))


@query("win_last_k_turns", f"WITH {I.TURNS}, r AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn DESC) - (role = 'user')::INT AS n FROM turns) SELECT turn_id, role FROM r WHERE n < 2")
def win_last_k_turns(s, d):
    return C.last_user_turns(I.turns(s, d), 2).select("turn_id", "role")


@query("win_recent_history", f"WITH {I.TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth FROM turns) SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS text, nth FROM r WHERE nth <= 3")
def win_recent_history(s, d):
    return C.recent(I.turns(s, d), 3, 100)


@query("win_last_queries", f"WITH {I.TURNS} SELECT conv_id, turn, text, nth FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth FROM turns WHERE role = 'user' AND trim(text) <> '') WHERE nth <= 2")
def win_last_queries(s, d):
    return C.last_queries(I.turns(s, d), 2)


@query("win_chain_order", f"WITH {I.VERSIONS} SELECT node, owner, row_number() OVER (PARTITION BY owner ORDER BY superseded_by IS NULL DESC, at_ DESC, node DESC) AS place FROM ver")
def win_chain_order(s, d):
    order = Window.partitionBy("owner").orderBy(F.col("superseded_by").isNull().desc(), F.col("at").desc(), F.col("node").desc())
    return I.versions(s, d).select("node", "owner", F.row_number().over(order).alias("place"))


@query("win_obs_times", f"WITH {I.OPERATIONS} SELECT memory_id, min(created_at) AS first_at, max(created_at) AS last_at, count(DISTINCT created_at) AS n FROM ops GROUP BY 1")
def win_obs_times(s, d):
    return I.operations(s, d).groupBy("memory_id").agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.countDistinct("created_at").alias("n"))


@query("win_latest_summary", f"WITH {I.MEMORY} SELECT user_id, agent_id, session_id, gmt_created::DATE AS day, arg_max(node_id, gmt_created) AS node_id FROM mem WHERE layer = 'l3_summary' AND status = 'active' GROUP BY 1, 2, 3, 4")
def win_latest_summary(s, d):
    return I.memory(s, d).where("layer = 'l3_summary' and status = 'active'").groupBy("user_id", "agent_id", "session_id", F.to_date("gmt_created").alias("day")).agg(F.max_by("node_id", "gmt_created").alias("node_id"))


@query("st_buffer_batch", f"WITH {I.TURNS}, r AS (SELECT *, floor((sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) - (role = 'user')::INT) / 2)::BIGINT AS batch FROM turns), f AS (SELECT conv_id, batch, count(*) AS n_lines, count_if(role = 'user') AS n_user, min(turn) AS first_turn FROM r GROUP BY 1, 2) SELECT * FROM f WHERE n_user >= 2")
def st_buffer_batch(s, d):
    return C.ready_batches(I.turns(s, d), 2)


# top-k, ranking, fusion

TOP = f"WITH {VEC} SELECT query_id, node_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM vec) WHERE rank <= {K}"


@query("top_vec", TOP)
def top_vec(s, d):
    return R.top(vector(s, d), K).select("query_id", "node_id", "score", "rank")


@query("top_keyword", f"WITH {BM} SELECT query_id, node_id, round(bm25, 6) AS bm25, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, node_id) AS rank FROM bm) WHERE rank <= {K}")
def top_keyword(s, d):
    return R.top(words(s, d).withColumn("bm25", F.round("bm25", 6)), K, "bm25").select("query_id", "node_id", "bm25", "rank")


@query("txt_bm25", f"WITH {BM} SELECT query_id, node_id, round(bm25, 6) AS bm25 FROM bm")
def txt_bm25(s, d):
    return words(s, d).select("query_id", "node_id", F.round("bm25", 6).alias("bm25"))


@query("win_bm25_norm", f"WITH {BM} SELECT query_id, node_id, round(bm25 / max(bm25) OVER (PARTITION BY query_id), 6) AS norm FROM bm")
def win_bm25_norm(s, d):
    return R.max_norm(words(s, d), "bm25", "norm").select("query_id", "node_id", F.round("norm", 6).alias("norm"))


SIG = "CASE WHEN bm25 <= 0 THEN 0 ELSE 1 / (1 + exp(-(CASE WHEN n_terms <= 2 THEN 0.8 WHEN n_terms <= 5 THEN 0.5 ELSE 0.3 END) * (bm25 - (CASE WHEN n_terms <= 2 THEN 5 WHEN n_terms <= 5 THEN 8 ELSE 12 END)))) END"


@query("rk_sigmoid", f"WITH {BM} SELECT query_id, node_id, round({SIG}, 6) AS p FROM bm")
def rk_sigmoid(s, d):
    return words(s, d).select("query_id", "node_id", F.round(X.sigmoid_bm25(F.col("bm25"), F.col("n_terms")), 6).alias("p"))


HYBRID = f"""{BM}, vec AS (SELECT query_id, node_id, layer, round(list_cosine_similarity(query_vector, embedding), 6) AS score FROM req JOIN mem USING (user_id) WHERE {ACTIVE} AND round(list_cosine_similarity(query_vector, embedding), 6) >= {THRESHOLD}),
fused AS (SELECT query_id, node_id, layer, round(CASE WHEN max(coalesce(w, 0)) OVER (PARTITION BY query_id) > 0 THEN 0.6 * score + 0.4 * coalesce(w, 0) ELSE score END, 6) AS score FROM vec LEFT JOIN (SELECT query_id, node_id, {SIG} AS w FROM bm) USING (query_id, node_id))"""


def hybrid(s, d):
    fused = R.fuse_hybrid(vector(s, d), words(s, d), words_alone=False).withColumn("score", F.round("score", 6))
    return fused.join(live(s, d).select("node_id", "layer"), "node_id")


EITHER = f"""{HYBRID}, ei AS (SELECT query_id, node_id, score, w, max(coalesce(w, 0)) OVER (PARTITION BY query_id) AS most FROM vec FULL JOIN (SELECT query_id, node_id, {SIG} AS w FROM bm) USING (query_id, node_id)),
su AS (SELECT query_id, node_id, score AS vec, CASE WHEN most > 0 THEN 0.6 * coalesce(score, 0) + 0.4 * coalesce(w, 0) ELSE score END AS score FROM ei)"""


@query("rk_sem_bm25", f"WITH {EITHER} SELECT query_id, node_id, round(score, 6) AS score FROM su WHERE vec IS NOT NULL OR score > 0")
def rk_sem_bm25(s, d):
    return R.fuse_hybrid(vector(s, d), words(s, d)).select("query_id", "node_id", F.round("score", 6).alias("score"))


CHANNELS = f"""{HYBRID}, hits AS (SELECT query_id, node_id, 'vec' AS channel, score FROM vec UNION ALL SELECT query_id, node_id, 'bm25', round(bm25, 6) FROM bm),
ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, node_id) AS rank FROM hits),
rrf AS (SELECT query_id, node_id, round(sum(CASE channel WHEN 'vec' THEN 1.0 ELSE 0.5 END / (60 + rank)), 6) AS score FROM ranks GROUP BY 1, 2)"""


def channels(s, d):
    return vector(s, d).select("query_id", "node_id", F.lit("vec").alias("channel"), "score").unionByName(words(s, d).select("query_id", "node_id", F.lit("bm25").alias("channel"), F.round("bm25", 6).alias("score")))


def fused(s, d):
    return R.rrf(channels(s, d), {"vec": 1.0, "bm25": 0.5}).withColumn("score", F.round("score", 6))


@query("win_rank_channels", f"WITH {CHANNELS} SELECT query_id, node_id, channel, rank FROM ranks")
def win_rank_channels(s, d):
    return R.ranked(channels(s, d), by=["query_id", "channel"]).select("query_id", "node_id", "channel", "rank")


@query("rk_rrf", f"WITH {CHANNELS} SELECT query_id, node_id, score FROM rrf")
def rk_rrf(s, d):
    return fused(s, d).select("query_id", "node_id", "score")


@query("rk_confidence", f"WITH {CHANNELS}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS n FROM rrf) SELECT query_id, round(least(avg(score) / 0.05, 1), 6) AS confidence, round(least(avg(score) / 0.05, 1), 6) < 0.15 AS low FROM t WHERE n <= 3 GROUP BY 1")
def rk_confidence(s, d):
    return R.confidence(fused(s, d)).select("query_id", F.round("confidence", 6).alias("confidence"), (F.round("confidence", 6) < 0.15).alias("low"))


@query("set_merge_dedup", f"WITH {CHANNELS}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY channel <> 'vec', rank) AS nth FROM ranks) SELECT query_id, node_id, channel, row_number() OVER (PARTITION BY query_id ORDER BY channel <> 'vec', rank, node_id) AS position FROM f WHERE nth = 1")
def set_merge_dedup(s, d):
    hits = R.ranked(channels(s, d), by=["query_id", "channel"])
    return R.merge_first(hits, ["vec", "bm25"]).select("query_id", "node_id", "channel", "position")


@query("set_union_max", f"WITH {CHANNELS} SELECT query_id, node_id, max(score) AS score FROM hits GROUP BY 1, 2")
def set_union_max(s, d):
    return channels(s, d).groupBy("query_id", "node_id").agg(F.max("score").alias("score"))


@query("rk_zero_fallback", f"WITH {I.MEMORY}, {I.REQUESTS}, a AS (SELECT query_id, node_id, round(list_cosine_similarity(query_vector, embedding), 6) AS score FROM req JOIN mem USING (user_id) WHERE {ACTIVE}), b AS (SELECT *, max(score >= 0.3) OVER (PARTITION BY query_id) AS found FROM a WHERE score >= 0.2) SELECT query_id, node_id, score, NOT found AS fallback FROM b WHERE NOT found OR score >= 0.3")
def rk_zero_fallback(s, d):
    hits = R.vector_hits(I.requests(s, d), live(s, d), 0.2 - 1e-6).withColumn("score", F.round("score", 6))
    return R.with_fallback(hits, 0.3, 0.2).select("query_id", "node_id", "score", "fallback")


@query("top_quota", f"WITH {VEC}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id, layer ORDER BY score DESC, node_id) <= CASE layer WHEN 'l4_identity' THEN 2 WHEN 'l6_schema' THEN 2 ELSE 0 END AS held FROM vec), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY held DESC, score DESC, node_id) AS rank FROM h) SELECT query_id, node_id, rank FROM r WHERE rank <= 5")
def top_quota(s, d):
    return R.quota(vector(s, d), 5, {"l4_identity": 0.4, "l6_schema": 0.4}).select("query_id", "node_id", "rank")


@query("top_bucket_caps", f"WITH {VEC}, b AS (SELECT *, CASE WHEN layer IN ('l0_basic_info', 'l4_identity', 'l6_schema') THEN 'profile' WHEN layer = 'l7_intention' THEN 'proactive' ELSE 'normal' END AS bucket FROM vec), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY score DESC, node_id) AS rank FROM b) SELECT query_id, bucket, node_id, rank FROM r WHERE rank <= CASE bucket WHEN 'profile' THEN 2 WHEN 'proactive' THEN 1 ELSE 3 END")
def top_bucket_caps(s, d):
    bucket = F.when(F.col("layer").isin("l0_basic_info", "l4_identity", "l6_schema"), "profile").when(F.col("layer") == "l7_intention", "proactive").otherwise("normal")
    return R.bucket_caps(vector(s, d).withColumn("bucket", bucket), {"profile": 2, "proactive": 1, "normal": 3}).select("query_id", "bucket", "node_id", "rank")


@query("search_three_bucket", f"WITH {HYBRID}, b AS (SELECT *, CASE WHEN layer IN ('l0_basic_info', 'l4_identity', 'l6_schema') THEN 'profile' WHEN layer = 'l7_intention' THEN 'proactive' ELSE 'normal' END AS bucket FROM vec), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY score DESC, node_id) AS rank FROM b) SELECT query_id, bucket, node_id, rank FROM r WHERE rank <= 10")
def search_three_bucket(s, d):
    bucket = F.when(F.col("layer").isin("l0_basic_info", "l4_identity", "l6_schema"), "profile").when(F.col("layer") == "l7_intention", "proactive").otherwise("normal")
    return R.bucket_caps(vector(s, d).withColumn("bucket", bucket), {"profile": 10, "proactive": 10, "normal": 10}).select("query_id", "bucket", "node_id", "rank")


STRENGTH = "CASE WHEN layer IN ('l0_basic_info', 'l6_schema', 'l7_intention') THEN 1 ELSE (1 + ln(greatest(access_count, 1))) * exp(-(date_diff('second', gmt_created, TIMESTAMP '2024-06-01') / 86400.0) / 180) END"


def idle():
    return (F.unix_timestamp(F.to_timestamp(F.lit("2024-06-01"))) - F.unix_timestamp("gmt_created")) / 86400.0


@query("rk_strength", f"WITH {I.MEMORY} SELECT node_id, round({STRENGTH}, 6) AS strength FROM mem")
def rk_strength(s, d):
    return I.memory(s, d).select("node_id", F.round(X.strength(F.col("access_count"), idle(), F.col("layer")), 6).alias("strength"))


@query("rk_composite", f"WITH {VEC} SELECT query_id, node_id, round(0.5 * score + 0.3 * pow(0.9, floor(date_diff('second', gmt_created, TIMESTAMP '2024-06-01') / 86400.0) / 30) + 0.15 * 0.5 + 0.05 * ln(access_count + 1) / ln(101), 6) AS total FROM vec JOIN mem USING (node_id)")
def rk_composite(s, d):
    rows = vector(s, d).join(I.memory(s, d).select("node_id", "gmt_created", "access_count"), "node_id")
    return rows.select("query_id", "node_id", F.round(X.composite(F.col("score"), idle(), F.lit(0.5), F.col("access_count")), 6).alias("total"))


@query("search_hybrid", f"WITH {HYBRID}, x AS (SELECT query_id, node_id, round(f.score * {STRENGTH.replace('layer IN', 'f.layer IN')}, 6) AS score FROM fused f JOIN mem USING (node_id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM x) SELECT query_id, node_id, score, rank FROM r WHERE rank <= {K}")
def search_hybrid(s, d):
    """Vectors and words fused, weakened by forgetting, the best of each request."""
    rows = hybrid(s, d).join(I.memory(s, d).select("node_id", "gmt_created", "access_count"), "node_id")
    scored = rows.select("query_id", "node_id", F.round(F.col("score") * X.strength(F.col("access_count"), idle(), F.col("layer")), 6).alias("score"))
    return R.top(scored, K).select("query_id", "node_id", "score", "rank")


@query("rk_evidence_boost", f"WITH {I.EVIDENCE} SELECT schema_id, round(least(count(*) / 5.0, 1) * 0.3, 6) AS boost FROM ev GROUP BY 1")
def rk_evidence_boost(s, d):
    return G.evidence_counts(I.evidence(s, d)).select("schema_id", F.round(X.evidence_boost(F.col("n_evidence")), 6).alias("boost"))


@query("rk_bump", f"WITH {VEC} SELECT node_id, access_count + (node_id IN (SELECT node_id FROM vec))::INT AS access_count, CASE WHEN node_id IN (SELECT node_id FROM vec) THEN TIMESTAMP '2024-06-01' ELSE gmt_created END AS last_accessed FROM mem")
def rk_bump(s, d):
    rows = I.memory(s, d).select("node_id", "access_count", F.col("gmt_created").alias("last_accessed"))
    hit = vector(s, d).select("node_id").distinct()
    return V.patch(rows, rows.join(hit, "node_id", "left_semi").withColumns({"access_count": F.col("access_count") + 1, "last_accessed": I.start("2024-06-01")}), "node_id", ["access_count", "last_accessed"])


@query("set_gold_intersect", f"WITH {VEC}, x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM vec) WHERE rank <= {K}), gold AS (SELECT query_id, node_id FROM req JOIN mem USING (user_id) WHERE num % 4 = 0 AND {ACTIVE}) SELECT query_id, count(x.node_id) AS found, count(*) AS n_gold, round(count(x.node_id) / count(*), 6) AS recall FROM gold LEFT JOIN x USING (query_id, node_id) GROUP BY 1")
def set_gold_intersect(s, d):
    gold = I.requests(s, d).select("query_id", "user_id").join(live(s, d).where("num % 4 = 0").select("user_id", "node_id"), "user_id").select("query_id", "node_id")
    return R.recall_at(R.top(vector(s, d), K), gold, K).withColumn("recall", F.round("recall", 6))


@query("top_list", f"WITH {I.MEMORY} SELECT node_id, coalesce(CASE WHEN num % 4 = 0 THEN gmt_created - INTERVAL 1 DAY END, gmt_created) AS listed_at, count(*) OVER () AS total FROM mem WHERE status = 'active' AND layer <> 'l1_raw' ORDER BY listed_at DESC, node_id LIMIT 20 OFFSET 10")
def top_list(s, d):
    memory_at = F.when(F.col("num") % 4 == 0, F.col("gmt_created") - F.expr("interval 1 day"))
    rows = I.memory(s, d).where("status = 'active' and layer <> 'l1_raw'").select("node_id", F.coalesce(memory_at, "gmt_created").alias("listed_at"))
    return rows.orderBy(F.col("listed_at").desc(), "node_id").offset(10).limit(20).withColumn("total", rows.agg(F.count("*")).scalar())


@query("top_code_list", "SELECT p_brand, p_partkey, nth FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS nth FROM part) WHERE nth <= 5")
def top_code_list(s, d):
    return I.table(s, d, "part").select("p_brand", "p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("p_partkey").desc())).alias("nth")).where("nth <= 5")


@query("top_history", f"WITH {I.OPERATIONS} SELECT memory_id, id, nth FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY created_at DESC, id DESC) AS nth FROM ops) WHERE nth <= 3")
def top_history(s, d):
    return I.operations(s, d).select("memory_id", "id", F.row_number().over(Window.partitionBy("memory_id").orderBy(F.col("created_at").desc(), F.col("id").desc())).alias("nth")).where("nth <= 3")


@query("top_sample", f"WITH {JUDGED}, a AS (SELECT *, row_number() OVER (PARTITION BY category, doc_id % 10 ORDER BY md5(doc_id::VARCHAR)) AS round FROM judged), b AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY round, md5(doc_id::VARCHAR)) AS nth FROM a) SELECT doc_id, category, nth, CASE WHEN nth <= 12 THEN 'tune' ELSE 'test' END AS phase FROM b WHERE nth <= 20")
def top_sample(s, d):
    rows = I.table(s, d, "labels").select("doc_id", (F.col("doc_id") % 5 + 1).alias("category"), (F.col("doc_id") % 10).alias("conversation"), F.md5(F.col("doc_id").cast("string")).alias("h"))
    return R.round_robin(rows, "category", "conversation", "h", 20).select("doc_id", "category", "nth", F.when(F.col("nth") <= 12, "tune").otherwise("test").alias("phase"))


@query("set_exact_dedup", "SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY lower(trim(text))")
def set_exact_dedup(s, d):
    return V.exact_duplicates(I.table(s, d, "documents"), "text", "doc_id")


# text and vectors


@query("txt_tokens", f"SELECT doc_id, len(regexp_extract_all(lower(text), '{TERMS}')) AS n, array_to_string(regexp_extract_all(lower(text), '{TERMS}'), ' ') AS terms FROM documents")
def txt_tokens(s, d):
    t = X.tokens(F.col("text"))
    return I.table(s, d, "documents").select("doc_id", F.size(t).alias("n"), F.array_join(t, " ").alias("terms"))


@query("txt_keywords", f"WITH k AS (SELECT doc_id, t.w, min(t.n) AS n FROM documents, unnest(regexp_extract_all(lower(text), '{TERMS}')) WITH ORDINALITY t(w, n) WHERE CASE WHEN regexp_matches(t.w, '^[a-z0-9]') THEN length(t.w) >= 3 AND t.w NOT IN ({STOP}) ELSE length(t.w) >= 2 END GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS nth FROM k) SELECT doc_id, string_agg(w, ' ' ORDER BY n) AS keywords FROM r WHERE nth <= 10 GROUP BY 1")
def txt_keywords(s, d):
    return I.table(s, d, "documents").select("doc_id", F.array_join(X.keywords(F.col("text")), " ").alias("keywords")).where("keywords <> ''")


@query("txt_intent", r"SELECT turn, conv_id, CASE WHEN regexp_matches(text, '" + "|".join(X.NAVIGATIONAL).replace("'", "''") + "') THEN 'NAVIGATIONAL' WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in X.CONCEPTUAL) + " THEN 'CONCEPTUAL' ELSE 'FACTUAL' END AS intent FROM conversations")
def txt_intent(s, d):
    return I.turns(s, d).select("turn", "conv_id", X.intent(F.col("text")).alias("intent"))


@query("arr_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def arr_cosine(s, d):
    e = I.table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id").select("vec_id", F.round(X.cosine(F.col("a"), F.col("b")), 6).alias("score"))


@query("arr_l2norm", "SELECT vec_id, n - 1 AS dim, round(v::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS v FROM embeddings, unnest(embedding) WITH ORDINALITY t(v, n)")
def arr_l2norm(s, d):
    return I.table(s, d, "embeddings").select("vec_id", F.posexplode(X.unit(F.col("embedding").cast("array<double>"))).alias("dim", "v")).withColumn("v", F.round("v", 6))


@query("arr_centroid", "SELECT label, n - 1 AS dim, round(avg(v::DOUBLE), 6) AS mean FROM embeddings, unnest(embedding) WITH ORDINALITY t(v, n) GROUP BY 1, 2")
def arr_centroid(s, d):
    return I.table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v")).groupBy("label", "dim").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


# versions and duplicates


@query("ver_chains", f"WITH {I.VERSIONS} SELECT node, min(node) OVER (PARTITION BY owner) AS chain FROM ver")
def ver_chains(s, d):
    return V.chains(written(I.versions(s, d), "versions"))


@query("ver_collapse", f"WITH {I.VERSIONS}, hits AS (SELECT node % (SELECT greatest(5, count(*) // 200) FROM orders) AS query_id, node, (node % 97) / 97.0 AS score FROM ver WHERE node % 9 <> 0), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS rank FROM hits), heads AS (SELECT owner, node AS head FROM ver WHERE superseded_by IS NULL), g AS (SELECT query_id, head, max(score) AS score, min(rank) AS first, array_to_string(list(node ORDER BY at_ DESC, node DESC), ',') AS members FROM ranked JOIN ver USING (node) JOIN heads USING (owner) GROUP BY 1, 2) SELECT query_id, head, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY first) AS position, members FROM g")
def ver_collapse(s, d):
    """Hits on versions that are no raw turns."""
    ver = written(I.versions(s, d), "versions")
    requests = I.users(s, d, "orders", 5)
    hits = ver.where("node % 9 <> 0").select((F.col("node") % requests).alias("query_id"), "node", ((F.col("node") % 97) / 97.0).alias("score"))
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node")))
    return V.collapsed(hits, ver, V.chains(ver)).select("query_id", "head", F.round("score", 6).alias("score"), "position", F.array_join("members", ",").alias("members"))


@query("ver_delete_repair", "SELECT o_orderkey AS node, lag(o_orderkey) OVER w AS supersedes, lead(o_orderkey) OVER w AS superseded_by FROM orders WHERE o_orderkey % 4 <> 0 WINDOW w AS (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderdate, o_orderkey)")
def ver_delete_repair(s, d):
    """Three chains of each customer."""
    by = Window.partitionBy("o_custkey", F.col("o_orderkey") % 3).orderBy("o_orderdate", "o_orderkey")
    ver = I.table(s, d, "orders").select(F.col("o_orderkey").alias("node"), F.lag("o_orderkey").over(by).alias("supersedes"), F.lead("o_orderkey").over(by).alias("superseded_by"))
    return V.delete_repair(ver, ver.where("node % 4 = 0"))


BROKEN = f"""{I.VERSIONS}, broken AS (
  SELECT node, owner, valid_until, CASE WHEN node % 11 = 0 AND supersedes IS NOT NULL THEN -node ELSE supersedes END AS supersedes, CASE WHEN node % 7 <> 0 THEN superseded_by END AS superseded_by FROM ver
  UNION ALL SELECT node + 100000000, owner, NULL, node, NULL FROM ver WHERE node % 13 = 0)"""


@query("ver_audit", f"WITH RECURSIVE {BROKEN}, u AS (SELECT a.node AS x, a.supersedes AS y FROM broken a WHERE a.supersedes IS NOT NULL), both_ AS (SELECT x, y FROM u UNION SELECT y, x FROM u), steps(n, m) AS (SELECT x, x FROM both_ UNION SELECT steps.n, both_.y FROM steps JOIN both_ ON both_.x = steps.m), chain AS (SELECT n AS node, min(m) AS chain FROM steps GROUP BY 1), heads AS (SELECT chain, count(*) AS k FROM broken JOIN chain USING (node) WHERE node NOT IN (SELECT supersedes FROM broken WHERE supersedes IS NOT NULL) GROUP BY 1) SELECT count(a.supersedes) AS links, count_if(a.supersedes IS NOT NULL AND b.node IS NOT NULL AND b.superseded_by IS DISTINCT FROM a.node) AS no_back_link, count_if(a.supersedes IS NOT NULL AND b.node IS NULL) AS dangling, count_if(a.valid_until IS NOT NULL AND a.superseded_by IS NULL) AS closed_without_successor, (SELECT count(*) FROM heads WHERE k > 1) AS two_heads FROM broken a LEFT JOIN broken b ON b.node = a.supersedes")
def ver_audit(s, d):
    """Versions of which some point at nothing, some have lost their back link, and some were superseded twice."""
    ver = I.versions(s, d)
    node = F.col("node")
    broken = ver.select("node", "owner", "valid_until", F.when((node % 11 == 0) & F.col("supersedes").isNotNull(), -node).otherwise(F.col("supersedes")).alias("supersedes"), F.when(node % 7 != 0, F.col("superseded_by")).alias("superseded_by"))
    forks = ver.where("node % 13 = 0").select((node + 100_000_000).alias("node"), "owner", F.lit(None).cast("timestamp").alias("valid_until"), node.alias("supersedes"), F.lit(None).cast("long").alias("superseded_by"))
    broken = written(broken.withColumn("valid_until", F.col("valid_until").cast("timestamp")).unionByName(forks), "versions")
    return V.chain_audit(broken, V.chains(broken))


@query("ver_expire_intent", f"WITH {I.MEMORY} SELECT node_id, CASE WHEN layer = 'l7_intention' AND valid_until < TIMESTAMP '2024-01-10' THEN 'l2_fact' ELSE layer END AS layer FROM mem")
def ver_expire_intent(s, d):
    gone = (F.col("layer") == "l7_intention") & (F.col("valid_until") < F.to_timestamp(F.lit("2024-01-10")))
    return I.memory(s, d).select("node_id", F.when(R.condition(gone), "l2_fact").otherwise(F.col("layer")).alias("layer"))


def stored(s, d):
    return I.memory(s, d).select("node_id", "content", F.array("session_id").alias("evidence"), F.col("gmt_created").alias("valid_from"), "valid_until", "is_latest", F.lit(None).cast("string").alias("supersedes"), F.lit(None).cast("string").alias("superseded_by"))


APPLIED = f"""{I.MEMORY}, {I.OPERATIONS},
o AS (SELECT ops.*, user_id IS NULL AS x, 'n' || id AS new_id FROM ops WHERE op IN ('ADD', 'UPDATE', 'SUPERSEDE')),
t AS (SELECT o.id AS seq, o.op, o.memory_id AS target, 'n' || o.id AS new_id, 'text ' || o.id AS content, o.request_id AS item, o.created_at AS at_ FROM o JOIN mem ON mem.node_id = o.memory_id WHERE o.op <> 'ADD'),
shut AS (SELECT target, min(seq) AS c_seq, arg_min(new_id, seq) AS c_id, arg_min(at_, seq) AS c_at FROM t WHERE op = 'SUPERSEDE' GROUP BY 1),
good AS (SELECT t.* FROM t LEFT JOIN shut USING (target) WHERE c_seq IS NULL OR seq <= c_seq),
said AS (SELECT target, item, min(seq) AS seq FROM (SELECT node_id AS target, session_id AS item, -1 AS seq FROM mem UNION ALL SELECT target, item, seq FROM good) GROUP BY 1, 2),
ups AS (SELECT target, arg_max(content, seq) AS u_content, min(at_) AS u_at FROM good WHERE op = 'UPDATE' GROUP BY 1),
old_ AS (SELECT target, string_agg(item, ',' ORDER BY seq) AS evidence FROM said LEFT JOIN shut USING (target) WHERE c_seq IS NULL OR seq < c_seq GROUP BY 1),
whole AS (SELECT target, string_agg(item, ',' ORDER BY seq) AS evidence FROM said GROUP BY 1)
SELECT node_id, coalesce(u_content, content) AS content, evidence, least(gmt_created, u_at) AS valid_from, CASE WHEN c_id IS NOT NULL AND (valid_until IS NULL OR valid_until > c_at) THEN c_at ELSE valid_until END AS valid_until, is_latest AND c_id IS NULL AS is_latest, NULL::VARCHAR AS supersedes, c_id AS superseded_by
FROM mem JOIN old_ ON old_.target = node_id LEFT JOIN ups ON ups.target = node_id LEFT JOIN shut ON shut.target = node_id
UNION ALL SELECT new_id, content, whole.evidence, at_, NULL, true, target, NULL FROM good JOIN whole USING (target) WHERE op = 'SUPERSEDE'
UNION ALL SELECT 'n' || id, 'text ' || id, request_id, created_at, NULL, true, NULL, NULL FROM o WHERE op = 'ADD'"""


@query("ver_apply_ops", f"WITH {APPLIED}")
def ver_apply_ops(s, d):
    """Documents as memory; events as operations on them, in the order of their ids."""
    memory = stored(s, d)
    ops = I.operations(s, d).where("op in ('ADD', 'UPDATE', 'SUPERSEDE')")
    ops = ops.select(F.col("id").alias("seq"), "op", F.concat(F.lit("n"), "id").alias("new_id"), F.when(F.col("op") != "ADD", F.col("memory_id")).alias("target_id"), F.concat(F.lit("text "), "id").alias("content"), F.array("request_id").alias("evidence"), F.col("created_at").alias("at"))
    return V.apply_operations(memory, ops)[0].withColumn("evidence", F.array_join("evidence", ","))


CHAINED = f"""{I.MEMORY}, nu AS (SELECT {I.USERS} AS n),
ch AS (SELECT num, user_id, gmt_created AS created, CASE WHEN num // n % 4 IN (1, 2) THEN num - n END AS supersedes, embedding FROM mem, nu),
lt AS (SELECT * FROM ch WHERE num NOT IN (SELECT supersedes FROM ch WHERE supersedes IS NOT NULL)),
cs AS (SELECT a.num AS x, b.num AS y, a.user_id, list_cosine_similarity(a.embedding, b.embedding) AS score FROM lt a JOIN lt b ON a.user_id = b.user_id AND a.num < b.num),
u AS (SELECT x, y FROM cs WHERE score > 0.3 UNION SELECT y, x FROM cs WHERE score > 0.3), r(n, m) AS (SELECT x, x FROM u UNION SELECT r.n, u.y FROM r JOIN u ON u.x = r.m),
gr AS (SELECT n AS num, min(m) AS grp FROM r GROUP BY 1),
kp AS (SELECT grp, coalesce(min_by(num, (created, num)) FILTER (supersedes IS NOT NULL), min_by(num, (created, num))) AS kept, count(supersedes) AS heads FROM gr JOIN lt USING (num) GROUP BY 1),
gn AS (SELECT num, supersedes, kept, CASE WHEN heads > 1 THEN 'earliest_chain_head' WHEN heads = 1 THEN 'chain_head' ELSE 'earliest_gmt' END AS reason FROM gr JOIN kp USING (grp) JOIN lt USING (num) WHERE num <> kept),
bd(num, kept) AS (SELECT supersedes, kept FROM gn WHERE supersedes IS NOT NULL UNION SELECT ch.supersedes, bd.kept FROM bd JOIN ch USING (num) WHERE ch.supersedes IS NOT NULL)"""


def chained(s, d):
    """Memory rows of which a user's second and third in each four supersede the one before."""
    rows = I.memory(s, d)
    n = I.users(s, d)
    supersedes = F.when(F.floor(F.col("num") / n) % 4 >= 1, F.col("num") - n)
    rows = rows.select("num", "user_id", F.col("gmt_created").alias("created"), F.when(F.floor(F.col("num") / n) % 4 <= 2, supersedes).alias("supersedes"), "embedding")
    old = rows.where("supersedes is not null").select(F.col("supersedes").alias("num"), F.lit(False).alias("last")).distinct()
    return rows.join(old.hint("merge"), "num", "left").select(*rows.columns, F.coalesce("last", F.lit(True)).alias("is_latest"))


@query("ddp_semantic", f"WITH RECURSIVE {CHAINED} SELECT num, kept, reason FROM gn UNION ALL SELECT num, min(kept), 'chain' FROM bd JOIN ch USING (num) WHERE num NOT IN (SELECT num FROM gn) GROUP BY 1")
def ddp_semantic(s, d):
    return P.plan_dedup(chained(s, d), 0.3)[0]


@query("ddp_semantic_stats", f"WITH RECURSIVE {CHAINED}, n AS (SELECT user_id, count(*) AS compared FROM lt GROUP BY 1), p AS (SELECT user_id, max(score) AS most, avg(score) AS mean FROM cs GROUP BY 1) SELECT user_id, compared, round(most, 8) AS max_cosine, round(mean, 8) AS avg_cosine FROM n LEFT JOIN p USING (user_id)")
def ddp_semantic_stats(s, d):
    return P.plan_dedup(chained(s, d), 0.3)[1].select("user_id", "compared", F.round("max_cosine", 8).alias("max_cosine"), F.round("avg_cosine", 8).alias("avg_cosine"))


@query("rk_merge_decision", f"WITH {I.MEMORY}, p AS (SELECT b.num AS new_id, a.num AS old_id, a.content AS old_text, b.content AS new_text, round(list_cosine_similarity(a.embedding, b.embedding), 6) + 0.55 AS score FROM mem a JOIN mem b ON a.user_id = b.user_id AND a.num < b.num WHERE list_cosine_similarity(a.embedding, b.embedding) > 0.2), t AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY score DESC, old_id DESC) AS n FROM p) SELECT new_id, old_id, CASE WHEN score >= 0.95 THEN 'duplicate' WHEN score >= 0.85 THEN 'merge' ELSE 'keep' END AS decision, CASE WHEN score < 0.95 AND score >= 0.85 THEN CASE WHEN length(new_text) > 1.2 * length(old_text) THEN 'new' WHEN contains(old_text, new_text) THEN 'old' ELSE 'new' END END AS text_of FROM t WHERE n = 1")
def rk_merge_decision(s, d):
    mem = I.memory(s, d)
    pairs = Y.similar_pairs(mem, 0.2).select(F.col("b").alias("new_id"), F.col("a").alias("old_id"), (F.round("score", 6) + 0.55).alias("score"))
    pairs = pairs.join(mem.select(F.col("num").alias("old_id"), F.col("content").alias("old_text")), "old_id").join(mem.select(F.col("num").alias("new_id"), F.col("content").alias("new_text")), "new_id")
    return R.merge_decision(pairs).select("new_id", "old_id", "decision", "text_of")


# streams


@query("st_minute", "SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2")
def st_minute(s, d):
    return S.drained(S.minute_metrics(S.events(s, d)), "minutes").withColumn("total", F.round("total", 4))


@query("st_minute_merged", "SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE date_trunc('minute', ts) > (SELECT date_trunc('minute', max(ts)) - INTERVAL 7 DAY FROM events) GROUP BY 1, 2")
def st_minute_merged(s, d):
    """Minutes of the last seven days, whatever batches their events come in."""
    place = f"{shared_dir(s)}/minutes-{uuid.uuid4().hex}"
    return S.merged_minutes(S.events(s, d), place).withColumn("total", F.round("total", 4))


MARK = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)"


@query("st_last60", f"WITH w AS (SELECT time_bucket(INTERVAL 10 SECOND, ts) + k.s * INTERVAL 10 SECOND AS until FROM events, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS s) k) SELECT until, count(*) AS n FROM w WHERE until <= {MARK} GROUP BY 1")
def st_last60(s, d):
    return S.drained(S.recent_completions(S.events(s, d)), "last60")


@query("st_sessions", f"WITH a AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM a) SELECT user_id, min(ts) AS begin, count(*) AS n, round(sum(value), 4) AS total FROM b GROUP BY user_id, nth HAVING max(ts) + INTERVAL 30 MINUTE <= {MARK}")
def st_sessions(s, d):
    return S.drained(S.sessions(S.events(s, d)), "sessions").withColumn("total", F.round("total", 4))


@query("st_dedup", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def st_dedup(s, d):
    """The events, of which every seventh comes again: copies go."""
    again = S.events(s, d).where("event_id % 7 = 0")
    return S.drained(S.first_inserts(S.events(s, d).unionByName(again), "event_id"), "inserts")


SAID = "said AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'user') AS role, text, TIMESTAMP '2024-01-01' + conv_id * INTERVAL 30 MINUTE + coalesce(turn, 0) * INTERVAL 1 MINUTE AS at_ FROM conversations WHERE trim(text) <> '')"


@query("st_buffer", f"""WITH {SAID}, d AS (SELECT *, strftime(at_, '%Y-%m-%d') AS day FROM said),
r AS (SELECT *, floor((sum((role = 'user')::INT) OVER w - (role = 'user')::INT) / 2)::BIGINT AS batch FROM d WINDOW w AS (PARTITION BY conv_id, day ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
f AS (SELECT conv_id, day, batch, count(*) AS n_lines, count_if(role = 'user') AS n_user, min(turn) AS first_turn, string_agg('[' || role || ']: ' || text, chr(10) ORDER BY turn, role, text) AS said FROM r GROUP BY 1, 2, 3)
SELECT concat_ws('::', 'u' || conv_id % 20, 'default_agent', 's' || conv_id, day) AS buffer_key, batch, CASE WHEN n_user >= 2 THEN 'ready' ELSE 'day end' END AS reason, n_lines, n_user, first_turn, sha256(said) AS said FROM f
WHERE n_user >= 2 OR day::TIMESTAMP + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(at_)) - INTERVAL 10 MINUTE FROM said)""")
def st_buffer(s, d):
    """Half an hour for each conversation."""
    rows = S.table_stream(s, d, "conversations.parquet")
    at = F.timestamp_seconds(F.unix_timestamp(I.start()) + F.col("conv_id") * 1800 + F.coalesce("turn", F.lit(0)) * 60)
    turns = rows.select(F.concat(F.lit("u"), F.col("conv_id") % 20).alias("user_id"), F.lit(None).cast("string").alias("agent_id"), F.concat(F.lit("s"), "conv_id").alias("session_id"), "turn", "role", "text", at.alias("at"))
    return S.drained(S.buffered(turns, 2), "buffer").withColumn("said", F.sha2(F.array_join("lines", "\n"), 256)).drop("lines")


@query("st_expire", "SELECT event_id, CASE event_type WHEN 'click' THEN 'l2_fact' WHEN 'view' THEN 'l1_raw' WHEN 'error' THEN CASE WHEN ts + INTERVAL 1 DAY < TIMESTAMP '2024-01-10' THEN 'l2_fact' ELSE 'l7_intention' END ELSE 'l3_summary' END AS layer, ts < TIMESTAMP '2024-01-10' - CASE event_type WHEN 'click' THEN 2000 WHEN 'view' THEN 500 ELSE 9000 END * INTERVAL 1 MINUTE AS gone FROM events")
def st_expire(s, d):
    kind = F.col("event_type")
    layer = F.when(kind == "click", "l2_fact").when(kind == "view", "l1_raw").when(kind == "error", "l7_intention").otherwise("l3_summary")
    rows = S.events(s, d).select("event_id", layer.alias("layer"), F.col("ts").alias("at"), (F.col("ts") + F.expr("interval 1 day")).alias("valid_until"))
    windows = s.createDataFrame([("l2_fact", 2000), ("l1_raw", 500)], "layer string, minutes int")
    return S.drained(S.expired(rows, windows, "2024-01-10", 9000), "expired").select("event_id", "layer", "gone")


@query("st_ops_apply", f"WITH {APPLIED}")
def st_ops_apply(s, d):
    """The operations of ver_apply_ops as a stream of events."""
    op = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in I.OPS.items()))
    ops = S.events(s, d).withColumn("op", op).where("op in ('ADD', 'UPDATE', 'SUPERSEDE')")
    target = F.when(F.col("op") != "ADD", F.concat(F.lit("m"), F.col("event_id") % I.targets(s, d)))
    day = F.concat_ws("-", F.concat(F.lit("u"), "user_id"), F.date_format("ts", "yyyyMMdd"))
    ops = ops.select(F.col("event_id").alias("seq"), "op", F.concat(F.lit("n"), "event_id").alias("new_id"), target.alias("target_id"), F.concat(F.lit("text "), "event_id").alias("content"), F.array(day).alias("evidence"), F.col("ts").alias("at"))
    return S.applied(ops, stored(s, d), "memory").withColumn("evidence", F.array_join("evidence", ","))


def flagship(s, d) -> DataFrame:
    return search_hybrid(s, d)

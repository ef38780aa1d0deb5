"""Queries over operations, code memories, profiles, inserts, copies, and what is measured of runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import expressions as X
from palimpsest.operators import operations as O
from palimpsest.operators import profiles as P
from palimpsest.operators import retrieval as R
from palimpsest.plans import catalog as A
from palimpsest.plans.catalog import CONTEXTS, PLACES, SEEN, contexts, placed
from palimpsest.plans.registry import query
from palimpsest.sources import inputs as I


def texts(s, d):
    """Events as what a model wrote: a fenced list, groups, a lost target, no JSON, one object."""
    k, i = F.col("event_id") % 5, F.col("event_id").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit('```json\n[{"op":"add","content":"c'), i, F.lit('","tags":["A"," b ","","c","d"]}]\n```')))
        .when(k == 1, F.concat(F.lit('[{"reason":"g","ops":[{"op":"UPDATE","memory_id":"m'), i, F.lit('","state_transition":true},{"op":"DELETE","memory_id":"m2","reason":"own"}]}]')))
        .when(k == 2, '[{"op":"SUPERSEDE","content":"x"}]')
        .when(k == 3, "I could not decide [")
        .otherwise(F.concat(F.lit('{"op":"SUPERSEDE","memory_ids":["a","b"],"memory_id":"m'), i, F.lit('","owner":"assistant","source_indices":[2,-1,2,0]}')))
    )
    return I.table(s, d, "events").select("event_id", text.alias("text"))


@query(
    "json_ops",
    """SELECT event_id, 0 AS nth, CASE event_id % 5 WHEN 0 THEN 'ADD' ELSE 'SUPERSEDE' END AS op, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'm' || event_id ELSE 'a,b,m' || event_id END AS ids, CASE event_id % 5 WHEN 0 THEN 'a,b,c' ELSE '' END AS tags, CASE event_id % 5 WHEN 1 THEN 'g' ELSE '' END AS reason, CASE event_id % 5 WHEN 4 THEN 'agent' END AS owner, CASE event_id % 5 WHEN 4 THEN '2,0' ELSE '' END AS sources FROM events WHERE event_id % 5 IN (0, 1, 4)
    UNION ALL SELECT event_id, 1, 'DELETE', 'm2', '', 'own', NULL, '' FROM events WHERE event_id % 5 = 1""",
)
def json_ops(s, d):
    good = O.parsed(texts(s, d), "event_id", "text")[0]
    return good.select("event_id", "nth", "op", F.array_join("memory_ids", ",").alias("ids"), F.array_join("tags", ",").alias("tags"), "reason", "owner", F.array_join(F.col("source_indices").cast("array<string>"), ",").alias("sources"))


@query("json_ops_rejects", "SELECT event_id, CASE WHEN event_id % 5 = 2 THEN 0 END AS nth, CASE WHEN event_id % 5 = 2 THEN 'target is missing' ELSE 'no JSON' END AS reason FROM events WHERE event_id % 5 IN (2, 3)")
def json_ops_rejects(s, d):
    return O.parsed(texts(s, d), "event_id", "text")[1]


@query("json_operations", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '[{\"k\":' || event_id || '}]' WHEN 1 THEN '[1]' END AS found FROM events")
def json_operations(s, d):
    i, k = F.col("event_id").cast("string"), F.col("event_id") % 3
    text = F.when(k == 0, F.concat(F.lit('I think: [{"k":'), i, F.lit("}] and that is all"))).when(k == 1, "so\n```json\n[1]\n```\nnot [2]").otherwise("see [broken")
    return I.table(s, d, "events").select("event_id", O.json_array(text).alias("found"))


@query("json_drafts", "SELECT p_partkey, p_name AS task, CASE p_partkey % 3 WHEN 1 THEN 'project' ELSE 'user' END AS scope, 'k1,k2,k3,k4,k5' AS keys, CASE p_partkey % 3 WHEN 1 THEN 1.0 ELSE 0.7 END AS confidence FROM part WHERE p_partkey % 3 <> 0")
def json_drafts(s, d):
    """A draft without a solution, one of an unknown scope, one of a user's, and one that lacks its branch, for each part."""
    k = F.col("p_partkey") % 3
    one = F.to_json(F.struct(F.col("p_name").alias("task"), F.when(k == 0, " ").otherwise("do it").alias("solution"), F.when(k == 1, "galaxy").otherwise("USER").alias("boundary_scope"), F.array(F.lit("k1"), F.lit(" k2 "), F.lit("k1"), F.col("p_name"), F.lit("k3"), F.lit("k4"), F.lit("k5"), F.lit("k6")).alias("search_keys"), F.when(k == 1, "7").otherwise("high").alias("confidence")))
    strict = '{"task":"t","solution":"s","boundary_scope":"strict"}'
    text = F.concat(F.when(k == 1, "Here it is: ").otherwise(""), F.lit('{"memories":['), one, F.lit(f",{strict}]}}"))
    raw = I.table(s, d, "part").select("p_partkey", text.alias("text"), F.col("p_brand").alias("workspace"), F.lit("").alias("branch"))
    return O.drafts(raw, "p_partkey", "text").select("p_partkey", "task", "scope", F.array_join("search_keys", ",").alias("keys"), "confidence")


@query("flt_scope_valid", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'boundary_scope=''strict'' requires both workspace_id and branch' WHEN 1 THEN CASE WHEN p_size > 25 THEN 'boundary_scope=''project'' requires workspace_id' END WHEN 4 THEN 'invalid boundary_scope=elsewhere' END AS error FROM part")
def flt_scope_valid(s, d):
    k = F.col("p_partkey") % 5
    scope = F.when(k == 0, "strict").when(k == 1, "project").when(k == 2, "user").when(k == 3, "global").otherwise("elsewhere")
    return I.table(s, d, "part").select("p_partkey", O.scope_error(scope, F.when(F.col("p_size") <= 25, F.col("p_brand")), F.lit("")).alias("error"))


# code memories: a part is one, its brand the workspace

CODE_OPS = "o AS (SELECT l_orderkey AS request_id, l_partkey * 1000000 + l_suppkey AS seq, CASE l_partkey % 4 WHEN 0 THEN 'ADD' WHEN 1 THEN 'UPDATE' WHEN 2 THEN 'SKIP' ELSE 'DELETE' END AS action, l_suppkey % 3 AS draft, CASE WHEN l_partkey % 5 <> 0 THEN 'p' || l_partkey END AS target FROM lineitem)"


@query(
    "ver_code_apply",
    f"""WITH {CODE_OPS}, p AS (SELECT o_orderkey AS request_id, unnest([0, 1]) AS draft FROM orders), t AS (SELECT o.* FROM o JOIN p USING (request_id, draft) WHERE action IN ('ADD', 'SKIP') OR (action = 'UPDATE' AND target IS NOT NULL)),
    f AS (SELECT *, row_number() OVER (PARTITION BY request_id, draft ORDER BY seq) AS turn FROM t)
    SELECT request_id, action, count(*) AS n FROM (SELECT request_id, action FROM f WHERE turn = 1 AND action <> 'SKIP' UNION ALL SELECT request_id, action FROM o WHERE action = 'DELETE' AND target IS NOT NULL UNION ALL SELECT request_id, 'ADD' FROM p ANTI JOIN f USING (request_id, draft)) GROUP BY 1, 2""",
)
def ver_code_apply(s, d):
    k = F.col("l_partkey") % 4
    rows = I.table(s, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("seq"), F.when(k == 0, "ADD").when(k == 1, "UPDATE").when(k == 2, "SKIP").otherwise("DELETE").alias("action"), (F.col("l_suppkey") % 3).cast("int").alias("draft"), F.when(F.col("l_partkey") % 5 != 0, F.concat(F.lit("p"), "l_partkey")).alias("target"))
    proposed = I.table(s, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("draft"))
    return O.code_changes(rows, proposed).groupBy("request_id", "action").agg(F.count("*").alias("n"))


def code(s, d):
    return I.table(s, d, "part").select(F.col("p_partkey").alias("num"), F.concat(F.lit("p"), "p_partkey").alias("memory_id"), F.col("p_brand").alias("workspace"), F.col("p_type").alias("task"), F.split("p_name", " ").alias("search_keys"), "p_size")


@query("ver_code_keys", "WITH k AS (SELECT 'p' || p_partkey AS memory_id, unnest(CASE WHEN p_partkey % 4 = 0 THEN [p_type] ELSE [p_type] || string_split(p_name, ' ') END) AS text, generate_subscripts(CASE WHEN p_partkey % 4 = 0 THEN [p_type] ELSE [p_type] || string_split(p_name, ' ') END, 1) - 1 AS place FROM part) SELECT memory_id || '#' || place AS key_id, memory_id, place, text FROM k")
def ver_code_keys(s, d):
    """Every fourth memory is updated to have no search keys: those of before go."""
    rows = code(s, d)
    fresh = rows.where("num % 4 = 0").withColumn("search_keys", F.slice("search_keys", 1, 0))
    return O.replaced_keys(O.code_keys(rows), fresh)


KEYS = f"""{CONTEXTS}, r AS (SELECT vec_id // 4 AS memory, 'u' || vec_id // 4 % {I.USERS} AS user_id, {PLACES.format("(vec_id // 4)")}, embedding::DOUBLE[] AS v FROM embeddings),
hit AS (SELECT query_id, memory, round(list_cosine_similarity(query_vector, v), 6) AS score FROM cx JOIN r ON {SEEN}), far AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory) AS nth FROM hit),
best AS (SELECT query_id, memory, max(score) AS score FROM far WHERE nth <= {{0}} GROUP BY 1, 2), top_ AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory) AS rank FROM best WHERE score >= {{1}})"""


def code_keys(s, d):
    """Four keys for each code memory."""
    n = F.floor(F.col("vec_id") / 4)
    rows = I.table(s, d, "embeddings").select(n.alias("node_id"), F.concat(F.lit("u"), n % I.users(s, d)).alias("user_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return placed(rows, F.col("node_id"))


@query("top_code", f"WITH {KEYS.format(40, 0.05)} SELECT query_id, memory, score, rank FROM top_ WHERE rank <= 10")
def top_code(s, d):
    return R.code_hits(contexts(s, d), code_keys(s, d), 0.05, 10).select("query_id", F.col("node_id").alias("memory"), "score", "rank")


@query("jn_code_cands", f"WITH {KEYS.format(12, -1)} SELECT query_id, memory, rank FROM top_ WHERE rank <= 3")
def jn_code_cands(s, d):
    """The three memories nearest to each draft, of the four times as many keys that are nearest."""
    return R.code_hits(contexts(s, d), code_keys(s, d), -1.0, 3).select("query_id", F.col("node_id").alias("memory"), "rank")


@query("top_code_tasks", "SELECT p_brand AS workspace, p_type AS task, nth FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY last DESC) AS nth FROM (SELECT p_brand, p_type, max(p_partkey) AS last FROM part GROUP BY 1, 2)) WHERE nth <= 50")
def top_code_tasks(s, d):
    from pyspark.sql import Window

    rows = code(s, d).groupBy("workspace", "task").agg(F.max("num").alias("last"))
    return rows.select("workspace", "task", F.row_number().over(Window.partitionBy("workspace").orderBy(F.col("last").desc())).alias("nth")).where("nth <= 50")


@query("jn_file_whitelist", "SELECT p_partkey, p_name AS path FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size = 7)")
def jn_file_whitelist(s, d):
    rows = I.table(s, d, "part")
    seen = rows.where("p_size = 7").select(F.col("p_name").alias("path")).distinct()
    return rows.select("p_partkey", F.col("p_name").alias("path")).join(seen, "path", "left_semi")


#: Arguments of tool calls that name a file. Fixed values.
PATH_KEYS = ["path", "file_path", "filepath", "file", "filename", "target_file", "absolute_path", "notebook_path", "relative_path"]


@query("agg_files", "SELECT l_orderkey AS conv_id, array_to_string(list_sort(list(DISTINCT 'f' || (l_partkey % 7))), ',') AS files FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1")
def agg_files(s, d):
    key = F.when(F.col("l_partkey") % 4 == 0, "path").when(F.col("l_partkey") % 2 == 0, "file_path").otherwise("query")
    calls = I.table(s, d, "lineitem").select("l_orderkey", F.create_map(key, F.concat(F.lit("f"), F.col("l_partkey") % 7)).alias("arguments"))
    rows = calls.select("l_orderkey", F.explode("arguments")).where(F.col("key").isin(PATH_KEYS))
    return rows.groupBy(F.col("l_orderkey").alias("conv_id")).agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("files"))


# references, evidence, schemas

REQ = "x AS (SELECT o_custkey AS request_id, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'n' || o_orderkey END AS created_id, CASE WHEN o_orderkey % 6 = 0 THEN 'r' END AS ref, CASE o_orderkey % 4 WHEN 0 THEN 'schema_1' WHEN 1 THEN 'r' WHEN 2 THEN 'schema_id_2' ELSE 'fixed' END AS node FROM orders)"


@query(
    "jn_refs",
    f"""WITH {REQ}, m AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY seq) AS k FROM x WHERE created_id IS NOT NULL), n AS (SELECT request_id, seq AS at_, created_id AS real, ref AS token FROM m WHERE ref IS NOT NULL UNION ALL SELECT request_id, seq, created_id, 'schema_' || k FROM m UNION ALL SELECT request_id, seq, created_id, 'schema_id_' || k FROM m)
    SELECT x.request_id, x.seq, coalesce(arg_max(real, at_), any_value(node)) AS node FROM x LEFT JOIN n ON n.request_id = x.request_id AND token = node AND at_ < x.seq GROUP BY 1, 2""",
)
def jn_refs(s, d):
    k = F.col("o_orderkey") % 4
    made = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("n"), "o_orderkey"))
    rows = I.table(s, d, "orders").select(F.col("o_custkey").alias("request_id"), F.col("o_orderkey").alias("seq"), made.alias("created_id"), F.when(F.col("o_orderkey") % 6 == 0, "r").alias("ref"), F.when(k == 0, "schema_1").when(k == 1, "r").when(k == 2, "schema_id_2").otherwise("fixed").alias("node"))
    return O.resolved(rows, ["node"]).select("request_id", "seq", "node")


JUDGE = "c AS (SELECT DISTINCT l_orderkey AS request_id, 'own' AS owner, l_partkey AS fact_id FROM lineitem), ft AS (SELECT p_partkey AS fact_id, CASE WHEN p_size = 9 THEN 'other' ELSE 'own' END AS owner FROM part WHERE p_size <> 10), j AS (SELECT request_id, c.fact_id, CASE WHEN ft.owner IS NULL THEN 'missing' WHEN ft.owner <> c.owner THEN 'isolation' END AS reason FROM c LEFT JOIN ft USING (fact_id))"


def cites(s, d):
    return I.table(s, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.lit("own").alias("owner"), F.col("l_partkey").alias("fact_id")).distinct()


def facts(s, d):
    return I.table(s, d, "part").where("p_size <> 10").select(F.col("p_partkey").alias("fact_id"), F.when(F.col("p_size") == 9, "other").otherwise("own").alias("owner"))


@query("jn_evidence_valid", f"WITH {JUDGE} SELECT request_id, fact_id, reason, count(reason) OVER (PARTITION BY request_id) = 0 AS accepted FROM j")
def jn_evidence_valid(s, d):
    return O.judged_evidence(cites(s, d), facts(s, d))


@query("jn_schema_create", f"WITH {JUDGE}, g AS (SELECT request_id, count(*) AS n FROM j GROUP BY 1 HAVING count(reason) = 0) SELECT sha256('schema:own:' || request_id) AS node_id, 'about ' || request_id AS content, n AS n_evidence, 2 AS n_topics FROM g")
def jn_schema_create(s, d):
    asked = cites(s, d).groupBy("request_id", "owner").agg(F.collect_set("fact_id").alias("facts")).withColumn("content", F.concat(F.lit("about "), "request_id")).withColumn("tags", F.array(F.lit("a"), F.lit("b")))
    nodes, evidence, topics, _ = O.made_schemas(asked, facts(s, d))
    n = evidence.groupBy("node_id").agg(F.count("*").alias("n_evidence"))
    return nodes.join(n, "node_id").join(topics.groupBy("node_id").agg(F.count("*").alias("n_topics")), "node_id").select("node_id", "content", "n_evidence", "n_topics")


@query("ver_link_segment", "SELECT o_orderkey::VARCHAR AS node, coalesce(lead(o_orderkey::VARCHAR) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 'new' || o_custkey) AS superseded_by FROM orders")
def ver_link_segment(s, d):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string"))
    ops = I.table(s, d, "orders").groupBy("o_custkey").agg(ids.alias("memory_ids")).select(F.concat(F.lit("new"), "o_custkey").alias("new_id"), "memory_ids")
    return O.segments(ops)


@query("ver_enrich_ops", "SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 2 = 0 THEN 'given' WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) END AS relation FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def ver_enrich_ops(s, d):
    """An order's operation names all its lines as sources; odd ones have no relation of their own."""
    ops = I.table(s, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.lit(0).alias("seq"), F.lit("x").alias("content"), F.sequence(F.lit(0), F.lit(10)).alias("source_indices"), F.when(F.col("o_orderkey") % 2 == 0, "given").alias("relation"))
    items = I.table(s, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("item"), F.lit("y").alias("content"), F.col("l_returnflag").alias("relation"))
    return O.enriched(ops, items, ["relation"]).join(items.select("request_id").distinct(), "request_id", "left_semi").select("request_id", "relation")


@query("map_custom", "SELECT p_partkey, 1 + (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS evidence_count, 'v' AS other FROM part")
def map_custom(s, d):
    n = I.table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    rows = I.table(s, d, "part").select("p_partkey", F.create_map(F.lit("s2_evidence_count"), F.lit("1"), F.lit("other"), F.lit("v")).alias("custom")).join(n, "p_partkey", "left")
    custom = X.map_patch(F.col("custom"), F.create_map(F.lit("s2_evidence_count"), (F.col("custom")["s2_evidence_count"].cast("long") + F.coalesce("n", F.lit(0))).cast("string")))
    return rows.select("p_partkey", custom["s2_evidence_count"].cast("long").alias("evidence_count"), custom["other"].alias("other"))


# profiles, inserts, edits, copies


def diffs(s, d):
    return I.table(s, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("key"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("node"))


FOLD = "fo AS (SELECT o_custkey AS user_id, o_orderpriority AS key, arg_max(o_orderstatus, o_orderkey) AS value FROM orders GROUP BY 1, 2), la AS (SELECT o_custkey AS user_id, max(o_orderkey) AS head, count(*) AS n FROM orders GROUP BY 1), kv AS (SELECT c_custkey AS user_id, unnest(['1-URGENT', 'segment']) AS key, unnest(['O', c_mktsegment]) AS value FROM customer)"


@query("ver_profile_upsert", f"WITH {FOLD} SELECT user_id, head AS supersedes, string_agg(kv.key || '=' || kv.value, ',' ORDER BY kv.key) AS changed FROM kv LEFT JOIN fo USING (user_id, key) LEFT JOIN la USING (user_id) WHERE fo.value IS NULL OR fo.value <> kv.value GROUP BY 1, 2")
def ver_profile_upsert(s, d):
    kv = I.table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.explode(F.create_map(F.lit("1-URGENT"), F.lit("O"), F.lit("segment"), "c_mktsegment")))
    return P.upserted(diffs(s, d), kv).select("user_id", "supersedes", F.array_join(F.transform(F.map_entries("kv"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("changed"))


@query("ver_profile_view", f"WITH {FOLD} SELECT user_id, head, n AS n_versions, string_agg(key || '=' || value, ',' ORDER BY key) AS kv FROM fo JOIN la USING (user_id) GROUP BY ALL")
def ver_profile_view(s, d):
    return P.view(diffs(s, d)).select("user_id", "head", "n_versions", F.array_join(F.transform(F.map_entries("kv"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("kv"))


def said(s, d):
    return I.table(s, d, "documents").select(F.concat(F.lit("u"), F.col("doc_id") % 20).alias("user_id"), F.col("doc_id").alias("item"), F.col("text").alias("content"))


def insert_sql(layer: str, more: str) -> str:
    return f"SELECT sha256('u' || (doc_id % 20) || ':{layer}:' || doc_id) AS node_id, md5(trim(text)) AS content_md5{more} FROM documents WHERE trim(text) <> ''"


@query("ver_insert_direct", insert_sql("l2_fact", ""))
def ver_insert_direct(s, d):
    return P.inserted(said(s, d)).select("node_id", F.md5("content").alias("content_md5"))


@query("ver_intentions", insert_sql("l7_intention", ", 'user' AS owner, 'future' AS temporal_relation"))
def ver_intentions(s, d):
    return P.inserted(said(s, d), "l7_intention", "future", "user").select("node_id", F.md5("content").alias("content_md5"), "owner", "temporal_relation")


@query("ver_insert_extracted", "SELECT user_id, count(*) AS n, sum(item)::BIGINT AS items FROM (SELECT doc_id % 20 AS user_id, min(doc_id) AS item FROM documents WHERE trim(text) <> '' GROUP BY 1, lower(trim(text))) GROUP BY 1")
def ver_insert_extracted(s, d):
    rows = P.extracted(said(s, d))
    items = said(s, d).select(F.sha2(F.concat_ws(":", "user_id", F.lit("l2_fact"), "item"), 256).alias("node_id"), "item")
    return rows.join(items, "node_id").groupBy(F.substring("user_id", 2, 9).cast("long").alias("user_id")).agg(F.count("*").alias("n"), F.sum("item").alias("items"))


@query("ver_edit", f"WITH {I.MEMORY} SELECT node_id, CASE WHEN num % 6 = 0 THEN 'new ' || num ELSE content END AS content, num % 6 = 0 AS in_history FROM mem")
def ver_edit(s, d):
    rows = I.memory(s, d).select("num", "node_id", "content", "embedding")
    edits = rows.where("num % 6 = 0").select("node_id", F.concat(F.lit("new "), "num").alias("content"), "embedding")
    after, history, _ = P.edited(rows, edits)
    return after.join(history.select("node_id", F.lit(True).alias("h")), "node_id", "left").select("node_id", "content", F.coalesce("h", F.lit(False)).alias("in_history"))


COPIED = """v AS (SELECT o_orderkey::VARCHAR AS node, lag(o_orderkey::VARCHAR) OVER w AS prev, lag(o_orderkey::VARCHAR, 2) OVER w AS older, lead(o_orderkey::VARCHAR) OVER w AS next_, 'u' || o_custkey % 10 AS u, o_custkey FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
c AS (SELECT *, sha256('copy:' || node) AS n1, CASE WHEN prev IS NOT NULL THEN sha256('copy:' || prev) END AS n0, CASE WHEN older IS NOT NULL THEN sha256('copy:' || older) END AS nn, CASE WHEN next_ IS NOT NULL THEN sha256('copy:' || next_) END AS n2 FROM v WHERE u = 'u3')"""


@query("ver_clone", f"""WITH {COPIED} SELECT 'row' AS kind, n1 AS id, concat_ws('>', n0, n1, n2) AS links, concat_ws(',', nn, 'D' || o_custkey, n0, n1) AS list FROM c UNION ALL SELECT 'edge', n1, n0, NULL FROM c WHERE n0 IS NOT NULL
UNION ALL SELECT 'log', sha256('copy:' || 'op' || node), concat_ws('>', n0, n1), concat_ws(',', n0, nn) FROM c""")
def ver_clone(s, d):
    """User u3's versions, an edge from each to the one before, and the operations that made them, copied to the user `copy`."""
    by = Window.partitionBy("owner").orderBy("at", "node")
    text = lambda c: F.col(c).cast("string")
    all_ = I.versions(s, d).withColumn("older", F.lag("node", 2).over(by)).withColumn("user_id", F.concat(F.lit("u"), F.col("owner") % 10))
    given = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())
    rows = all_.select(text("node").alias("node_id"), "user_id", text("supersedes").alias("supersedes"), text("superseded_by").alias("superseded_by"), given(text("older"), F.concat(F.lit("D"), "owner"), text("supersedes"), text("node")).alias("evidence"), F.lit(3).alias("access_count"))
    edges = rows.where("supersedes is not null").select(F.col("node_id").alias("src"), F.col("supersedes").alias("dst"))
    log = all_.select(F.concat(F.lit("op"), text("node")).alias("id"), "user_id", text("node").alias("memory_id"), text("supersedes").alias("old_memory_id"), given(text("supersedes"), text("older")).alias("supersedes"))
    new, links, said = P.cloned(rows, edges, log, "u3", "copy")
    out = new.select(F.lit("row").alias("kind"), F.col("node_id").alias("id"), F.concat_ws(">", "supersedes", "node_id", "superseded_by").alias("links"), F.array_join("evidence", ",").alias("list"))
    out = out.unionByName(links.select(F.lit("edge").alias("kind"), F.col("src").alias("id"), F.col("dst").alias("links"), F.lit(None).cast("string").alias("list")))
    return out.unionByName(said.select(F.lit("log").alias("kind"), "id", F.concat_ws(">", "old_memory_id", "memory_id").alias("links"), F.array_join("supersedes", ",").alias("list")))


@query("snk_graph_purge", f"WITH {I.MEMORY} SELECT num AS node_id, l_suppkey AS fact_id FROM (SELECT DISTINCT num, l_suppkey FROM mem JOIN lineitem ON l_partkey = num) JOIN mem USING (num) WHERE user_id <> 'u1'")
def snk_graph_purge(s, d):
    mem = I.memory(s, d).select(F.col("num").alias("node_id"), F.concat_ws("::", "user_id", "agent_id").alias("isolation_key"))
    edges = mem.join(I.table(s, d, "lineitem").select(F.col("l_partkey").alias("node_id"), F.col("l_suppkey").alias("fact_id")), "node_id").select("node_id", "fact_id").distinct()
    return P.purged(mem, mem.select("isolation_key"), edges, "u1")[2]


@query("snk_opslog", f"WITH {I.OPERATIONS} SELECT id, request_id, op FROM ops")
def snk_opslog(s, d):
    """Operations appended to a log in two batches, and the log."""
    from palimpsest.operators.lineage import appended

    rows = I.operations(s, d).select("id", "request_id", "op")
    return appended([rows.where("id % 2 = 0"), rows.where("id % 2 = 1")], "operations")


# text and dates


@query("txt_lang", r"WITH t AS (SELECT conv_id, turn, length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g')) AS c, length(regexp_replace(text, '\s', '', 'g')) AS n FROM conversations) SELECT conv_id, turn, CASE WHEN n > 0 AND c / n > 0.1 THEN 'zh' ELSE 'en' END AS lang FROM t")
def txt_lang(s, d):
    return I.turns(s, d).select("conv_id", "turn", X.language(F.col("text")).alias("lang"))


@query("txt_normalize", f"SELECT doc_id, coalesce(array_to_string(list_filter(regexp_extract_all(lower(text), '{A.TERMS}'), lambda t: CASE WHEN regexp_matches(t, '^[a-z0-9]') THEN t NOT IN ({A.STOP}) ELSE length(t) >= 2 END), ' '), '') AS words FROM documents")
def txt_normalize(s, d):
    return I.table(s, d, "documents").select("doc_id", X.normal_words(F.col("text")).alias("words"))


@query("dt_since", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate::TIMESTAMP WHEN 1 THEN o_orderdate::TIMESTAMP END AS since FROM orders")
def dt_since(s, d):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.concat(F.lit('"'), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit(' 10:00".'))).when(k == 2, "none").otherwise("last week")
    return I.table(s, d, "orders").select("o_orderkey", X.since(text).alias("since"))


# runs


@query("agg_eval_multi", "WITH w AS (SELECT event_type, count_if(value > 10) AS good, count(*) AS n FROM events GROUP BY 1) SELECT round(sum(good) / greatest(1, sum(n)), 4) AS write_rate, sum(n)::BIGINT AS writes, count_if(good % 2 = 0) AS digests_ok, array_to_string(coalesce(list_sort(list(event_type) FILTER (good % 2 = 1)), []), ',') AS failed FROM w")
def agg_eval_multi(s, d):
    """An event is a written session of the sample that its type names; a sample's digest failed where its number of good ones is odd."""
    per = I.table(s, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 10).alias("good"), F.count("*").alias("n"))
    failed = F.array_sort(F.collect_list(F.when(F.col("good") % 2 == 1, F.col("event_type"))))
    return per.agg(F.round(F.sum("good") / F.greatest(F.lit(1), F.sum("n")), 4).alias("write_rate"), F.sum("n").alias("writes"), F.count_if(F.col("good") % 2 == 0).alias("digests_ok"), F.array_join(failed, ",").alias("failed"))


@query("agg_usage", "WITH u AS (SELECT user_id, sum(event_id % 1000)::BIGINT AS prompt, sum(event_id % 77)::BIGINT AS completion FROM events GROUP BY 1) SELECT user_id, prompt, completion, round(prompt / 1000000 * 12 + completion / 1000000 * 24, 4) AS cost FROM u")
def agg_usage(s, d):
    """Tokens and their price, in units for a million of each."""
    rows = I.table(s, d, "events").groupBy("user_id").agg(F.sum(F.col("event_id") % 1000).alias("prompt"), F.sum(F.col("event_id") % 77).alias("completion"))
    return rows.withColumn("cost", F.round(F.col("prompt") / 1000000 * 12 + F.col("completion") / 1000000 * 24, 4))


@query("agg_merge_stats", f"WITH r AS ({A.SQL['rk_merge_decision']}) SELECT count(*) AS checks, count_if(decision = 'merge') AS merges, round(count_if(decision = 'merge') / greatest(1, count(*)), 6) AS rate FROM r")
def agg_merge_stats(s, d):
    merged = F.count_if(F.col("decision") == "merge")
    return A.rk_merge_decision(s, d).agg(F.count("*").alias("checks"), merged.alias("merges"), F.round(merged / F.greatest(F.lit(1), F.count("*")), 6).alias("rate"))

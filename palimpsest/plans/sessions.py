"""Queries over logged chats: dialects, citations, times, residence, tool calls, traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import citations as C
from palimpsest.operators import traces as T
from palimpsest.plans.registry import query
from palimpsest.sources import dialects as D
from palimpsest.sources import inputs as I


def nested(s, d):
    """Conversations with their first four turns as session 1 and the rest as session 2; every third turn has a caption."""
    turn = F.struct(F.when(F.col("role") == "user", "A").otherwise("B").alias("speaker"), F.concat_ws(":", F.concat(F.lit("D"), "conv_id"), "turn").alias("dia_id"), "text", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("picture "), "turn")).alias("blip_caption"))
    rows = I.table(s, d, "conversations").groupBy("conv_id").agg(*(F.array_sort(F.collect_list(F.when(cond, F.struct("turn", turn.alias("t"))))).alias(n) for n, cond in (("one", F.col("turn") < 4), ("two", F.col("turn") >= 4))))
    part = lambda c: F.transform(c, lambda x: x["t"])
    return rows.select(F.col("conv_id").alias("sample_id"), F.struct(F.lit("A").alias("speaker_a"), part("one").alias("session_1"), F.lit("1:56 pm on 8 May, 2023").alias("session_1_date_time"), part("two").alias("session_2")).alias("conversation"))


@query("src_turns", "SELECT * FROM (SELECT conv_id AS sample_id, CASE WHEN turn < 4 THEN 1 ELSE 2 END AS session, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, trim(coalesce(text, '')) || CASE WHEN turn % 3 = 0 THEN ' [Shared image description: picture ' || turn || ']' ELSE '' END AS text, 'D' || conv_id || ':' || turn AS turn_id FROM conversations) WHERE text <> ''")
def src_turns(s, d):
    return D.nested_turns(nested(s, d)).select("sample_id", "session", "role", "text", "turn_id")


def logged(s, d):
    """Turns as JSON: user turns plain, other turns with a call beside the text or as blocks, by the parity of the conversation."""
    key = F.concat_ws(":", "conv_id", "turn")
    call = F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn")
    plain = F.to_json(F.struct("role", F.col("text").alias("content"), key.alias("turn_id")))
    listed = F.to_json(F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"), key.alias("turn_id"), F.array(F.struct(call.alias("id"), F.struct(F.lit("look").alias("name"), F.when(F.col("turn") % 3 == 0, "no json").otherwise('{"n":1}').alias("arguments")).alias("function"))).alias("tool_calls")))
    answer = F.to_json(F.struct(F.lit("tool").alias("role"), F.concat(F.lit("found "), "turn").alias("content"), call.alias("tool_call_id"), F.lit("look").alias("name")))
    kind = lambda t, **f: F.struct(*(f.get(n, F.lit(None).cast("string")).alias(n) for n in ("text", "id", "name", "tool_use_id", "content")), F.lit(t).alias("type"))
    blocks = F.to_json(F.struct(F.lit("assistant").alias("role"), key.alias("turn_id"), F.array(kind("text", text=F.col("text")), kind("tool_use", id=call, name=F.lit("look")), kind("tool_result", tool_use_id=call, content=F.concat(F.lit("found "), "turn"))).alias("content")))
    rows = F.when(F.col("role") == "user", F.array(plain)).when(F.col("conv_id") % 2 == 0, F.array(listed, answer)).otherwise(F.array(blocks))
    return I.table(s, d, "conversations").select("conv_id", "turn", F.posexplode(rows).alias("nth", "message")).withColumn("key", F.struct("conv_id", "turn", "nth"))


def chat(s, d):
    return D.messages(logged(s, d), "key", "message").select("key.conv_id", "key.turn", (F.col("key.nth") + F.col("part")).alias("nth"), "role", "content", "turn_id", "tool_call_id", "tool_name", "calls")


@query(
    "src_messages",
    """SELECT conv_id, turn, 0 AS nth, CASE WHEN role = 'user' THEN role ELSE 'assistant' END AS role, CASE WHEN role = 'user' OR conv_id % 2 = 0 THEN coalesce(text, '') ELSE trim(coalesce(text, '')) END AS content, CASE WHEN role = 'user' THEN '' WHEN conv_id % 2 = 1 THEN '{}' WHEN turn % 3 = 0 THEN '{"_raw":"no json"}' ELSE '{"n":1}' END AS arguments FROM conversations
    UNION ALL SELECT conv_id, turn, 1, 'tool', 'found ' || turn, '' FROM conversations WHERE role <> 'user'""",
)
def src_messages(s, d):
    return chat(s, d).select("conv_id", "turn", "nth", "role", "content", F.coalesce(F.try_element_at("calls", F.lit(1))["arguments"], F.lit("")).alias("arguments"))


@query("jn_tool_calls", "SELECT conv_id, 'c' || conv_id || '-' || turn AS call_id, 'look' AS name, CASE WHEN conv_id % 2 = 1 THEN '{}' WHEN turn % 3 = 0 THEN '{\"_raw\":\"no json\"}' ELSE '{\"n\":1}' END AS arguments, 'found ' || turn AS result FROM conversations WHERE role <> 'user'")
def jn_tool_calls(s, d):
    return C.tool_calls(chat(s, d))


@query("txt_roles", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS message, role, text AS content FROM conversations WHERE text IS NOT NULL")
def txt_roles(s, d):
    line = F.concat(F.lit("["), "role", F.lit("]: "), "text")
    whole = I.table(s, d, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return D.transcript(whole, "conv_id", "text")


# citations: each turn of a conversation stands for an item that cites its own turn, one that doesn't exist, and a number

ITEMS = "items AS (SELECT conv_id AS session_id, turn AS item, turn % 3 AS way FROM conversations)"


def items(s, d):
    named = F.when(F.col("turn") % 3 == 0, F.array(F.concat_ws(":", "conv_id", F.lit("turn"), "turn"), F.lit("invented"))).otherwise(F.array(F.lit("invented")))
    numbered = F.when(F.col("turn") % 3 == 1, F.array(F.col("turn"), F.lit(0), F.lit(9999))).otherwise(F.array(F.lit(9999)))
    return I.table(s, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("item"), named.alias("source_turn_ids"), numbered.alias("source_turn_indices"))


@query("jn_provenance_whitelist", f"WITH {ITEMS}, {I.TURNS} SELECT session_id, item, turn FROM items JOIN turns ON conv_id = session_id AND CASE way WHEN 0 THEN turn = item WHEN 1 THEN turn IN (item, 0) ELSE (SELECT count(*) FROM conversations c WHERE c.conv_id = session_id) = 1 END")
def jn_provenance_whitelist(s, d):
    return C.cited_turns(items(s, d), I.turns(s, d).withColumnRenamed("conv_id", "session_id")).select("session_id", "item", "turn")


@query("jn_provenance_semantic", "WITH p AS (SELECT c.conv_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM conversations c JOIN embeddings a ON a.vec_id = c.conv_id JOIN embeddings b ON b.vec_id = c.conv_id + c.turn) SELECT conv_id, count(*) AS checked, count_if(score >= 0.45) AS accepted, count_if(score < 0.45) AS rejected FROM p GROUP BY 1")
def jn_provenance_semantic(s, d):
    vectors = I.table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    cites = I.table(s, d, "conversations").select("conv_id", (F.col("conv_id") + F.col("turn")).alias("context"))
    cites = cites.join(vectors.select(F.col("vec_id").alias("conv_id"), F.col("v").alias("item_vector")), "conv_id").join(vectors.select(F.col("vec_id").alias("context"), F.col("v").alias("context_vector")), "context")
    return C.supported(cites).groupBy("conv_id").agg(F.count("*").alias("checked"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


@query(
    "prj_temporal",
    """WITH r AS (SELECT o_orderkey, o_orderdate::TIMESTAMP AS day, o_orderkey % 4 AS k FROM orders)
    SELECT o_orderkey, day - INTERVAL 8 HOUR AS observed_at, CASE k WHEN 0 THEN 'past' WHEN 1 THEN 'unknown' WHEN 2 THEN 'recurring' END AS temporal_relation,
      CASE WHEN k <> 2 THEN day - INTERVAL 8 HOUR END AS event_start, day + INTERVAL 1 DAY - INTERVAL 1 SECOND - INTERVAL 8 HOUR AS event_end,
      CASE k WHEN 0 THEN day - INTERVAL 8 HOUR WHEN 2 THEN day - INTERVAL 8 HOUR END AS valid_from, CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 END AS confidence FROM r""",
)
def prj_temporal(s, d):
    day, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 4
    none = F.lit(None).cast("string")
    rows = I.table(s, d, "orders").select(
        "o_orderkey",
        F.concat(day, F.lit("T00:00:00")).alias("observed_at"),
        F.when(k == 0, "Past ").when(k == 1, "someday").when(k == 2, "recurring").alias("temporal_relation"),
        F.when(k != 2, day).otherwise("not a date").alias("event_start"),
        day.alias("event_end"),
        none.alias("valid_from"),
        none.alias("valid_until"),
        F.when(k == 0, "7").when(k == 1, "0.25").when(k == 2, "high").alias("confidence"),
        F.lit("Asia/Shanghai").alias("zone"),
    )
    return C.temporal(rows).select("o_orderkey", "observed_at", "temporal_relation", "event_start", "event_end", "valid_from", "confidence")


@query("prj_residence", "SELECT c_custkey AS session_id, unnest(CASE c_custkey % 3 WHEN 0 THEN ['name', 'location'] ELSE ['name'] END) AS key FROM customer")
def prj_residence(s, d):
    """A customer says that they live in a place, came from it, or live in another that starts alike."""
    place = F.concat(F.lit("St. N"), "c_nationkey")
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("I currently LIVE in "), place, F.lit("."))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("I moved away from "), place)).otherwise(F.concat(F.lit("we are based in "), place, F.lit("x")))
    rows = I.table(s, d, "customer")
    kv = rows.select(F.col("c_custkey").alias("session_id"), F.explode(F.create_map(F.lit("name"), "c_name", F.lit("location"), place)))
    return C.residence(kv, rows.select(F.col("c_custkey").alias("session_id"), F.lit("user").alias("role"), text.alias("text"))).select("session_id", "key")


# traces of requests


def steps(s, d):
    """Events as steps of a request; views and clicks are what a reader logged."""
    name = F.when(F.col("event_type") == "view", "READ_SUMMARY").when(F.col("event_type") == "click", "READ_VECTOR").otherwise(F.upper("event_type"))
    return I.table(s, d, "events").select(F.col("event_id").alias("id"), F.concat_ws("-", F.concat(F.lit("u"), "user_id"), F.date_format("ts", "yyyyMMdd")).alias("request_id"), name.alias("step"), F.regexp_replace("props", r"\}$", F.lit(', "_reader": "v2"}')).alias("parsed"), F.col("ts").alias("at"))


@query("jn_trace", f"WITH {I.OPERATIONS}, q AS (SELECT DISTINCT request_id FROM ops WHERE op = 'GRAPH_ADD'), a AS (SELECT request_id, 'op' AS kind, id, op AS what, created_at AS at_ FROM ops UNION ALL SELECT o.request_id, 'step', o.id, CASE event_type WHEN 'view' THEN 'READ_SUMMARY' WHEN 'click' THEN 'READ_VECTOR' ELSE upper(event_type) END, ts FROM ops o JOIN events ON event_id = o.id) SELECT request_id, kind, id, what, row_number() OVER (PARTITION BY request_id ORDER BY at_, id, kind) AS nth FROM a WHERE request_id IN (FROM q)")
def jn_trace(s, d):
    ops = I.operations(s, d)
    return T.full_trace(steps(s, d), ops, ops.where("op = 'GRAPH_ADD'").select("request_id")).select("request_id", "kind", "id", "what", "nth")


@query("jn_read_trace", f"WITH {I.OPERATIONS} SELECT request_id, count(*) AS n_steps, 'v2' AS reader, max(id) FILTER (event_type = 'view') AS summary_id, sum((props ->> 'k')::INT) AS k_total FROM ops JOIN events ON event_id = id WHERE event_type IN ('view', 'click') GROUP BY 1")
def jn_read_trace(s, d):
    rows = T.read_trace(steps(s, d))
    return rows.groupBy("request_id", "reader", "summary_id").agg(F.sum("n").alias("n_steps"), F.sum(F.aggregate("details", F.lit(0), lambda a, x: a + F.get_json_object(x, "$.k").cast("int"))).cast("long").alias("k_total"))

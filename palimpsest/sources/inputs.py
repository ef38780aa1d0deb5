"""Memory tables derived from the given tables, so that every query grows with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators.lineage import parts

#: Layers of memory. Fixed values.
LAYERS = ["l0_basic_info", "l1_raw", "l2_fact", "l3_summary", "l4_identity", "l5_knowledge", "l6_schema", "l7_intention"]
#: Older names of layers. Fixed values.
ALIASES = {
    "l6_identity": "l4_identity",
    "l4_knowledge": "l5_knowledge",
    "l5_schema": "l6_schema",
    "l4_5_schema": "l6_schema",
    "l5_identity": "l4_identity",
    "l6_intention": "l7_intention",
    "profile": "l4_identity",
    "dialogue": "l2_fact",
    "summary": "l3_summary",
    "knowledge": "l5_knowledge",
    "raw": "l1_raw",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def start(days: str = "2024-01-01"):
    return F.to_timestamp(F.lit(f"{days} 00:00:00"))


#: Users of the derived tables: a user has about 200 rows at any size.
USERS = "(SELECT greatest(20, count(*) // 200) FROM documents)"


def users(spark: SparkSession, sf_dir: str, name: str = "documents", least: int = 20) -> Column:
    """USERS, as a scalar subquery."""
    return table(spark, sf_dir, name).agg(F.greatest(F.lit(least), F.expr("count(*) div 200"))).scalar()


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that has a vector."""
    n = F.col("doc_id")
    layer = F.when(n % 10 == 0, "l0_basic_info").when(n % 10 == 1, "l6_schema").when(n % 10 == 2, "l7_intention").when(n % 10 == 3, "l3_summary").when(n % 10 == 4, "l4_identity").when(n % 10 == 5, "l1_raw").otherwise("l2_fact")
    created = F.timestamp_seconds(F.unix_timestamp(start()) + n * 60)
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings"), F.col("vec_id") == n)
    return rows.select(
        n.alias("num"),
        F.concat(F.lit("m"), n).alias("node_id"),
        F.concat(F.lit("u"), n % users(spark, sf_dir)).alias("user_id"),
        F.concat(F.lit("a"), n % 3).alias("agent_id"),
        F.concat(F.lit("s"), n % 7).alias("session_id"),
        layer.alias("layer"),
        F.when(n % 11 == 0, "superseded").otherwise("active").alias("status"),
        (n % 13 != 0).alias("is_latest"),
        F.col("text").alias("content"),
        F.array("source", "lang").alias("tags"),
        created.alias("gmt_created"),
        (n % 7).cast("int").alias("access_count"),
        F.when(n % 10 == 2, F.timestamp_seconds(F.unix_timestamp(created) + (n % 30) * 86400)).alias("valid_until"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


MEMORY = f"""mem AS (
  SELECT doc_id AS num, 'm' || doc_id AS node_id, 'u' || (doc_id % {USERS}) AS user_id, 'a' || (doc_id % 3) AS agent_id, 's' || (doc_id % 7) AS session_id,
         CASE doc_id % 10 WHEN 0 THEN 'l0_basic_info' WHEN 1 THEN 'l6_schema' WHEN 2 THEN 'l7_intention' WHEN 3 THEN 'l3_summary' WHEN 4 THEN 'l4_identity' WHEN 5 THEN 'l1_raw' ELSE 'l2_fact' END AS layer,
         CASE WHEN doc_id % 11 = 0 THEN 'superseded' ELSE 'active' END AS status, doc_id % 13 <> 0 AS is_latest, text AS content, [source, lang] AS tags,
         TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS gmt_created, (doc_id % 7)::INT AS access_count,
         CASE WHEN doc_id % 10 = 2 THEN TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE + (doc_id % 30) * INTERVAL 1 DAY END AS valid_until,
         embedding::DOUBLE[] AS embedding
  FROM documents JOIN embeddings ON vec_id = doc_id)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search request for each benchmark item."""
    i = F.col("item_id")
    rows = table(spark, sf_dir, "benchmark").join(table(spark, sf_dir, "embeddings"), F.col("vec_id") == i)
    return rows.select(i.alias("query_id"), F.concat(F.lit("u"), i % users(spark, sf_dir)).alias("user_id"), F.col("text").alias("query_text"), F.col("embedding").cast("array<double>").alias("query_vector"))


REQUESTS = f"""req AS (
  SELECT item_id AS query_id, 'u' || (item_id % {USERS}) AS user_id, text AS query_text, embedding::DOUBLE[] AS query_vector
  FROM benchmark JOIN embeddings ON vec_id = item_id)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.concat_ws(":", "conv_id", F.lit("turn"), "turn").alias("turn_id"))


TURNS = "turns AS (SELECT conv_id, turn, role, text, conv_id || ':turn:' || turn AS turn_id FROM conversations)"

#: What an event stands for in the operation log.
OPS = {"click": "ADD", "view": "UPDATE", "purchase": "SUPERSEDE", "error": "DELETE", "signup": "GRAPH_ADD"}


#: Rows that operations aim at: each has about 60 at any size.
TARGETS = "(SELECT greatest(1000, count(*) // 60) FROM events)"


def targets(spark: SparkSession, sf_dir: str) -> Column:
    """TARGETS, as a scalar subquery."""
    return table(spark, sf_dir, "events").agg(F.greatest(F.lit(1000), F.expr("count(*) div 60"))).scalar()


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in OPS.items()), F.lit("OTHER"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u"), "user_id").alias("user_id"),
        F.concat_ws("-", F.concat(F.lit("u"), "user_id"), F.date_format("ts", "yyyyMMdd")).alias("request_id"),
        op.alias("op"),
        F.concat(F.lit("m"), F.col("event_id") % targets(spark, sf_dir)).alias("memory_id"),
        (F.col("event_id") % 5).cast("int").alias("n_supersedes"),
        F.col("ts").alias("created_at"),
        F.col("value").alias("elapsed_ms"),
    )


OPERATIONS = f"""ops AS (
  SELECT event_id AS id, 'u' || user_id AS user_id, 'u' || user_id || '-' || strftime(ts, '%Y%m%d') AS request_id,
         CASE event_type WHEN 'click' THEN 'ADD' WHEN 'view' THEN 'UPDATE' WHEN 'purchase' THEN 'SUPERSEDE' WHEN 'error' THEN 'DELETE' WHEN 'signup' THEN 'GRAPH_ADD' ELSE 'OTHER' END AS op,
         'm' || (event_id % {TARGETS}) AS memory_id, (event_id % 5)::INT AS n_supersedes, ts AS created_at, value AS elapsed_ms FROM events)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions: each supersedes the customer's order before."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("at"), F.lag("o_orderkey").over(by).alias("supersedes"), F.lead("o_orderkey").over(by).alias("superseded_by"), F.lead("o_orderdate").over(by).alias("valid_until"))


VERSIONS = """ver AS (
  SELECT o_orderkey AS node, o_custkey AS owner, o_orderdate AS at_, lag(o_orderkey) OVER w AS supersedes, lead(o_orderkey) OVER w AS superseded_by, lead(o_orderdate) OVER w AS valid_until
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which facts (parts) a schema (supplier) rests on."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("schema_id"), F.col("l_partkey").alias("fact_id"))
    return rows.repartition(parts(rows), "fact_id").distinct()


EVIDENCE = "ev AS (SELECT DISTINCT l_suppkey AS schema_id, l_partkey AS fact_id FROM lineitem)"

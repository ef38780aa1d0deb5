"""Evidence, topics and relations between memory rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.lineage import written


def evidence_counts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("schema_id").agg(F.countDistinct("fact_id").alias("n_evidence"))


def reverse_evidence(facts: DataFrame, evidence: DataFrame, active: DataFrame) -> DataFrame:
    """For facts (query_id, fact_id): the active schemas (schema_id) that rest on them, by how many, relative to the best."""
    evidence = evidence.join(active.select("schema_id"), "schema_id", "left_semi")
    support = facts.join(evidence, "fact_id").groupBy("query_id", "schema_id").agg(F.countDistinct("fact_id").alias("support"))
    return support.withColumn("score", F.col("support") / F.max("support").over(Window.partitionBy("query_id")))


def neighbours(anchors: DataFrame, edges: DataFrame, active: DataFrame) -> DataFrame:
    """Other ends of the anchors' edges (src, dst, kind), either way, that are active (node); anchors themselves are left out."""
    out = anchors.join(edges.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node"), "kind")
    back = anchors.join(edges.withColumnRenamed("dst", "node"), "node").select(F.col("src").alias("node"), "kind")
    return out.union(back).groupBy("node").agg(F.min("kind").alias("kind")).join(anchors, "node", "left_anti").join(active.select("node"), "node", "left_semi")


def first_of(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The `most` rows of smallest `order` for each value of `by`; partial limits keep a value of many rows from gathering."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("nth") <= most).drop("nth")


def expand(anchors: DataFrame, edges: DataFrame, topics: DataFrame, hops: int = 2, cap: int = 50) -> DataFrame:
    """(query_id, node, hop): what each request reaches within `hops` from its anchors (query_id, node, hop 0), and the first hop that does.

    edges(src, dst) count either way, and two nodes of one topic, in
    topics(node, topic), are a hop apart. A hop adds the `cap` smallest nodes
    that are new to a request, and the next one starts from these. Topics stay
    rows between nodes: a hop goes to the topics of its front, once each, and
    from there to their members. A node's or topic's members beyond those that
    could be among the `cap` new ones, whatever the request has seen, are never
    joined, so a hub costs a request no more than that.
    """
    seen = written(anchors.select("query_id", "node", F.lit(0).alias("hop")).distinct(), "reached")
    largest = seen.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    most = largest + cap * hops
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src is not null and dst is not null").distinct()
    both = written(first_of(both, "src", "dst", most), "near")
    tagged = written(topics.select("node", "topic").where("node is not null and topic is not null").distinct(), "topics")
    members = written(first_of(tagged, "topic", "node", most), "members")
    for hop in range(1, hops + 1):
        front = seen.where(F.col("hop") == hop - 1).select("query_id", "node")
        direct = front.join(both.hint("merge"), F.col("node") == F.col("src")).select("query_id", F.col("dst").alias("node"))
        shared = front.join(tagged.hint("merge"), "node").select("query_id", "topic").distinct().join(members.hint("merge"), "topic").select("query_id", "node")
        new = direct.union(shared).distinct().join(seen.select("query_id", "node").hint("merge"), ["query_id", "node"], "left_anti")
        seen = written(seen.unionByName(first_of(new, "query_id", "node", cap).withColumn("hop", F.lit(hop))), "reached")
    return seen


def add_edges(edges: DataFrame, candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with the candidates whose ends both exist; edges that are there already stay single."""
    known = nodes.select("node").distinct()
    good = candidates.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return edges.select("src", "dst").unionByName(good.select("src", "dst")).distinct()


#: Layers between which relations may be made. Fixed values.
RELATED = ["l6_schema", "l7_intention"]


def judged_edges(candidates: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, reason): candidates once each, with the reason why they can't be new relations, or null.

    nodes(node, owner, layer) and edges(src, dst), stored both ways. In this
    order: both ends are one node, an end is missing, the owners differ, a layer
    is none of RELATED, or the edge is there already, in either direction. Of
    two candidates that are each other's reverse the one with the smaller src
    counts, and the other is there already.
    """
    a = nodes.select(F.col("node").alias("src"), F.col("owner").alias("src_owner"), F.col("layer").alias("src_layer"))
    b = nodes.select(F.col("node").alias("dst"), F.col("owner").alias("dst_owner"), F.col("layer").alias("dst_layer"))
    once = candidates.select("src", "dst").distinct()
    there = edges.select("src", "dst").union(edges.select("dst", "src")).distinct().withColumn("there", F.lit(True))
    twin = once.where("src < dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("twin"))
    rows = once.join(a.hint("merge"), "src", "left").join(b.hint("merge"), "dst", "left").join(there.hint("merge"), ["src", "dst"], "left").join(twin.hint("merge"), ["src", "dst"], "left")
    reason = F.when(F.col("src") == F.col("dst"), "self").when(F.col("src_owner").isNull() | F.col("dst_owner").isNull(), "missing").when(F.col("src_owner") != F.col("dst_owner"), "isolation")
    reason = reason.when(~F.coalesce(F.col("src_layer").isin(RELATED) & F.col("dst_layer").isin(RELATED), F.lit(False)), "layer").when(F.col("there") | F.col("twin"), "exists")
    return rows.select("src", "dst", reason.alias("reason"))


def related(candidates: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges(src, dst) with the candidates that judged_edges lets pass, both ways. Doing it again changes nothing."""
    good = judged_edges(candidates, nodes, edges).where("reason is null")
    return edges.select("src", "dst").unionByName(good.select("src", "dst")).union(good.select("dst", "src"))

"""Queries over clusters, schemas, cores and entities.

The vectors of the given tables are near to random, so thresholds here are
lower than the operators' own.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import expressions as X
from palimpsest.operators import clusters as K
from palimpsest.operators import entities as E
from palimpsest.operators import retrieval as R
from palimpsest.operators import similarity as Y
from palimpsest.plans.registry import query
from palimpsest.sources import inputs as I

#: A user has about 200 vectors at any size.
OWNERS = "(SELECT greatest(20, count(*) // 200) FROM embeddings)"
POINTS = f"pt AS (SELECT vec_id AS num, vec_id % {OWNERS} AS user_id, label, embedding::DOUBLE[] AS embedding FROM embeddings)"
PAIRS = "pr AS (SELECT a.num AS a, b.num AS b, round(list_cosine_similarity(a.embedding, b.embedding), 9) AS score FROM pt a JOIN pt b ON a.user_id = b.user_id AND a.num < b.num)"


def points(s, d):
    return I.table(s, d, "embeddings").select(F.col("vec_id").alias("num"), (F.col("vec_id") % I.users(s, d, "embeddings")).alias("user_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))


@query(
    "clu_dense",
    f"""WITH RECURSIVE {POINTS}, {PAIRS}, nb AS MATERIALIZED (SELECT a, b FROM pr WHERE score >= 0.2 UNION ALL SELECT b, a FROM pr WHERE score >= 0.2),
    core AS MATERIALIZED (SELECT a AS num FROM nb GROUP BY 1 HAVING count(*) + 1 >= 4), cc AS MATERIALIZED (SELECT a, b FROM nb WHERE a IN (FROM core) AND b IN (FROM core)),
    r(n, m) AS (SELECT num, num FROM core UNION SELECT r.n, cc.b FROM r JOIN cc ON cc.a = r.m), named AS (SELECT n AS num, min(m) AS cluster FROM r GROUP BY 1)
    SELECT num, cluster FROM named UNION ALL SELECT a, min(cluster) FROM nb JOIN named ON num = b WHERE a NOT IN (FROM core) GROUP BY 1""",
)
def clu_dense(s, d):
    rows = points(s, d)
    pairs = Y.similar_pairs(rows, 0.2 - 1e-8).where(F.round("score", 9) >= 0.2)
    return K.dense(rows, pairs.select("a", "b"), 4)


@query("clu_dbscan")
def clu_dbscan(s, d):
    return K.clusters(points(s, d), 0.2, 0.27, 8, 3, 0.33)


@query("ddp_greedy")
def ddp_greedy(s, d):
    rows = points(s, d)
    return K.first_kept(rows, Y.similar_pairs(rows, 0.25, inclusive=True))


@query("ddp_batch", f"WITH RECURSIVE {POINTS}, p AS (SELECT a.num AS x, b.num AS y FROM pt a JOIN pt b ON a.user_id = b.user_id AND a.label = b.label AND a.num < b.num WHERE list_cosine_similarity(a.embedding, b.embedding) > 0.2), u AS (SELECT x, y FROM p UNION SELECT y, x FROM p), r(n, m) AS (SELECT x, x FROM u UNION SELECT r.n, u.y FROM r JOIN u ON u.x = r.m) SELECT n AS num, min(m) AS kept FROM r GROUP BY 1")
def ddp_batch(s, d):
    """A user's facts with one label came in one batch; the first of each group of like ones stays."""
    return Y.similar_groups(points(s, d), 0.2, by=("user_id", "label")).withColumnRenamed("group", "kept")


#: Facts (labels below 8), and the dense regions among them.
FACTS = f"""{POINTS}, fa AS (SELECT * FROM pt WHERE label < 8), fb AS MATERIALIZED (SELECT a.num AS a, b.num AS b FROM fa a JOIN fa b ON a.user_id = b.user_id AND a.num <> b.num WHERE round(list_cosine_similarity(a.embedding, b.embedding), 9) >= 0.22),
core AS MATERIALIZED (SELECT a AS num FROM fb GROUP BY 1 HAVING count(*) + 1 >= 4), cl AS (SELECT num FROM core UNION SELECT a FROM fb WHERE b IN (FROM core))"""


def clustered(s, d):
    """Facts, and those of them that lie in a cluster."""
    facts = points(s, d).where("label < 8")
    pairs = Y.similar_pairs(facts, 0.22 - 1e-8).where(F.round("score", 9) >= 0.22)
    return facts, K.dense(facts, pairs.select("a", "b"), 4)


@query("clu_skip", f"WITH {FACTS} SELECT user_id, CASE WHEN count_if(label < 8) = 0 THEN 'no_facts' WHEN count(cl.num) = 0 THEN 'no_clusters' END AS reason FROM pt LEFT JOIN cl USING (num) GROUP BY 1")
def clu_skip(s, d):
    facts, found = clustered(s, d)
    return K.skipped(points(s, d).select("user_id").distinct(), facts, found)


@query("set_unclustered", f"WITH {FACTS}, r AS (SELECT num, user_id, row_number() OVER (PARTITION BY user_id ORDER BY num) AS nth FROM fa WHERE num NOT IN (FROM cl)) SELECT num, user_id, nth FROM r WHERE nth <= 15")
def set_unclustered(s, d):
    return K.unclustered(*clustered(s, d), 15)


@query(
    "clu_schema_recall",
    f"""WITH {POINTS}, {I.EVIDENCE}, c AS (SELECT user_id, label, list(v ORDER BY n) AS centroid FROM (SELECT user_id, label, n, avg(v) AS v FROM pt, unnest(embedding) WITH ORDINALITY t(v, n) WHERE label < 8 GROUP BY ALL) GROUP BY ALL),
    h AS (SELECT c.user_id, c.label, num, round(list_cosine_similarity(centroid, embedding), 6) AS score FROM c JOIN pt USING (user_id) WHERE pt.label >= 8), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY score DESC, num) AS nth FROM h WHERE score >= 0.1),
    n AS (SELECT schema_id AS num, count(DISTINCT fact_id) AS n_evidence FROM ev GROUP BY 1) SELECT DISTINCT num, coalesce(n_evidence, 0) AS n_evidence FROM r LEFT JOIN n USING (num) WHERE nth <= 8""",
)
def clu_schema_recall(s, d):
    """The schemas (labels 8 and 9) nearest to the mean of each of the user's groups, and how much they rest on."""
    from palimpsest.operators.graph import evidence_counts

    rows = points(s, d)
    means = K.centroids(rows.where("label < 8"), ["user_id", "label"])
    hits = means.join(rows.where("label >= 8").select("user_id", "num", "embedding").hint("shuffle_hash"), "user_id").select("user_id", "label", "num", F.round(X.cosine(F.col("centroid"), F.col("embedding")), 6).alias("score")).where("score >= 0.1")
    nth = F.row_number().over(Window.partitionBy("user_id", "label").orderBy(F.col("score").desc(), "num"))
    best = hits.withColumn("nth", nth).where("nth <= 8").select("num").distinct()
    return best.join(evidence_counts(I.evidence(s, d)).withColumnRenamed("schema_id", "num").hint("merge"), "num", "left").select("num", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


# schemas with two vectors: the vector of an id, and that of the id half the table away

DOMAINS = OWNERS.replace("(20,", "(10,")
SCHEMAS = f"""sc AS (SELECT a.vec_id AS node, a.vec_id % {DOMAINS} AS user_id, a.embedding::DOUBLE[] AS con, b.embedding::DOUBLE[] AS beh FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + (SELECT count(*) // 2 FROM embeddings)),
abs AS (SELECT node AS src, node + 10 AS dst FROM sc WHERE node % 7 = 0 UNION ALL SELECT node, 1000000 + node % 3 FROM sc WHERE node % 5 = 0)"""
CLUSTERED = f"""{SCHEMAS}, p AS (SELECT a.node AS x, b.node AS y FROM sc a JOIN sc b ON a.user_id = b.user_id AND a.node < b.node WHERE list_cosine_similarity(a.beh, b.beh) > 0.25 AND list_cosine_similarity(a.con, b.con) < 0.1 AND a.user_id IN (SELECT user_id FROM sc GROUP BY 1 HAVING count(*) >= 5)),
f AS (SELECT x, y FROM p WHERE NOT EXISTS (FROM abs WHERE (src = x AND dst = y) OR (src = y AND dst = x)) AND NOT EXISTS (FROM abs m JOIN abs n USING (dst) WHERE m.src = x AND n.src = y)),
u AS (SELECT x, y FROM f UNION SELECT y, x FROM f), r(n, m) AS (SELECT x, x FROM u UNION SELECT r.n, u.y FROM r JOIN u ON u.x = r.m), cl AS (SELECT n AS node, min(m) AS cluster FROM r GROUP BY 1)"""


def schemas(s, d):
    e = I.table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    half = e.agg(F.floor(F.count("*") / 2).alias("half"))
    later = e.join(F.broadcast(half)).select((F.col("vec_id") - F.col("half")).alias("node"), F.col("e").alias("behaviour"))
    return e.select(F.col("vec_id").alias("node"), (F.col("vec_id") % I.users(s, d, "embeddings", 10)).alias("user_id"), F.col("e").alias("content")).join(later, "node")


def abstracted(s, d):
    rows = schemas(s, d).select("node")
    return rows.where("node % 7 = 0").select(F.col("node").alias("src"), (F.col("node") + 10).alias("dst")).union(rows.where("node % 5 = 0").select("node", F.lit(1000000) + F.col("node") % 3))


def colliding(s, d):
    return K.collisions(schemas(s, d), abstracted(s, d), 0.25, 0.1)


@query("grf_collisions", f"WITH RECURSIVE {CLUSTERED} SELECT node, cluster FROM cl")
def grf_collisions(s, d):
    return colliding(s, d)


@query("grf_core_merge", f"WITH RECURSIVE {CLUSTERED}, t AS (SELECT src AS node, dst AS core FROM abs WHERE dst >= 1000000), c AS (SELECT cluster, min(core) AS core FROM cl JOIN t USING (node) GROUP BY 1) SELECT node, core FROM cl JOIN c USING (cluster) EXCEPT SELECT node, core FROM t")
def grf_core_merge(s, d):
    targets = abstracted(s, d).where("dst >= 1000000").select(F.col("src").alias("node"), F.col("dst").alias("core"))
    return K.core_links(colliding(s, d), targets)


@query("grf_inherit", f"WITH RECURSIVE {CLUSTERED}, {I.EVIDENCE} SELECT DISTINCT cluster, fact_id FROM cl JOIN ev ON schema_id = node")
def grf_inherit(s, d):
    return K.inherited_evidence(colliding(s, d), I.evidence(s, d))


@query("jn_cores", "WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem), a AS (SELECT s_suppkey AS node FROM supplier), h1 AS (SELECT node, dst AS core FROM a JOIN e ON src = node), h2 AS (SELECT DISTINCT node, dst AS core FROM h1 JOIN e ON src = core) SELECT node, core, min(hop) AS hop FROM (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY 1, 2")
def jn_cores(s, d):
    edges = I.table(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return K.cores(I.table(s, d, "supplier").select(F.col("s_suppkey").alias("node")), edges)


BEH = f"""WITH {SCHEMAS}, {I.REQUESTS}, h AS (SELECT query_id, node, round(list_cosine_similarity(query_vector, beh), 6) AS score FROM req JOIN sc ON sc.user_id = query_id % {DOMAINS}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS rank FROM h)"""


@query("top_beh", f"{BEH} SELECT query_id, node, round(1 - score, 6) AS distance, rank FROM r WHERE rank <= 5")
def top_beh(s, d):
    rows = schemas(s, d).select("user_id", F.col("node").alias("node_id"), F.col("behaviour").alias("embedding"))
    asked = I.requests(s, d).withColumn("user_id", F.col("query_id") % I.users(s, d, "embeddings", 10))
    hits = R.vector_hits(asked, rows, -1.0).withColumn("score", F.round("score", 6))
    return R.top(hits, 5).select("query_id", F.col("node_id").alias("node"), F.round(1 - F.col("score"), 6).alias("distance"), "rank")


@query("jn_graph_topk", f"WITH {I.MEMORY}, {I.REQUESTS}, h AS (SELECT query_id, node_id, round(list_cosine_similarity(query_vector, embedding), 6) AS score FROM req r JOIN mem m ON starts_with(m.user_id || '::' || m.agent_id, r.user_id || '::') WHERE layer = 'l6_schema' AND status = 'active'), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM h WHERE score >= 0.05) SELECT query_id, node_id, score, rank FROM t WHERE rank <= 5")
def jn_graph_topk(s, d):
    rows = R.scoped(I.memory(s, d), latest=None, layers=["l6_schema"])
    hits = R.vector_hits(I.requests(s, d), rows, -1.0).withColumn("score", F.round("score", 6)).where("score >= 0.05")
    return R.top(hits, 5).select("query_id", "node_id", "score", "rank")


# entities: names in texts, and vectors of which like ones are one entity

INDEX = f"""{POINTS}, p AS (SELECT a.num AS x, b.num AS y FROM pt a JOIN pt b ON a.user_id = b.user_id AND a.num < b.num WHERE list_cosine_similarity(a.embedding, b.embedding) >= 0.28), u AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
r(n, m) AS (SELECT num, num FROM pt UNION SELECT r.n, u.y FROM r JOIN u ON u.x = r.m), ix AS (SELECT user_id, min(m) AS entity_id, 'm' || n AS node_id FROM r JOIN pt ON num = n GROUP BY user_id, n)"""


def index(s, d):
    return E.entity_index(points(s, d).withColumn("node_id", F.concat(F.lit("m"), "num")), 0.28)


@query("ent_extract")
def ent_extract(s, d):
    return E.entities(I.memory(s, d))


@query("ent_index", f"WITH RECURSIVE {INDEX} SELECT user_id, entity_id, node_id FROM ix")
def ent_index(s, d):
    return index(s, d)


@query("ent_unlink", f"WITH RECURSIVE {INDEX} SELECT user_id, entity_id, count(*) AS n_links FROM ix WHERE substr(node_id, 2)::BIGINT % 3 <> 0 GROUP BY 1, 2")
def ent_unlink(s, d):
    gone = points(s, d).where("num % 3 = 0").select(F.concat(F.lit("m"), "num").alias("node_id"))
    return E.unlinked(index(s, d), gone).groupBy("user_id", "entity_id").agg(F.count("*").alias("n_links"))


HITS = f"""{INDEX}, {I.REQUESTS}, eh AS (SELECT query_id, pt.user_id, num AS entity_id, round(list_cosine_similarity(query_vector, embedding), 6) AS similarity FROM req JOIN pt ON pt.user_id = query_id % {OWNERS} WHERE num IN (SELECT entity_id FROM ix)),
et AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entity_id) AS nth FROM eh WHERE similarity >= 0.15) WHERE nth <= 500)"""


def hits(s, d, known):
    vectors = points(s, d).withColumnRenamed("num", "entity_id").join(known.select("entity_id").distinct().hint("merge"), "entity_id", "left_semi")
    return E.entity_hits(I.requests(s, d).withColumn("user_id", F.col("query_id") % I.users(s, d, "embeddings")), vectors, 0.15)


@query("top_entities", f"WITH RECURSIVE {HITS} SELECT query_id, entity_id, similarity FROM et")
def top_entities(s, d):
    return hits(s, d, index(s, d)).select("query_id", "entity_id", "similarity")


BOOST = f"{HITS}, bs AS (SELECT query_id, node_id, max(similarity * 0.5 / (1 + 0.001 * (n - 1) * (n - 1))) AS boost FROM et JOIN (SELECT *, count(*) OVER (PARTITION BY user_id, entity_id) AS n FROM ix) USING (user_id, entity_id) GROUP BY 1, 2)"


def boosts(s, d):
    known = index(s, d)
    return E.entity_boosts(hits(s, d, known), known)


@query("rk_entity_boost", f"WITH RECURSIVE {BOOST} SELECT query_id, node_id, round(boost, 8) AS boost FROM bs")
def rk_entity_boost(s, d):
    return boosts(s, d).select("query_id", "node_id", F.round("boost", 8).alias("boost"))


TAGS = "tg AS (SELECT DISTINCT user_id, t.tag FROM mem, unnest(tags) t(tag) WHERE t.tag IS NOT NULL)"


#: A tag's vector is that of the first row of its user that bears it. Every third tag is in the index already, with no vector of its own.
INDEXED = "tx AS (SELECT user_id, t.tag, arg_min(embedding, num) AS embedding FROM mem, unnest(tags) t(tag) WHERE t.tag IS NOT NULL GROUP BY 1, 2), ti AS (SELECT user_id, tag, CASE WHEN length(tag) % 3 > 0 THEN embedding END AS embedding FROM tx)"


def tags_known(s, d):
    """The index before: every third length of a tag, without vectors."""
    rows = I.memory(s, d).select("user_id", F.explode("tags").alias("tag")).where("tag is not null and length(tag) % 3 = 0").distinct()
    return rows.withColumn("embedding", F.lit(None).cast("array<double>"))


def indexed(s, d):
    rows = I.memory(s, d).select("user_id", "num", "embedding", F.explode("tags").alias("tag")).where("tag is not null")
    return E.tag_index(tags_known(s, d), rows)


@query("tag_index", f"WITH {I.MEMORY}, {INDEXED} SELECT user_id, tag, len(embedding) AS dims, round(embedding[1], 8) AS first FROM ti")
def tag_index(s, d):
    return indexed(s, d).select("user_id", "tag", F.size("embedding").alias("dims"), F.round(F.get("embedding", F.lit(0)), 8).alias("first")).withColumn("dims", F.when(F.col("dims") >= 0, F.col("dims")))

"""Queries of further searches: additive, weighted, by tags, and their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import expressions as X
from palimpsest.operators import entities as E
from palimpsest.operators import fusion as U
from palimpsest.operators import retrieval as R
from palimpsest.operators import versions as V
from palimpsest.plans import catalog as A
from palimpsest.plans import knowledge as N
from palimpsest.plans.registry import query
from palimpsest.sources import inputs as I

NTH = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)"
POOL = f"""pl AS (SELECT * FROM (SELECT *, {NTH} AS rank FROM vec) WHERE rank <= 20), pt_ AS (SELECT query_id, node_id, regexp_extract_all(lower(content), '{A.TERMS}') AS terms FROM pl JOIN mem USING (node_id)),
ps AS (SELECT query_id, count(*) AS n, avg(len(terms)) AS mean FROM pt_ GROUP BY 1), pp AS (SELECT query_id, node_id, len(terms) AS dl, t.term, count(*) AS tf FROM pt_, unnest(terms) t(term) GROUP BY ALL),
pq AS (SELECT query_id, t.term FROM req, unnest(list_distinct(regexp_extract_all(lower(query_text), '{A.TERMS}'))) t(term)), pm AS (SELECT *, count(*) OVER (PARTITION BY query_id, term) AS df FROM pp JOIN pq USING (query_id, term)),
pb AS (SELECT query_id, node_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS bm25 FROM pm JOIN ps USING (query_id) GROUP BY 1, 2)"""


def pool(s, d):
    return R.top(A.vector(s, d), 20).join(I.memory(s, d).select("node_id", "content"), "node_id")


@query("txt_bm25_pool", f"WITH {A.VEC}, {POOL} SELECT query_id, node_id, round(bm25, 6) AS bm25 FROM pb")
def txt_bm25_pool(s, d):
    return U.pool_bm25(I.requests(s, d), pool(s, d)).withColumn("bm25", F.round("bm25", 6))


@query("rk_reconcile_cands", f"WITH {A.VEC}, {POOL}, x AS (SELECT query_id, node_id, round(0.6 * score + 0.4 * coalesce(bm25 / max(bm25) OVER (PARTITION BY query_id), 0), 6) AS score FROM pl LEFT JOIN pb USING (query_id, node_id)), r AS (SELECT *, {NTH} AS rank FROM x WHERE score >= 0.15) SELECT query_id, node_id, score, rank FROM r WHERE rank <= 5")
def rk_reconcile_cands(s, d):
    return U.mixed_pool(R.top(A.vector(s, d), 20), U.pool_bm25(I.requests(s, d), pool(s, d)), 0.15, 5).select("query_id", "node_id", "score", "rank")


CHAINS = f"""{A.VEC}, nu AS (SELECT {I.USERS} AS n), ch AS (SELECT num, user_id, gmt_created AS created, CASE WHEN num // n % 4 IN (1, 2) THEN num - n END AS supersedes FROM mem, nu),
up(num, root) AS (SELECT num, num FROM ch WHERE supersedes IS NULL UNION ALL SELECT ch.num, up.root FROM ch JOIN up ON ch.supersedes = up.num),
hd AS (SELECT root, max(num) AS head FROM up JOIN ch USING (num) WHERE num NOT IN (SELECT supersedes FROM ch WHERE supersedes IS NOT NULL) GROUP BY 1)"""


@query("ver_cand_chains", f"WITH RECURSIVE {CHAINS}, x AS (SELECT query_id, head, max(score) AS score FROM vec JOIN mem USING (node_id) JOIN up USING (num) JOIN hd USING (root) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, head) AS rank FROM x) SELECT query_id, head, score, rank FROM r WHERE rank <= 8")
def ver_cand_chains(s, d):
    """Candidates as heads of their version chains, each with the best score of its chain: twice the four that are wanted."""
    rows = A.chained(s, d).select(F.col("num").alias("node"), F.col("created").alias("at"), "supersedes")
    hits = A.vector(s, d).join(I.memory(s, d).select("node_id", F.col("num").alias("node")).hint("merge"), "node_id").select("query_id", "node", "score")
    return V.candidate_heads(hits, rows, V.chains(rows), 8)


BOOSTED = f"{A.HYBRID}, {N.BOOST.replace(I.REQUESTS + ', ', '')}"
ADDED = f"{BOOSTED}, ad AS (SELECT v.query_id, v.node_id, round(least((v.score + coalesce({A.SIG}, 0) + coalesce(boost, 0)) / (1 + (v.query_id IN (SELECT query_id FROM bm))::INT + 0.5 * (v.query_id IN (SELECT query_id FROM bs))::INT), 1), 6) AS score FROM vec v LEFT JOIN bm USING (query_id, node_id) LEFT JOIN bs USING (query_id, node_id) WHERE v.score >= 0.18)"


def added(s, d):
    return U.additive(A.vector(s, d), A.words(s, d), N.boosts(s, d), 0.18).withColumn("score", F.round("score", 6))


@query("rk_additive", f"WITH RECURSIVE {ADDED} SELECT query_id, node_id, score FROM ad")
def rk_additive(s, d):
    return added(s, d)


@query("search_additive", f"WITH RECURSIVE {ADDED}, t AS (SELECT *, {NTH} AS rank FROM ad) SELECT query_id, node_id, score, rank FROM t WHERE rank <= 10")
def search_additive(s, d):
    return R.top(added(s, d), 10).select("query_id", "node_id", "score", "rank")


WEIGHTED = f"""{A.HYBRID}, sp AS (SELECT query_id, node_id, round({A.SIG}, 6) AS score FROM bm), da AS (SELECT * FROM (SELECT *, {NTH} AS n FROM vec) WHERE n <= 30), sa AS (SELECT * FROM (SELECT *, {NTH} AS n FROM sp) WHERE n <= 30),
wt AS (SELECT query_id, node_id, round(CASE WHEN max(sa.score IS NOT NULL) OVER (PARTITION BY query_id) THEN 0.7 * coalesce(da.score, 0) + 0.3 * coalesce(sa.score, 0) ELSE da.score END, 8) AS score FROM da FULL JOIN sa USING (query_id, node_id))"""


def sparse(s, d):
    return A.words(s, d).select("query_id", "node_id", F.round(X.sigmoid_bm25(F.col("bm25"), F.col("n_terms")), 6).alias("score"))


def weighted(s, d):
    return U.weighted(A.vector(s, d), sparse(s, d), 10).withColumn("score", F.round("score", 8))


@query("rk_dense_sparse", f"WITH {WEIGHTED} SELECT query_id, node_id, score FROM wt")
def rk_dense_sparse(s, d):
    return weighted(s, d)


FIRST = f"{WEIGHTED}, pf AS (SELECT query_id, node_id, score FROM vec WHERE layer IN ('l0_basic_info', 'l4_identity', 'l6_schema')), un AS (SELECT query_id, node_id, 0 AS place, {NTH} AS rank, score FROM pf UNION ALL SELECT query_id, node_id, 1, {NTH}, score FROM wt), fi AS (SELECT query_id, node_id, min((place, rank)) AS first, arg_max(score, place) AS score FROM un GROUP BY 1, 2)"


def profile(s, d):
    return A.vector(s, d).where(F.col("layer").isin("l0_basic_info", "l4_identity", "l6_schema"))


@query("set_profile_first", f"WITH {FIRST} SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY first, node_id) AS position FROM fi")
def set_profile_first(s, d):
    return U.profile_first(profile(s, d), weighted(s, d))


@query("search_weighted", f"WITH {FIRST}, x AS (SELECT query_id, node_id, round(f.score * {A.STRENGTH}, 6) AS score FROM fi f JOIN mem USING (node_id)), t AS (SELECT *, {NTH} AS rank FROM x) SELECT query_id, node_id, score, rank FROM t WHERE rank <= 10")
def search_weighted(s, d):
    """Dense and sparse scores weighted, profile rows with their weighted scores, all weakened by forgetting."""
    rows = U.profile_first(profile(s, d), weighted(s, d)).join(I.memory(s, d).select("node_id", "layer", "gmt_created", "access_count"), "node_id")
    scored = rows.select("query_id", "node_id", F.round(F.col("score") * X.strength(F.col("access_count"), A.idle(), F.col("layer")), 6).alias("score"))
    return R.top(scored, 10).select("query_id", "node_id", "score", "rank")


TAGV = "tv AS (SELECT m.user_id, t.tag, arg_min(embedding, num) AS embedding FROM mem m, unnest(tags) t(tag) WHERE t.tag IS NOT NULL GROUP BY 1, 2), tm AS (SELECT query_id, user_id, tag FROM (SELECT query_id, user_id, tag, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(query_vector, embedding), 6) DESC, tag) AS n FROM req JOIN tv USING (user_id) WHERE round(list_cosine_similarity(query_vector, embedding), 6) >= 0.1) WHERE n <= 5)"


def tags(s, d):
    """The tags nearest to a request; a tag's vector is that of the first row of its user that bears it."""
    rows = I.memory(s, d).select("user_id", "num", "embedding", F.explode("tags").alias("node_id")).where("node_id is not null")
    vectors = rows.groupBy("user_id", "node_id").agg(F.min_by("embedding", "num").alias("embedding"))
    hits = R.vector_hits(I.requests(s, d), vectors.hint("merge"), -1.0).withColumn("score", F.round("score", 6)).where("score >= 0.1")
    return R.top(hits, 5).select("query_id", F.col("node_id").alias("tag"))


# a keyword's vector is one of the table, by a hash of the keyword
ASKED_WORDS = f"""kw AS (SELECT DISTINCT query_id, user_id, w FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n) AS nth FROM (SELECT query_id, user_id, t.w, min(t.n) AS n FROM req, unnest(regexp_extract_all(lower(query_text), '{A.TERMS}')) WITH ORDINALITY t(w, n) WHERE CASE WHEN regexp_matches(t.w, '^[a-z0-9]') THEN length(t.w) >= 3 AND t.w NOT IN ({A.STOP}) ELSE length(t.w) >= 2 END GROUP BY 1, 2, 3)) WHERE nth <= 10),
kv AS (SELECT query_id, user_id, w, embedding::DOUBLE[] AS v FROM kw JOIN embeddings ON vec_id = ('0x' || substr(md5(w), 1, 7))::BIGINT % (SELECT count(*) FROM embeddings))"""


@query("top_tags", f"WITH {I.MEMORY}, {I.REQUESTS}, {N.INDEXED}, {ASKED_WORDS} SELECT DISTINCT query_id, tag FROM (SELECT query_id, tag, row_number() OVER (PARTITION BY query_id, w ORDER BY score DESC, tag) AS n FROM (SELECT query_id, w, tag, round(list_cosine_similarity(v, ti.embedding), 6) AS score FROM kv JOIN ti USING (user_id)) WHERE score >= 0.1) WHERE n <= 5")
def top_tags(s, d):
    """Five tags for each of a request's keywords."""
    vectors = I.table(s, d, "embeddings")
    words = I.requests(s, d).select("query_id", "user_id", F.explode(X.keywords(F.col("query_text"))).alias("keyword"))
    at = F.conv(F.substring(F.md5("keyword"), 1, 7), 16, 10).cast("long") % vectors.agg(F.count("*")).scalar()
    words = words.withColumn("at", at).join(vectors.select(F.col("vec_id").alias("at"), F.col("embedding").cast("array<double>").alias("embedding")).hint("merge"), "at")
    return E.matched_tags(words, N.indexed(s, d), 0.1)


WEIGHTS = "CASE channel WHEN 'vec' THEN " + " ".join(["CASE i"] + [f"WHEN '{k}' THEN {w['vec']}" for k, w in U.INTENT_WEIGHTS.items()] + ["END"]) + " WHEN 'tag' THEN " + " ".join(["CASE i"] + [f"WHEN '{k}' THEN {w['tag']}" for k, w in U.INTENT_WEIGHTS.items()] + ["END"]) + " ELSE " + " ".join(["CASE i"] + [f"WHEN '{k}' THEN {w['bm25']}" for k, w in U.INTENT_WEIGHTS.items()] + ["END"]) + " END"
INTENT = "CASE WHEN regexp_matches(query_text, '" + "|".join(X.NAVIGATIONAL).replace("'", "''") + "') THEN 'NAVIGATIONAL' WHEN " + " OR ".join(f"contains(lower(query_text), '{w}')" for w in X.CONCEPTUAL) + " THEN 'CONCEPTUAL' ELSE 'FACTUAL' END"
THREE = f"""{A.VEC}, {POOL}, {TAGV}, it AS (SELECT query_id, {INTENT} AS i FROM req), th AS (SELECT DISTINCT query_id, node_id, round(list_cosine_similarity(query_vector, embedding), 6) AS score FROM tm JOIN req USING (query_id) JOIN mem m ON m.user_id = req.user_id AND list_contains(m.tags, tm.tag) WHERE {A.ACTIVE}),
ch AS (SELECT query_id, node_id, 'vec' AS channel, score FROM vec UNION ALL SELECT query_id, node_id, 'tag', score FROM th UNION ALL SELECT query_id, node_id, 'bm25', round(bm25, 6) FROM pb),
cr AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, node_id) AS rank FROM ch), f3 AS (SELECT query_id, node_id, round(sum({WEIGHTS} / (60 + rank)), 6) AS score FROM cr JOIN it USING (query_id) GROUP BY 1, 2)"""


def three(s, d):
    asked, rows = I.requests(s, d), A.live(s, d)
    tagged = rows.select("user_id", "node_id", "embedding", F.explode("tags").alias("tag"))
    wanted = asked.select("query_id", "user_id", "query_vector").join(tags(s, d).hint("shuffle_hash"), "query_id")
    by_tag = wanted.join(tagged.hint("shuffle_hash"), ["user_id", "tag"]).select("query_id", "node_id", F.round(X.cosine(F.col("query_vector"), F.col("embedding")), 6).alias("score")).distinct()
    hits = A.vector(s, d).select("query_id", "node_id", F.lit("vec").alias("channel"), "score")
    hits = hits.unionByName(by_tag.withColumn("channel", F.lit("tag")))
    hits = hits.unionByName(U.pool_bm25(asked, pool(s, d)).select("query_id", "node_id", F.lit("bm25").alias("channel"), F.round("bm25", 6).alias("score")))
    return U.intent_rrf(hits, U.intent_weight(asked)).withColumn("score", F.round("score", 6))


@query("rk_three_channel", f"WITH {THREE} SELECT query_id, node_id, score FROM f3")
def rk_three_channel(s, d):
    return three(s, d)


@query("search_tag", f"WITH {THREE}, pf AS (SELECT query_id, node_id, score FROM vec WHERE layer IN ('l0_basic_info', 'l4_identity', 'l6_schema')), un AS (SELECT query_id, node_id, 0 AS place, {NTH} AS rank, score FROM pf UNION ALL SELECT query_id, node_id, 1, {NTH}, score FROM f3), fi AS (SELECT query_id, node_id, min((place, rank)) AS first, arg_max(score, place) AS score FROM un GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, node_id) AS position FROM fi) SELECT query_id, node_id, score, position FROM t WHERE position <= 10")
def search_tag(s, d):
    """Vectors, tags and words fused by the request's intent, profile rows first."""
    return U.profile_first(profile(s, d), three(s, d)).where("position <= 10")


@query("rk_profile_two_way", f"WITH {A.VEC}, {I.EVIDENCE}, fw AS (SELECT query_id, num AS schema_id, score FROM vec JOIN mem USING (node_id)), rv AS (SELECT query_id, e.schema_id, count(DISTINCT fact_id) AS support FROM fw JOIN ev e ON fact_id = fw.schema_id WHERE e.schema_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) GROUP BY 1, 2), ch AS (SELECT query_id, schema_id::VARCHAR AS node_id, 'f' AS channel, score FROM fw UNION ALL SELECT query_id, schema_id::VARCHAR, 'r', round(support / max(support) OVER (PARTITION BY query_id), 6) FROM rv), rr AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, node_id) AS rank FROM ch) SELECT query_id, node_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM rr GROUP BY 1, 2")
def rk_profile_two_way(s, d):
    from palimpsest.operators.graph import reverse_evidence

    forward = A.vector(s, d).join(I.memory(s, d).select("node_id", "num"), "node_id")
    active = I.table(s, d, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("schema_id"))
    reverse = reverse_evidence(forward.select("query_id", F.col("num").alias("fact_id")), I.evidence(s, d), active)
    node = lambda c: F.col(c).cast("string").alias("node_id")
    return U.two_way(forward.select("query_id", node("num"), "score"), reverse.select("query_id", node("schema_id"), F.round("score", 6).alias("score"))).select("query_id", "node_id", F.round("score", 6).alias("score"))


@query("rk_core_append", f"WITH {A.VEC}, br AS (SELECT DISTINCT query_id, m2.node_id FROM vec JOIN mem m1 USING (node_id) JOIN mem m2 ON m2.user_id = m1.user_id AND list_has_any(m2.tags, m1.tags)), w AS (SELECT query_id, node_id, score, 0 AS way FROM vec UNION ALL SELECT query_id, 'm' || l_suppkey, 0.95, 1 FROM vec JOIN mem USING (node_id) JOIN lineitem ON l_partkey = num UNION ALL SELECT query_id, node_id, 0.7, 2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY node_id) AS n FROM br) WHERE n <= 60) SELECT query_id, node_id, min(way) AS way, arg_min(score, way) AS score FROM w GROUP BY 1, 2")
def rk_core_append(s, d):
    """Cores of the hits, and up to 60 rows that share a tag with one."""
    rows = I.memory(s, d).select("node_id", "num", "user_id", "tags")
    hits = A.vector(s, d).join(rows.hint("merge"), "node_id")
    cores = hits.join(I.table(s, d, "lineitem").select(F.col("l_partkey").alias("num"), F.concat(F.lit("m"), "l_suppkey").alias("core")).distinct().hint("merge"), "num").select("query_id", F.col("core").alias("node_id")).distinct()
    return U.with_graph(hits, cores, U.tag_bridge(hits, rows, 60))


@query("rk_bm25_fallback", f"WITH {A.HYBRID} SELECT query_id, node_id, score FROM vec WHERE query_id % 3 <> 0 UNION ALL SELECT query_id, node_id, round({A.SIG}, 6) FROM bm WHERE query_id % 3 = 0")
def rk_bm25_fallback(s, d):
    """Every third request has no vector here."""
    asked = I.requests(s, d).withColumn("query_vector", F.when(F.col("query_id") % 3 != 0, F.col("query_vector")))
    return U.words_where_no_vector(asked, A.vector(s, d), sparse(s, d))


@query("rk_weights", f"WITH {A.VEC} SELECT query_id, node_id, round(0.625 * score + 0.375 * 0.5, 9) AS score FROM vec")
def rk_weights(s, d):
    """Weights 0.5 and 0.3 of a score's two parts, renormalised."""
    w = U.renormalised({"semantic": 0.5, "recency": 0.2}, {"recency": 0.3, "semantic": 0})
    return A.vector(s, d).select("query_id", "node_id", F.round(w["semantic"] * F.col("score") + w["recency"] * 0.5, 9).alias("score"))


@query("set_evidence_union", "SELECT o_orderkey, array_to_string(list_distinct_ordered, ',') AS evidence FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ['a', 'b', 'D' || (o_custkey % 2)] WHEN o_custkey % 2 = 0 THEN ['D0', 'a'] ELSE ['D1', 'D0', 'a'] END AS list_distinct_ordered FROM orders)")
def set_evidence_union(s, d):
    own = F.concat(F.lit("D"), F.col("o_custkey") % 2)
    first = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("a"))).otherwise(F.array(own, F.lit("D0")))
    second = F.when(F.col("o_orderkey") % 3 == 0, F.array(own, F.lit("b"))).otherwise(F.array(F.lit("a"), own))
    return I.table(s, d, "orders").select("o_orderkey", F.array_join(U.merged_evidence(first, second), ",").alias("evidence"))

"""More ways to join the hits of several channels into one ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.expressions import intent, sigmoid_bm25, tokens
from palimpsest.operators.retrieval import ranked, rrf, top

#: What a channel counts by the intent of a request. Fixed values.
INTENT_WEIGHTS = {
    "NAVIGATIONAL": {"vec": 0.3, "tag": 0.8, "bm25": 1.5},
    "FACTUAL": {"vec": 1.0, "tag": 1.2, "bm25": 0.8},
    "CONCEPTUAL": {"vec": 1.0, "tag": 1.3, "bm25": 0.5},
}
#: Scores of rows that a graph adds. Fixed values.
CORE_SCORE, BRIDGE_SCORE = 0.95, 0.70


def pool_bm25(requests: DataFrame, pool: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, node_id, bm25) inside each request's pool(query_id, node_id, content); rows without a shared term are left out."""
    rows = pool.select("query_id", "node_id", tokens(F.col("content")).alias("terms"))
    sizes = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("mean_length"))
    counts = rows.select("query_id", "node_id", F.size("terms").alias("length"), F.explode("terms").alias("term")).groupBy("query_id", "node_id", "length", "term").agg(F.count("*").alias("tf"))
    asked = requests.select("query_id", F.explode(F.array_distinct(tokens(F.col("query_text")))).alias("term"))
    met = counts.join(asked.hint("shuffle_hash"), ["query_id", "term"])
    df = F.count("*").over(Window.partitionBy("query_id", "term"))
    met = met.withColumn("df", df).join(sizes.hint("shuffle_hash"), "query_id")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    return met.groupBy("query_id", "node_id").agg(F.sum(weight).alias("bm25"))


def additive(vector: DataFrame, words: DataFrame, boosts: DataFrame, threshold: float) -> DataFrame:
    """(query_id, node_id, score): vector score, word score and entity boost added, over the most that the request's channels can give.

    Only rows whose vector score reaches the threshold count. The most is 1 for
    the vector, 1 more if the request has any word hit, 0.5 more if it has any boost.
    """
    w = words.select("query_id", "node_id", sigmoid_bm25(F.col("bm25"), F.col("n_terms")).alias("w"))
    rows = vector.where(F.col("score") >= threshold).join(w, ["query_id", "node_id"], "left").join(boosts.select("query_id", "node_id", "boost"), ["query_id", "node_id"], "left")
    has_words = w.select("query_id", F.lit(1.0).alias("has_words")).distinct()
    has_boost = boosts.select("query_id", F.lit(0.5).alias("has_boost")).distinct()
    rows = rows.join(has_words.hint("shuffle_hash"), "query_id", "left").join(has_boost.hint("shuffle_hash"), "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    total = F.col("score") + zero("w") + zero("boost")
    return rows.select("query_id", "node_id", F.least(total / (1 + zero("has_words") + zero("has_boost")), F.lit(1.0)).alias("score"))


def weighted(dense: DataFrame, sparse: DataFrame, k: int, w_dense: float = 0.7, w_sparse: float = 0.3) -> DataFrame:
    """(query_id, node_id, score): both channels' best max(3k, 30) rows, weighted; where a request has no sparse hit, the dense score alone."""
    most = max(3 * k, 30)
    a = top(dense, most).select("query_id", "node_id", F.col("score").alias("d"))
    b = top(sparse, most).select("query_id", "node_id", F.col("score").alias("s"))
    rows = a.join(b, ["query_id", "node_id"], "full")
    any_sparse = F.max(F.col("s").isNotNull().cast("int")).over(Window.partitionBy("query_id")) == 1
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select("query_id", "node_id", F.when(any_sparse, w_dense * zero("d") + w_sparse * zero("s")).otherwise(F.col("d")).alias("score"))


def profile_first(profile: DataFrame, other: DataFrame) -> DataFrame:
    """(query_id, node_id, score, position): profile hits before all others; one found as both is a profile hit, with the other's score."""
    p = ranked(profile).select("query_id", "node_id", F.lit(0).alias("place"), "rank", "score")
    o = ranked(other).select("query_id", "node_id", F.lit(1).alias("place"), "rank", "score")
    rows = p.unionByName(o).groupBy("query_id", "node_id").agg(F.min(F.struct("place", "rank")).alias("first"), F.max_by("score", "place").alias("score"))
    order = Window.partitionBy("query_id").orderBy("first", "node_id")
    return rows.select("query_id", "node_id", "score", F.row_number().over(order).alias("position"))


def intent_weight(requests: DataFrame) -> DataFrame:
    """(query_id, channel, weight) by each request's intent."""
    kinds = F.create_map(*(x for k, w in INTENT_WEIGHTS.items() for x in (F.lit(k), F.create_map(*(y for c, v in w.items() for y in (F.lit(c), F.lit(v)))))))
    return requests.select("query_id", F.explode(kinds[intent(F.col("query_text"))]).alias("channel", "weight"))


def intent_rrf(hits: DataFrame, weights: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal ranks over (query_id, channel, node_id, score), weighted by request and channel."""
    rows = ranked(hits, by=["query_id", "channel"]).join(weights.hint("shuffle_hash"), ["query_id", "channel"])
    return rows.groupBy("query_id", "node_id").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"))


def two_way(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """Schemas found by their vectors and those found by their evidence, by reciprocal ranks."""
    both = forward.select("query_id", "node_id", F.lit("forward").alias("channel"), "score").unionByName(reverse.select("query_id", "node_id", F.lit("reverse").alias("channel"), "score"))
    return rrf(both, {"forward": 1.0, "reverse": 1.0})


def with_graph(hits: DataFrame, found_cores: DataFrame, bridged: DataFrame) -> DataFrame:
    """Hits (query_id, node_id, score), then cores and rows met over topics at fixed scores, where they are not hits yet."""
    rows = hits.select("query_id", "node_id", "score", F.lit(0).alias("way"))
    rows = rows.unionByName(found_cores.select("query_id", "node_id", F.lit(CORE_SCORE).alias("score"), F.lit(1).alias("way")))
    rows = rows.unionByName(bridged.select("query_id", "node_id", F.lit(BRIDGE_SCORE).alias("score"), F.lit(2).alias("way")))
    return rows.groupBy("query_id", "node_id").agg(F.min("way").alias("way"), F.min_by("score", "way").alias("score"))


def tag_bridge(hits: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """(query_id, node_id): the first `most` rows by id that share a tag with one of a request's hits (query_id, user_id, tags); rows has node_id, user_id, tags.

    A request goes to each of its tags once, and a tag gives no more than its
    first `most` rows, as no others can be among those of the request.
    """
    tag = F.explode("tags").alias("tag")
    wanted = hits.select("query_id", "user_id", tag).where("tag is not null").distinct()
    bearers = rows.select("node_id", "user_id", tag).where("tag is not null").distinct()
    nth = F.row_number().over(Window.partitionBy("user_id", "tag").orderBy("node_id"))
    bearers = bearers.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")
    met = wanted.join(bearers.hint("merge"), ["user_id", "tag"]).select("query_id", "node_id").distinct()
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("node_id"))
    return met.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def words_where_no_vector(requests: DataFrame, vector: DataFrame, words: DataFrame) -> DataFrame:
    """Vector hits of requests that have a vector, word hits (score) of the others."""
    without = requests.where(F.col("query_vector").isNull() | (F.size("query_vector") == 0)).select("query_id")
    return vector.join(without, "query_id", "left_anti").select("query_id", "node_id", "score").unionByName(words.join(without, "query_id", "left_semi").select("query_id", "node_id", "score"))


def mixed_pool(pool: DataFrame, words: DataFrame, least: float, most: int) -> DataFrame:
    """Candidates of a new fact: 0.6 of the vector's score and 0.4 of the word score within the pool, relative to its best; at `least`, the first `most`."""
    best = F.max("bm25").over(Window.partitionBy("query_id"))
    share = words.withColumn("w", F.when(best > 0, F.col("bm25") / best).otherwise(F.lit(0.0))).select("query_id", "node_id", "w")
    rows = pool.join(share, ["query_id", "node_id"], "left").select("query_id", "node_id", F.round(0.6 * F.col("score") + 0.4 * F.coalesce("w", F.lit(0.0)), 6).alias("score"))
    return top(rows.where(F.col("score") >= least), most)


def renormalised(weights: dict[str, float], new: dict[str, float | None]) -> dict[str, float]:
    """Weights with new ones where given (0 or None keeps the old), summing to 1."""
    merged = {k: new.get(k) or v for k, v in weights.items()}
    return {k: v / sum(merged.values()) for k, v in merged.items()}


def merged_evidence(a: Column, b: Column) -> Column:
    """Both lists in order, each element once; nulls are empty lists."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty)))

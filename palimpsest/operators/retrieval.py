"""Hybrid retrieval for all requests at once: vectors, words, fusion, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.expressions import cosine, evidence_boost, keywords, sigmoid_bm25, tokens
from palimpsest.operators.lineage import written


def scoped(memory: DataFrame, status: str | None = "active", latest: bool | None = True, layers: list[str] | None = None) -> DataFrame:
    """Rows that a search may see: a status, the latest versions, some layers (None: any)."""
    out = memory
    if status:
        out = out.where(F.col("status") == status)
    if latest is not None:
        out = out.where(F.col("is_latest") == latest)
    return out.where(F.col("layer").isin(layers)) if layers else out


def last_minutes(minutes: DataFrame, n: int) -> DataFrame:
    """(stage, minutes, completed, failed, total, mean) over the last n minutes up to the newest, from sums of minutes (minute, stage, completed, failed, total)."""
    since = minutes.agg(F.max("minute") - F.expr(f"interval {n} minute")).scalar()
    sums = minutes.where(F.col("minute") > since).groupBy("stage").agg(F.count("*").alias("minutes"), F.sum("completed").alias("completed"), F.sum("failed").alias("failed"), F.sum("total").alias("total"))
    done = F.col("completed") + F.col("failed")
    return sums.select("stage", "minutes", "completed", "failed", F.round("total", 4).alias("total"), F.round(F.col("total") / F.when(done > 0, done), 4).alias("mean"))


def round_robin(rows: DataFrame, by: str, within: str, order: str, most: int) -> DataFrame:
    """`most` rows of each value of `by`, with their place `nth`: the first in `order` of each of its values of `within`, then the second ones, and so on.

    No more than `most` rows of a stratum can be among them. Both limits stand
    right on the windows, so every task keeps `most` rows of a stratum before
    anything is shuffled, and none gets a stratum's share of the rows.
    """
    first = rows.withColumn("round", F.row_number().over(Window.partitionBy(by, within).orderBy(order))).where(F.col("round") <= most)
    return first.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy("round", order))).where(F.col("nth") <= most).drop("round")


def tiered(memory: DataFrame, scopes: DataFrame) -> DataFrame:
    """(query_id, and the columns of memory): the rows that each scope may see.

    scopes(query_id, keys array, key, users array, agents array, layers array,
    statuses array, latest, created_after). A scope with keys sees the rows of
    these isolation_keys; one without, but with a key, those of that key; one
    with neither those of its users and agents, where no users or no agents
    means any, but one that names nobody sees nothing. Beyond that empty layers
    mean any, empty statuses `active` alone, a null latest the latest rows, and
    rows count that were created after created_after, if it is given. Each tier
    is an equi-join of its own. memory has isolation_key, user_id, agent_id,
    layer, status, is_latest, gmt_created.
    """
    some = lambda c: F.size(F.coalesce(c, F.array())) > 0
    rest = ["query_id", "layers", "statuses", "latest", "created_after"]
    first = scopes.where(some("keys")).select(*rest, F.explode(F.array_distinct("keys")).alias("isolation_key"))
    second = scopes.where(~some("keys") & F.col("key").isNotNull()).select(*rest, F.col("key").alias("isolation_key"))
    third = scopes.where(~some("keys") & F.col("key").isNull())
    by_user = third.where(some("users")).select(*rest, "agents", F.explode(F.array_distinct("users")).alias("user_id"))
    by_agent = third.where(~some("users") & some("agents")).select(*rest, F.explode(F.array_distinct("agents")).alias("agent_id"))
    columns = [*rest, *memory.columns]
    out = memory.join(first.unionByName(second).hint("merge"), "isolation_key").select(columns)
    out = out.unionByName(memory.join(by_user.hint("merge"), "user_id").where(~some("agents") | F.array_contains("agents", F.col("agent_id"))).select(columns))
    out = out.unionByName(memory.join(by_agent.hint("merge"), "agent_id").select(columns))
    statuses = F.when(some("statuses"), F.col("statuses")).otherwise(F.array(F.lit("active")))
    out = out.where((~some("layers") | F.array_contains("layers", F.col("layer"))) & F.array_contains(statuses, F.col("status")))
    out = out.where((F.col("is_latest") == F.coalesce("latest", F.lit(True))) & (F.col("created_after").isNull() | (F.col("gmt_created") > F.col("created_after"))))
    return out.select("query_id", *memory.columns)


def visibility(scope: Column, user: Column, workspace: Column, branch: Column) -> Column:
    """What a context must have for a row of the scope: a struct to be joined by equality; null where nobody sees the row."""
    at = lambda kind, *parts: F.struct(F.lit(kind).alias("kind"), *((p if p is not None else F.lit("")).alias(n) for p, n in zip([*parts, None, None][:3], ("a", "b", "c"))))
    known = F.when(scope.isin("user", "global"), at("user", user)).when((scope == "project") & workspace.isNotNull(), at("project", user, workspace)).when((scope == "strict") & workspace.isNotNull() & branch.isNotNull(), at("strict", user, workspace, branch))
    return F.when(user.isNotNull(), known)


def visible(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """(query_id, and the columns of rows): the code memories that each context may see.

    rows(user_id, scope, workspace, branch, ...); contexts(query_id, user_id,
    workspace, branch). A user sees their own rows of scope user and global
    always, project ones in the same workspace, strict ones in the same
    workspace and branch, and no others. The three rules are one equi-join: a
    context has up to three keys, a row has one.
    """
    c = F.col
    keyed = rows.withColumn("seen_by", visibility(c("scope"), c("user_id"), c("workspace"), c("branch"))).where("seen_by is not null")
    keys = F.array(*(visibility(F.lit(scope), c("user_id"), c("workspace"), c("branch")) for scope in ("user", "project", "strict")))
    asked = contexts.select("query_id", F.explode(keys).alias("sees")).where("sees is not null")
    return keyed.join(asked.hint("merge"), c("seen_by") == c("sees")).select("query_id", *rows.columns)


def code_hits(contexts: DataFrame, keys: DataFrame, least: float, most: int, over: int = 4) -> DataFrame:
    """(query_id, node_id, score, rank): the `most` code memories with the best key for each request, of those that it may see.

    keys(node_id, user_id, scope, workspace, branch, embedding) has a row for
    each key of a memory; contexts also have query_vector. The boundary comes
    first; then `over` times as many keys are fetched, since several may be of
    one memory, each memory counts with its best one, those below `least` go,
    and the rest is cut.
    """
    met = visible(keys, contexts).join(contexts.select("query_id", "query_vector").hint("merge"), "query_id")
    scored = met.select("query_id", "node_id", F.round(cosine(F.col("query_vector"), F.col("embedding")), 6).alias("score"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node_id"))
    fetched = scored.withColumn("nth", nth).where(F.col("nth") <= most * over)
    best = fetched.groupBy("query_id", "node_id").agg(F.max("score").alias("score")).where(F.col("score") >= least)
    return top(best, most).select("query_id", "node_id", "score", "rank")


def request_scopes(requests: DataFrame) -> DataFrame:
    """(query_id, isolation_key, error) for requests(query_id, user_id, agents array, rooms array).

    A key for each agent and session that a request names; one that names none
    has its user's alone. Several agents together with several sessions are
    rejected, with an error and no key.
    """
    wrong = (F.size("agents") > 1) & (F.size("rooms") > 1)
    some = lambda c: F.explode_outer(F.when(F.size(c) > 0, F.col(c)))
    rows = requests.where(~wrong).select("query_id", "user_id", some("agents").alias("agent"), "rooms").select("query_id", "user_id", "agent", some("rooms").alias("room"))
    keys = rows.select("query_id", F.concat_ws("::", "user_id", "agent", "room").alias("isolation_key"), F.lit(None).cast("string").alias("error"))
    return keys.unionByName(requests.where(wrong).select("query_id", F.lit(None).cast("string").alias("isolation_key"), F.lit("several agents and several sessions").alias("error")))


def vector_hits(requests: DataFrame, memory: DataFrame, threshold: float) -> DataFrame:
    """(query_id, node_id, score): a request meets its own user's rows only, joined by user."""
    pairs = requests.select("query_id", "user_id", "query_vector").join(memory.select("user_id", "node_id", "embedding"), "user_id")
    return pairs.select("query_id", "node_id", cosine(F.col("query_vector"), F.col("embedding")).alias("score")).where(F.col("score") >= threshold)


def ranked(hits: DataFrame, score: str = "score", by: list[str] | None = None) -> DataFrame:
    order = Window.partitionBy(*(by or ["query_id"])).orderBy(F.col(score).desc(), "node_id")
    return hits.withColumn("rank", F.row_number().over(order))


def top(hits: DataFrame, k: int, score: str = "score") -> DataFrame:
    return ranked(hits, score).where(F.col("rank") <= k)


#: Users whose asked terms go to all tasks; those of more are joined.
ASKERS = 10_000


def postings(memory: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: (user_id, node_id, length, term, tf), an inverted index of the terms in wanted(user_id, term), and (user_id, n, mean_length), the sizes of these users.

    A row's terms are cut to those that its user asks for before they are
    counted, so what a task holds grows with the terms it finds, not with the
    texts it reads. length and sizes are those of whole texts.
    """
    by_user = written(wanted.groupBy("user_id").agg(F.collect_set("term").alias("wanted")), "wanted")
    by_user = F.broadcast(by_user) if by_user.count() <= ASKERS else by_user.hint("merge")
    rows = memory.select("user_id", "node_id", "content").join(by_user, "user_id").select("user_id", "node_id", tokens(F.col("content")).alias("terms"), "wanted")
    rows = rows.select("user_id", "node_id", F.size("terms").alias("length"), F.filter("terms", lambda x: F.array_contains(F.col("wanted"), x)).alias("terms"))
    rows = written(rows, "asked_rows")
    counts = rows.select("user_id", "node_id", "length", F.explode("terms").alias("term")).groupBy("user_id", "node_id", "length", "term").agg(F.count("*").alias("tf"))
    # a row without terms is in no posting, but counts
    return written(counts, "postings"), written(rows.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("length").alias("mean_length")), "sizes")


def bm25_hits(requests: DataFrame, memory: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, node_id, n_terms, bm25) for rows of the request's user that share a term; statistics are the user's."""
    asked = requests.select("query_id", "user_id", F.array_distinct(tokens(F.col("query_text"))).alias("terms"))
    asked = asked.select("query_id", "user_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    index, sizes = postings(memory, asked.select("user_id", "term"))
    df = index.groupBy("user_id", "term").agg(F.count("*").alias("df"))
    rows = asked.join(df.hint("merge"), ["user_id", "term"]).join(index.hint("merge"), ["user_id", "term"]).join(sizes, "user_id")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    return rows.groupBy("query_id", "node_id", "n_terms").agg(F.sum(weight).alias("bm25"))


def max_norm(hits: DataFrame, score: str, out: str) -> DataFrame:
    most = F.max(score).over(Window.partitionBy("query_id"))
    return hits.withColumn(out, F.when(most > 0, F.col(score) / most).otherwise(F.lit(0.0)))


def fuse_hybrid(vector: DataFrame, words: DataFrame, words_alone: bool = True) -> DataFrame:
    """0.6 of the vector's score and 0.4 of the words', where any row of the request has the latter; else the vector's alone.

    A row that only words found has a vector score of 0. Without `words_alone`
    such rows are left out, and don't tell either that a request has words.
    """
    w = words.select("query_id", "node_id", sigmoid_bm25(F.col("bm25"), F.col("n_terms")).alias("words"))
    both = vector.select("query_id", "node_id", "score").join(w, ["query_id", "node_id"], "full" if words_alone else "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    any_words = F.max(zero("words")).over(Window.partitionBy("query_id")) > 0
    fused = F.when(any_words, 0.6 * zero("score") + 0.4 * zero("words")).otherwise(F.col("score"))
    rows = both.withColumn("fused", fused).where(F.col("score").isNotNull() | (F.col("fused") > 0))
    return rows.select("query_id", "node_id", F.col("fused").alias("score"))


def rrf(hits: DataFrame, weights: dict[str, float], k: int = 60) -> DataFrame:
    """Weighted reciprocal ranks over (query_id, channel, node_id, score), with each channel's rank. Channels of weight 0 don't count."""
    weight = F.coalesce(*(F.when(F.col("channel") == c, F.lit(float(w))) for c, w in weights.items()), F.lit(0.0))
    rows = ranked(hits, by=["query_id", "channel"]).withColumn("weight", weight).where("weight > 0")
    return rows.groupBy("query_id", "node_id").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "rank")))).alias("ranks"))


def confidence(fused: DataFrame) -> DataFrame:
    """Mean of the three best fused scores over 0.05, 1 at most; low below 0.15."""
    best = top(fused, 3).groupBy("query_id").agg(F.least(F.avg("score") / 0.05, F.lit(1.0)).alias("confidence"))
    return best.withColumn("low", F.col("confidence") < 0.15)


def boosted(hits: DataFrame, counts: DataFrame) -> DataFrame:
    """Order by score and evidence; the score itself stays."""
    rows = hits.join(counts, "node_id", "left").withColumn("boost", evidence_boost(F.coalesce("n_evidence", F.lit(0))))
    return ranked(rows.withColumn("ordering", F.col("score") * (1 + F.col("boost"))), "ordering")


def with_fallback(hits: DataFrame, threshold: float, lower: float) -> DataFrame:
    """Hits at the threshold; requests without any get those at the lower one, flagged."""
    found = F.max((F.col("score") >= threshold).cast("int")).over(Window.partitionBy("query_id")) == 1
    rows = hits.where(F.col("score") >= lower).withColumn("fallback", ~found)
    return rows.where(F.col("fallback") | (F.col("score") >= threshold))


def merge_first(hits: DataFrame, order: list[str]) -> DataFrame:
    """A row that several channels found counts for the first of them."""
    place = F.coalesce(*(F.when(F.col("channel") == c, i) for i, c in enumerate(order)), F.lit(len(order)))
    rows = hits.withColumn("place", place)
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "node_id").orderBy("place", "rank"))).where("nth = 1")
    return first.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "rank", "node_id"))).drop("nth", "place")


def bucket_caps(hits: DataFrame, caps: dict[str, int]) -> DataFrame:
    cap = F.coalesce(*(F.when(F.col("bucket") == b, n) for b, n in caps.items()), F.lit(0))
    return ranked(hits, by=["query_id", "bucket"]).where(F.col("rank") <= cap)


def quota(hits: DataFrame, total: int, shares: dict[str, float]) -> DataFrame:
    """Each named class gets its share of the places (one at least); what is left goes by score."""
    own = F.row_number().over(Window.partitionBy("query_id", "layer").orderBy(F.col("score").desc(), "node_id"))
    places = F.coalesce(*(F.when(F.col("layer") == c, max(1, int(total * s))) for c, s in shares.items()), F.lit(0))
    rows = hits.withColumn("held", (own <= places).cast("int"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("held").desc(), F.col("score").desc(), "node_id"))).where(F.col("rank") <= total)


def recall_at(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, found, n_gold, recall) of gold (query_id, node_id) among the first k hits."""
    near = hits.where(F.col("rank") <= k).select("query_id", "node_id", F.lit(1).alias("hit"))
    rows = gold.join(near, ["query_id", "node_id"], "left")
    return rows.groupBy("query_id").agg(F.count("hit").alias("found"), F.count("*").alias("n_gold"), (F.count("hit") / F.count("*")).alias("recall"))


def keyword_tags(requests: DataFrame) -> DataFrame:
    return requests.select("query_id", F.explode(keywords(F.col("query_text"))).alias("tag"))


def merge_decision(pairs: DataFrame) -> DataFrame:
    """For the best match of each new row: duplicate from 0.95 on, merge from 0.85 on (whose text says more), else keep."""
    best = pairs.groupBy("new_id").agg(F.max(F.struct("score", "old_id", "old_text", "new_text")).alias("b")).select("new_id", "b.*")
    kept = F.when(F.length("new_text") > 1.2 * F.length("old_text"), "new").when(F.col("old_text").contains(F.col("new_text")), "old").otherwise("new")
    return best.select("new_id", "old_id", "score", F.when(F.col("score") >= 0.95, "duplicate").when(F.col("score") >= 0.85, "merge").otherwise("keep").alias("decision"), F.when((F.col("score") < 0.95) & (F.col("score") >= 0.85), kept).alias("text_of"))


def condition(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))

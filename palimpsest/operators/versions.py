"""Versioned rows: applying operations, chains, audits, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.components import components
from palimpsest.operators.lineage import written


def upsert(base: DataFrame, delta: DataFrame, key: str, needs: str | None = None) -> DataFrame:
    """Rows of delta replace those of base with their key. Of several in delta the last by `seq` counts; those whose array `needs` is null or empty are skipped."""
    delta = delta if needs is None else delta.where(F.size(F.coalesce(needs, F.array())) > 0)
    last = delta.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.col("seq").desc()))).where("nth = 1").drop("nth", "seq")
    return base.join(last.select(key).hint("merge"), key, "left_anti").unionByName(last.select(base.columns))


def without(rows: DataFrame, deletions: DataFrame) -> DataFrame:
    """rows(node_id, isolation_key, user_id, agent_id, session_id, ...) that no deletion (the same five) names.

    A deletion with a node_id deletes that row, one with an isolation_key the
    rows of that key (both, if it has both), and one with a user_id the user's
    rows, only those of its agent_id and of its session_id if it names them. One
    that names nothing, or an agent or session without a user, deletes nothing.
    """
    gone = written(deletions.select("node_id", "isolation_key", "user_id", "agent_id", "session_id").distinct(), "deletions")
    given = lambda c: F.col(c).isNotNull()
    out = rows
    for c in ("node_id", "isolation_key"):
        out = out.join(gone.where(given(c)).select(c).distinct().hint("merge"), c, "left_anti")
    scopes = ("user_id",), ("user_id", "agent_id"), ("user_id", "session_id"), ("user_id", "agent_id", "session_id")
    for columns in scopes:
        named = given("user_id")
        for c in ("agent_id", "session_id"):
            named &= given(c) if c in columns else ~given(c)
        out = out.join(gone.where(named).select(*columns).distinct().hint("merge"), list(columns), "left_anti")
    return out.select(rows.columns)


def patch(base: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of base take the update's value where it has one."""
    new = updates.select(key, *(F.col(c).alias(f"new_{c}") for c in columns))
    out = base.join(new, key, "left")
    return out.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in columns else c for c in base.columns))


def chains(versions: DataFrame) -> DataFrame:
    """(node, chain): what `supersedes` links join, named by the smallest node."""
    links = versions.where("supersedes is not null").select(F.col("node").alias("a"), F.col("supersedes").alias("b"))
    found = components(links)
    return versions.select("node").join(found.withColumnRenamed("id", "node").hint("merge"), "node", "left").select("node", F.coalesce("component_id", "node").alias("chain"))


def collapsed(hits: DataFrame, versions: DataFrame, chain: DataFrame) -> DataFrame:
    """Hits (query_id, node, score, rank) on one chain become its head, with the best score and all hit versions, newest first.

    `position` orders the chains of a query by their first hit. The head is what
    no version of the chain says to supersede; of several the last by time.
    """
    rows = written(hits.join(chain.hint("merge"), "node").join(versions.select("node", "at").hint("merge"), "node"), "chain-hits")
    replaced = versions.where("supersedes is not null").select(F.col("supersedes").alias("node")).distinct()
    heads = chain.join(rows.select("chain").distinct().hint("merge"), "chain", "left_semi").join(replaced.hint("merge"), "node", "left_anti").join(versions.select("node", "at").hint("merge"), "node")
    heads = heads.groupBy("chain").agg(F.max(F.struct("at", "node"))["node"].alias("head"))
    grouped = rows.groupBy("query_id", "chain").agg(F.max("score").alias("score"), F.min("rank").alias("first"), F.reverse(F.array_sort(F.collect_list(F.struct("at", "node")))).alias("members"))
    order = Window.partitionBy("query_id").orderBy("first")
    return grouped.join(heads.hint("merge"), "chain").select("query_id", "head", "score", F.row_number().over(order).alias("position"), F.transform("members", lambda m: m["node"]).alias("members"))


def candidate_heads(hits: DataFrame, versions: DataFrame, chain: DataFrame, most: int) -> DataFrame:
    """(query_id, head, score, rank): the `most` best chains of a request's hits (query_id, node, score), each as its head with the best score of its versions.

    versions(node, at, supersedes), chain(node, chain). The head is what no
    version says to supersede; of several the last by time. Ties by head.
    """
    replaced = versions.where("supersedes is not null").select(F.col("supersedes").alias("node")).distinct()
    heads = versions.join(replaced.hint("merge"), "node", "left_anti").join(chain.hint("merge"), "node").groupBy("chain").agg(F.max(F.struct("at", "node"))["node"].alias("head"))
    best = hits.join(chain.hint("merge"), "node").groupBy("query_id", "chain").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "head"))
    return best.join(heads.hint("merge"), "chain").select("query_id", "head", "score", rank.alias("rank")).where(F.col("rank") <= most)


def chain_audit(versions: DataFrame, chain: DataFrame) -> DataFrame:
    """One row of counts: links, missing back links, links to nothing, closed rows without successor, and chains (node, chain) with two heads or more."""
    old = versions.select(F.col("node").alias("old"), F.col("superseded_by").alias("back"))
    rows = versions.join(old.hint("merge"), F.col("supersedes") == F.col("old"), "left")
    linked = F.col("supersedes").isNotNull()
    counts = rows.agg(
        F.count_if(linked).alias("links"),
        F.count_if(linked & F.col("old").isNotNull() & (F.coalesce(F.col("back"), F.lit(-1)) != F.col("node"))).alias("no_back_link"),
        F.count_if(linked & F.col("old").isNull()).alias("dangling"),
        F.count_if(F.col("valid_until").isNotNull() & F.col("superseded_by").isNull()).alias("closed_without_successor"),
    )
    # a head is what no other version says to supersede
    replaced = versions.where(linked).select(F.col("supersedes").alias("node")).distinct()
    heads = versions.select("node").join(replaced.hint("merge"), "node", "left_anti").join(chain.hint("merge"), "node").groupBy("chain").count()
    return counts.withColumn("two_heads", heads.where(F.col("count") > 1).agg(F.count("*")).scalar())


MEMORY_COLUMNS = ["node_id", "content", "evidence", "valid_from", "valid_until", "is_latest", "supersedes", "superseded_by"]


def judged_operations(memory: DataFrame, operations: DataFrame) -> DataFrame:
    """The operations with `root`, the first version of the chain that they belong to, and `reason`, null where they hold.

    An operation holds if its target is there and open when its turn comes: it is
    stored, or an operation before it that holds has made it, and none has
    superseded it in between. What depends on the target's own making is
    followed up by doubling, so a chain of n operations takes log n joins.
    """
    aimed = F.coalesce(F.col("op").isin("UPDATE", "SUPERSEDE") & F.col("target_id").isNotNull() & F.col("seq").isNotNull(), F.lit(False))
    # ADDs, however many, need no target, so they take no part in what follows
    rest = operations.where(~aimed)
    wrong = F.when(~F.coalesce(F.col("op").isin("ADD", "UPDATE", "SUPERSEDE"), F.lit(False)), "unknown operation").when((F.col("op") != "ADD") | F.col("seq").isNull(), "target is missing")
    rest = rest.select(*operations.columns, wrong.alias("reason"), F.lit(None).cast("long").alias("up"), F.when(F.col("op") == "ADD", F.col("new_id")).alias("root"))
    stored = memory.select(F.col("node_id").alias("stored"), F.col("superseded_by").isNotNull().alias("shut"))
    makers = operations.where("op in ('ADD', 'SUPERSEDE')").groupBy(F.col("new_id").alias("made")).agg(F.min("seq").alias("maker"))
    ops = operations.where(aimed).join(stored.hint("merge"), F.col("target_id") == F.col("stored"), "left").join(makers.hint("merge"), F.col("target_id") == F.col("made"), "left")
    reason = F.when(F.col("stored").isNull() & (F.col("made").isNull() | (F.col("maker") >= F.col("seq"))), "target is missing").when(F.col("shut"), "target is superseded already")
    ops = written(ops.withColumn("reason", reason), "aimed-operations")
    closing = ops.where("op = 'SUPERSEDE' and reason is null").groupBy(F.col("target_id").alias("closed")).agg(F.min("seq").alias("closing"))
    ops = ops.join(closing.hint("merge"), F.col("target_id") == F.col("closed"), "left")
    late = F.col("reason").isNull() & (F.col("seq") > F.col("closing"))
    up = F.when(F.col("stored").isNull() & (F.col("maker") < F.col("seq")), F.col("maker"))
    ops = ops.select(*operations.columns, F.when(late, "target is superseded already").otherwise(F.col("reason")).alias("reason"), up.cast("long").alias("up"), F.when(up.isNull(), F.col("stored")).alias("root"))
    ops = written(rest.unionByName(ops), "operations")
    while True:
        waiting = ops.where("up is not null")
        if waiting.isEmpty():
            return ops.drop("up")
        above = ops.select(F.col("seq").alias("above"), F.col("up").alias("next"), F.col("root").alias("next_root"), F.col("reason").isNull().alias("holds"))
        both = waiting.join(above.hint("merge"), F.col("up") == F.col("above"), "left")
        fails = ~F.col("holds")
        both = both.withColumn("reason", F.when(fails, "target is missing").otherwise(F.col("reason"))).withColumn("root", F.coalesce("root", "next_root"))
        both = both.withColumn("up", F.when(~fails, F.col("next"))).select(ops.columns)
        ops = written(ops.where("up is null").unionByName(both), "operations")


def changed_rows(memory: DataFrame, operations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of memory that operations change and those that they make, and the operations that don't hold (seq, op, target_id, reason). See apply_operations."""
    extra = [c for c in memory.columns if c not in MEMORY_COLUMNS]
    ops = judged_operations(memory, operations)
    good = ops.where("reason is null")
    updates = good.where("op = 'UPDATE'").groupBy(F.col("target_id").alias("u_id")).agg(F.max_by("content", F.when(F.col("content").isNotNull(), F.col("seq"))).alias("u_content"), F.min("at").alias("u_at"))
    closing = good.where("op = 'SUPERSEDE'").select(F.col("target_id").alias("c_target"), F.col("new_id").alias("c_id"), F.col("at").alias("c_at"), F.col("seq").alias("c_seq"))
    touched = good.where("op != 'ADD'").select(F.col("target_id").alias("node_id")).distinct()
    old = memory.join(touched.hint("merge"), "node_id", "left_semi").withColumn("root", F.col("node_id"))
    kinds = dict(memory.dtypes)
    made = good.where("op in ('ADD', 'SUPERSEDE')").select(
        F.col("new_id").alias("node_id"),
        "content",
        F.lit(None).cast(kinds["evidence"]).alias("evidence"),
        F.col("at").alias("valid_from"),
        F.lit(None).cast("timestamp").alias("valid_until"),
        F.lit(True).alias("is_latest"),
        F.when(F.col("op") == "SUPERSEDE", F.col("target_id")).alias("supersedes"),
        F.lit(None).cast("string").alias("superseded_by"),
        *(F.col(c) if c in operations.columns else F.lit(None).cast(kinds[c]).alias(c) for c in extra),
        "root",
    )
    nodes = old.unionByName(made).join(updates.hint("merge"), F.col("node_id") == F.col("u_id"), "left").join(closing.hint("merge"), F.col("node_id") == F.col("c_target"), "left")
    nodes = written(nodes, "changed-nodes")

    # each piece of evidence once in a chain, where it comes first; a version has what came before it was closed
    said = good.where(F.col("root").isNotNull()).select("root", "seq", F.posexplode("evidence").alias("place", "item"))
    had = old.select("root", F.lit(-(1 << 62)).alias("seq"), F.posexplode("evidence").alias("place", "item"))
    first = written(had.unionByName(said).groupBy("root", "item").agg(F.min(F.struct("seq", "place")).alias("first")), "evidence")
    owned = nodes.select("node_id", "root", "c_seq").join(first.hint("merge"), "root").where(F.col("c_seq").isNull() | (F.col("first.seq") < F.col("c_seq")))
    lists = owned.groupBy(F.col("node_id").alias("of")).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "item"))), lambda x: x["item"]).alias("chain_evidence"))
    rows = nodes.join(lists.hint("merge"), F.col("node_id") == F.col("of"), "left")
    closed = F.col("c_id").isNotNull()
    rows = rows.select(
        "node_id",
        F.coalesce("u_content", "content").alias("content"),
        F.coalesce("chain_evidence", F.array().cast(kinds["evidence"])).alias("evidence"),
        F.least("valid_from", "u_at").alias("valid_from"),
        F.when(closed & (F.col("valid_until").isNull() | (F.col("valid_until") > F.col("c_at"))), F.col("c_at")).otherwise(F.col("valid_until")).alias("valid_until"),
        (F.col("is_latest") & ~closed).alias("is_latest"),
        "supersedes",
        F.coalesce("c_id", "superseded_by").alias("superseded_by"),
        *extra,
    )
    return rows.select(memory.columns), ops.where("reason is not null").select("seq", "op", "target_id", "reason")


def apply_operations(memory: DataFrame, operations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next version of the memory table, and the operations that don't hold, with a reason.

    memory(node_id, content, evidence array, valid_from, valid_until, is_latest,
    supersedes, superseded_by, and any others); operations(seq, op, new_id,
    target_id, content, evidence array, at, and any others). Operations count
    one after another by seq; new_ids and seqs are unique. ADD makes a row;
    UPDATE changes its target in place: the last content wins, evidence is
    merged in order, valid_from only moves back, other columns stay; SUPERSEDE
    makes a row with the target's evidence and its own, and closes the target at
    its time, unless that was closed before. A new row has the other columns of
    its operation, null where that has none. A target may be a row that the same
    operations made earlier. Operations on a row that isn't there yet, or was
    superseded, are rejected.

    So operations cut anywhere into batches, applied one after another, lead to
    the same table and the same rejections. Nulls: an operation without a seq or
    with a target_id of null (but for ADD) is rejected as missing its target.
    """
    changed, rejected = changed_rows(memory, operations)
    changed = written(changed, "changed-rows")
    return memory.join(changed.select("node_id").hint("merge"), "node_id", "left_anti").select(memory.columns).unionByName(changed), rejected


def delete_repair(versions: DataFrame, deleted: DataFrame) -> DataFrame:
    """versions(node, supersedes, superseded_by, ...) without the deleted nodes, with the ends of each deleted run linked to one another.

    Links are followed over deleted nodes by doubling: a run of n nodes takes
    log n joins. A row whose successors are all deleted becomes a head again
    (superseded_by null). Rows without links stay without, and links to nodes
    that aren't there stay as they are.
    """
    gone = deleted.select("node").distinct().withColumn("gone", F.lit(True))
    rows = written(versions.join(gone.hint("merge"), "node", "left"), "versions")
    left = rows.where("gone is null").drop("gone")
    for link in ("supersedes", "superseded_by"):
        # where each deleted node leads to, over other deleted ones
        over = written(rows.where("gone").select("node", F.col(link).alias("to")), "deleted-links")
        while True:
            step = over.join(over.select(F.col("node").alias("to"), F.col("to").alias("further"), F.lit(True).alias("more")).hint("merge"), "to", "left")
            if step.where("more").isEmpty():
                break
            over = written(step.select("node", F.when(F.col("more"), F.col("further")).otherwise(F.col("to")).alias("to")), "deleted-links")
        over = over.select(F.col("node").alias("old"), F.col("to").alias("new"), F.lit(True).alias("passed"))
        left = left.join(over.hint("merge"), F.col(link) == F.col("old"), "left").withColumn(link, F.when(F.col("passed"), F.col("new")).otherwise(F.col(link))).drop("old", "new", "passed")
    return left.select(*versions.columns)


def exact_duplicates(rows: DataFrame, text: str, key: str) -> DataFrame:
    """Rows whose trimmed lower-case text no row with a smaller key has."""
    norm = F.lower(F.trim(F.col(text)))
    first = rows.groupBy(norm.alias("norm")).agg(F.min(key).alias(key), F.count("*").alias("n_copies"))
    return first.select(key, "n_copies")

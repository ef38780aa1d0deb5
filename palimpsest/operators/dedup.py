"""Plans for removing rows of memory that say nearly the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.lineage import written
from palimpsest.operators.similarity import highest_cosine, mean_cosine, similar_groups
from palimpsest.operators.versions import chains


def plan_dedup(memory: DataFrame, threshold: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(num, kept, reason) of rows to delete, and (user_id, compared, max_cosine, avg_cosine).

    memory(num, user_id, created, is_latest, supersedes, embedding). Only the
    latest rows of a user are compared; those above the threshold, directly or
    over others, are one group. Its earliest chain head stays (a latest row that
    supersedes another), and without one its earliest row; ties by num. reason
    is why the kept row stays, or `chain` for earlier versions of a deleted
    head, which go with it. Rows with no vector are neither compared nor
    deleted. `compared` counts a user's rows that took part, and the cosines are
    over all their pairs, null for fewer than two.
    """
    rows = written(memory.select("num", "user_id", "created", "is_latest", "supersedes", "embedding"), "memory")
    latest = rows.where("is_latest and size(embedding) > 0")
    groups = written(similar_groups(latest, threshold), "groups")
    head = F.col("supersedes").isNotNull()
    members = latest.select("num", "created", head.alias("head")).join(groups.hint("merge"), "num")
    first = lambda which: F.min(F.when(which, F.struct("created", "num")))["num"]
    kept = members.groupBy("group").agg(first(F.col("head")).alias("head_kept"), first(F.lit(True)).alias("row_kept"), F.count_if("head").alias("heads"))
    reason = F.when(F.col("heads") > 1, "earliest_chain_head").when(F.col("heads") == 1, "chain_head").otherwise("earliest_gmt")
    kept = kept.select("group", F.coalesce("head_kept", "row_kept").alias("kept"), reason.alias("reason"))
    gone = written(members.join(kept.hint("merge"), "group").where("num <> kept").select("num", "head", "kept", "reason"), "gone")
    # a deleted head takes the versions before it along
    chain = written(chains(rows.select(F.col("num").alias("node"), "supersedes")), "chains")
    dropped = gone.where("head").join(chain.withColumnRenamed("node", "num").hint("merge"), "num").select("chain", F.col("num").alias("lead"), "kept")
    bodies = chain.join(dropped.hint("merge"), "chain").where("node <> lead and node <> kept").groupBy("node").agg(F.min("kept").alias("kept"))
    bodies = bodies.join(gone.select(F.col("num").alias("node")).hint("merge"), "node", "left_anti")
    plan = gone.select("num", "kept", "reason").unionByName(bodies.select(F.col("node").alias("num"), "kept", F.lit("chain").alias("reason")))
    means = mean_cosine(latest)
    stats = means.join(highest_cosine(latest, threshold).hint("merge"), "user_id", "left").select("user_id", F.col("n").alias("compared"), "max_cosine", "avg_cosine")
    return plan, stats

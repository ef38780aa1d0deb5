"""Turns of conversations, prepared for what reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BY_TURN = ("conv_id", "turn")


def context(turns: DataFrame) -> DataFrame:
    """Each turn's text between those before and after it, blanks left out."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    around = F.array(F.lag("text").over(by), F.col("text"), F.lead("text").over(by))
    return turns.select("conv_id", "turn", F.array_join(F.filter(around, lambda t: t.isNotNull() & (F.trim(t) != "")), "\n").alias("context"))


def last_user_turns(turns: DataFrame, k: int) -> DataFrame:
    """Turns from the k-th last user turn on; all if there are fewer."""
    back = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    after = F.sum((F.col("role") == "user").cast("int")).over(back)
    return turns.withColumn("n", after - (F.col("role") == "user").cast("int")).where(F.col("n") < k).drop("n")


def recent(turns: DataFrame, n: int, cap: int = 500) -> DataFrame:
    """The last n turns, long assistant texts cut, newest first."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    text = F.when((F.col("role") == "assistant") & (F.length("text") > cap), F.concat(F.left("text", F.lit(cap)), F.lit("..."))).otherwise(F.col("text"))
    return turns.select("conv_id", "turn", "role", text.alias("text"), nth.alias("nth")).where(F.col("nth") <= n)


def last_queries(turns: DataFrame, k: int) -> DataFrame:
    users = turns.where("role = 'user' and trim(text) <> ''")
    return users.select("conv_id", "turn", "text", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc())).alias("nth")).where(F.col("nth") <= k)


def character_buckets(turns: DataFrame) -> DataFrame:
    """Characters of a conversation by what they belong to."""
    first = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    rows = turns.withColumn("first", first)
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.length("text"))), F.lit(0))
    return rows.groupBy("conv_id").agg(
        count(F.col("role") == "system").alias("system"),
        count((F.col("role") == "user") & (F.col("turn") == F.col("first"))).alias("first_user"),
        count((F.col("role") == "user") & (F.col("turn") > F.col("first"))).alias("later_user"),
        count(F.col("role") == "assistant").alias("assistant"),
    )


def user_rounds(turns: DataFrame) -> DataFrame:
    """(conv_id, nth, asked, n_answers, tools, has_result): a row for each user turn, from 0, with what follows it before the next.

    turns(conv_id, turn, role, text, tools array: names of the tools that a turn
    calls, or of the one whose result it is). tools has each name once, in the
    order of first use; has_result tells whether a turn of role `tool` follows.
    Turns before the first user turn are a row of their own that asks nothing.
    """
    rows = turns.withColumn("round", F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy("conv_id").orderBy("turn")))
    user = F.col("role") == "user"
    found = rows.groupBy("conv_id", "round").agg(F.coalesce(F.max(F.when(user, F.trim("text"))), F.lit("")).alias("asked"), F.count_if(~user).alias("n_answers"), F.max(F.col("role") == "tool").alias("has_result"))
    used = rows.select("conv_id", "round", "turn", F.posexplode("tools").alias("place", "tool")).groupBy("conv_id", "round", "tool").agg(F.min(F.struct("turn", "place")).alias("first"))
    # a round has no more entries than there are tools
    lists = used.groupBy("conv_id", "round").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "tool"))), lambda x: x["tool"]).alias("tools"))
    out = found.join(lists.hint("merge"), ["conv_id", "round"], "left")
    nth = F.col("round") - F.min("round").over(Window.partitionBy("conv_id"))
    return out.select("conv_id", nth.alias("nth"), "asked", "n_answers", F.coalesce("tools", F.array().cast("array<string>")).alias("tools"), "has_result")


def counts(memory: DataFrame, history: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): rows of memory(isolation_key, user_id) by key, by user and in all (`store`), of history(key) by key, and the nodes of edges(src, dst) (`graph`)."""
    none = F.lit(None).cast("string")
    by = lambda df, kind, c: df.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    every = by(memory, "key", "isolation_key").unionByName(by(memory, "user", "user_id")).unionByName(by(history, "history", "key"))
    nodes = edges.select("src").union(edges.select("dst")).distinct()
    for kind, df in (("store", memory), ("graph", nodes)):
        every = every.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), none.alias("name"), "n"))
    return every


def ready_batches(turns: DataFrame, size: int) -> DataFrame:
    """What a buffer of user turns fires: a row each time `size` of them have come together in a conversation."""
    n = F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = turns.withColumn("n", n).withColumn("batch", F.floor((F.col("n") - (F.col("role") == "user").cast("int")) / size))
    fired = rows.groupBy("conv_id", "batch").agg(F.count("*").alias("n_lines"), F.count_if(F.col("role") == "user").alias("n_user"), F.min("turn").alias("first_turn"))
    return fired.where(F.col("n_user") >= size)

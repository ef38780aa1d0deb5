"""Profiles, inserts, edits and copies of a user's memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.lineage import written


def folded(diffs: DataFrame) -> DataFrame:
    """(user_id, key, value): the latest value of each key in diffs(user_id, key, value, seq)."""
    return diffs.groupBy("user_id", "key").agg(F.max_by("value", "seq").alias("value"))


def upserted(diffs: DataFrame, kv: DataFrame) -> DataFrame:
    """(user_id, node_id, supersedes, kv): a new version for each user whose kv(user_id, key, value) differs from the profile; it holds what differs.

    It supersedes the version `node` of the user's last diff, if there is any.
    """
    old = folded(diffs).withColumnRenamed("value", "old")
    changed = kv.join(old.hint("merge"), ["user_id", "key"], "left").where("old is null or old <> value")
    new = changed.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("kv"))
    last = diffs.groupBy("user_id").agg(F.max_by("node", "seq").alias("supersedes"))
    node = F.sha2(F.concat_ws(":", F.lit("profile"), "user_id", F.to_json("kv")), 256)
    return new.join(last.hint("merge"), "user_id", "left").select("user_id", node.alias("node_id"), "supersedes", "kv")


def view(diffs: DataFrame) -> DataFrame:
    """(user_id, head, n_versions, kv): each user's present profile and how many versions led to it."""
    values = folded(diffs).groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("kv"))
    chain = diffs.groupBy("user_id").agg(F.max_by("node", "seq").alias("head"), F.countDistinct("node").alias("n_versions"))
    return chain.join(values.hint("merge"), "user_id")


def inserted(items: DataFrame, layer: str = "l2_fact", relation: str | None = None, owner: str | None = None) -> DataFrame:
    """Rows of a layer for items(user_id, item, content), without looking for others like them; blank ones are left out."""
    rows = items.withColumn("content", F.trim("content")).where("content <> ''")
    return rows.select(F.sha2(F.concat_ws(":", "user_id", F.lit(layer), "item"), 256).alias("node_id"), "user_id", "content", F.lit(layer).alias("layer"), F.lit(relation).alias("temporal_relation"), F.lit(owner).alias("owner"))


def extracted(texts: DataFrame) -> DataFrame:
    """Inserted rows for the texts of each user, once for each text but for case and space around it; the smallest item stands for it."""
    rows = texts.withColumn("content", F.trim("content")).where("content <> ''")
    first = rows.groupBy("user_id", F.lower("content").alias("low")).agg(F.min_by("content", "item").alias("content"), F.min("item").alias("item"))
    return inserted(first)


def edited(memory: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """memory(node_id, content, embedding) with edits(node_id, content, embedding), history(node_id, old, new), and edits of unknown ids."""
    new = edits.select("node_id", F.col("content").alias("new_content"), F.col("embedding").alias("new_embedding"), F.lit(True).alias("hit"))
    rows = memory.join(new, "node_id", "left")
    pick = lambda c: F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    history = rows.where("hit").select("node_id", F.col("content").alias("old"), F.col("new_content").alias("new"))
    return rows.select(*(pick(c) if c in ("content", "embedding") else c for c in memory.columns)), history, edits.join(memory.select("node_id"), "node_id", "left_anti")


def copied_id(node: Column, target: str) -> Column:
    return F.when(node.isNotNull(), F.sha2(F.concat_ws(":", F.lit(target), node), 256))


def remapped(rows: DataFrame, key: str, column: str, ids: DataFrame) -> DataFrame:
    """rows with the ids in an array column replaced by those in ids(old, new), in their order; other entries stay, and so do null and empty arrays. `key` tells rows apart."""
    each = rows.select(key, F.posexplode(column).alias("place", "entry"))
    known = each.join(ids.hint("merge"), F.col("entry") == F.col("old"), "left")
    back = known.groupBy(F.col(key).alias("of")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("new", "entry").alias("entry")))), lambda x: x["entry"]).alias("entries"))
    return rows.join(back.hint("merge"), F.col(key) == F.col("of"), "left").withColumn(column, F.coalesce("entries", column)).drop("of", "entries")


def replaced(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """rows with the ids in a column replaced by those in ids(old, new); others stay."""
    return rows.join(ids.hint("merge"), F.col(column) == F.col("old"), "left").withColumn(column, F.coalesce("new", column)).drop("old", "new")


def cloned(memory: DataFrame, edges: DataFrame, log: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The source user's rows, edges and log entries once more for the target user: new ids everywhere, access counts at 0.

    memory(node_id, user_id, supersedes, superseded_by, evidence array,
    access_count, ...), edges(src, dst), log(id, user_id, memory_id,
    old_memory_id, supersedes array, ...). New ids follow from the target and
    the old id, so a second run gives the same. Ids of the source user's rows
    are replaced wherever they stand, inside arrays in their place; what is no
    such id (a turn, a row of someone else) stays. Edges with an end of another
    user are not copied. The target must have no rows yet.
    """
    if not memory.where(F.col("user_id") == target).isEmpty():
        raise ValueError(f"{target} has rows already")
    own = memory.where(F.col("user_id") == source)
    ids = written(own.select(F.col("node_id").alias("old"), copied_id(F.col("node_id"), target).alias("new")).distinct(), "new-ids")
    rows = remapped(own, "node_id", "evidence", ids)
    for c in ("supersedes", "superseded_by", "node_id"):
        rows = replaced(rows, c, ids)
    rows = rows.withColumn("user_id", F.lit(target)).withColumn("access_count", F.lit(0)).select(memory.columns)
    ends = ids.select(F.col("old").alias("src"), F.col("new").alias("new_src")), ids.select(F.col("old").alias("dst"), F.col("new").alias("new_dst"))
    links = edges.join(ends[0].hint("merge"), "src").join(ends[1].hint("merge"), "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))
    said = remapped(log.where(F.col("user_id") == source), "id", "supersedes", ids)
    for c in ("memory_id", "old_memory_id"):
        said = replaced(said, c, ids)
    said = said.withColumn("user_id", F.lit(target)).withColumn("id", copied_id(F.col("id").cast("string"), target))
    return rows, links, said.select(log.columns)


def purged(memory: DataFrame, topics: DataFrame, edges: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A graph without a scope: memories and topics whose isolation_key is the prefix or begins with it and "::", their edges(node_id, fact_id), then facts that no edge leads to.

    Returns memories, topics, edges, and the facts that still have an edge.
    """
    inside = (F.col("isolation_key") == prefix) | F.col("isolation_key").startswith(prefix + "::")
    left = memory.where(~inside)
    kept = edges.join(left.select("node_id"), "node_id", "left_semi")
    return left, topics.where(~inside), kept, kept.select("fact_id").distinct()

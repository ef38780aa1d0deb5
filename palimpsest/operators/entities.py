"""Names in texts: finding them, indexing them, and what they add to a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.expressions import cosine
from palimpsest.operators.lineage import written
from palimpsest.operators.similarity import similar_groups

#: Words that may stand inside a name. Fixed values.
INSIDE = ["'s", "of", "the", "in", "and", "for", "at", "is"]
#: A word that begins with a capital letter and is no label.
CAPITAL = r"\p{Lu}[\p{L}\p{N}_\-]*+(?!:)"
#: Two capitals or more, or one that begins no sentence.
PROPER = rf"{CAPITAL}(?:(?: (?:{'|'.join(INSIDE[1:])})|'s)*+ {CAPITAL})+|(?<=[^.!?:\s][ ]){CAPITAL}"


def named(text: Column) -> Column:
    """array(kind, entity, place) of proper names and quoted words of 3 characters or more, in the order of the kinds."""
    text = F.coalesce(text, F.lit(""))
    proper = F.transform(F.regexp_extract_all(text, F.lit(PROPER), F.lit(0)), lambda e, i: F.struct(F.lit("PROPER").alias("kind"), e.alias("entity"), i.alias("place")))
    quoted = F.transform(F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1)), lambda e, i: F.struct(F.lit("QUOTED").alias("kind"), F.trim(e).alias("entity"), i.alias("place")))
    return F.filter(F.concat(proper, quoted), lambda x: (F.length(x["entity"]) > 2) & (F.length(x["entity"]) <= 100) & ~x["entity"].rlike(r"  |[\n\t]|\*\*|__"))


def entities(memory: DataFrame, most: int = 8) -> DataFrame:
    """(node_id, user_id, kind, entity): up to `most` names of each text, its first.

    Of spellings that differ in case the first counts, a proper name before a
    quoted one; a name inside a longer one of the same text is left out.
    """
    rows = memory.select("node_id", "user_id", F.explode(named(F.col("content"))).alias("e")).select("node_id", "user_id", "e.*").withColumn("low", F.lower("entity"))
    once = rows.groupBy("node_id", "user_id", "low").agg(F.min(F.struct("kind", "place", "entity")).alias("e"))
    names = once.groupBy("node_id", "user_id").agg(F.array_sort(F.collect_list(F.struct("e.kind", "e.place", "low", "e.entity"))).alias("names"))
    longest = F.filter("names", lambda x: ~F.exists("names", lambda o: (o["low"] != x["low"]) & o["low"].contains(x["low"])))
    return names.select("node_id", "user_id", F.explode(F.slice(longest, 1, most)).alias("e")).select("node_id", "user_id", "e.kind", "e.entity")


def entity_index(mentions: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(user_id, entity_id, node_id): mentions(num, user_id, node_id, embedding) of one user that are alike are one entity, named by its first.

    Links stay rows, so that an entity which everything mentions is no long array.
    """
    mentions = written(mentions.select("num", "user_id", "node_id", "embedding"), "mentions")
    same = similar_groups(mentions, threshold, inclusive=True).select("num", F.col("group").alias("component_id"))
    return mentions.join(same.hint("merge"), "num", "left").select("user_id", F.coalesce("component_id", "num").alias("entity_id"), "node_id").distinct()


def unlinked(index: DataFrame, deleted: DataFrame) -> DataFrame:
    """The index without links to deleted rows; an entity left without links has no row any more."""
    return index.join(deleted.select("node_id").distinct(), "node_id", "left_anti")


def entity_hits(requests: DataFrame, vectors: DataFrame, threshold: float = 0.5, most: int = 500) -> DataFrame:
    """(query_id, user_id, entity_id, similarity) of a request's vectors (query_vector) and its user's entities (entity_id, embedding)."""
    rows = requests.select("query_id", "user_id", "query_vector").join(vectors.select("user_id", "entity_id", "embedding"), "user_id")
    rows = rows.select("query_id", "user_id", "entity_id", F.round(cosine(F.col("query_vector"), F.col("embedding")), 6).alias("similarity")).where(F.col("similarity") >= threshold)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "entity_id"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def entity_boosts(hits: DataFrame, index: DataFrame, weight: float = 0.5) -> DataFrame:
    """(query_id, node_id, boost): similarity spread to the rows that mention the entity, less for one that many mention; the best counts."""
    spread = index.groupBy("user_id", "entity_id").agg(F.count("*").alias("n"))
    rows = hits.join(spread, ["user_id", "entity_id"]).join(index, ["user_id", "entity_id"])
    boost = F.col("similarity") * weight / (1 + 0.001 * (F.col("n") - 1) * (F.col("n") - 1))
    return rows.groupBy("query_id", "node_id").agg(F.max(boost).alias("boost"))


def tag_index(index: DataFrame, mentions: DataFrame) -> DataFrame:
    """index(user_id, tag, embedding) with the tags of mentions(user_id, tag, num, embedding) that it doesn't hold, each with the vector of its first mention. Rows that are there stay as they are, so doing it again changes nothing."""
    new = mentions.groupBy("user_id", "tag").agg(F.min_by("embedding", "num").alias("embedding"))
    new = new.join(index.select("user_id", "tag").hint("merge"), ["user_id", "tag"], "left_anti")
    return index.select("user_id", "tag", "embedding").unionByName(new)


def matched_tags(keywords: DataFrame, index: DataFrame, threshold: float = 0.3, most: int = 5) -> DataFrame:
    """(query_id, tag), once each: for every one of a request's keywords (query_id, user_id, keyword, embedding) the `most` tags of its user nearest to it, at the threshold or above."""
    scored = keywords.join(index.withColumnRenamed("embedding", "tag_vector").hint("merge"), "user_id").select("query_id", "keyword", "tag", F.round(cosine(F.col("embedding"), F.col("tag_vector")), 6).alias("score"))
    nth = F.row_number().over(Window.partitionBy("query_id", "keyword").orderBy(F.col("score").desc(), "tag"))
    return scored.where(F.col("score") >= threshold).withColumn("nth", nth).where(F.col("nth") <= most).select("query_id", "tag").distinct()

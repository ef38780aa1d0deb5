"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight that changes linearly over training time. Its integral
tells how many words the source has given by any moment; inverting that demand
at a document's place in the source's order tells the moment at which the
document is read. Documents are sorted by range of that moment.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.tables import documents, fresh, written

#: What sources weigh, in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Weight at the start and at the end of training, relative to a source's own mean, for the same order.
SLOPES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Rows of a part of a source, at most about: its running sums need no single task. There are 256 parts at least.
PART = 65_536
#: Equal rows that move as one.
COPIES = 10_000
#: Sources up to which their table of a row each is broadcast.
FEW = 10_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with `part` and `at`: sorted by range into parts, and the place in the part from 0."""
    rows = written(df.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), name)
    return rows.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1)})


def before(rows: DataFrame, **sums: Column) -> DataFrame:
    """(part, ...) with the sums over all parts before it. There are as many parts as a sort has tasks."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    found = written(rows.groupBy("part").agg(*(c.alias(n) for n, c in sums.items())), "part-sums")
    return F.broadcast(found.select("part", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums)))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size) with weight, rank and target. All targets together are all sizes together, none above `most` times its own.

    A source is full when the level (target for each unit of weight) passes most
    * size / weight. Sources sorted by that bound fill in turn, so running sums
    give the level after each, and the first that holds is the answer. Sums run
    within parts of the order and over the parts.
    """
    named = in_order(sizes, [F.col("source").asc_nulls_last()], "sources")
    ranked = named.join(before(named, first=F.count("*")), "part").withColumn("rank", F.col("first") + F.col("at"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("full", F.lit(float(most)) * F.col("source_size")).withColumn("bound", F.col("full") / F.col("weight"))
    filled = in_order(ranked.drop("part", "at", "first"), [F.col("bound"), F.col("rank")], "bounds")
    every = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    up_to = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sums = filled.join(before(filled, fulls=F.sum("full"), weights=F.sum("weight")), "part")
    left = F.lit(float(every[0] or 0)) - F.col("fulls") - F.coalesce(F.sum("full").over(up_to), F.lit(0.0))
    level = left / (F.lit(every[1]) - F.col("weights") - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0)))
    held = sums.select("bound", level.alias("level")).agg(F.max(F.when(F.col("level") <= F.col("bound"), F.col("level")))).first()[0]
    share = F.lit(held).cast("double") * F.col("weight")
    return filled.select("source", "source_size", "rank", "weight", F.when(share < F.col("full"), share).otherwise(F.col("full")).alias("target"))


def moment(share: Column, start: Column, end: Column) -> Column:
    """When a source whose weight goes from start to end over [0, 1] has given this share of its words."""
    return F.when(start == end, share).otherwise((F.sqrt(start * start + (end - start) * (start + end) * share) - start) / (end - start))


def mark(df: DataFrame, doc_id: str, text: str, source: str) -> Column:
    """A hash that equal rows share."""
    return F.xxhash64(F.isnull(doc_id), doc_id, F.isnull(source), source, F.isnull(text), text)


def placed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, slopes: tuple = SLOPES, most: float = 3.0, seed: int = 5) -> DataFrame:
    """A row for each row of df: doc_id, mark, n, size, source_size, target, whole (readings), given (words of the reading after them), readings.

    `n` counts the rows that are equal to it. `readings` has (words, position)
    of each reading in turn, the cut one last.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), mark(df, doc_id, text, source).alias("mark"))
    docs = written(docs, "sizes")
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = written(targets(sizes, weights, most).withColumn("target_words", F.round("target").cast("long")), "targets")
    few = goals.count() <= FEW
    goals = F.broadcast(goals) if few else goals.hint("merge")
    # equal rows follow one another, so they are counted and get their places at the end
    same = docs.groupBy("doc_id", F.col("source").alias("own"), "size", "mark").agg(F.count("*").alias("n"))
    mixed = same.join(goals, F.col("own").eqNullSafe(F.col("source"))).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))))
    mixed = mixed.withColumn("held", F.least(F.lit(COPIES), F.col("n") - F.col("piece") * COPIES)).withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "size", "mark", "piece"))
    bits = min(20, max(8, math.ceil(math.log2(max(1, docs.count()) / PART))))
    mixed = mixed.withColumn("part", F.shiftrightunsigned("order", 64 - bits).cast("int"))

    sums = mixed.groupBy("rank", "part").agg(F.sum(F.col("size") * F.col("held")).alias("part_size"))
    earlier = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "part", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("rank", "part").orderBy("order", "doc_id", "size", "mark", "piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.col("size") * F.col("held")
    rows = mixed.join(sums.hint("merge"), ["rank", "part"]).withColumn("begin", F.col("part_start") + F.sum(held).over(inside) - held)
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("held") - 1))).withColumn("begin", F.col("begin") + F.col("nth") * F.col("size"))

    whole = F.coalesce(F.expr("target_words div nullif(source_size, 0)"), F.lit(0))
    last = F.col("target_words") - F.col("whole") * F.col("source_size")
    given = F.greatest(F.lit(0), F.least(F.col("size"), last - F.col("begin")))
    rows = rows.withColumn("whole", whole.cast("long")).withColumn("given", given.cast("long"))
    starts, ends = (F.element_at(F.array(*(F.lit(float(s[i])) for s in slopes)), (F.col("rank") % len(slopes) + 1).cast("int")) for i in (0, 1))

    def reading(r: Column) -> Column:
        share = (F.col("begin") + r * F.col("source_size")) / F.when(F.col("target_words") > 0, F.col("target_words"))
        size = F.when(r < F.col("whole"), F.col("size")).otherwise(F.col("given"))
        return F.struct(size.alias("words"), F.abs(moment(F.least(share, F.lit(1.0)), starts, ends)).alias("position"))

    readings = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("whole")), reading), lambda x: x["words"] > 0)
    return rows.select("doc_id", "mark", "n", "size", "source_size", "target", "whole", "given", readings.alias("readings"))


def curriculum(df: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """A row for each row of df: doc_id, size, source_size, target, taken, copies, cut, position, positions; sorted by position.

    Documents of a source follow one another in an order by hash. A source is
    read whole floor(target / size) times and then from its beginning until its
    target is met, to the word: the last document of that is cut (`cut` words of
    it, else 0). `copies` counts whole readings, `taken` the words, `positions`
    are the moments in [0, 1] at which the document is read, one for each
    reading, and `position` is the first of them (null if it is never read).
    A document is taken at most `most` times its size, rounded up to whole
    readings only where the source's target is that of its bound.

    Null or empty texts have size 0 and are never taken. A null source is a
    source, last in order. Rows that share an id are documents of their own;
    equal rows are interchangeable. An empty table gives an empty table.
    """
    return placed(df, doc_id, **how).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + F.col("given")).alias("taken"),
        (F.col("whole") + F.when((F.col("given") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)).alias("copies"),
        F.when(F.col("given") < F.col("size"), F.col("given")).otherwise(0).cast("long").alias("cut"),
        F.try_element_at("readings", F.lit(1))["position"].alias("position"),
        F.col("readings.position").alias("positions"),
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """A row of df for each reading of it, sorted by the readings' positions; a cut reading has the first words of its text.

    Rows that share an id have readings of their own. Of rows that are equal in
    id, source and text, but not in other columns, one stands for all. Columns
    stay as they are. Null or empty texts are never read; an empty table gives
    an empty table.
    """
    key, nth, salt, reads = (fresh(df, n) for n in ("mark", "nth", "salt", "reads"))
    mix = written(placed(df, doc_id, text, source, **how).select(F.col("mark").alias(key), "n", "size", F.explode("readings").alias("reading")), "readings")
    marked = df.withColumn(key, mark(df, doc_id, text, source))
    # there are at most COPIES marks of so many rows
    most = max(COPIES, df.count() // COPIES)
    hot = written(mix.where(F.col("n") > most).select(key, "n").distinct(), "hot-marks")
    own = marked.join(F.broadcast(hot), key, "left_anti")
    first = own.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(key))).where(F.col(nth) == 1).drop(nth)
    lists = mix.where(F.col("n") <= most).groupBy(key).agg(F.collect_list(F.struct("reading.position", "reading.words", "size")).alias(reads))
    rows = first.join(lists.hint("merge"), key)
    if not hot.isEmpty():
        # one row of each, in several places, meets the readings dealt to them
        salts = F.expr(f"1 + (n - 1) div {COPIES}")
        one = marked.join(F.broadcast(hot), key).dropDuplicates([key]).withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("n")
        dealt = mix.where(F.col("n") > most).select(key, F.pmod(F.xxhash64("reading.position"), salts).alias(salt), F.array(F.struct("reading.position", "reading.words", "size")).alias(reads))
        rows = rows.unionByName(one.join(dealt.hint("merge"), [key, salt]).select(rows.columns))
    rows = rows.withColumn(reads, F.explode(reads))
    begun = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col(f"{reads}.words").cast("int")), "")
    rows = rows.withColumn(text, F.when(F.col(f"{reads}.words") < F.col(f"{reads}.size"), begun).otherwise(F.col(text)))
    return rows.orderBy(f"{reads}.position", doc_id, key).select(*df.columns)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """curriculum of all documents."""
    return curriculum(documents(spark, sf_dir))

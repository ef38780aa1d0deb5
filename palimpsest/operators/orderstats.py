"""Exact order statistics of large groups, by narrowing value ranges instead of ranking rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.lineage import written

#: Ranges that a group's values are counted in, at each pass.
RANGES = 1024
#: A range of this many rows is ranked. States of up to FEW rows are sent to all tasks.
RANKED, FEW = 10_000, 10_000


def inside(rows: DataFrame, open_: DataFrame, by: list[str], few: bool) -> DataFrame:
    """rows(by, value) whose value lies in the range of a state of their group, each with that state."""
    state = open_.withColumnsRenamed({c: f"{c}_of" for c in by})
    state = F.broadcast(state) if few else state.hint("merge")
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_of"))
    return rows.join(state, same).where("value >= low and value <= high")


def order_statistics(df: DataFrame, by: list[str], value: str, places: dict[str, Column], ranges: int = RANGES, ranked: int = RANKED) -> DataFrame:
    """(by, n, and a column for each of places): the value at that place, from 0, of a group's values in order.

    A place is a column over `n`, the number of values of the group; it is null
    where there is no such place. A pass counts a group's values in equal ranges
    between the smallest and the largest one that are still possible, and goes
    on in the range that holds the place. A range of few rows is ranked, and one
    of a single value is done, so neither a group nor a value that many rows
    have ever comes to one task. Null and NaN values do not count; a null in
    `by` is a group of its own.
    """
    rows = df.select(*by, F.col(value).alias("value")).where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    groups = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("place"), at.cast("long").alias("rank")) for name, at in places.items())))
    state = groups.select("*", each.alias("p")).select(*by, "n", "p.*", "low", "high", F.col("n").alias("size"))
    state = written(state.where("rank >= 0 and rank < n"), "places")
    done = [state.where("low = high")]
    key = [*by, "n", "place", "rank"]
    open_ = state.where("low < high")
    while (left := open_.agg(F.count("*").alias("n"), F.max("size").alias("size")).first())["n"]:
        held = inside(rows, open_, by, left["n"] <= FEW).select(*key, "low", "high", "value")
        last = left["size"] <= ranked
        # a range is a monotonic function of the value, whatever is rounded
        at = F.least(F.lit(ranges - 1), F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * ranges))
        parts = held.groupBy(*key, (F.col("value") if last else at).alias("at")).agg(F.count("*").alias("size"), F.min("value").alias("low"), F.max("value").alias("high"))
        before = F.sum("size").over(Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
        parts = parts.withColumn("before", F.coalesce(before, F.lit(0))).where("before <= rank and rank < before + size")
        found = written(parts.withColumn("rank", F.col("rank") - F.col("before")).select(*by, "n", "place", "rank", "low", "high", "size"), "places")
        done.append(found.where("low = high"))
        open_ = found.where("low < high")
    values = done[0]
    for more in done[1:]:
        values = values.unionByName(more)
    picked = (F.max(F.when(F.col("place") == name, F.col("low"))).alias(name) for name in places)
    wide = values.groupBy(*by).agg(*picked).withColumnsRenamed({c: f"{c}_of" for c in by})
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_of"))
    return groups.select(*by, "n").join(wide.hint("merge"), same, "left").select(*by, "n", *places)

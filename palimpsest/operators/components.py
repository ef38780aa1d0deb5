"""Connected components of links between ids, as rounds of grouping and joining."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.lineage import dropped, written

#: A node is a hub with over HUB links, and over a HUBS-th of all: there are at most 2 * HUBS of them.
HUB, HUBS = 200, 10_000


#: Links that a task works on, about: rounds over few links shall not be many small tasks.
TASK = 50_000


#: Types of ids that tasks can join by themselves: Python orders them as Spark does.
PLAIN = ("tinyint", "smallint", "int", "bigint", "string")


def forest(links: Iterator[tuple]) -> dict:
    """The smallest node that each node is joined to, for those that aren't the smallest."""
    up: dict = {}

    def root(x):
        top = x
        while top in up:
            top = up[top]
        while x in up:
            up[x], x = top, up[x]
        return top

    for u, v in links:
        u, v = root(u), root(v)
        if u != v:
            up[max(u, v)] = min(u, v)
    return {x: root(x) for x in list(up)}


def contracted(edges: DataFrame, most: int = 4 * TASK) -> DataFrame:
    """Links (u, v) with the same components: of every `most` links that a task reads, those from each node to the smallest that they lead to."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, schema = [], None
        for b in batches:
            schema = b.schema
            for i in range(0, b.num_rows, most):
                held.append(b.slice(i, most))
                if sum(h.num_rows for h in held) >= most:
                    yield joined(held, schema)
                    held = []
        if held:
            yield joined(held, schema)

    def joined(held: list, schema: pa.Schema) -> pa.RecordBatch:
        found = forest(pair for h in held for pair in zip(h.column(0).to_pylist(), h.column(1).to_pylist()))
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), schema.types[0]), pa.array(found.values(), schema.types[1])], schema=schema)

    return edges.mapInArrow(of, edges.schema)


def state(edges: DataFrame, tasks: int) -> tuple:
    """How many links there are, the most that a node has, and whether they are stars: every node but the smallest of each has one link, and that leads to the smallest."""
    ends = edges.select("u", F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    each = ends.groupBy("u").agg(F.count("*").alias("n"), F.sum("up").alias("up")).coalesce(tasks)
    n, most, tangled = each.agg(F.sum("up"), F.max("n"), F.max((F.col("up") > 0) & (F.col("n") > 1))).first()
    return n or 0, most or 0, bool(tangled)


def with_least(edges: DataFrame, least: Column, hub: int | None, tasks: int) -> DataFrame:
    """The links (u, v), each with m, the `least` of those of u.

    Nodes of over `hub` links are sent to all tasks, so that their links stay
    where they are; all others are joined.
    """
    if hub is None:
        return edges.join(edges.groupBy("u").agg(least.alias("m")).hint("merge"), "u").coalesce(tasks)
    few = written(edges.groupBy("u").agg(least.alias("m"), F.count("*").alias("n")).coalesce(tasks), "least")
    hubs = F.broadcast(few.where(F.col("n") > hub).select("u", "m"))
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(few.where(F.col("n") <= hub).select("u", "m").hint("merge"), "u").coalesce(tasks)
    return rest.unionByName(edges.join(hubs, "u"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) for each id that occurs in a link; component_id is the smallest id it is joined to.

    Tasks first join what they can of the links they read. Then large-star and
    small-star steps alternate until all links are stars: each node's larger
    (then smaller) neighbours are linked to the smallest one it knows. Minima
    are taken by aggregation and joined back, so no node's neighbours are ever
    gathered, and those of one node aren't sent to one task. Links with a null
    end and loops are left out.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    plain = dict(edges.dtypes)["u"] in PLAIN
    edges = written(edges if plain else edges.distinct(), "links")
    tasks = max(8, edges.count() // TASK)
    if plain:
        last, edges = edges, written(contracted(edges.coalesce(tasks)).distinct().coalesce(tasks), "links")
        dropped(last)
    n, most, tangled = state(edges, tasks)
    while tangled:
        both = edges.union(edges.select("v", "u"))
        hub = max(HUB, n // HUBS)
        hub = int(hub) if most > hub else None
        large = with_least(both, F.least(F.min("v"), F.first("u")), hub, tasks).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct().coalesce(tasks)
        small = with_least(large, F.min("v"), hub, tasks)
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        last, edges = edges, written(small.coalesce(tasks), "links")
        dropped(last)
        n, most, tangled = state(edges, tasks)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())

"""Exact joins of vectors by cosine, without comparing all pairs where vectors lie in clusters.

On unit vectors a cosine of t or more is a distance of r = sqrt(2 - 2t) or less. Each
vector lives in the cell of its nearest pivot, and visits a cell with a smaller number
if the plane between the two pivots is within r: only then a partner can live there.
Cells are cut into blocks and each pair of blocks is a task of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.expressions import unit
from palimpsest.operators.components import components
from palimpsest.operators.lineage import written

#: Vectors of a block. A task holds two blocks.
BLOCK = 1024
#: Pivots at most, and vectors from which they are drawn. Both only move work, not results.
PIVOTS, DRAWN = 256, 2048
#: Distances this close to a bound count as inside it.
EPSILON = 1e-9


def radius(threshold: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * threshold)) + EPSILON


def visits(v: np.ndarray, pivots: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each vector's home and its distance to the pivot there, and (vector, pivot) flags of the smaller cells that it visits."""
    squares = np.maximum(0.0, (v * v).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * v @ pivots.T)
    home = squares.argmin(axis=1)
    nearest = squares[np.arange(len(v)), home]
    apart = np.sqrt(np.maximum(0.0, ((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2)))[home]
    reach = squares - nearest[:, None] <= 2 * apart * r + EPSILON
    return home, np.sqrt(nearest), reach & (np.arange(len(pivots))[None, :] < home[:, None])


def vectors_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def drawn_pivots(rows: DataFrame, r: float, most: int) -> dict[int, np.ndarray]:
    """Pivots for each length of vectors, from those of smallest hash; none where vectors would visit most cells anyway, or are few."""
    counts = {x["dims"]: x["n"] for x in rows.groupBy("part", "dims").agg(F.count("*").alias("n")).groupBy("dims").agg(F.max("n").alias("n")).collect()}
    found = {}
    for dims, n in counts.items():
        k = min(most, n // BLOCK)
        if k < 2:
            continue
        some = rows.where(F.col("dims") == dims).select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(DRAWN)
        sample = np.array([x["v"] for x in some.collect()])
        # the first, and then always the one farthest from all so far
        pivots, far = [0], ((sample - sample[0]) ** 2).sum(axis=1)
        while len(pivots) < k and far.max() > EPSILON:
            pivots.append(int(far.argmax()))
            far = np.minimum(far, ((sample - sample[pivots[-1]]) ** 2).sum(axis=1))
        if len(pivots) > 1 and visits(sample, sample[pivots], r)[2].mean() < 0.25:
            found[dims] = sample[pivots]
    return found


def compared(table: pa.Table, threshold: float, inclusive: bool, joined: bool, best: bool = False) -> pa.Table:
    """(a, b, score) of a task's pairs, a spanning forest of them if `joined`, the closest one if `best`; and a row without a and b that says how many pairs it compared."""
    col = {c: table[c].combine_chunks() for c in table.column_names}
    i, j, block = (int(col[c][0].as_py()) if c != "block" else col[c].to_numpy() for c in ("i", "j", "block"))
    num, home, core = (col[c].to_numpy(zero_copy_only=False) for c in ("num", "home", "core"))
    v = vectors_of(col["v"])
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    scores = v[left] @ v[right].T
    fits = home[left][:, None] | home[right][None, :]
    if i == j:
        fits &= np.triu(np.ones(fits.shape, bool), 1)
    if joined:
        fits &= ~(core[left][:, None] & core[right][None, :])
    n = int(fits.sum())
    good = fits & (scores >= threshold if inclusive else scores > threshold)
    x, y = np.nonzero(good)
    s = scores[x, y]
    x, y = left[x], right[y]
    if best and len(x):
        top = int(s.argmax())
        x, y, s = x[top : top + 1], y[top : top + 1], s[top : top + 1]
    if joined and len(x) > len(num):
        name = np.arange(len(num))
        while True:
            least = np.minimum(name[x], name[y])
            before = name.copy()
            np.minimum.at(name, x, least)
            np.minimum.at(name, y, least)
            name = name[name]
            if np.array_equal(before, name):
                break
        x = np.flatnonzero(name != np.arange(len(num)))
        y, s = name[x], np.full(len(x), np.nan)
    a, b = np.minimum(num[x], num[y]), np.maximum(num[x], num[y])
    return pa.table({"a": pa.array([*a.tolist(), None], pa.int64()), "b": pa.array([*b.tolist(), None], pa.int64()), "score": pa.array([*s.tolist(), None], pa.float64()), "n": pa.array([0] * len(a) + [n], pa.int64())})


def distinct_vectors(rows: DataFrame, num: str, by: list[str], vector: str) -> tuple[DataFrame, DataFrame]:
    """(num, part, dims, v): one row, that of the smallest num, for equal vectors of a part; and (num, same): all rows with that of theirs.

    Rows without a num, with a null in `by`, or whose vector is null, empty,
    zero or holds nulls or no finite numbers have no direction and no row.
    """
    part = F.xxhash64(*by) if by else F.lit(0).cast("long")
    known = F.col(num).isNotNull()
    for c in by:
        known &= F.col(c).isNotNull()
    v = unit(F.col(vector).cast("array<double>"))
    good = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    # parts are told apart by their values as well: `by` goes along
    all_ = rows.where(known).select(F.col(num).cast("long").alias("num"), F.struct(part.alias("h"), *by).alias("part"), v.alias("v")).where("v is not null").where(good)
    all_ = written(all_.withColumn("dims", F.size("v")).withColumn("mark", F.xxhash64("v")), "directions")
    first = written(all_.groupBy("part", "dims", "mark", "v").agg(F.min("num").alias("num")), "distinct-directions")
    reps = first.select(F.col("part").alias("p"), F.col("mark").alias("m"), F.col("v").alias("w"), F.col("num").alias("same"))
    members = all_.join(reps.hint("merge"), (F.col("part") == F.col("p")) & (F.col("mark") == F.col("m")) & (F.col("v") == F.col("w")))
    return first.select("num", "part", "dims", "v"), members.select("num", "same")


def compared_pairs(first: DataFrame, threshold: float, inclusive: bool = False, joined: bool = False, best: bool = False, block: int = BLOCK, most: int = PIVOTS) -> DataFrame:
    """Rows of compared(), with their part, for all pairs of a part that can reach the threshold; first is that of distinct_vectors.

    With `joined`, rows within r / 2 of their pivot are like one another by the
    triangle, so they are linked to the first of them and not compared.
    """
    first = first.select("num", "part", "dims", "v")
    r = radius(threshold)
    pivots = drawn_pivots(first, r, most)
    schema = T.StructType([first.schema["num"], first.schema["part"], first.schema["dims"], first.schema["v"], *(T.StructField(n, t) for n, t in (("cell", T.IntegerType()), ("home", T.BooleanType()), ("core", T.BooleanType())))])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                for lo in range(0, len(at), 1024):
                    rows = batch.take(pa.array(at[lo : lo + 1024]))
                    n = rows.num_rows
                    if int(d) in pivots:
                        home, gap, more = visits(vectors_of(rows.column(3)), pivots[int(d)], r)
                        guests, cells = np.nonzero(more)
                    else:
                        home, gap, guests, cells = np.zeros(n, int), np.full(n, np.inf), np.zeros(0, int), np.zeros(0, int)
                    order = np.concatenate([np.arange(n), guests])
                    out = rows.take(pa.array(order))
                    flags = np.arange(len(order)) < n
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate([home, cells]).astype(np.int32)), pa.array(flags), pa.array(flags & (np.concatenate([gap, np.full(len(guests), np.inf)]) <= r / 2 - 2 * EPSILON))], names=schema.names)

    cells = written(first.mapInArrow(placed, schema), "cells")
    key = ["part", "dims", "cell"]
    sizes = cells.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.min(F.when(F.col("core"), F.col("num"))).alias("first_core"))
    sized = cells.join(sizes.hint("merge"), key).withColumn("block", F.pmod(F.xxhash64("num"), F.col("blocks")).cast("int"))
    tiles = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def task(table: pa.Table) -> pa.Table:
        out = compared(table, threshold, inclusive, joined, best)
        return out.add_column(0, "part", table["part"].combine_chunks().take(pa.array(np.zeros(len(out), np.int64))))

    found = tiles.select(*key, "i", "j", "block", "num", "home", "core", "v").groupBy(*key, "i", "j").applyInArrow(task, T.StructType([first.schema["part"], *T._parse_datatype_string("a long, b long, score double, n long").fields]))
    if joined:
        near = sized.where("core and num <> first_core").select("part", F.col("first_core").alias("a"), F.col("num").alias("b"), F.lit(None).cast("double").alias("score"), F.lit(0).cast("long").alias("n"))
        found = found.unionByName(near)
    return written(found, "compared")


def similar_classes(rows: DataFrame, threshold: float, inclusive: bool = False, num: str = "num", by: tuple = ("user_id",), vector: str = "embedding", **how) -> tuple[DataFrame, DataFrame]:
    """(a, b, score) of unequal vectors of one part whose cosine is above the threshold (or at it, if inclusive), a < b, and (num, same) of all rows.

    Equal vectors are one class, and stand in the pairs as its smallest num.
    """
    first, members = distinct_vectors(rows, num, list(by), vector)
    return compared_pairs(first, threshold, inclusive, **how).where("a is not null").select("a", "b", "score"), members


def similar_pairs(rows: DataFrame, threshold: float, inclusive: bool = False, num: str = "num", by: tuple = ("user_id",), vector: str = "embedding", **how) -> DataFrame:
    """(a, b, score) of all pairs of rows of one part whose cosine is above the threshold, or at it if inclusive; a < b.

    Rows without a direction have no partners; nums are unique. Classes of equal
    vectors are expanded, so the result has the square of their sizes: where
    that can be large use similar_classes or similar_groups.
    """
    pairs, members = similar_classes(rows, threshold, inclusive, num, by, vector, **how)
    members = written(members, "members")
    far = pairs.join(members.select(F.col("same").alias("a"), F.col("num").alias("x")).hint("merge"), "a").join(members.select(F.col("same").alias("b"), F.col("num").alias("y")).hint("merge"), "b").select("x", "y", "score")
    several = members.groupBy("same").count().where("count > 1").select("same")
    twins = written(members.join(several.hint("merge"), "same"), "twins")
    equal = twins.select("same", F.col("num").alias("x")).join(twins.select("same", F.col("num").alias("y")).hint("merge"), "same").where("x < y").select("x", "y", F.lit(1.0).alias("score"))
    if not (1.0 > threshold or inclusive and threshold <= 1.0):
        equal = equal.limit(0)
    return far.unionByName(equal).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")


def similar_groups(rows: DataFrame, threshold: float, inclusive: bool = False, num: str = "num", by: tuple = ("user_id",), vector: str = "embedding", **how) -> DataFrame:
    """(num, group) of rows that similar pairs join, directly or over others; group is the smallest num. Rows alone have no row.

    Equal vectors, and those close to one pivot, are joined without being
    compared, and a task returns a spanning forest, so no group is ever
    expanded into pairs.
    """
    first, members = distinct_vectors(rows, num, list(by), vector)
    members = written(members, "members")
    links = compared_pairs(first, threshold, inclusive, joined=True, **how).where("a is not null").select("a", "b")
    if 1.0 > threshold or inclusive:
        links = links.unionByName(members.where("num <> same").select(F.col("same").alias("a"), F.col("num").alias("b")))
    return components(links).select(F.col("id").alias("num"), F.col("component_id").alias("group"))


def highest_cosine(rows: DataFrame, threshold: float, num: str = "num", by: str = "user_id", vector: str = "embedding", **how) -> DataFrame:
    """(by, max_cosine) over all pairs of rows of one part; parts of fewer than two rows with a direction have no row.

    The threshold is where most parts are thought to have a pair. Parts without
    one are looked at again with a lower bound, and then with none.
    """
    first, members = distinct_vectors(rows, num, [by], vector)
    several = members.where("num <> same").select(F.col("same").alias("num")).distinct()
    found = written(first.join(several.hint("merge"), "num").select("part", F.lit(1.0).alias("max_cosine")).distinct(), "highest")
    for bound in (threshold, threshold / 2, -1.1):
        left = written(first.join(found.select("part").hint("merge"), "part", "left_anti"), "left")
        pairs = compared_pairs(left, bound, best=True, **how).where("a is not null")
        found = written(found.unionByName(pairs.groupBy("part").agg(F.max("score").alias("max_cosine"))), "highest")
    return found.select(F.col(f"part.{by}").alias(by), "max_cosine")


def mean_cosine(rows: DataFrame, by: str = "user_id", vector: str = "embedding") -> DataFrame:
    """(by, n, avg_cosine) over all pairs of rows of one part, from the sum of their unit vectors: no pair is made. Null for one row."""
    v = rows.select(by, unit(F.col(vector).cast("array<double>")).alias("v"))
    sums = v.select(by, F.posexplode("v").alias("dim", "x")).groupBy(by, "dim").agg(F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("own"))
    square = sums.groupBy(by).agg(F.sum(F.col("x") * F.col("x")).alias("all"), F.sum("own").alias("own"))
    counts = rows.groupBy(F.col(by).alias("of")).agg(F.count("*").alias("n"))
    return counts.join(square.hint("merge"), F.col("of") == F.col(by), "left").select(F.col("of").alias(by), "n", ((F.col("all") - F.col("own")) / F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1))).alias("avg_cosine"))

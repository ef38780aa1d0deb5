"""Prefix trie of conversations as node tables addressed by minimal perfect hashes.

Every prefix of a conversation has a digest, the running sum of its turns' digests.
Distinct ones are the nodes. They are cut into shards: whole subtrees, named by their
topmost node, as long as they stay small; what lies above is cut again in coarser
steps. A task gives the nodes of some shards their slots by a minimal perfect hash,
checks each slot by the digest that it stores, scatters counts into flat arrays and
adds them up along the array of parents' slots, the deepest nodes first.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.tables import documents, written
from palimpsest.operators.ordering import running

#: Turns below a node of the lowest level; each level above has up to 2^STEP times as many.
LIMIT, STEP = 50_000, 4
#: Depths of a band: no shard reaches over its end. So a shard above the lowest level has at most 2^STEP nodes in each of SPAN depths.
SPAN = 65_536
#: Nodes of shards that are dealt to a task together.
BIN = 50_000
#: Turns of a block, over which running sums are carried, and ids that are joined to one text.
BLOCK, IDS = 4096, 4096
EMPTY = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "d1", "d2"]


def numbered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, at, said, chars): turns from 0 by turn number, nulls first, ties by `said`, 128 bits of the SHA-256 of role and text."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    said = F.unhex(F.substring(F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256), 1, 32))
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), said.alias("said"), F.length(text_).cast("long").alias("chars")).where("conv is not null")
    rows = rows.groupBy("conv", "turn", "said", "chars").agg(F.count("*").alias("copies"))
    rows = running(rows, ["conv"], [F.col("turn").asc_nulls_first(), F.col("said")], {"first": F.col("copies")}, "turns")
    return rows.select("conv", F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)).alias("at"), "said", "chars")


def own_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns as trie() takes them: (conv, length, at, said, chars) and (conv, length)."""
    lengths = turns.groupBy("conv").agg(F.count("*").alias("length"))
    return turns.join(lengths.hint("merge"), "conv"), lengths


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """As own_turns, of conversations whose first h turns are those of conversation c - c % every; h = crc32 of the decimal id, modulo `most`.

    If that conversation has fewer turns all of them are taken, and none if it
    isn't there; its own turns after the first h follow.
    """
    counts = written(turns.groupBy("conv").agg(F.count("*").alias("n")), "lengths")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    base = counts.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = counts.withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % every).join(base.hint("merge"), "base", "left")
    convs = convs.withColumn("kept", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = written(convs.select("conv", "base", "h", "kept", (F.col("kept") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")), "convs")
    own = turns.join(convs.hint("merge"), "conv").where("at >= h").select("conv", "length", (F.col("at") - F.col("h") + F.col("kept")).alias("at"), "said", "chars")
    heads = turns.where((F.col("at") < most - 1) & (F.col("conv") % every == 0)).select(F.col("conv").alias("base"), "at", "said", "chars")
    taken = convs.join(heads.hint("merge"), "base").where("at < kept").select("conv", "length", "at", "said", "chars")
    return own.unionByName(taken), convs.select("conv", "length")


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv, length, depth, d1, d2, p1, p2, chars): for each turn the digest (d1, d2) of all turns up to it, and (p1, p2) of those before it.

    Each turn's two 64-bit hashes, of its place and what is said, are summed by
    halves of 32 bits modulo 2^32.
    """
    halves = {}
    for k in (1, 2):
        hashed = F.xxhash64(F.lit(k), "at", "said")
        halves |= {f"low{k}": hashed.bitwiseAND(0xFFFFFFFF), f"high{k}": F.shiftrightunsigned(hashed, 32)}
    rows = rows.select("conv", "length", "at", "chars", F.floor(F.col("at") / BLOCK).alias("block"), *(v.alias(k) for k, v in halves.items()))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "block").agg(*(F.sum(k).alias(f"{k}_in") for k in halves))
    blocks = blocks.select("conv", "block", *(F.coalesce(F.sum(f"{k}_in").over(earlier), F.lit(0)).alias(f"{k}_in") for k in halves))
    inside = Window.partitionBy("conv", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(blocks.hint("merge"), ["conv", "block"])
    joined = joined.select("conv", "length", "at", "chars", *halves, *((F.col(f"{k}_in") + F.coalesce(F.sum(k).over(inside), F.lit(0))).alias(f"{k}_in") for k in halves))

    def packed(k: int, more: bool) -> Column:
        low, high = ((F.col(f"{s}{k}_in") + (F.col(f"{s}{k}") if more else F.lit(0))).bitwiseAND(0xFFFFFFFF) for s in ("low", "high"))
        return F.shiftleft(high, 32).bitwiseOR(low)

    return joined.select("conv", "length", (F.col("at") + 1).alias("depth"), packed(1, True).alias("d1"), packed(2, True).alias("d2"), packed(1, False).alias("p1"), packed(2, False).alias("p2"), "chars")


def hashed(a: np.ndarray, b: np.ndarray, level: int, m: int) -> np.ndarray:
    """A place below m for each digest, another one at every level."""
    with np.errstate(over="ignore"):
        x = a ^ (b * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(m)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct digests (a, b): n of them get the slots 0 to n - 1.

    At each level digests that have a place to themselves keep it, and the
    others try again at the next one; a slot is the rank of its place.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels, before, left = [], 0, np.arange(len(a))
        while len(left):
            if len(self.levels) > 100:
                raise ValueError("a digest comes twice")
            m = max(64, 2 * len(left))
            place = hashed(a[left], b[left], len(self.levels), m)
            alone = np.bincount(place, minlength=m) == 1
            self.levels.append((m, alone, before + np.cumsum(alone) - 1))
            before += int(alone.sum())
            left = left[~alone[place]]

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A slot for each digest, -1 where it is surely none of the set; other strangers get the slot of one that is."""
        out = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, (m, alone, rank) in enumerate(self.levels):
            place = hashed(a[left], b[left], level, m)
            hit = alone[place]
            out[left[hit]] = rank[place[hit]]
            left = left[~hit]
        return out


SUMS = "depth long, d1 long, d2 long, p1 long, p2 long, conv long, n_convs long, n_children long, n_leaves long, saved long, parent_conv long, is_top boolean"


def node_table(nodes: pa.Table) -> pa.Table:
    """Sums over the subtrees of a few shards' nodes; what lies below them comes with them as more_children, more_leaves and more_saved."""
    col = {c: nodes[c].combine_chunks().to_numpy(zero_copy_only=False) for c in nodes.column_names}
    a, b, pa_, pb = (col[c].view(np.uint64) for c in ("d1", "d2", "p1", "p2"))
    table = PerfectHash(a, b)
    slot = table.slots(a, b)
    n = len(a)
    flat = {}
    for c in ("d1", "d2", "p1", "p2", "depth", "conv", "n_convs", "chars", "more_children", "more_leaves", "more_saved"):
        flat[c] = np.empty(n, np.int64)
        flat[c][slot] = col[c]
    if not np.array_equal(flat["d1"][slot], col["d1"]) or not np.array_equal(flat["d2"][slot], col["d2"]):
        raise ValueError("two digests have one slot")
    parent = np.empty(n, np.int64)
    parent[slot] = table.slots(pa_, pb)
    known = parent >= 0
    known[known] = (flat["d1"][parent[known]] == flat["p1"][known]) & (flat["d2"][parent[known]] == flat["p2"][known]) & (flat["depth"][parent[known]] == flat["depth"][known] - 1)
    children = flat["more_children"] + np.bincount(parent[known], minlength=n)
    leaves = flat["more_leaves"] + (children == 0)
    saved = flat["more_saved"] + (flat["n_convs"] - 1) * flat["chars"]
    order = np.argsort(-flat["depth"], kind="stable")
    ends = np.flatnonzero(np.diff(flat["depth"][order])) + 1
    for level in np.split(order, ends):
        level = level[known[level]]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    above = np.where(known, flat["conv"][parent], 0)
    out = {c: flat[c] for c in ("depth", "d1", "d2", "p1", "p2", "conv", "n_convs")} | {"n_children": children, "n_leaves": leaves, "saved": saved}
    return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()} | {"parent_conv": pa.array(above, pa.int64(), mask=~known), "is_top": pa.array(~known)})


def id_hashes(ends: DataFrame) -> DataFrame:
    """(depth, d1, d2, ends_sha256) of (conv, length, d1, d2): the SHA-256 of the ids that end at a node, ascending and joined by commas.

    Ids are joined for ranges of IDS numbers first; a node's texts then pass
    through one hash in order, one at a time.
    """
    texts = ends.groupBy(F.col("length").alias("depth"), "d1", "d2", F.floor(F.col("conv") / IDS).alias("range")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for depth, d1, d2, ids in zip(batch["depth"], batch["d1"], batch["d2"], batch["ids"]):
                if (depth, d1, d2) != key:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = (depth, d1, d2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
        if key:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=[*KEY, "ends_sha256"])

    dealt = texts.repartition(*KEY).sortWithinPartitions(*KEY, "range").select(*KEY, "ids")
    return dealt.mapInPandas(digests, "depth long, d1 long, d2 long, ends_sha256 string")


def trie(rows: DataFrame, lengths: DataFrame, limit: int = LIMIT, span: int = SPAN, bin_nodes: int = BIN) -> DataFrame:
    """A row for each node, that is each distinct sequence of first turns of a conversation.

    rows (conv, length, at, said, chars) has the turns of each conversation from
    0, and lengths (conv, length) all conversations, also those without turns,
    which end at the root. conv_id is a node's smallest member, parent_conv_id
    that of its parent (null for the root), n_convs the members, n_children the
    nodes one turn longer, n_leaves the childless nodes of its subtree (itself
    included), saved_tokens the sum over its subtree of (n_convs - 1) times the
    characters of the last turn, ends_sha256 the SHA-256 of the ids of members
    that end there.

    Equality of prefixes is that of 128-bit digests. Copies of a conversation
    are counted before nodes are made. Without conversations there is no node.
    """
    spark = rows.sparkSession
    steps = written(prefixes(rows), "prefixes")
    none = F.lit(0).cast("long")
    ends = steps.where("depth = length").select("conv", "length", "d1", "d2").unionByName(lengths.where("length = 0").select("conv", none.alias("length"), none.alias("d1"), none.alias("d2")))
    ends = written(ends, "ends")
    distinct = written(ends.groupBy("length", "d1", "d2").agg(F.count("*").alias("copies"), F.min("conv").alias("conv")), "distinct")
    paths = written(steps.join(distinct.select("conv", "copies").hint("merge"), "conv"), "paths")
    counted = [F.sum("copies").alias("n_convs"), F.min("conv").alias("conv")]
    nodes = paths.groupBy(*KEY).agg(*counted, F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("chars").alias("chars"), F.sum(F.col("length") - F.col("depth")).alias("weight"))
    root = distinct.agg(*counted, F.sum("length").alias("weight")).where("n_convs > 0").select(*(none.alias(c) for c in (*KEY, "p1", "p2", "chars")), "n_convs", "conv", "weight")
    level = F.when(F.col("weight") <= limit, 0).otherwise(F.ceil(F.log2(F.col("weight") / limit) / STEP)).cast("int")
    # the root is no one's child, though its digest is the sum of nothing
    nodes = written(nodes.unionByName(root).withColumn("level", level).withColumn("band", F.floor(F.col("depth") / span).cast("int")), "nodes")
    first = nodes.where("depth = 0").select("level", "conv").first()
    if first is None:
        return nodes.select("conv", "depth", *(none.alias(c) for c in ("parent", "n_convs", "children", "leaves", "saved")), F.lit("").alias("ends")).toDF("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")

    # the topmost node of each run of one band and level on a path names the shard
    placed = paths.select("conv", *KEY).join(nodes.select(*KEY, "level", "band").hint("merge"), KEY)
    placed = placed.unionByName(distinct.select("conv", *(none.alias(c) for c in KEY), F.lit(first["level"]).alias("level"), F.lit(0).alias("band")))
    tops = placed.groupBy("conv", "band", "level").agg(F.min(F.struct(*KEY)).alias("top"))
    shards = written(nodes.join(tops.hint("merge"), ["conv", "band", "level"]).withColumn("shard", F.xxhash64("top")).drop("top", "weight"), "shards")
    classes = sorted(((r["band"], r["level"], r["count"]) for r in shards.groupBy("band", "level").count().collect()), key=lambda r: (-r[0], r[1]))
    more = ["more_children", "more_leaves", "more_saved"]
    done: list[DataFrame] = []
    for band, lev, count in classes:
        part = shards.where((F.col("band") == band) & (F.col("level") == lev))
        if done:
            below = reduce(DataFrame.unionByName, done).where("is_top and depth > 0")
            below = below.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count("*").alias(more[0]), F.sum("n_leaves").alias(more[1]), F.sum("saved").alias(more[2]))
            part = part.join(below.hint("merge"), KEY, "left").withColumns({c: F.coalesce(c, none) for c in more})
        else:
            part = part.withColumns(dict.fromkeys(more, none))
        bins = max(1, math.ceil(count / bin_nodes))
        part = part.select(F.pmod("shard", F.lit(bins)).alias("bin"), *KEY, "p1", "p2", "conv", "n_convs", "chars", *more)
        done.append(written(part.groupBy("bin").applyInArrow(node_table, SUMS), "sums"))
    sums = reduce(DataFrame.unionByName, done)
    loose = sums.where("is_top and depth > 1").drop("parent_conv")
    parents = sums.select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv").alias("parent_conv"))
    tied = loose.join(parents.hint("merge"), ["depth", "p1", "p2"])
    rest = sums.where("not is_top or depth <= 1").withColumn("parent_conv", F.when(F.col("is_top") & (F.col("depth") == 1), F.lit(first["conv"])).otherwise(F.col("parent_conv")))
    whole = rest.unionByName(tied).join(id_hashes(ends).hint("merge"), KEY, "left")
    return whole.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent_conv").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, **names) -> DataFrame:
    """trie, of conversations as they are.

    Turns are ordered by number, nulls first; turns that share a number follow
    one another by a hash of role and text, and repeated ones all count. A null
    role or text is empty. Ids are whole numbers; rows without one belong to no
    conversation and are left out. Other columns are not read.
    """
    return trie(*own_turns(written(numbered(conversations, **names), "numbered")))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trie, of all conversations with rebuilt beginnings."""
    return trie(*rebuilt(written(numbered(documents(spark, sf_dir, "conversations")), "numbered")))

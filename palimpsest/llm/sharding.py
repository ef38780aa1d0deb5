"""Sharding by balanced label propagation, by DataFrame functions alone.

Documents that share a key are linked. Linked documents begin evenly spread; in each
round every group counts its members by shard, and those outside its best shard ask to
move there. How many may is decided for each pair of shards: as many bytes as come the
other way, and a share of the room that is left. What isn't linked to anything is
placed last, and levels the shards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.tables import documents, fresh, written
from palimpsest.operators.ordering import running

#: A group of over a PIECEth of a shard moves in pieces.
PIECE = 64
#: Moves between two shards are accepted by whole buckets of groups.
BUCKETS = 256
#: Exchanges may leave a shard over its capacity by a SLACK-th.
SLACK = 200
#: Single documents are placed in order of these bands: over a 64th of a shard, over a 1024th, the rest.
BANDS = (64, 1024)


def levelled(loads: list[int], total: int) -> list[float]:
    """What each shard gets of `total` so that all end as level as can be."""
    order = sorted(range(len(loads)), key=lambda k: loads[k])
    level, left = 0.0, float(total)
    for n, k in enumerate(order, 1):
        level = (sum(loads[j] for j in order[:n]) + left) / n
        if n == len(order) or level <= loads[order[n]]:
            break
    return [max(0.0, level - x) for x in loads]


def by_intervals(middle: Column, shares: list[float]) -> Column:
    """The shard in whose interval, of the given lengths one after another, the middle lies."""
    last = max(k for k, s in enumerate(shares) if s == max(shares))
    out, end = F.lit(last), sum(shares)
    for k in range(len(shares) - 1, -1, -1):
        begin = end - shares[k]
        if shares[k] > 0:
            out = F.when((middle >= begin) & (middle < end), k).otherwise(out)
        end = begin
    return out.cast("int")


def quotas(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], float]:
    """Bytes that may move from one shard to another: what wants to come back, and a share of the target's room by what is wanted beyond that."""
    met = {(a, b): min(w, wanted.get((b, a), 0)) for (a, b), w in wanted.items()}
    over = [sum(w - met[a, b] for (a, b), w in wanted.items() if b == k) for k in range(len(room))]
    return {(a, b): met[a, b] + (max(0, room[b]) * min(1.0, (w - met[a, b]) / over[b]) if over[b] else 0) for (a, b), w in wanted.items()}


def accepted(sums: list[tuple[int, int, int, int]], allowed: dict[tuple[int, int], float], loads: list[int], most: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """The first buckets (bucket, bytes) of each pair of shards that its quota allows, without the last ones where a shard would end over `most` and over what it has.

    sums: (bucket, from, to, bytes) in order of buckets.
    """
    out: dict = {pair: [] for pair in allowed}
    ended = set()
    after = list(loads)
    for bucket, a, b, n in sums:
        if (a, b) in ended or sum(m for _, m in out[a, b]) + n > allowed[a, b]:
            ended.add((a, b))
            continue
        out[a, b].append((bucket, n))
        after[a], after[b] = after[a] - n, after[b] + n
    while True:
        into = [pair for pair, found in out.items() if found and after[pair[1]] > max(most, loads[pair[1]])]
        if not into:
            return out
        a, b = max(into, key=lambda pair: (sum(m for _, m in out[pair]), pair))
        n = out[a, b].pop()[1]
        after[a], after[b] = after[a] + n, after[b] - n


def propagated(state: DataFrame, shards: int, capacity: int, rounds: int) -> DataFrame:
    """state(uid, hub, piece, size, shard) after its rounds: members of a hub gather where most of them are, as far as capacity lets them."""
    loads = [0] * shards
    for r in state.groupBy("shard").agg(F.sum("size").alias("n")).collect():
        loads[r["shard"]] = r["n"]
    idle = 0
    for turn in range(rounds):
        room = [capacity - x for x in loads]
        # every other round looks only at shards with room to spare, for groups whose best shard is full
        aims = [k for k in range(shards) if turn % 2 == 0 or room[k] >= capacity / PIECE]
        if not aims:
            idle += 1
            if idle == 2:
                break
            continue
        votes = [F.struct(F.count_if(F.col("shard") == k).alias("n"), F.xxhash64(F.lit(k), "hub").alias("tie"), F.lit(k).alias("k")) for k in range(shards)]
        best = state.groupBy(F.col("hub").alias("of")).agg(F.array(*votes).alias("votes")).withColumn("best", F.array_max(F.filter("votes", lambda v: v["k"].isin(aims))))
        both = state.join(best.hint("merge"), F.col("hub") == F.col("of"))
        moves = F.col("best") > F.get("votes", F.col("shard"))
        bucket = F.pmod(F.xxhash64(F.lit(turn), "hub", "piece"), F.lit(BUCKETS)).cast("int")
        asked = written(both.select("uid", "hub", "piece", "size", "shard", F.when(moves, F.col("best.k")).alias("to"), bucket.alias("bucket")), "moves")
        # at most shards^2 * BUCKETS sums
        sums = asked.where("to is not null").groupBy("shard", "to", "bucket").agg(F.sum("size").alias("n")).collect()
        wanted: dict = {}
        for r in sums:
            wanted[r["shard"], r["to"]] = wanted.get((r["shard"], r["to"]), 0) + r["n"]
        taken = accepted(sorted((r["bucket"], r["shard"], r["to"], r["n"]) for r in sums), quotas(wanted, room), loads, capacity + capacity // SLACK)
        for (a, b), found in taken.items():
            n = sum(m for _, m in found)
            loads[a], loads[b] = loads[a] - n, loads[b] + n
        idle = 0 if any(taken.values()) else idle + 1
        ends = {pair: found[-1][0] + 1 for pair, found in taken.items() if found}
        bound = F.array(*(F.lit(ends.get((a, b), 0)) for a in range(shards) for b in range(shards)))
        goes = F.col("to").isNotNull() & (F.col("bucket") < F.get(bound, F.col("shard") * shards + F.col("to")))
        state = asked.select("uid", "hub", "piece", "size", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard"))
        if idle == 2:
            break
    return state


def sharded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", link: Column | None = None, shards: int = 8, rounds: int = 10) -> DataFrame:
    """A row for each document: its id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus 1. The law is `bytes`: shards have the
    same size but for about a document. Documents with the same `link` (by
    default: the same text; null links nothing) are gathered in as few shards as
    sizes allow; a group of more than a shard's size fills several. `slot`
    numbers a shard's rows from 0 by id, nulls first. grown_shard is null under
    this law.

    A null text has size 1 and counts as an empty one, also as a link. Rows
    that share an id, and equal rows, are documents of their own. Documents are
    known by a number of their own within the job, so ids may have any type that
    can be ordered. Fewer documents than shards leave some empty, and an empty
    table gives an empty table. Other columns are not read.
    """
    text_ = F.coalesce(F.col(text), F.lit(""))
    hub = F.xxhash64(text_) if link is None else link
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("id"), (F.octet_length(text_) + 1).cast("long").alias("size"), F.crc32(text_.cast("binary")).alias("text_crc32"), hub.alias("hub"))
    rows = written(rows, "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    capacity = -(-total // shards)
    groups = rows.where("hub is not null").groupBy(F.col("hub").alias("of")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    both = rows.join(groups.hint("merge"), F.col("hub") == F.col("of"), "left")
    band = F.when(F.col("of").isNotNull(), -1)
    for k, part in enumerate(BANDS):
        band = band.when(F.col("size") * part > capacity, k)
    pieces = F.ceil(F.col("bytes") * PIECE / max(1, capacity)).cast("long")
    both = both.select("uid", "id", "size", "text_crc32", "hub", band.otherwise(len(BANDS)).alias("band"), F.pmod(F.xxhash64("uid"), pieces).alias("piece"))
    ordered = written(running(both, ["band"], [F.xxhash64(F.lit(7), "uid"), F.col("uid")], {"begin": F.col("size")}, "bands"), "ordered")
    sums = {r["band"]: r["n"] for r in ordered.groupBy("band").agg(F.sum("size").alias("n")).collect()}
    loads, placed = [0] * shards, []
    for k in (-1, *range(len(BANDS) + 1)):
        if k not in sums:
            continue
        part = ordered.where(F.col("band") == k)
        middle = F.col("begin") + F.col("size") / 2
        if k < 0:
            state = part.select("uid", "hub", "piece", "size", by_intervals(middle, [sums[k] / shards] * shards).alias("shard"))
            gathered = propagated(state, shards, capacity, rounds).select("uid", "shard")
            part = part.select("uid", "id", "size", "text_crc32").join(gathered.hint("merge"), "uid")
        else:
            part = part.select("uid", "id", "size", "text_crc32", by_intervals(middle, levelled(loads, sums[k])).alias("shard"))
        part = written(part, "placed")
        for r in part.groupBy("shard").agg(F.sum("size").alias("n")).collect():
            loads[r["shard"]] += r["n"]
        placed.append(part.select("uid", "id", "size", "text_crc32", "shard"))
    every = reduce(DataFrame.unionByName, placed) if placed else rows.select("uid", "id", "size", "text_crc32", F.lit(0).alias("shard"))
    slots = running(every, ["shard"], [F.col("id").asc_nulls_first(), F.col("uid")], {"slot": F.lit(1).cast("long")}, "shards")
    out = slots.select("id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    return out.withColumnRenamed("id", fresh(out.drop("id"), doc_id))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sharded, of all documents."""
    return sharded(documents(spark, sf_dir))

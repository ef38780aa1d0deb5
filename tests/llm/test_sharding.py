"""Shards: whole, level, numbered without gaps, and with linked documents together."""

import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from palimpsest.llm import sharding

SCHEMA = "doc_id long, text string, source string"


def held(rows, docs, name="doc_id", shards=8, unlike=1.0):
    """rows of the query over docs (id, text). unlike: how many of the largest document two shards may differ by."""
    size = lambda t: len((t or "").encode()) + 1
    want = sorted(((i is not None, i, size(t), zlib.crc32((t or "").encode())) for i, t in docs), key=str)
    assert sorted(((r[name] is not None, r[name], r["size"], r["text_crc32"]) for r in rows), key=str) == want
    slots, loads = defaultdict(list), Counter()
    for r in rows:
        assert r["law"] == "bytes" and 0 <= r["shard"] < shards and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if docs:
        spread = max(loads[k] for k in range(shards)) - min(loads[k] for k in range(shards))
        assert spread <= unlike * max(size(t) for _, t in docs), (spread, loads)


def cut(rows):
    """Pairs of equal documents in different shards, and all pairs of equal ones."""
    groups = defaultdict(Counter)
    for r in rows:
        groups[r["text_crc32"], r["size"]][r["shard"]] += 1
    every = sum(n * (n - 1) // 2 for g in groups.values() for n in [sum(g.values())])
    return every - sum(n * (n - 1) // 2 for g in groups.values() for n in g.values()), every


def test_whole_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    df = sharding.op13(spark, sf_dir)
    rows = df.collect()
    held(rows, docs)
    assert cut(rows)[0] == 0


def test_copies_are_gathered_and_a_group_of_many_fills_few_shards(spark):
    rng = random.Random(4)
    docs = [(i, f"single {i} " + "x" * rng.randrange(300)) for i in range(3000)]
    docs += [(10_000 + 10 * g + k, f"group {g} " + "y" * (g % 200)) for g in range(300) for k in range(2 + g % 6)]
    docs += [(50_000 + i, "hot " * 40) for i in range(3000)]  # two fifths of all bytes
    df = spark.createDataFrame([(*d, "s") for d in docs], SCHEMA).repartition(4)
    rows = sharding.sharded(df).collect()
    held(rows, docs)
    small = [r for r in rows if r["doc_id"] < 50_000]
    lost, every = cut(small)
    assert lost <= 0.02 * every, (lost, every)
    hot = Counter(r["shard"] for r in rows if r["doc_id"] >= 50_000)
    assert sum(n for _, n in hot.most_common(5)) >= 0.97 * 3000, hot


def test_tables_of_copies_alone(spark):
    docs = [(i, f"text {i % 400} " + "z" * (i % 400 % 50)) for i in range(2400)]
    rows = sharding.sharded(spark.createDataFrame([(*d, "s") for d in docs], SCHEMA), rounds=20).collect()
    held(rows, docs, unlike=8)
    lost, every = cut(rows)
    assert lost <= 0.2 * every, (lost, every)  # nothing unlinked levels the shards: copies only move by exchange


def test_odd_rows(spark):
    docs = [(None, None), (None, None), (None, ""), (1, None), (1, "a"), (1, "a"), (1, "b"), (2, "ü𝄞"), (3, "long " * 100_000)] + [(7, "same row")] * 500
    df = spark.createDataFrame([(*d, "s") for d in docs], SCHEMA)
    held(sharding.sharded(df).collect(), docs)
    assert sharding.sharded(df.limit(0)).collect() == []
    held(sharding.sharded(df.where("doc_id = 2")).collect(), [(2, "ü𝄞")])
    other = df.select(F.concat(F.lit("d"), "doc_id").alias("shard"), F.col("text").alias("slot"), F.lit(1).alias("size"))
    rows = sharding.sharded(other, doc_id="shard", text="slot").collect()
    held(rows, [(None if i is None else f"d{i}", t) for i, t in docs], name="shard_")


def test_links_by_another_column_and_other_numbers_of_shards(spark):
    df = spark.createDataFrame([(i, f"text {i}", f"s{i % 30}" if i % 3 else None) for i in range(900)], SCHEMA)
    rows = sharding.sharded(df, link=F.col("source"), shards=5).collect()
    held(rows, [(i, f"text {i}") for i in range(900)], shards=5, unlike=2)
    where = defaultdict(set)
    for r in rows:
        if r["doc_id"] % 3:
            where[r["doc_id"] % 30].add(r["shard"])
    assert sum(len(s) > 1 for s in where.values()) <= 4


def test_no_python_in_the_plan(spark, sf_dir):
    plan = sharding.op13(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_buckets_that_would_fill_a_shard_too_far_are_given_back():
    sums = [(0, 0, 1, 5), (0, 1, 0, 3), (1, 0, 1, 4), (2, 0, 1, 4), (2, 1, 0, 9)]
    got = sharding.accepted(sums, {(0, 1): 9, (1, 0): 20}, [10, 10], 11)
    assert got == {(0, 1): [], (1, 0): []}
    got = sharding.accepted([(0, 0, 1, 5), (0, 1, 0, 4), (1, 0, 1, 4), (2, 1, 0, 9)], {(0, 1): 9, (1, 0): 8}, [10, 10], 11)
    assert got == {(0, 1): [(0, 5)], (1, 0): [(0, 4)]}


def test_levels():
    assert sharding.levelled([5, 0, 3], 4) == [0.0, 3.5, 0.5]
    assert sharding.levelled([0, 0], 4) == [2.0, 2.0]
    assert sharding.levelled([9, 1], 2) == [0.0, 2.0]

"""What a job leaves on disk while it runs."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F
from test_cores import plain_cores

from palimpsest.llm import likeness, simhash
from palimpsest.operators import clusters, lineage


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def test_what_is_shuffled_for_a_table_goes_with_its_writing(spark):
    before, key = shuffled(spark), next(iter(lineage.RELEASE))
    set_before = spark.conf.get(key, None)
    rows = spark.range(20_000).repartition(8, F.xxhash64("id"))
    table = lineage.written(rows.groupBy((F.col("id") % 5000).alias("k")).count(), "counts")
    until = time.time() + 10  # files are deleted by another thread
    while shuffled(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled(spark) - before
    assert table.count() == 5000 and spark.conf.get(key, None) == set_before


def test_tables_of_all_prefixes_are_deleted_once_read(spark, monkeypatch):
    words = [f"w{i}" for i in range(4000)]
    texts = [(i, " ".join(words[i * 9 : i * 9 + 60])) for i in range(400)] + [(1000 + i, " ".join(words[i * 9 : i * 9 + 59])) for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    there, shared = {}, lineage.shared_dir(spark)
    before = set(os.listdir(shared))

    def noted(df, name, write=lineage.written):
        out = write(df, name)
        there[name] = {x.rpartition("-")[0] for x in set(os.listdir(shared)) - before}
        return out

    monkeypatch.setattr(likeness, "written", noted)
    monkeypatch.setattr(simhash, "written", noted)
    assert simhash.near_copies(df).where("component_id < 1000").count() == 800
    large = {"prefixes", "distinct-sets", "prefix-shingles"}
    assert all(len(tables & large) <= 2 for tables in there.values())
    assert not there["whole-sets"] & large and not there["named-sets"] & (large | {"shared-shingles", "whole-sets"})


def test_nothing_reads_a_deleted_table_where_nothing_is_alike(spark):
    df = spark.createDataFrame([(i, " ".join(f"own{i}x{j}" for j in range(20))) for i in range(30)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df).collect()} == {i: i for i in range(30)}


@pytest.mark.parametrize("few", [500_000, 0])
def test_cores_keep_no_table_twice(spark, monkeypatch, few):
    monkeypatch.setattr(clusters, "FEW", few, raising=False)
    monkeypatch.setattr(clusters, "STEPS", 15)
    rng, shared = random.Random(2), lineage.shared_dir(spark)
    nodes = [*range(10), 3, None]
    edges = [(rng.choice([*range(40), None]), rng.choice([*range(60), None])) for _ in range(120)]
    for hops in (1, 2, 3):
        before = set(os.listdir(shared))
        found = clusters.cores(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges * 2, "src long, dst long"), hops)
        left = [x.rpartition("-")[0] for x in set(os.listdir(shared)) - before]
        got = found.collect()
        want = plain_cores(nodes, edges, hops)
        assert len(got) == len(want) and {(r["node"], r["core"]): r["hop"] for r in got} == want
        assert left.count("edges") == (hops == 1) and left.count("onward") == left.count("steps") == hops - 1

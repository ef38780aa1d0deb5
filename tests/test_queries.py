"""Every query against its SQL, and the rules that the reference's own tests hold."""

import datetime
import random

import oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from palimpsest.functions import expressions as X
from palimpsest.operators import versions as V
from palimpsest.plans import catalog
from palimpsest.streaming import jobs as S


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_agrees_with_sql(spark, sf_dir, con, name):
    assert oracle.difference(con, catalog.QUERIES[name](spark, sf_dir), catalog.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


MEMORY = "node_id string, content string, evidence array<string>, valid_from timestamp, valid_until timestamp, is_latest boolean, supersedes string, superseded_by string"
OPS = "seq long, op string, new_id string, target_id string, content string, evidence array<string>, at timestamp"


def day(m, d):
    return datetime.datetime(2023, m, d)


def test_supersede_closes_the_old_interval_and_links_both_ways(spark):
    memory = spark.createDataFrame([("old", "a", ["D1:1"], day(1, 1), None, True, None, None), ("shut", "b", [], day(1, 1), day(2, 1), True, None, None)], MEMORY)
    ops = spark.createDataFrame([(1, "SUPERSEDE", "new", "old", "b", ["D2:2"], day(5, 25)), (2, "SUPERSEDE", "n2", "shut", "c", [], day(5, 25)), (3, "SUPERSEDE", "n3", "gone", "d", [], day(5, 25)), (4, "SUPERSEDE", "n4", "old", "e", [], day(6, 1)), (5, "MERGE", "n5", "old", "e", [], day(6, 1))], OPS)
    after, rejected = V.apply_operations(memory, ops)
    rows = {r["node_id"]: r for r in after.collect()}
    assert (rows["old"]["valid_until"], rows["old"]["is_latest"], rows["old"]["superseded_by"]) == (day(5, 25), False, "new")
    assert (rows["new"]["supersedes"], rows["new"]["evidence"], rows["new"]["is_latest"]) == ("old", ["D1:1", "D2:2"], True)
    assert rows["shut"]["valid_until"] == day(2, 1)
    assert {(r["seq"], r["reason"]) for r in rejected.collect()} == {(3, "target is missing"), (4, "target is superseded already"), (5, "unknown operation")}


def test_updates_merge_evidence_in_order(spark):
    memory = spark.createDataFrame([("x", "a", ["D1:1"], day(3, 1), None, True, None, None)], MEMORY)
    ops = spark.createDataFrame([(1, "UPDATE", None, "x", "b", ["D2:3"], day(4, 1)), (2, "UPDATE", None, "x", None, ["D1:1", "D0:9"], day(2, 1)), (3, "ADD", "y", None, "new", None, day(2, 2))], OPS)
    rows = {r["node_id"]: r for r in V.apply_operations(memory, ops)[0].collect()}
    assert (rows["x"]["content"], rows["x"]["evidence"], rows["x"]["valid_from"]) == ("b", ["D1:1", "D2:3", "D0:9"], day(2, 1))
    assert (rows["y"]["content"], rows["y"]["evidence"], rows["y"]["supersedes"]) == ("new", [], None)


def plain_apply(memory, ops):
    """Operations one after another."""
    rows, rejected = {r[0]: list(r) for r in memory}, []
    for seq, op, new, target, content, evidence, at in sorted(ops):
        row = rows.get(target)
        if op not in ("ADD", "UPDATE", "SUPERSEDE"):
            rejected.append((seq, "unknown operation"))
        elif op == "ADD":
            rows[new] = [new, content, list(dict.fromkeys(evidence or [])), at, None, True, None, None]
        elif row is None:
            rejected.append((seq, "target is missing"))
        elif row[7] is not None:
            rejected.append((seq, "target is superseded already"))
        elif op == "UPDATE":
            row[1] = row[1] if content is None else content
            row[2] = list(dict.fromkeys(row[2] + (evidence or [])))
            row[3] = min(row[3], at)
        else:
            rows[new] = [new, content, list(dict.fromkeys(row[2] + (evidence or []))), at, None, True, target, None]
            row[4] = at if row[4] is None or row[4] > at else row[4]
            row[5], row[7] = False, new
    return sorted(map(repr, rows.values())), sorted(rejected)


def random_operations(seed, n):
    rng, ids, ops = random.Random(seed), [f"m{i}" for i in range(8)], []
    memory = [(i, f"text {i}", [f"D{k}" for k in range(k % 3)], day(1, 1 + k), day(6, 1) if k % 4 == 0 else None, True, None, None) for k, i in enumerate(ids)]
    for seq in range(n):
        op = rng.choice(["ADD", "UPDATE", "UPDATE", "SUPERSEDE", "SUPERSEDE", "MERGE"])
        new, target = f"n{seq}", None if op == "ADD" else rng.choice([*ids, *(f"n{k}" for k in range(n)), *(f"n{seq - k}" for k in (1, 2, 3, 4)), "gone"])
        ops.append((seq, op, new, target, rng.choice([None, f"text {seq}"]), rng.choice([None, [], [f"D{rng.randrange(9)}", f"E{seq}"]]), day(1 + rng.randrange(11), 1 + rng.randrange(28))))
    return memory, ops


def test_operations_count_one_after_another_in_any_batches(spark):
    for seed in range(2):
        memory, ops = random_operations(seed, 60)
        want = plain_apply(memory, ops)
        for cuts in ([0, 60], [0, 13, 14, 41, 60]):
            table, rejects = spark.createDataFrame(memory, MEMORY), []
            for i, j in zip(cuts, cuts[1:]):
                table, rejected = V.apply_operations(table, spark.createDataFrame(ops[i:j], OPS))
                rejects += [(r["seq"], r["reason"]) for r in rejected.collect()]
            assert (sorted(repr(list(r)) for r in table.collect()), sorted(rejects)) == want, (seed, cuts)


def test_new_rows_carry_their_operations_columns(spark):
    memory = spark.createDataFrame([("old", "a", [], day(1, 1), None, True, None, None, "s1", 4)], MEMORY + ", session_id string, turn int")
    ops = spark.createDataFrame([(1, "UPDATE", None, "old", "b", [], day(2, 1), "s2", 7), (2, "SUPERSEDE", "new", "old", "c", [], day(3, 1), "s3", 9)], OPS + ", session_id string, turn int")
    rows = {r["node_id"]: (r["content"], r["session_id"], r["turn"]) for r in V.apply_operations(memory, ops)[0].collect()}
    assert rows == {"old": ("b", "s1", 4), "new": ("c", "s3", 9)}


def test_streamed_operations_come_to_the_same_table(spark, tmp_path):
    memory, ops = random_operations(5, 60)
    for k, (i, j) in enumerate([(0, 20), (20, 21), (21, 60)]):
        spark.createDataFrame(ops[i:j], OPS).coalesce(1).write.parquet(str(tmp_path / "ops" / f"p{k}"))
    stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ops" / "*"))
    place = str(tmp_path / "table")
    base = spark.createDataFrame(memory, MEMORY)
    after = S.applied(stream, base, "memory", place, buckets=4)
    want, rejected = plain_apply(memory, ops)
    assert sorted(repr(list(r)) for r in after.collect()) == want
    assert sorted((r["seq"], r["reason"]) for r in spark.read.parquet(f"{place}/rejected").collect()) == rejected
    assert len(list((tmp_path / "table" / "reads").glob("batch=*"))) == 3
    assert sorted(repr(list(r)) for r in S.current(spark, place, base).collect()) == want


def test_deleted_runs_are_bridged_along_their_links(spark):
    links = [(1, None, 2), (2, 1, 4), (4, 2, 5), (5, 4, 9), (9, 5, None), (3, None, 6), (6, 3, 7), (7, 6, None), (8, None, None), (10, 99, None), (11, None, 12), (12, 11, None)]
    versions = spark.createDataFrame([(*x, "u") for x in links], "node long, supersedes long, superseded_by long, owner string")
    gone = spark.createDataFrame([(2,), (4,), (5,), (7,), (11,), (12,), (2,)], "node long")
    got = {r["node"]: (r["supersedes"], r["superseded_by"], r["owner"]) for r in V.delete_repair(versions, gone).collect()}
    assert got == {1: (None, 9, "u"), 9: (1, None, "u"), 3: (None, 6, "u"), 6: (3, None, "u"), 8: (None, None, "u"), 10: (99, None, "u")}


def test_expressions(spark):
    row = spark.range(1).select(
        X.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("a"),
        X.cosine(F.array(F.lit(1.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("b"),
        X.redact(F.lit("api_key = 'abc' --token xyz")).alias("c"),
        X.intent(F.lit("why `x`")).alias("d"),
        X.intent(F.lit("why is it")).alias("e"),
        X.layer_name(F.lit(" Profile ")).alias("f"),
        X.layer_name(F.lit("nothing")).alias("g"),
        X.language(F.lit("你好 world")).alias("h"),
        X.keywords(F.lit("The cat, the CAT and 你好 at 10")).alias("i"),
    ).first()
    assert tuple(row) == (0.0, 0.0, "api_key = <REDACTED> --token <REDACTED>", "NAVIGATIONAL", "CONCEPTUAL", "l4_identity", None, "zh", ["cat", "你好"])

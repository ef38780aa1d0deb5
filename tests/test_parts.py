"""Tasks get few rows at any size of the tables."""

from palimpsest.operators import lineage, operations as O
from palimpsest.sources import inputs as I


def test_evidence_is_dealt_by_its_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lineage, "SHARE", 100)
    rows = I.table(spark, sf_dir, "lineitem")
    found = I.evidence(spark, sf_dir)
    assert found.rdd.getNumPartitions() == rows.count() // 100
    assert found.count() == rows.select("l_suppkey", "l_partkey").distinct().count()


def test_enriched_operations_are_dealt_by_their_items(spark, monkeypatch):
    monkeypatch.setattr(lineage, "SHARE", 1)
    ops = spark.createDataFrame([(1, 0, "x", [0, 1], None), (1, 1, "y", None, None), (2, 0, "x", [5], None), (3, 0, "x", [0], "own"), (4, 0, "x", [0], None)], "request_id long, seq int, content string, source_indices array<int>, relation string")
    items = spark.createDataFrame([(1, 0, "a", "p"), (1, 1, "y", "q"), (2, 0, "z", "r"), (3, 0, "a", "s")] + [(9 + i, 0, "a", "t") for i in range(20)], "request_id long, item int, content string, relation string")
    found = O.enriched(ops, items, ["relation"])
    assert sorted((r["request_id"], r["seq"], r["relation"]) for r in found.collect()) == [(1, 0, None), (1, 1, "q"), (2, 0, "r"), (3, 0, "own"), (4, 0, None)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" not in plan and "(request_id#" in plan and ", 24), REPARTITION_BY_NUM" in plan

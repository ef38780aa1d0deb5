"""Schemas made of candidates: requests count as a whole, and evidence is stored before it is named."""

from palimpsest.operators import operations as O


def test_schemas_of_whole_requests_without_shuffled_names(spark):
    asked = spark.createDataFrame([(1, "u", "a", [1, 2, 2], ["x", "x", "y"]), (2, "u", "b", [1, 3], ["x"]), (3, "u", "c", [1, 4], ["x"]), (4, "u", "d", [], ["x"]), (5, "v", "e", [3], None), (1, "u", "a", [2], ["y"]), (6, "u", "f", [None, 1], ["x"])], "request_id long, owner string, content string, facts array<long>, tags array<string>")
    facts = spark.createDataFrame([(1, "u"), (2, "u"), (3, "v")], "fact_id long, owner string")
    nodes, evidence, topics, uses = O.made_schemas(asked, facts)
    assert sorted((r["owner"], r["content"]) for r in nodes.collect()) == [("u", "a"), ("u", "a"), ("v", "e")]
    assert sorted(r["fact_id"] for r in evidence.collect()) == [1, 2, 3]
    assert topics.count() == topics.distinct().count() == 2
    assert sorted(map(tuple, uses.collect())) == [(1, 1), (2, 1), (3, 1)]
    assert {r["node_id"] for r in nodes.collect()} == {r["node_id"] for r in evidence.collect()}
    assert "Exchange" not in evidence._jdf.queryExecution().executedPlan().toString()

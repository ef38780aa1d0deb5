"""The inverted index holds what is asked for, with the statistics of whole texts."""

import pytest

from palimpsest.operators import retrieval as R


@pytest.mark.parametrize("askers", [10_000, 0])
def test_postings_hold_asked_terms_and_whole_sizes(spark, monkeypatch, askers):
    monkeypatch.setattr(R, "ASKERS", askers, raising=False)
    memory = spark.createDataFrame([("u1", "a", "cat cat dog"), ("u1", "b", "bird"), ("u1", "c", "!"), ("u2", "d", "cat"), ("u1", "a", "Cat sat on")], "user_id string, node_id string, content string")
    wanted = spark.createDataFrame([("u1", "cat"), ("u1", "cat"), ("u1", "sat"), ("u3", "cat")], "user_id string, term string")
    index, sizes = R.postings(memory, wanted)
    assert sorted(map(tuple, index.select("user_id", "node_id", "length", "term", "tf").collect())) == [("u1", "a", 3, "cat", 3), ("u1", "a", 3, "sat", 1)]
    assert list(map(tuple, sizes.select("user_id", "n", "mean_length").collect())) == [("u1", 4, 7 / 4)]

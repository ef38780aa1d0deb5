"""Fusion of vectors and words, row by row as the survey's method does it."""

import math

import pytest

from palimpsest.operators import retrieval as R


def fused(spark, **how):
    vector = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.25), (2, "a", 0.5), (3, "a", 0.5)], "query_id long, node_id string, score double")
    words = spark.createDataFrame([(1, "a", 2, 5.0), (1, "c", 2, 5.0), (2, "d", 4, 8.0), (3, "e", 1, 0.0), (4, "f", 9, 12.0)], "query_id long, node_id string, n_terms int, bm25 double")
    return {(r["query_id"], r["node_id"]): r["score"] for r in R.fuse_hybrid(vector, words, **how).collect()}


def test_rows_that_only_words_found_are_fused(spark):
    # request 1 has all kinds of rows, 2 words for another row than its vector, 3 a word hit of no weight, 4 words alone
    want = {(1, "a"): 0.6 * 0.5 + 0.4 * 0.5, (1, "b"): 0.6 * 0.25, (1, "c"): 0.4 * 0.5, (2, "a"): 0.6 * 0.5, (2, "d"): 0.4 * 0.5, (3, "a"): 0.5, (4, "f"): 0.4 * 0.5}
    assert fused(spark) == pytest.approx(want)


def test_rows_of_vectors_alone(spark):
    got = fused(spark, words_alone=False)
    assert got == pytest.approx({(1, "a"): 0.5, (1, "b"): 0.15, (2, "a"): 0.5, (3, "a"): 0.5}) and not any(map(math.isnan, got.values()))

"""The join by cosine against all pairs, and how many pairs it compares."""

import numpy as np
import pytest

from palimpsest.operators import similarity as Y

SCHEMA = "num long, user_id long, embedding array<double>"


def clustered(seed, n, dims=16, middles=40, spread=0.03):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(middles, dims))
    centre /= np.linalg.norm(centre, axis=1)[:, None]
    return [(i, i % 2, (centre[i % middles] + spread * rng.normal(size=dims)).tolist()) for i in range(n)]


def plain(rows, threshold, inclusive=False):
    out = set()
    for u in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == u and r[2] and np.linalg.norm(r[2]) > 0]
        v = np.array([r[2] for r in own])
        v /= np.linalg.norm(v, axis=1)[:, None]
        s = v @ v.T
        for i, j in zip(*np.nonzero(np.triu(s >= threshold if inclusive else s > threshold, 1))):
            out.add((min(own[i][0], own[j][0]), max(own[i][0], own[j][0])))
    return out


def groups(pairs):
    name = {}
    for a, b in pairs:
        name.setdefault(a, a), name.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            least = min(name[a], name[b])
            if name[a] != least or name[b] != least:
                name[a] = name[b] = least
                changed = True
    return name


@pytest.mark.parametrize("threshold", [0.3, 0.9, 0.97, 0.99])
def test_pairs_are_those_of_all_pairs(spark, monkeypatch, threshold):
    monkeypatch.setattr(Y, "BLOCK", 64)
    rows = clustered(1, 1200)
    rows += [(5000 + k, 0, rows[0][2]) for k in range(5)] + [(6000, 0, [0.0] * 16), (6001, 0, None), (6002, 0, []), (6003, 0, rows[0][2][:8]), (6004, 0, rows[0][2][:8]), (6005, 1, [2 * x for x in rows[1][2]])]
    whole = [r for r in rows if r[0] < 6003 or r[0] == 6005]
    want = plain(whole, threshold) | {(6003, 6004)}
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r["a"], r["b"]) for r in Y.similar_pairs(df, threshold, block=64).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r["num"]: r["group"] for r in Y.similar_groups(df, threshold, block=64).collect()} == groups(want)


def test_few_pairs_are_compared_on_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(Y, "BLOCK", 64)
    rows = [(n, 0, v) for n, _, v in clustered(2, 4000)]
    first, _ = Y.distinct_vectors(spark.createDataFrame(rows, SCHEMA), "num", ["user_id"], "embedding")
    n = sum(r["n"] for r in Y.compared_pairs(first, 0.95, block=64).collect())
    assert n < 4000 * 3999 / 2 / 5, n
    fewer = sum(r["n"] for r in Y.compared_pairs(first, 0.9, joined=True, block=64).collect())
    assert fewer < n, fewer


def test_a_hot_vector_and_a_hot_cluster_are_not_expanded(spark, monkeypatch):
    monkeypatch.setattr(Y, "BLOCK", 64)
    rng = np.random.default_rng(3)
    rows = [(i, 0, [1.0, 2.0, 3.0, 0.5]) for i in range(3000)] + [(3000 + i, 0, ([5.0, -1.0, 0.3, 2.0] + 0.001 * rng.normal(size=4)).tolist()) for i in range(1000)] + [(4000 + i, 0, rng.normal(size=4).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    first, members = Y.distinct_vectors(df, "num", ["user_id"], "embedding")
    assert first.count() == 1301 and members.count() == 4300
    found = Y.compared_pairs(first, 0.999, joined=True, block=64).collect()
    assert len(found) < 4000
    name = {r["num"]: r["group"] for r in Y.similar_groups(df, 0.999, block=64).collect()}
    assert all(name[i] == 0 for i in range(3000)) and all(name[i] == 3000 for i in range(3000, 4000))


def test_mean_cosine(spark):
    rows = clustered(4, 60)
    v = np.array([r[2] for r in rows if r[1] == 1])
    v /= np.linalg.norm(v, axis=1)[:, None]
    want = (v @ v.T)[np.triu_indices(len(v), 1)].mean()
    got = {r["user_id"]: (r["n"], r["avg_cosine"]) for r in Y.mean_cosine(spark.createDataFrame([*rows, (99, 7, rows[0][2])], SCHEMA)).collect()}
    assert got[1][0] == 30 and abs(got[1][1] - want) < 1e-12 and got[7] == (1, None)


def test_highest_cosine(spark):
    rng = np.random.default_rng(5)
    rows = [(10 * u + i, u, rng.normal(size=6).tolist()) for u in range(6) for i in range(4)]
    rows += [(100, 0, rows[0][2]), (200, 9, rows[0][2]), (201, 8, [0.0] * 6)]
    want = {}
    for u in range(6):
        v = np.array([r[2] for r in rows if r[1] == u])
        v /= np.linalg.norm(v, axis=1)[:, None]
        want[u] = (v @ v.T)[np.triu_indices(len(v), 1)].max()
    got = {r["user_id"]: r["max_cosine"] for r in Y.highest_cosine(spark.createDataFrame(rows, SCHEMA), 0.8).collect()}
    assert set(got) == set(want) and all(abs(got[u] - want[u]) < 1e-12 for u in want)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert Y.similar_pairs(df, 0.5).count() == 0 and Y.similar_groups(df, 0.5).count() == 0

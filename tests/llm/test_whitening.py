"""Whitening against numpy and against plain exact arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest

from palimpsest.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_polynomial(m):
    """Faddeev and LeVerrier, in exact fractions; constant first."""
    d = len(m)
    out, work = [1], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        work = [[sum(m[i][j] * work[j][c] for j in range(d)) + (out[-1] if i == c else 0) for c in range(d)] for i in range(d)]
        product = [[sum(m[i][j] * work[j][c] for j in range(d)) for c in range(d)] for i in range(d)]
        out.append(-sum(product[i][i] for i in range(d)) / k)
    return [int(c) for c in reversed(out)]


def held_against_numpy(rows, vectors):
    """rows of the query against eigenvectors by numpy. vectors: (id, list or None)."""
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), object)
    n, s = len(fit), fit.sum(axis=0)
    moved = (n * fit - s).astype(float)
    cov = moved.T @ moved / n / n / n
    values, basis = np.linalg.eigh(cov)
    order = np.argsort(-values)[:4]
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    assert sum(len(x) for c in got.values() for x in c.values()) == 4 * len(good)
    signs = {}
    for i, x in good:
        y = n * np.array(x, object) - s
        for k, at in enumerate(order, 1):
            r = got[i][k][0]
            want = float(y.astype(float) @ basis[:, at]) / n / math.sqrt(values[at])
            sign = signs.setdefault(k, 1 if want * r["whitened"] >= 0 else -1) if abs(want) > 1e-3 else signs.get(k, 1)
            assert r["n"] == n and r["deviation"] == sum(int(v) ** 2 for v in y)
            assert abs(sign * r["whitened"] - want) < 1e-6 * max(1, abs(want))
            assert abs(r["explained"] / (values[at] / values.sum()) - 1) < 1e-9
            assert r["identity_error"] < 1e-12


def test_polynomial_roots_and_null_space(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(-9, 9, (7, 5))
    m = [[int(v) for v in row] for row in a @ a.T]  # of rank 5
    coefficients = whitening.characteristic_polynomial(spark, m)
    assert coefficients == plain_polynomial(m)
    roots = whitening.largest_roots(coefficients, 7)
    want = sorted(np.linalg.eigvalsh(np.array(m, float)))[::-1][:5]
    assert len(roots) == 5 and np.allclose([float(r) for r in roots], want, rtol=1e-9)
    for r in roots:
        (v,) = whitening.null_space(m, r, 1)
        rest = [sum(int(x) * y for x, y in zip(row, v)) for row in m]
        assert max(abs(float(x) - float(r) * float(y)) for x, y in zip(rest, v)) < 1e-9


@pytest.mark.parametrize("size", [1, 2, 3, 6])
def test_polynomials_modulo_a_prime(size):
    rng = np.random.default_rng(size)
    for _ in range(5):
        m = rng.integers(-3, 3, (size, size)) * (rng.random((size, size)) < 0.6)
        p = 2147483647
        assert whitening.polynomial_modulo(m, p) == [c % p for c in plain_polynomial([[int(v) for v in r] for r in m])]


def test_equal_eigenvalues_have_an_orthonormal_basis(spark):
    m = [[5, 0, 0, 0], [0, 5, 0, 0], [0, 0, 5, 0], [0, 0, 0, 2]]
    roots = whitening.largest_roots(whitening.characteristic_polynomial(spark, m), 4)
    assert [float(r) for r in roots] == [5, 5, 5, 2]
    v = np.array(whitening.null_space(m, roots[0], 3), float)
    assert np.allclose(v @ v.T, np.eye(3)) and np.allclose(v[:, 3], 0)


def test_near_eigenvalues_are_told_apart(spark):
    big = 10**30
    m = [[big + 1, 0, 0], [0, big, 0], [0, 0, 3]]
    roots = whitening.largest_roots(whitening.characteristic_polynomial(spark, m), 3)
    assert roots[0] > big + Fraction(1, 2) > roots[1] and len(set(roots)) == 3
    assert np.allclose(np.array(whitening.null_space(m, roots[1], 1), float), [[0, 1, 0]])


def test_whole_table(spark, sf_dir):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    held_against_numpy(whitening.op11(spark, sf_dir).collect(), vectors)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=6) * [3, 2.5, 2, 1.5, 1, 0.5]], 0) for i in range(40)]
    same = [(100 + i, rows[0][1], 1) for i in range(30)]
    bad = [(200, None, 0), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (202, [float("nan")] * 6, 0), (203, [float("inf")] + [0.0] * 5, 0)]
    short = [(300, [0.25, -0.5], 0), (301, [], 0)]
    got = whitening.whitened(spark.createDataFrame(rows + same + bad + short, SCHEMA)).collect()
    held_against_numpy(got, [(i, v if v is None or len(v) == 6 else v + [0.0] * (6 - len(v))) for i, v, _ in rows + same + bad + short])
    assert {r["vec_id"] for r in got} == {i for i, *_ in rows + same + short}


def test_vectors_of_a_small_space_have_fewer_components(spark):
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 0) for i in range(5)], SCHEMA)
    got = whitening.whitened(line).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 5 and abs(got[0]["explained"] - 1) < 1e-12
    assert abs(sum(r["whitened"] ** 2 for r in got) / 5 - 1) < 1e-12
    equal = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], SCHEMA)
    assert whitening.whitened(equal).count() == 0
    assert whitening.whitened(equal.limit(0)).count() == 0 and whitening.whitened(equal.limit(0)).columns == whitening.whitened(line).columns


def test_names_that_clash_null_ids_and_large_entries(spark):
    df = spark.createDataFrame([(None, [1e6, -3.0], 1, 2), (None, [1e6, 5.0], 1, 2), ("b", [-4e30, 0.5], 1, 2), ("b", [7.0, 0.25], 1, 2), (None, [4e30, 5.0], 1, 2), ("c", [4e31, 5.5], 1, 2)], "component string, v array<double>, n int, whitened int")
    got = whitening.whitened(df, id_="component", vector="v").collect()
    assert len(got) == 12 and [r["component_"] for r in got].count(None) == 6 and {r["n"] for r in got} == {6}
    assert all(r["identity_error"] < 1e-6 for r in got)

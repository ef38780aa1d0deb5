"""Embedding whitening from the exact characteristic polynomial of the integer scatter.

Vectors become integers, so n^2 times their covariance is an integer matrix M. Its
characteristic polynomial is computed modulo many primes by Hessenberg reduction, one
prime at a time in Spark tasks, and put together by Chinese remainders under a proven
bound. M is positive semidefinite, so all roots are real; for such a polynomial the
sign changes of its coefficients about a point count the roots above that point
exactly, and bisection encloses the largest ones as tightly as is wanted. Inverse
iteration at an enclosed root, in long decimals, gives its null space.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.tables import documents, fresh

#: A root's bounds end up closer than 2^-TIGHT of it; roots that are closer to each other count as one multiple root.
TIGHT = 200
#: Digits of the decimals in inverse iteration: over three times those of a root's bounds.
DIGITS = 220
#: Moduli lie below this, so that products of two residues fit in 64 bits.
BELOW = 1 << 31
#: Primes of a task.
PRIMES = 16


def is_prime(n: int) -> bool:
    """Exact below 3,215,031,751."""
    if n < 2 or n % 2 == 0:
        return n == 2
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if a % n and x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(s - 1)):
            return False
    return True


def primes_over(bound: int) -> list[int]:
    """The largest primes below BELOW whose product exceeds the bound, and one more to check by."""
    found, product, p = [], 1, BELOW - 1
    while product <= bound:
        if is_prime(p):
            found.append(p)
            product *= p
        p -= 2
    while not is_prime(p):
        p -= 2
    return [*found, p]


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients, constant first, of det(x - matrix) modulo the prime p."""
    h = matrix.astype(np.int64) % p
    d = len(h)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        pivot = k + int(below[0])
        if pivot != k:
            h[[k, pivot]] = h[[pivot, k]]
            h[:, [k, pivot]] = h[:, [pivot, k]]
        c = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - c[:, None] * h[k][None, :] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * c[None, :] % p).sum(axis=1)) % p
    # of the leading blocks one after another
    rows = np.zeros((d + 1, d + 1), np.int64)
    rows[0, 0] = 1
    for k in range(1, d + 1):
        rows[k, 1:] = rows[k - 1, :-1]
        rows[k] = (rows[k] - h[k - 1, k - 1] * rows[k - 1]) % p
        chain = 1
        for i in range(k - 1, 0, -1):
            chain = chain * int(h[i, i - 1]) % p
            if not chain:
                break
            rows[k] = (rows[k] - int(h[i - 1, k - 1]) * chain % p * rows[i - 1]) % p
    return rows[d].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Integer coefficients, constant first, of det(x - matrix) of a positive semidefinite integer matrix.

    The kth of d elementary symmetric sums of roots that are not negative is at
    most C(d, k) (trace / d)^k, which bounds how many primes are needed. One
    more prime checks the result.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = max(-(-math.comb(d, k) * trace**k // d**k) for k in range(d + 1))
    moduli = primes_over(2 * bound + 1)
    cells = [[str(v) for v in row] for row in matrix]

    def residues(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = np.array([[int(v) for v in row] for row in cells], object)
        for batch in batches:
            for p in batch["p"]:
                yield pd.DataFrame({"p": [p], "c": [polynomial_modulo((whole % int(p)).astype(np.int64), int(p))]})

    jobs = spark.createDataFrame([(p,) for p in moduli], "p long").repartition(max(1, len(moduli) // PRIMES))
    found = {r["p"]: r["c"] for r in jobs.mapInPandas(residues, "p long, c array<long>").collect()}
    check, product, out = moduli.pop(), 1, [0] * (d + 1)
    for p in moduli:
        inverse = pow(product, -1, p)
        out = [c + product * ((r - c) * inverse % p) for c, r in zip(out, found[p])]
        product *= p
    out = [c - product if 2 * c > product else c for c in out]
    if [c % check for c in out] != found[check]:
        raise ArithmeticError("the polynomial differs from its residues at a further prime")
    return out


def roots_above(coefficients: list[int], shift: int, at: int) -> int:
    """How many roots, by multiplicity, of a real-rooted polynomial lie above at / 2^shift: the sign changes about that point."""
    d = len(coefficients) - 1
    c = [v << shift * (d - k) for k, v in enumerate(coefficients)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += at * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def sign_at(coefficients: list[int], shift: int, at: int) -> int:
    d, value = len(coefficients) - 1, 0
    for k in range(d, -1, -1):
        value = value * at + (coefficients[k] << shift * (d - k))
    return (value > 0) - (value < 0)


def largest_roots(coefficients: list[int], k: int, tight: int = TIGHT) -> list[Fraction]:
    """The k largest positive roots by multiplicity, falling, each within 2^-tight of itself.

    Bisection counts the roots above the middle until an interval holds a single
    one, then only looks at the sign there. Roots that are still together when
    their interval is that narrow are one multiple root.
    """
    top = 1
    while roots_above(coefficients, 0, top):
        top *= 2
    found: list[Fraction] = []
    positive = roots_above(coefficients, 0, 0)
    while len(found) < min(k, positive):
        nth, shift, low, high = len(found) + 1, 0, 0, top
        above_low, above_high = positive, 0
        # invariant: at least nth roots above low, fewer above high
        while not low or (high - low) << tight > low:
            if high - low == 1:
                low, high, shift = 2 * low, 2 * high, shift + 1
            middle = (low + high) // 2
            if low and above_low - above_high == 1:
                # one simple root in (low, high]: it is above the middle if the sign there is that at low
                here = sign_at(coefficients, shift, middle)
                odd = (-1) ** above_high
                n = above_high if here == 0 or here == odd else above_low
            else:
                n = roots_above(coefficients, shift, middle)
            if n >= nth:
                low, above_low = middle, n
            else:
                high, above_high = middle, n
        found += [Fraction(high + low, 2 << shift)] * min(above_low - above_high, k - len(found))
    return found


def null_space(matrix: list[list[int]], root: Fraction, size: int) -> list[list[decimal.Decimal]]:
    """`size` orthonormal vectors that matrix - root sends closest to zero, by inverse iteration; the largest entry of each is positive."""
    D = decimal.Decimal
    with decimal.localcontext() as context:
        context.prec = DIGITS
        d, mu = len(matrix), D(root.numerator) / D(root.denominator)
        a = [[D(v) - mu if i == j else D(v) for j, v in enumerate(row)] for i, row in enumerate(matrix)]
        least = max(abs(mu), D(1)) * D(10) ** -(DIGITS - 20)
        order = list(range(d))
        for k in range(d):
            pivot = max(range(k, d), key=lambda i: abs(a[i][k]))
            a[k], a[pivot], order[k], order[pivot] = a[pivot], a[k], order[pivot], order[k]
            if abs(a[k][k]) < least:
                a[k][k] = least
            for i in range(k + 1, d):
                if a[i][k]:
                    f = a[i][k] = a[i][k] / a[k][k]
                    above = a[k]
                    a[i][k + 1 :] = [x - f * y for x, y in zip(a[i][k + 1 :], above[k + 1 :])]

        def solved(b):
            y = [b[i] for i in order]
            for i in range(d):
                y[i] -= sum((a[i][j] * y[j] for j in range(i)), D(0))
            for i in range(d - 1, -1, -1):
                y[i] = (y[i] - sum((a[i][j] * y[j] for j in range(i + 1, d)), D(0))) / a[i][i]
            return y

        def unit(v, others):
            for _ in range(2):
                for o in others:
                    along = sum((x * y for x, y in zip(v, o)), D(0))
                    v = [x - along * y for x, y in zip(v, o)]
            length = sum((x * x for x in v), D(0)).sqrt()
            return [x / length for x in v]

        found: list = []
        for nth in range(size):
            # a fixed start that no plane is likely to hold
            v = unit([D(1) + D((i * 7919 + nth * 104729 + 17) % 1009) / D(1009) for i in range(d)], found)
            for _ in range(4):
                v = unit(solved(v), found)
            peak = max(v, key=abs)
            found.append([-x for x in v] if peak < 0 else v)
        return found


def integers(vector: Column) -> Column:
    """floor(256 c) of each entry as long; null if the vector or an entry is null or no finite number."""
    entry = lambda c: c.cast("double")
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(entry(c)) | (F.abs(entry(c)) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda c: F.floor(entry(c) * 256).cast("long")))


def matrix_of(column: pa.Array, d: int) -> np.ndarray:
    """A row for each list of longs, ended with zeros up to d entries."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.arange(d)[None, :] < sizes[:, None]] = flat
    return out


def exact_products(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Sums of x and of x_i x_j (the upper triangle by rows), exact: in doubles where no sum can pass 2^53, else in Python's integers."""
    upper = np.triu_indices(x.shape[1])
    most = int(np.abs(x.astype(float)).max(initial=0)) + 1
    if most * most * len(x) < 1 << 53:
        y = x.astype(np.float64)
        return [int(v) for v in y.sum(axis=0)], [int(v) for v in (y.T @ y)[upper]]
    y = x.astype(object)
    return list(y.sum(axis=0)), list((y.T @ y)[upper])


def scatter(fit: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, per-dimension sums, and the sums of products of the vectors `x` of fit: d (d + 3) / 2 sums from each task are added by Spark, and only these reach the driver."""
    width = d * (d + 1) // 2

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (1 + d + width)
        for batch in batches:
            x = matrix_of(batch.column(0), d)
            one, two = exact_products(x)
            total = [a + b for a, b in zip(total, [len(x), *one, *two])]
        if total[0]:
            high, low = zip(*(divmod(v, 10**18) for v in total))
            yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(total)), pa.int32()), "high": pa.array(map(str, high), pa.string()), "low": pa.array(low, pa.int64())})

    parts = fit.select("x").mapInArrow(sums, "place int, high string, low long").withColumn("high", F.col("high").cast("decimal(38,0)")).withColumn("low", F.col("low").cast("decimal(18,0)"))
    found = {r["place"]: int(r["high"]) * 10**18 + int(r["low"]) for r in parts.groupBy("place").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()}
    upper = iter(found.get(1 + d + i, 0) for i in range(width))
    products = [[0] * d for _ in range(d)]
    for i in range(d):
        for j in range(i, d):
            products[i][j] = products[j][i] = next(upper)
    return found.get(0, 0), [found.get(1 + i, 0) for i in range(d)], products


def whitened(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """A row for each vector and component up to `components`: the id, component, n, deviation, whitened, explained, identity_error.

    Entries become floor(256 c). The components are fitted on each distinct
    vector once; all rows are projected, repeated ones as often as they come.
    identity_error is of the covariance of what the doubles used here give over
    the fit list, computed exactly. Equal eigenvalues have some orthonormal
    basis, the same in every run.

    Rows with a null vector, or with null or non-finite entries, are left out;
    vectors shorter than the longest count as ended with zeros. A null id stays
    null, and rows that share an id stay rows of their own. Directions without
    any variance can't be whitened and have no rows, so fewer components come
    from vectors that lie in a smaller space, and none if all are equal or the
    table is empty. A deviation that no long can hold is null; entries beyond a
    long's range are held to it. Other columns are not read. The driver holds
    the scatter of d dimensions, d^2 numbers, whatever the number of rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_).alias("id"), integers(F.col(vector)).alias("x")).where("x is not null")
    kind = rows.schema["id"].dataType
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    n, sums, products = 0, [], []
    if d:
        padded = F.when(F.size("x") < d, F.concat("x", F.array_repeat(F.lit(0).cast("long"), d - F.size("x")))).otherwise(F.col("x"))
        rows = rows.withColumn("x", padded)
        n, sums, products = scatter(rows.select("x").distinct(), d)
    matrix = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    trace = sum(matrix[i][i] for i in range(d))
    roots = largest_roots(characteristic_polynomial(spark, matrix), min(components, d)) if trace else []
    basis = [v for root in dict.fromkeys(roots) for v in null_space(matrix, root, roots.count(root))]
    with decimal.localcontext() as context:
        context.prec = DIGITS
        weights = [[float(x / (decimal.Decimal(e.numerator) / decimal.Decimal(e.denominator)).sqrt()) for x in v] for v, e in zip(basis, roots)]
    explained = [float(e / trace) for e in roots]
    error = Fraction(0)
    for i, u in enumerate(weights):
        along = [sum(Fraction(a) * m for a, m in zip(u, row)) for row in matrix]
        for j, v in enumerate(weights[: i + 1]):
            error = max(error, abs(sum(a * Fraction(b) for a, b in zip(along, v)) - (i == j)))
    k, error = len(weights), float(error)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(weights).T
        reach = max(map(abs, sums), default=0)
        for batch in batches:
            x = matrix_of(batch.column(1), d)
            most = n * (int(np.abs(x.astype(float)).max(initial=0)) + 1) + reach
            if most * most * d < 1 << 62:
                moved = n * x - np.array(sums, np.int64)
                deviations = (moved * moved).sum(axis=1).tolist()
            else:
                moved = n * x.astype(object) - np.array(sums, object)
                deviations = [v if v < 1 << 63 else None for v in (moved * moved).sum(axis=1)]
            values = moved.astype(np.float64) @ w
            for lo in range(0, len(x), 4096):
                part = slice(lo, lo + 4096)
                size = len(values[part])
                nth = np.repeat(np.arange(size), k)
                out = {
                    "id": batch.column(0).slice(lo, size).take(pa.array(nth)),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                    "deviation": pa.array(deviations[part], pa.int64()).take(pa.array(nth)),
                    "whitened": pa.array(values[part].ravel()),
                    "explained": pa.array(np.tile(np.array(explained), size)),
                }
                yield pa.RecordBatch.from_pydict(out)

    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, t) for c, t in (("component", T.IntegerType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType())))])
    out = rows.mapInArrow(projected, schema) if k else spark.createDataFrame([], schema)
    name = fresh(spark.createDataFrame([], "component int, n long, deviation long, whitened double, explained double, identity_error double"), id_)
    return out.select(F.col("id").alias(name), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whitened, of all vectors."""
    return whitened(documents(spark, sf_dir, "embeddings"))

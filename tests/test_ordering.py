"""Order statistics, running sums and interval joins against plain versions."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.intervals import as_of
from palimpsest.operators.ordering import running
from palimpsest.operators.orderstats import order_statistics


@pytest.mark.parametrize("ranges,ranked", [(4, 0), (16, 30), (1024, 10_000)])
def test_order_statistics(spark, ranges, ranked):
    rng = random.Random(ranges)
    rows = [("a", rng.lognormvariate(0, 4)) for _ in range(500)] + [("b", 7.0)] * 400 + [("b", -1e300), ("b", 1e300)] + [(None, float(i % 3)) for i in range(50)] + [("c", 5.0), ("d", None), ("e", float("nan")), ("e", 2.0)]
    groups = {}
    for k, v in rows:
        if v is not None and v == v:
            groups.setdefault(k, []).append(v)
    got = order_statistics(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"half": F.floor(F.col("n") / 2), "high": F.floor(0.95 * F.col("n")), "tenth": F.lit(10)}, ranges, ranked).collect()
    want = {k: (len(v), sorted(v)[len(v) // 2], sorted(v)[int(0.95 * len(v))], sorted(v)[10] if len(v) > 10 else None) for k, v in groups.items()}
    assert {r["k"]: (r["n"], r["half"], r["high"], r["tenth"]) for r in got} == want and len(got) == len(want)


def test_no_window_over_a_group(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"))
    plan = order_statistics(df, ["k"], "v", {"half": F.floor(F.col("n") / 2)})._jdf.queryExecution().toString()
    assert "Window" not in plan and "NestedLoop" not in plan


def test_running_sums_carry_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), i, rng.randrange(5)) for i in range(2000)]
    got = running(spark.createDataFrame(rows, "k string, at long, v long").repartition(7), ["k"], [F.col("at").desc()], {"sum": F.col("v"), "place": F.lit(1)}).collect()
    sums, want = {}, {}
    for k, at, v in sorted(rows, key=lambda r: -r[1]):
        want[at] = tuple(sums.get(k, (0, 0)))
        sums[k] = (want[at][0] + v, want[at][1] + 1)
    assert {r["at"]: (r["sum"], r["place"]) for r in got} == want


def test_intervals_meet_instants_once(spark):
    rng, t0 = random.Random(3), datetime.datetime(2020, 1, 1)
    at = lambda s: None if s is None else t0 + datetime.timedelta(seconds=s)
    rows = []
    for i in range(300):
        a = rng.randrange(-10**6, 10**8)
        rows.append((i, at(a if i % 17 else None), at(a + rng.choice([0, 1, 60, 3600, 10**5, 10**7, 10**9]) if i % 11 else None)))
    rows += [(500, at(5), at(5)), (501, at(9), at(5)), (502, at(7), at(8)), (502, at(7), at(8))]
    instants = [(k, at(rng.randrange(0, 10**8))) for k in range(60)] + [(90, at(7)), (91, at(7)), (92, None), (93, at(5)), (94, at(8))]
    df, points = spark.createDataFrame(rows, "id long, valid_from timestamp, valid_until timestamp"), spark.createDataFrame(instants, "k long, at timestamp")
    out = as_of(df, points)
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    want = sorted((i, k) for i, a, b in rows for k, t in instants if t is not None and (a is None or a <= t) and (b is None or t < b))
    assert sorted((r["id"], r["k"]) for r in out.collect()) == want
    assert as_of(df, points.limit(0)).count() == 0 and as_of(df.limit(0), points).count() == 0

"""Joins of intervals with instants, as equi-joins over bins of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.lineage import fresh, written

#: Microseconds of the narrowest bins; each level's are twice as wide as those below.
NARROWEST = 3_600_000_000


def as_of(rows: DataFrame, instants: DataFrame, valid_from: str = "valid_from", valid_until: str = "valid_until", at: str = "at", narrowest: int = NARROWEST) -> DataFrame:
    """Rows with each instant at which they are valid: valid_from <= at < valid_until.

    A null valid_until is open, and a null valid_from has always been valid.
    Intervals are cut to the time that instants span. An interval lies on the
    level whose bins are as wide as it or wider, so in two bins at most; an
    instant looks up its bin on each level that has intervals. So long and short
    intervals meet instants by an equi-join, and each pair once. Null instants
    meet nothing; repeated ones and repeated rows count as often as they come.
    All columns of both sides stay; names must differ.
    """
    low, high, level, bin_ = (fresh(rows.crossJoin(instants.limit(0)), c) for c in ("low", "high", "level", "bin"))
    points = written(instants.where(F.col(at).isNotNull()), "instants")
    span = points.agg(F.unix_micros(F.min(at)).alias("a"), F.unix_micros(F.max(at)).alias("b")).first()
    a, b = (span["a"], span["b"] + 1) if span["a"] is not None else (0, 0)
    begin, end = F.unix_micros(F.col(valid_from).cast("timestamp")), F.unix_micros(F.col(valid_until).cast("timestamp"))
    cut = rows.withColumn(low, F.greatest(F.coalesce(begin, F.lit(a)), F.lit(a))).withColumn(high, F.least(F.coalesce(end, F.lit(b)), F.lit(b))).where(F.col(low) < F.col(high))
    width = lambda lev: F.lit(narrowest).cast("long") * F.pow(F.lit(2.0), lev).cast("long")
    cut = cut.withColumn(level, F.greatest(F.lit(0), F.ceil(F.log2((F.col(high) - F.col(low)) / narrowest)) + 1).cast("int"))
    first, last = (F.floor(x / width(F.col(level))).cast("long") for x in (F.col(low), F.col(high) - 1))
    binned = written(cut.withColumn(bin_, F.explode(F.sequence(first, last))), "intervals")
    # there are as many levels as doublings of the narrowest bin in the time spanned
    levels = sorted(r[0] for r in binned.select(level).distinct().collect())
    t = F.unix_micros(F.col(at).cast("timestamp"))
    probes = points.withColumn(level, F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn(bin_, F.floor(t / width(F.col(level))).cast("long"))
    met = binned.join(probes.hint("merge"), [level, bin_]).where((t >= F.col(low)) & (t < F.col(high)))
    return met.select(*rows.columns, *instants.columns)

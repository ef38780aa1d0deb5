"""Running sums along an order, however many rows share a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.lineage import fresh, written


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], name: str = "ordered") -> DataFrame:
    """df with, for each entry of `sums`, the sum of its column over the rows before it in `order` among those of its `by` (0 for the first).

    Rows are dealt by ranges of `by` and `order`, so a key with any share of the
    rows is dealt over many tasks; the sums of whole ranges are carried over.
    Rows that are equal in `by` and `order` stay in one range: aggregate such
    rows before, or end `order` by what tells them apart. Columns of `by` hold
    no nulls.
    """
    part = fresh(df, "part")
    dealt = written(df.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()), name)
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    names = {}
    for k in sums:
        names[k] = fresh(dealt, f"{k}_before")
    parts = dealt.groupBy(*by, part).agg(*(F.sum(v).alias(names[k]) for k, v in sums.items()))
    parts = parts.select(*by, part, *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in names.values()))
    out = dealt.join(parts.hint("merge"), [*by, part])
    return out.select(*df.columns, *((F.col(names[k]) + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(k) for k, v in sums.items()))

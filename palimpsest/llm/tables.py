"""The given tables, and the helpers that this subpackage shares with the rest of the library."""

from __future__ import annotations

from collections.abc import Callable, Hashable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.lineage import fresh, shared_dir, written

__all__ = ["alone", "documents", "fresh", "in_order", "in_short_batches", "resident", "shared_dir", "written"]

#: Rows that go to a Python worker at a time: texts may be long.
BATCH = 1000

_resident: dict = {}


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def resident(key: Hashable, make: Callable):
    """What make() gives, kept in a Python worker under its key until another is asked for: models of several operators never lie in memory together."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def alone() -> None:
    """Lets go of what resident() keeps, in a worker whose task needs no model."""
    _resident.clear()


def in_order(df: DataFrame, name: str) -> DataFrame:
    """df with a column of positions: the order of its rows in the numbered files that it was written to, or that of its partitions if it comes from no file."""
    # files are told from one another by the bits above the 26th
    try:
        file, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
        number = F.coalesce(F.regexp_extract(file, r"part-([0-9]+)", 1).try_cast("long"), F.lit(0))
        return df.select("*", (number * (1 << 26) + row).alias(name))
    except AnalysisException:
        every = F.monotonically_increasing_id()
        return df.withColumn(name, every).withColumn(name, F.shiftright(name, 33) * (1 << 26) + F.col(name).bitwiseAND((1 << 33) - 1))


def in_short_batches(df: DataFrame) -> DataFrame:
    """df, in a session that hands at most BATCH rows to Python at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH:
        df.sparkSession.conf.set(key, str(BATCH))
    return df

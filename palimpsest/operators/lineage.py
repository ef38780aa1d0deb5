"""Tables that cut a job's lineage, and column names that clash with nothing."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which spark.checkpoint.dir names.

    A local session without one gets a temporary folder; on a cluster executors
    could not see that, so a session without one is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark's setting by which shuffle files go with the query that made them, not when the driver happens to collect its garbage.
RELEASE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder: later stages neither recompute them nor guess their size.

    What was shuffled for them is deleted once they are written.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with settings(df.sparkSession, **RELEASE):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task gets, about.
SHARE = 500_000


def parts(df: DataFrame, least: int = 8) -> int:
    """How many tasks the rows of a stored table are work for: given to repartition, it keeps a task's rows few at any size, where bytes of well compressed ones would not."""
    return max(least, df.count() // SHARE)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def appended(batches: list[DataFrame], name: str) -> DataFrame:
    """A log in the shared folder to which the batches are appended one after another."""
    first = batches[0]
    path = f"{shared_dir(first.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for batch in batches:
        batch.write.mode("append").parquet(path)
    return first.sparkSession.read.schema(first.schema).parquet(path)


def file_system(spark: SparkSession, place: str):
    """Hadoop's file system of a place, and the place as its path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def folders(spark: SparkSession, place: str) -> list[str]:
    """Names of the folders in a place; none if it isn't there."""
    fs, path = file_system(spark, place)
    return sorted(x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory()) if fs.exists(path) else []


def size_of(spark: SparkSession, place: str) -> int:
    """Bytes of all files in a place."""
    fs, path = file_system(spark, place)
    return fs.getContentSummary(path).getLength()


def removed(spark: SparkSession, place: str) -> None:
    """Deletes a folder that this library has written."""
    fs, path = file_system(spark, place)
    fs.delete(path, True)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """The session with some settings, and afterwards with its own again."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dropped(*tables: DataFrame) -> None:
    """Deletes what written() has written, once nothing that is still to be computed reads it."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            removed(df.sparkSession, folder)

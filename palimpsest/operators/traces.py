"""What was logged for a request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def full_trace(steps: DataFrame, operations: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, kind, id, what, at, nth): steps and operations of the requests in the order of time, ties by id."""
    wanted = requests.select("request_id").distinct()
    a = steps.select("request_id", F.lit("step").alias("kind"), "id", F.col("step").alias("what"), "at")
    b = operations.select("request_id", F.lit("op").alias("kind"), "id", F.col("op").alias("what"), F.col("created_at").alias("at"))
    rows = a.unionByName(b).join(wanted, "request_id", "left_semi")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("request_id").orderBy("at", "id", "kind")))


def read_trace(steps: DataFrame) -> DataFrame:
    """(request_id, step, n, details, reader, summary_id) of a request's READ_ steps.

    details holds the parsed JSON of each in order; what is no JSON is left
    out. reader is the first version that a step names, summary_id the last
    READ_SUMMARY.
    """
    reads = steps.where(F.col("step").startswith("READ_")).withColumn("json", F.when(F.try_parse_json("parsed").isNotNull(), F.col("parsed")))
    reads = reads.withColumn("version", F.get_json_object("json", "$._reader"))
    per = reads.groupBy("request_id", "step").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("json").isNotNull(), F.struct("id", "json")))), lambda x: x["json"]).alias("details"))
    about = reads.groupBy("request_id").agg(F.min_by("version", F.when(F.col("version").isNotNull(), F.col("id"))).alias("reader"), F.max(F.when(F.col("step") == "READ_SUMMARY", F.col("id"))).alias("summary_id"))
    return per.join(about, "request_id")

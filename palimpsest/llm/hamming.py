"""Exact top-k search in binary codes by incremental multi-index hashing.

A 64-bit code is cut into m segments, of about as many bits as the number of
codes has, so that a value of a segment has about one code. If no segment of
two codes differs in r bits or fewer, the codes differ in m (r + 1) bits or
more. So a query looks up, segment by segment, what differs from its own in
exactly r bits, for r = 0, 1, ...; as soon as its kth best verified distance is
covered by the radius it has looked up, nothing closer can be missing.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.tables import documents, written

#: Bits of a code; segments at least, so that a mask has 22 bits at most, and at most.
BITS, FEWEST, MOST = 64, 3, 8


def sign_code(vector: Column) -> Column:
    """Bit i is set if component i is above 0, for the first 64 components (the code has no more bits); null for a null vector, and no bit for a null component."""
    bits = [F.when(F.get(vector, F.lit(i)) > 0, F.lit((1 << i) - (1 << 64 if i == 63 else 0))).otherwise(F.lit(0)).cast("long") for i in range(BITS)]
    code = bits[0]
    for b in bits[1:]:
        code = code.bitwiseOR(b)
    return F.when(vector.isNotNull(), code)


def widths(n_codes: int) -> list[int]:
    """Bits of each segment: about log2 of the number of codes, and as even as can be."""
    m = min(MOST, max(FEWEST, round(BITS / max(1.0, math.log2(max(n_codes, 1))))))
    return [BITS // m + (i < BITS % m) for i in range(m)]


def masks(spark: SparkSession, sizes: set[int], radius: int) -> DataFrame:
    """(width, mask) with the masks of exactly `radius` bits of each width: of 22 bits 705,432 at most."""
    each = [spark.range(1 << w).where(F.bit_count("id") == radius).select(F.lit(w).alias("width"), F.col("id").cast("int").alias("mask")) for w in sorted(sizes)]
    return reduce(DataFrame.unionByName, each)


def segments(df: DataFrame, sizes: list[int]) -> DataFrame:
    """df with a row for each segment of its code: segment, width, value."""
    cut = lambda i: F.shiftrightunsigned("code", sum(sizes[:i])).bitwiseAND((1 << sizes[i]) - 1).cast("int")
    each = F.array(*(F.struct(F.lit(i).alias("segment"), F.lit(w).alias("width"), cut(i).alias("value")) for i, w in enumerate(sizes)))
    return df.select("*", F.explode(each).alias("s")).select("*", "s.segment", "s.width", "s.value").drop("s")


def nearest(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, id, distance): the k rows of `codes` closest to each query, ties by smallest id.

    Both tables have id (long) and code (long). A query that is itself a row of
    codes finds itself. Rows without a code or an id are neither found nor
    asked for. Equal codes are indexed once, with their k smallest ids: no
    others can be among the k best. Fewer than k rows give all of them. Queries
    that share an id are one query if their codes are equal too.
    """
    spark = codes.sparkSession
    known = codes.select("id", "code").where("id is not null and code is not null")
    smallest = known.select("*", F.row_number().over(Window.partitionBy("code").orderBy("id")).alias("nth")).where(F.col("nth") <= k)
    members = written(smallest.select("code", "nth", "id"), "members")
    distinct = members.where("nth = 1").select("code", F.col("id").alias("least_id"))
    n_codes = distinct.count()
    sizes = widths(n_codes)
    index = written(segments(distinct, sizes).select("segment", "value", F.col("code").alias("found"), "least_id"), "segments")
    asked = queries.select(F.col("id").alias("query_id"), "code").where("id is not null and code is not null").distinct()
    # a row without `found` stands for its query until that is settled
    open_, done = written(asked.withColumns({"found": F.lit(None).cast("long"), "least_id": F.lit(None).cast("long"), "distance": F.lit(None).cast("int"), "worst": F.lit(BITS)}), "queries"), []
    by_query = Window.partitionBy("query_id", "code")
    for radius in range(max(sizes) + 1):
        if open_.isEmpty():
            break
        probes = segments(open_.where("found is null").select("query_id", "code", "worst"), sizes).join(F.broadcast(masks(spark, set(sizes), radius)), "width").select("query_id", "code", "worst", "segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
        # verified within the join: what is beyond the k best so far never leaves it
        distance = F.bit_count(F.col("code").bitwiseXOR(F.col("found")))
        same = (F.col("p.segment") == F.col("i.segment")) & (F.col("p.value") == F.col("i.value")) & (distance <= F.col("worst"))
        hits = probes.hint("shuffle_hash").alias("p").join(index.alias("i"), same).select("query_id", "code", "found", "least_id", distance.alias("distance"))
        # the k closest codes (ties by their smallest ids) hold the k closest rows, so no more need be carried on
        ranked = hits.unionByName(open_.drop("worst")).distinct().withColumn("nth", F.row_number().over(by_query.orderBy(F.col("distance").asc_nulls_first(), "least_id"))).where(F.col("nth") <= k + 1)
        proven = (F.count("found").over(by_query) >= min(k, n_codes)) & (F.max("distance").over(by_query) <= len(sizes) * (radius + 1) - 1)
        worst = F.when(F.count("found").over(by_query) >= k, F.max("distance").over(by_query)).otherwise(F.lit(BITS))
        state = written(ranked.withColumn("worst", worst).withColumn("settled", F.coalesce(proven, F.lit(False)) if radius < max(sizes) else F.lit(True)).drop("nth"), "best")
        done.append(state.where("settled and found is not null").drop("settled", "worst"))
        open_ = state.where("not settled").drop("settled")
    codes_found = reduce(DataFrame.unionByName, done) if done else open_
    rows = codes_found.drop("least_id").join(members.select(F.col("code").alias("found"), "id").hint("merge"), "found")
    order = Window.partitionBy("query_id", "code").orderBy("distance", "id")
    return rows.select("query_id", "code", F.row_number().over(order).alias("rank"), "id", "distance").where(F.col("rank") <= k).drop("code")


def op7(spark: SparkSession, sf_dir: str, k: int = 10, every: int = 100) -> DataFrame:
    """The k nearest of all rows by the signs of their vectors. Queries are the rows whose id is divisible by `every`."""
    codes = written(documents(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code")), "codes")
    found = nearest(codes, codes.where(F.col("id") % every == 0), k)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


SQL = """
WITH codes AS (
  SELECT vec_id, (SELECT bit_or(1::UBIGINT << i::UBIGINT) FROM range(64) r(i) WHERE embedding[i + 1] > 0) AS code FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code)) AS distance FROM codes q, codes c WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""

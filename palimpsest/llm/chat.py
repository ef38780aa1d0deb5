"""Chat formatting after the collapse of cumulative snapshots, by DataFrame functions alone.

A chat log often holds the same conversation again and again as it grows. Each
turn has a hash of its place and content, and the running sums of these are a
hash of every prefix. A conversation whose hash is that of another one's proper
prefix is dropped by an anti-join, and of equal ones the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.tables import documents, written

#: Turns of a block: running sums and rendered texts are made for each block, then carried over blocks.
BLOCK = 64
#: Turns that a rendered row has at most; longer conversations have several rows.
PART = 4096
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def numbered(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(conv_id, at, role, text): turns in order of turn, role, text, numbered from 0; nulls come first.

    Blocks of turn numbers are counted first, so that a very long conversation
    is numbered by many tasks.
    """
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))).cast("long"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    counts = counts.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = rows.join(counts.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return placed.select("conv_id", (F.col("first") + F.row_number().over(inside) - 1).alias("at"), "role", "text")


def prefixes(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, n, h1, h2): for each turn, how many turns there are up to it, and two 64-bit hashes of all of them.

    A turn's hashes depend on its place, role and text. Their halves of 32 bits
    are summed by themselves, first within a block of turns, then over blocks.
    """
    halves = {}
    for name, seed in (("h1", 1), ("h2", 2)):
        h = F.xxhash64(F.lit(seed), "at", "role", "text")
        halves |= {f"{name}_low": h.bitwiseAND(0xFFFFFFFF), f"{name}_high": F.shiftrightunsigned(h, 32)}
    rows = rows.select("conv_id", "at", F.floor(F.col("at") / block).cast("long").alias("block"), *(v.alias(k) for k, v in halves.items()))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "block").agg(*(F.sum(k).alias(k) for k in halves))
    sums = sums.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before") for k in halves))
    inside = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(sums.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    joined = joined.select("conv_id", (F.col("at") + 1).alias("n"), *((F.col(f"{k}_before") + F.sum(k).over(inside)).alias(k) for k in halves))
    return joined.select("conv_id", "n", F.xxhash64("h1_low", "h1_high").alias("h1"), F.xxhash64(F.lit(3), "h2_low", "h2_high").alias("h2"))


def maximal(turns: DataFrame, **names) -> tuple[DataFrame, DataFrame]:
    """Numbered turns, and (conv_id, n_turns, n_copies) of the conversations that are no proper prefix of another; of equal ones the smallest id (null before all)."""
    rows = written(numbered(turns, **names), "turns")
    steps = written(prefixes(rows), "prefixes")
    lengths = rows.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("n_turns"))
    steps = steps.join(lengths.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c")))
    # copies of a conversation, and of a prefix, become one row before they meet
    whole = steps.where("n = n_turns").groupBy("n", "h1", "h2").agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id")).alias("kept"), F.count("*").alias("n_copies"))
    inner = steps.where("n < n_turns").select("n", "h1", "h2").distinct()
    kept = whole.join(inner.hint("merge"), ["n", "h1", "h2"], "left_anti")
    return rows, kept.select(F.col("kept.conv_id").alias("conv_id"), F.col("n").alias("n_turns"), "n_copies")


def rendered(turns: DataFrame, part: int = PART, **names) -> DataFrame:
    """(conv_id, part, n_turns, n_copies, text): the chat text of each conversation that no longer one contains as its beginning.

    A turn is rendered as `<|im_start|>role`, a line end, the text, `<|im_end|>`
    and a line end. A null role is `unknown`, a null text empty. Turns that
    share a number follow one another by role and text, repeated turns stay,
    turns without a number come first, and rows without a conv_id are one
    conversation. Conversations of over `part` turns have one row for each
    `part` turns, so no row gathers without bound. n_copies counts equal
    conversations. An empty table gives an empty table; other columns are not read.
    """
    rows, kept = maximal(turns, **names)
    kept = kept.withColumnRenamed("conv_id", "kept_id")
    rows = rows.join(kept.hint("merge"), F.col("conv_id").eqNullSafe(F.col("kept_id")))
    line = F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE))
    rows = rows.select("conv_id", "n_turns", "n_copies", F.floor(F.col("at") / part).cast("long").alias("part"), "at", line.alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("at", "line")))
    return rows.groupBy("conv_id", "part", "n_turns", "n_copies").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("text"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rendered, of all conversations."""
    return rendered(documents(spark, sf_dir, "conversations"))


SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS place,
         '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line
  FROM conversations),
whole AS (SELECT conv_id, count(*) AS n, list(line ORDER BY place) AS lines FROM turns GROUP BY conv_id),
prefix AS (
  SELECT DISTINCT list_slice(w.lines, 1, t.place + 1) AS lines FROM whole w JOIN turns t ON t.conv_id = w.conv_id WHERE t.place + 1 < w.n),
kept AS (
  SELECT min(conv_id) AS conv_id, count(*) AS n_copies FROM whole
  WHERE NOT EXISTS (SELECT 1 FROM prefix WHERE prefix.lines = whole.lines) GROUP BY lines)
SELECT t.conv_id, t.place // 4096 AS part, w.n AS n_turns, k.n_copies, string_agg(t.line, '' ORDER BY t.place) AS text
FROM turns t JOIN kept k ON k.conv_id = t.conv_id JOIN whole w ON w.conv_id = t.conv_id GROUP BY 1, 2, 3, 4
"""

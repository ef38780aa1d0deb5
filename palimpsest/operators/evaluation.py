"""Measures of retrieval and answers over judged questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The category of questions that have no evidence; it counts in no measure of hits.
ADVERSARIAL = 5


def evaluation(questions: DataFrame, ks: tuple = (1, 5, 10)) -> DataFrame:
    """A row for each category and, with a null category, one for all: counts and means, rounded to 4 digits, times to 2.

    questions(category, correct, coverage, elapsed_ms, and for each k hit_k,
    exact_k, recall_k). A missing hit or verdict counts as wrong, a missing time
    as 0; a null exact hit, recall or coverage is left out of its mean, which is
    null if nothing is left. Adversarial questions count in n, accuracy,
    coverage and time alone. All measures come from one aggregation.
    """
    answerable = F.col("category") != ADVERSARIAL
    share = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    mean = lambda v, digits=4: F.round(F.avg(v), digits)
    measures: list[Column] = [F.count("*").alias("n"), mean(share("correct")).alias("accuracy")]
    for k in ks:
        measures += [
            mean(F.when(answerable, share(f"hit_{k}"))).alias(f"hit{k}"),
            mean(F.when(answerable, F.col(f"exact_{k}").cast("double"))).alias(f"exact{k}"),
            mean(F.when(answerable, F.col(f"recall_{k}").cast("double"))).alias(f"recall{k}"),
        ]
    measures += [mean(F.col("coverage").cast("double")).alias("coverage"), mean(share("elapsed_ms"), 2).alias("mean_ms")]
    return questions.rollup("category").agg(*measures)


def recalls(gold: DataFrame, hits: DataFrame, ks: tuple = (1, 5, 10)) -> DataFrame:
    """(question_id, and for each k hit_k, exact_k, recall_k) of gold(question_id, evidence) and hits(question_id, rank, evidence).

    recall_k is the share of a question's gold evidence that hits of rank up to
    k bear, hit_k whether there is any, exact_k whether that is all. Evidence
    counts once, at its first rank. Questions without gold have no row.
    """
    wanted = gold.select("question_id", "evidence").where("evidence is not null").distinct()
    first = hits.groupBy("question_id", "evidence").agg(F.min("rank").alias("rank"))
    met = wanted.join(first.hint("merge"), ["question_id", "evidence"], "left")
    shares = met.groupBy("question_id").agg(*(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"recall_{k}") for k in ks))
    return shares.select("question_id", *(c for k in ks for c in ((F.col(f"recall_{k}") > 0).alias(f"hit_{k}"), (F.col(f"recall_{k}") >= 1).alias(f"exact_{k}"), f"recall_{k}")))

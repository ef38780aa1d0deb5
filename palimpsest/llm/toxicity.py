"""Toxicity by a chain of linear classifiers.

Categories are labels, predicted one after the other. Each is a logistic model
over the words that a text has and over the probabilities of the categories
before it. For fitting, those come from models that haven't seen the row (out of
fold), so later models learn how far earlier ones can be trusted. Rows of equal
words, such as copies of a text, are in one fold.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.tables import alone, documents, fresh, in_short_batches, written

#: Labelled documents that are fitted on at most, words of the vocabulary at most, folds, steps of a fit.
SAMPLE_DOCS, WORDS, FOLDS, STEPS = 6000, 2000, 3, 100
#: Chi-square that a word needs: none of some hundred thousand words of no meaning is expected to pass.
CHANCE = 22.0
#: Categories in the order of the chain, as expressions over the table of labels; the last one makes the decision.
CATEGORIES = {"junk": "1 - quality", "toxic": "toxic"}
_word = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    """Words, and the beginnings of longer ones, which inflected and compound words share."""
    words = set(_word.findall(text.lower()))
    return words | {f"{w[:5]}*" for w in words if len(w) > 5} | {f"{w[:7]}*" for w in words if len(w) > 7}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Linear:
    """Logistic regression on a sparse 0/1 matrix (rows, cols of its ones) and a few dense columns."""

    def fit(self, rows: np.ndarray, cols: np.ndarray, width: int, dense: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rate: float = 0.15) -> Linear:
        n, m = dense.shape
        mean = np.clip(y.mean() if n else 0.0, 1e-3, 1 - 1e-3)
        w = np.zeros(width + m + 1)
        w[-1] = np.log(mean / (1 - mean))
        first, second = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, STEPS + 1):
            z = np.bincount(rows, w[cols], n) + dense @ w[width:-1] + w[-1]
            r = (sigmoid(z) - y) / max(n, 1)
            g = np.r_[np.bincount(cols, r[rows], width), dense.T @ r, r.sum()]
            g[:-1] += ridge * w[:-1]
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        self.words, self.dense, self.bias = w[:width], w[width:-1], w[-1]
        return self

    def probability(self, rows: np.ndarray, cols: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return sigmoid(np.bincount(rows, self.words[cols], len(dense)) + dense @ self.dense + self.bias)


class Chain:
    """Models of the categories in their order; the last one's threshold makes the decision. A target may be NaN: the row then teaches that category nothing."""

    def __init__(self, names: list[str], vocabulary: list[str], texts: list[set[str]], targets: np.ndarray, folds: np.ndarray | None = None):
        self.names, self.models, self.threshold = names, [], 0.5
        self.vocabulary = {w: i for i, w in enumerate(vocabulary)}
        rows, cols = self._ones(texts)
        n, width = len(texts), len(self.vocabulary)
        fold, before = (np.arange(n) if folds is None else folds) % FOLDS, np.zeros((n, 0))
        for c in range(len(names)):
            y, unseen = targets[:, c], np.zeros(n)
            known = ~np.isnan(y)
            for f in range(FOLDS):
                learn, hold = np.flatnonzero((fold != f) & known), np.flatnonzero(fold == f)
                if not len(learn) or not len(hold):
                    continue
                model = Linear().fit(*self._part(rows, cols, learn, n), width, before[learn], y[learn])
                unseen[hold] = model.probability(*self._part(rows, cols, hold, n), before[hold])
            learn = np.flatnonzero(known)
            self.models.append(Linear().fit(*self._part(rows, cols, learn, n), width, before[learn], y[learn]))
            before = np.c_[before, unseen]
        last = targets[:, -1]
        if len(names) and np.nanmax(last, initial=0) > 0 and np.nanmin(last, initial=1) < 1:
            judged = ~np.isnan(last)
            order = np.flatnonzero(judged)[np.argsort(-before[judged, -1], kind="stable")]
            p, hit = before[order, -1], last[order].cumsum()
            f1 = 2 * hit / (np.arange(len(order)) + 1 + hit[-1])
            best = int(f1.argmax())
            self.threshold = float((p[best] + p[min(best + 1, len(order) - 1)]) / 2)
            self.f1 = float(f1[best])

    def _ones(self, texts: Iterable[set[str]]) -> tuple[np.ndarray, np.ndarray]:
        """One text's words are held at a time, beside the known words of those before."""
        known = self.vocabulary.keys()
        found = [[self.vocabulary[w] for w in known & words] for words in texts]
        return np.repeat(np.arange(len(found)), [len(x) for x in found]), np.array([c for x in found for c in x], np.int64)

    @staticmethod
    def _part(rows: np.ndarray, cols: np.ndarray, chosen: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        place = np.full(n, -1)
        place[chosen] = np.arange(len(chosen))
        keep = place[rows] >= 0
        return place[rows][keep], cols[keep]

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        rows, cols = self._ones(words_of(t) if t else set() for t in texts)
        before = np.zeros((len(texts), 0))
        for model in self.models:
            before = np.c_[before, model.probability(rows, cols, before)]
        return before


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", categories: dict[str, str] | None = None, sample_docs: int = SAMPLE_DOCS) -> Chain:
    """A chain fitted on at most twice sample_docs labelled documents, chosen by a hash of their ids, and of the texts of an id.

    `categories` are expressions of 0, 1 or null over the table of labels, the
    decision last. Of labels that share an id the largest of each category
    counts. Ids without a text, or a label of any category, aren't fitted on; of
    equal rows one is. A chain of empty tables says no of everything.
    """
    categories = CATEGORIES if categories is None else categories
    flags = [f"flag{i}" for i in range(len(categories))]
    known = labels.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), *(F.expr(e).cast("double").alias(f) for e, f in zip(categories.values(), flags)))
    known = known.groupBy("id").agg(*(F.max(f).alias(f) for f in flags)).where(F.coalesce(*flags).isNotNull())
    share = min(1.0, sample_docs / max(labels.count(), 1))
    known = written(known.where(F.xxhash64(F.lit(17), "id") <= min(int(share * 2**64), 2**64 - 1) - 2**63).orderBy(F.xxhash64("id"), "id").limit(2 * sample_docs), "labelled")

    @F.pandas_udf("array<string>")
    def words(s: pd.Series) -> pd.Series:
        return s.map(lambda t: sorted(words_of(t)))

    rows = in_short_batches(docs).select(F.col(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(known), F.col("doc") == F.col("id"))
    # an id may have any number of rows
    rows = rows.withColumn("h", F.xxhash64("text"))
    chosen = written(rows.select("id", "h").distinct().orderBy(F.xxhash64("id", "h"), "id", "h").limit(2 * sample_docs), "chosen-rows")
    rows = rows.join(F.broadcast(chosen), ["id", "h"]).dropDuplicates(["id", "h"])
    sample = written(rows.select("id", *flags, words("text").alias("words")), "labelled-words")
    vocabulary = chosen_words(sample, flags[-1])
    # what comes to the driver are the chosen words of at most twice sample_docs texts
    fold = F.pmod(F.xxhash64("words"), F.lit(FOLDS)).alias("fold")
    rows = sample.select("id", *flags, fold, F.array_intersect("words", F.array(*map(F.lit, vocabulary)).cast("array<string>")).alias("words")).collect()
    rows = sorted(rows, key=lambda r: (hash_of(r["id"]), r["words"]))
    targets = np.array([[np.nan if r[f] is None else r[f] for f in flags] for r in rows], float).reshape(len(rows), len(flags))
    return Chain(list(categories), vocabulary, [set(r["words"]) for r in rows], targets, np.array([r["fold"] for r in rows], np.int64))


def chosen_words(sample: DataFrame, label: str, most: int = WORDS) -> list[str]:
    """Words of (label, words) whose share differs most between the classes, by chi-square and beyond what chance would give; copies of a text count once."""
    once = sample.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), "words").dropDuplicates(["words"])
    n, positive = once.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    counts = once.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("total"), F.sum("y").alias("hits"))
    expected = F.col("total") * F.lit(positive / max(n, 1))
    lead = F.pow(F.col("hits") - expected, F.lit(2.0)) / F.greatest(expected, F.lit(0.5))
    counts = counts.withColumn("lead", lead).where((F.col("total") >= 3) & (F.col("lead") >= CHANCE))
    return [r["word"] for r in counts.orderBy(F.col("lead").desc(), "word").limit(most).collect()]


def hash_of(value) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(str(value).encode())


def scored(text: Column, chain: Chain) -> Column:
    """Struct with the probability of each category."""

    @F.pandas_udf(", ".join(f"`{n}` double" for n in chain.names))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        alone()
        for s in batches:
            yield pd.DataFrame(chain.probabilities(list(s)), columns=chain.names)

    return of(text)


def with_toxicity(df: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """df with p_<category> for each category of the chain and a boolean toxic, by the last one's threshold.

    A null or empty text has no words and gets what the models say of none.
    Texts of any length are read whole, repeated rows get the same. Columns of these
    names are replaced. A chain fitted on nothing says 0.5 or less of all.
    """
    name = fresh(df, "scores")
    out = in_short_batches(df).withColumn(name, scored(F.col(text), chain))
    return out.withColumns({f"p_{n}": F.col(f"{name}.`{n}`") for n in chain.names} | {"toxic": F.col(f"{name}.`{chain.names[-1]}`") > chain.threshold}).drop(name)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_junk, p_toxic and toxic of every document, by a chain fitted on the table of labels."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return with_toxicity(docs, fitted(docs, documents(spark, sf_dir, "labels"))).drop("text")

"""Language identification by compression with per-language zstandard dictionaries.

A language's dictionary is raw text of that language. A text is compressed with
each dictionary, block by block, and belongs to the language whose dictionary
makes it smallest. Where two come out about alike, the decision is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.tables import documents, fresh, in_short_batches, resident, written

#: Documents of a language that its dictionary is made from at most, and bytes of a dictionary.
SAMPLE_DOCS, DICTIONARY = 200, 1 << 16
#: Bytes of all dictionaries together, which are broadcast, and languages at most: with more languages each has a smaller share.
BROADCAST, LANGUAGES = 32 << 20, 20_000
#: Bytes that are compressed at a time: more would let a text be its own dictionary.
BLOCK = 512
#: Matches of four bytes count, and tables are small enough to be ready for each block.
HOW = {"window_log": 17, "hash_log": 14, "chain_log": 14, "search_log": 4, "min_match": 4, "target_length": 32, "strategy": zstd.STRATEGY_GREEDY, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}
#: Relative lead over the second language below which a decision is rejected.
MARGIN = 0.002

_letter = regex.compile(r"\p{L}")
#: ASCII letters and all other bytes of UTF-8 stay, the rest of ASCII becomes a space.
_words = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def plain(text: str) -> bytes:
    """Lower-case words with one space before and after each, so that ASCII marks, numbers and layout say nothing."""
    return b" %b " % b" ".join(text.lower().encode("utf-8", "replace").translate(_words).split())


def dictionaries(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS, size: int = DICTIONARY) -> dict[str, bytes]:
    """Bytes for each language of df, of a bounded sample of its rows that have a text and a language.

    Ids are ranked by a hash without their texts, each once in a language, and
    of the rows of the first sample_docs of them the first sample_docs by a hash
    of their text are read. A row longer than an eighth of a dictionary gives
    that many bytes, from a place by its hash. Of over LANGUAGES languages those
    of most rows count.
    """
    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    langs = known.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGUAGES).collect()
    if not langs:
        return {}
    size = min(size, BROADCAST // len(langs))
    docs = max(1, min(sample_docs, SAMPLE_DOCS * 400 // len(langs)))
    kept = F.broadcast(df.sparkSession.createDataFrame([(r["lang"],) for r in langs], "lang string"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = known.select("lang", "id").join(kept, "lang").distinct().select("*", F.row_number().over(order).alias("nth")).where(F.col("nth") <= docs)
    # at most 80,000 rows
    ids = F.broadcast(written(ids.select(F.col("lang").alias("of"), F.col("id").alias("chosen")), "chosen-ids"))
    rows = known.join(ids, (F.col("lang") == F.col("of")) & F.col("id").eqNullSafe(F.col("chosen")))
    tie = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"), "text")
    share = size // 8
    place = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - share, F.lit(0)) + 1) + 1
    rows = rows.withColumn("nth", F.row_number().over(tie)).where(F.col("nth") <= docs).select("lang", "nth", F.expr("text").substr(place.cast("int"), F.lit(share)).alias("text"))
    out: dict[str, bytes] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["nth"])):
        out[r["lang"]] = (out.get(r["lang"], b"") + plain(r["text"]))[:size]
    # zstandard needs eight bytes
    return {k: v for k, v in out.items() if len(v) >= 8}


class Compressors:
    def __init__(self, found: dict[str, bytes]):
        self.names = sorted(found)
        self.raw = [found[n] for n in self.names]
        self.each, how = [], zstd.ZstdCompressionParameters(**HOW)
        for name in self.names:
            d = zstd.ZstdCompressionDict(found[name], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.each.append(zstd.ZstdCompressor(dict_data=d, compression_params=how))

    def sizes(self, data: bytes) -> list[int]:
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.each]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and relative lead over the second; `und` and 0 for a text without a letter."""
        if not text or not self.names or not _letter.search(text):
            return "und", 0.0
        data = plain(text)
        sizes = self.sizes(data)
        least = min(sizes)
        if sizes.count(least) > 1:  # of languages that compress alike, the one that knows more of the text's four-byte strings
            grams = {data[i : i + 4] for i in range(max(1, len(data) - 3))}
            sizes = [n - sum(g in d for g in grams) / (1 + len(grams)) if n == least else n for n, d in zip(sizes, self.raw)]
        order = sorted(zip(sizes, self.names))
        return order[0][1], 1.0 if len(order) == 1 else 1 - order[0][0] / max(order[1][0], 1)


def predicted(text: Column, found: dict[str, bytes]) -> Column:
    """Struct (lang string, margin double) for each text."""

    key = ("languages", hash(tuple(sorted(found.items()))))

    @F.pandas_udf("lang string, margin double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        each = resident(key, lambda: Compressors(found))
        for s in batches:
            yield pd.DataFrame([each.predict(t) for t in s], columns=["lang", "margin"])

    return of(text)


def identified(df: DataFrame, learn: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """df with lang_pred, lang_score and lang_rejected, by dictionaries from `learn` (df itself if not given).

    A null text, one without a letter, and every text if there is nothing to
    learn from, is `und` with score 0 and rejected. So is a decision by a margin
    below MARGIN, whose best guess is still told. Texts of any length are
    compressed whole. Columns of these names in df are replaced.
    """
    found = dictionaries(df if learn is None else learn, text, lang, doc_id)
    name = fresh(df, "language")
    out = in_short_batches(df).withColumn(name, predicted(F.col(text), found))
    margin = F.col(f"{name}.margin")
    rejected = (F.col(f"{name}.lang") == "und") | (margin < MARGIN)
    return out.withColumns({"lang_pred": F.col(f"{name}.lang"), "lang_score": margin / (margin + F.lit(0.02)), "lang_rejected": rejected}).drop(name)


def confident(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of df whose language is told and not rejected, with df's columns."""
    name = fresh(df, "language")
    found = dictionaries(df, text, lang, doc_id)
    told = in_short_batches(df).withColumn(name, predicted(F.col(text), found))
    return told.where((F.col(f"{name}.lang") != "und") & (F.col(f"{name}.margin") >= MARGIN)).drop(name)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that aren't held out."""
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    told = identified(docs.select("doc_id", "text"), docs.where(~held_out).select("doc_id", "text", "lang"))
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))

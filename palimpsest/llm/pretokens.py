"""Token counts by a map-side lookup in two tiers.

Byte-pair merges never cross a pre-token, so a text has as many tokens as its
pre-tokens have together. The first tier is a broadcast table of the most
frequent pre-tokens and their lengths in tokens; what it lacks goes through a
bounded cache in each Python worker and, once, through the library. No
pre-token is ever shuffled.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.tables import documents, in_short_batches, resident

#: Documents that the frequent table is made from (its content changes the speed, never a count).
SAMPLE_DOCS = 2000
#: Entries of the frequent table, about 0.5 MB of broadcast.
FREQUENT = 32_768
#: Entries of a worker's cache; it is emptied when full.
CACHE = 300_000
#: Characters of a pre-token beyond which it isn't kept.
LONG = 256
#: Characters whose classes may differ between releases of Unicode: texts with one outside go to the library whole.
SURE = regex.compile(r"[\x00-\x1b\x20-\x7e\xa0-ɏͰ-ͳ΄-ϿЀ-ԯ‐-‧‰-⁞ぁ-ゖァ-ヺ一-龥가-힣]*")

class Lengths:
    """Tokens of texts, by a worker's tiers."""

    def __init__(self, vocabulary: str, table: tuple[bytes, bytes, bytes] | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = special
        self.frequent: dict[str, int] = unpacked(table) if table else {}
        self.cache: dict[str, int] = {}

    def pretokens(self, text: str) -> tuple[list[str], int] | None:
        """Pre-tokens, and the number of special tokens between them; None if only the library can tell."""
        if not SURE.fullmatch(text):
            return None
        if not any(m in text for m in self.marks):
            return self.pattern.findall(text), 0
        parts = self.special.split(text)
        return [t for p in parts for t in self.pattern.findall(p)], len(parts) - 1

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            split = self.pretokens(text)
            if split is None:
                out.append(self.encoded([text])[0])
                continue
            found, total = split
            lengths = list(map(self.frequent.get, found))
            if None in lengths:
                total += sum(n for n in lengths if n)
                missed = [t for t, n in zip(found, lengths) if n is None]
                new = list({t for t in missed if t not in self.cache})
                if new:
                    if len(self.cache) + len(new) > CACHE:
                        self.cache = {}
                        new = list(set(missed))
                    # very long pre-tokens, and those of a text of very many, go through and are not kept
                    known = dict(zip(new, self.encoded(new)))
                    if len(known) <= CACHE:
                        self.cache.update((t, n) for t, n in known.items() if len(t) <= LONG)
                    total += sum(known[t] if t in known else self.cache[t] for t in missed)
                else:
                    total += sum(map(self.cache.__getitem__, missed))
            else:
                total += sum(lengths)
            out.append(total)
        return out


def packed(lengths: dict[str, int]) -> tuple[bytes, bytes, bytes]:
    """Keys as one UTF-8 string, their ends, and a length of up to 65,535 for each."""
    keys = [k.encode() for k in lengths]
    ends = np.cumsum([len(k) for k in keys], dtype=np.uint32)
    return b"".join(keys), ends.tobytes(), np.array(list(lengths.values()), np.uint16).tobytes()


def unpacked(table: tuple[bytes, bytes, bytes]) -> dict[str, int]:
    blob, ends, sizes = table[0], np.frombuffer(table[1], np.uint32).tolist(), np.frombuffer(table[2], np.uint16).tolist()
    return {blob[a:b].decode(): n for a, b, n in zip([0, *ends], ends, sizes)}


def frequent_lengths(df: DataFrame, text: str, vocabulary: str, sample_docs: int = SAMPLE_DOCS, entries: int = FREQUENT) -> tuple[bytes, bytes, bytes]:
    """The first tier. Tasks over a sample of about sample_docs texts count pre-tokens on their own, all at once, and hand over at most 64 for each text of theirs."""
    rows = df.count()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiers, seen, texts = None, Counter(), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                tiers = tiers or Lengths(vocabulary)
                texts += 1
                if t and (split := tiers.pretokens(t)):
                    seen.update(split[0])
        top = [(k, n) for k, n in seen.most_common(min(entries, 64 * texts)) if len(k) <= 64]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["token", "n"])

    sample = in_short_batches(df).select(text).sample(fraction=min(1.0, sample_docs / max(rows, 1)), seed=7)
    seen: Counter = Counter()
    for r in sample.mapInArrow(counted, "token string, n long").collect():
        seen[r["token"]] += r["n"]
    keys = sorted(seen, key=lambda k: (-seen[k], k))[:entries]
    return packed(dict(zip(keys, Lengths(vocabulary).encoded(keys))) if keys else {})


def token_counts(df: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """df with a column of the number of tokens of each whole text, as the tokenizers library gives it.

    Nulls and empty texts have 0 tokens. Special strings inside a text count as
    one token each, the library's default. Very long texts are counted whole.
    Repeated rows stay, each with its count. An empty table stays empty. If df
    has a column named `out`, it is replaced; all other columns are kept.
    """
    table = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, text, vocabulary))
    key = uuid.uuid4().hex

    @F.pandas_udf("long")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tiers = resident(key, lambda: Lengths(vocabulary, table.value))
        for s in batches:
            yield pd.Series(tiers.count(["" if t is None else t for t in s]), dtype="int64")

    return df.withColumn(out, lengths(F.col(text)))


def op9(spark: SparkSession, sf_dir: str, limit: int = 1024) -> DataFrame:
    """Bytes and tokens of every document, and whether it has over `limit` tokens."""
    counted = token_counts(documents(spark, sf_dir).select("doc_id", "text"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

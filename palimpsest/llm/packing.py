"""Packing token sequences: first-fit decreasing inside randomised groups of documents.

A document longer than a sequence fills whole sequences first; what is left of
it, and every shorter document, is a piece to be packed. Pieces are dealt into
groups by a hash of their document's id, and each group is packed on its own by
first-fit decreasing: a tournament tree over the bins' free room finds the
leftmost bin with enough room in a logarithmic number of steps. A group has
some thousand documents whatever the table's size, so only its last bins stay
partly empty and no task ever holds more than a few groups.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.pretokens import SURE
from palimpsest.llm.tables import documents, in_short_batches, resident, written

#: Tokens of a sequence.
ROOM = 4096
#: Groups of a range of positions, over which its pieces are dealt.
SPREAD = 2
#: Pieces that a group has on average.
GROUP = 2048
#: Entries of a worker's cache of words; it is emptied when full (it may pass this by the new words of STEP).
CACHE = 250_000
#: Characters of a word beyond which it isn't kept.
LONG = 64
#: Words of a text that are encoded at a time.
STEP = 100_000

#: Characters that stand for bytes in the vocabulary: printable Latin-1 for itself, others from U+0100 on.
_own = [*range(33, 127), *range(161, 173), *range(174, 256)]
_byte_chars = {b: chr(b) if b in _own else chr(256 + n) for n, b in enumerate([*(b for b in range(256) if b not in _own), *_own])}
#: What the tokenizer splits words into.
_parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class Words:
    """Ids of texts. White space always ends a token here, so ids of words, and of the parts of words, are kept and joined."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.merge = self.tokenizer.model.tokenize
        self.cache: dict[str, bytes] = {}

    def raw(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        out = []
        for part in _parts.findall(word):
            ids = self.cache.get(part)
            if ids is None:
                ids = array("I", [t.id for t in self.merge(part.encode().decode("latin-1").translate(_byte_chars))]).tobytes()
                if len(part) <= LONG:
                    self.cache[part] = ids
            out.append(ids)
        return b"".join(out)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids. Texts of rarer characters, and those that may hold special strings, go through the library whole."""
        if "<|" in text or "Σ" in text or not SURE.fullmatch(text) or not unicodedata.is_normalized("NFC", text):
            return self.raw(text)
        words, out = text.lower().split(), []
        for i in range(0, len(words), STEP):
            some = words[i : i + STEP]
            found = list(map(self.cache.get, some))
            if None in found:
                if len(self.cache) > CACHE:
                    self.cache = {}
                for n, ids in enumerate(found):
                    if ids is None:
                        word = some[n]
                        ids = self.cache.get(word)
                        if ids is None:
                            ids = self.word(word)
                            if len(word) <= LONG:
                                self.cache[word] = ids
                        found[n] = ids
            out.append(b"".join(found))
        return b"".join(out)


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Longest pieces first, each into the leftmost bin that has room."""
    n = len(lengths)
    width = 1 << max(0, n - 1).bit_length()
    tree = [room] * (2 * width)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, at = int(lengths[i]), 1
        while at < width:
            at *= 2
            if tree[at] < need:
                at += 1
        bins[i], offsets[i] = at - width, room - tree[at]
        tree[at] -= need
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
    return bins, offsets


def pieces(df: DataFrame, doc_id: str = "doc_id", text: str = "text", room: int = ROOM, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, with_ids: bool = False, position: str | None = None) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens[, position][, ids]): each document's ids and end_id, cut after every `room` ids."""
    end = array("I", [end_id]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = resident(("words", vocabulary), lambda: Words(vocabulary))
        for b in batches:
            docs, starts, lengths, crcs, totals, kept, places = [], [], [], [], [], [], []
            for row, (d, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                ids = words.ids(t or "") + end
                n = len(ids) // 4
                for s in range(0, n, room):
                    piece = ids[4 * s : 4 * (s + room)]
                    docs.append(d)
                    starts.append(s)
                    lengths.append(len(piece) // 4)
                    crcs.append(zlib.crc32(piece))
                    totals.append(n)
                    places.append(row)
                    if with_ids:
                        kept.append(np.frombuffer(piece, np.uint32).astype(np.int32))
            cols = [pa.array(docs, b.schema.field(0).type), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if position:
                cols, names = [*cols, b.column(2).take(pa.array(places, pa.int64()))], [*names, "position"]
            if with_ids:
                cols, names = [*cols, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = dict(df.dtypes)[doc_id]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", position long" if position else "") + (", ids array<int>" if with_ids else "")
    own = [F.col(position).cast("long").alias("position")] if position else []
    return in_short_batches(df).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *own).mapInArrow(cut, schema)


def packed(cut: DataFrame, room: int = ROOM, group: int = GROUP, seed: int = 11) -> DataFrame:
    """The pieces with sequence_id and offset: in each sequence pieces follow one another from 0 without gaps.

    Full pieces are sequences of their own, with negative sequence_ids; other
    sequence_ids name a group and a bin of it.
    Groups come from a hash of id, start and content, so a rerun packs alike;
    copies of a row lie wherever their ties fall, each in one place, and if they
    are more than a group holds, they are dealt over several by their place in
    the table. Nulls in
    doc_id are a value like any other. An empty table gives an empty table.
    """
    cut = written(cut, "pieces")
    short = cut.where(F.col("length") < room).withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32"))
    n = short.count()
    groups = max(1, round(n / group))
    # equal pieces of which there are more than in a group; there are at most 10,000 keys of so many
    equal = short.groupBy("key").count().where(F.col("count") > max(group, n // 10_000))
    equal = F.broadcast(written(equal.select(F.col("key").alias("hot"), F.ceil(F.col("count") / group).alias("dealt")), "equal-pieces"))
    full = cut.where(F.col("length") >= room).withColumn("group", F.lit(-1).cast("long"))
    rest = short.withColumn("place", F.monotonically_increasing_id()).join(equal, F.col("key") == F.col("hot"), "left")
    rest = rest.withColumn("copy", F.pmod("place", F.coalesce("dealt", F.lit(1))))
    rest = rest.withColumn("group", F.pmod(F.when(F.col("copy") == 0, F.col("key")).otherwise(F.xxhash64("key", "copy")), F.lit(groups))).drop("key", "place", "hot", "dealt", "copy")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], na_position="last", kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), room)
        return pdf.assign(sequence_id=pdf["group"] * (1 << 32) + bins, offset=offsets).drop(columns="group")

    schema = rest.drop("group").schema.add("sequence_id", "long").add("offset", "long")
    binned = rest.groupBy("group").applyInPandas(pack, schema)
    # whole sequences are numbered within their read partition: nothing is compared or moved
    whole = full.drop("group").withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return binned.unionByName(whole.select(binned.columns))


def packed_in_order(cut: DataFrame, room: int = ROOM, group: int = GROUP, spread: int = SPREAD, seed: int = 11) -> DataFrame:
    """As packed, for pieces with a position: sequence_ids follow the positions from one range of spread * group of them to the next.

    Within a range pieces are dealt over `spread` groups by a hash. A document
    has one piece at most that isn't full, so a group has about `group` of them,
    and equal rows lie where they stand. Positions are below 2^46.
    """
    range_ = F.floor(F.col("position") / (group * spread))
    rows = cut.withColumn("group", (range_ * spread + F.pmod(F.xxhash64(F.lit(seed), "position", "doc_id", "start", "ids_crc32"), F.lit(spread))).cast("long"))
    rows = written(rows, "pieces")
    full = rows.where(F.col("length") >= room)
    rest = rows.where(F.col("length") < room)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["position", "start", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), room)
        return pdf.assign(sequence_id=pdf["group"] * (1 << 28) + bins, offset=offsets).drop(columns="group")

    schema = rest.drop("group").schema.add("sequence_id", "long").add("offset", "long")
    binned = rest.groupBy("group").applyInPandas(pack, schema)
    # a whole sequence comes after the bins of its group
    nth = F.row_number().over(Window.partitionBy("group").orderBy("position", "start", "ids_crc32"))
    whole = full.withColumn("sequence_id", F.col("group") * (1 << 28) + (1 << 27) + nth).withColumn("offset", F.lit(0).cast("long"))
    return binned.unionByName(whole.select(binned.columns))


def pack_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", room: int = ROOM, group: int = GROUP, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, with_ids: bool = False, position: str | None = None) -> DataFrame:
    """All texts of df as packed pieces of sequences of at most `room` tokens.

    A null or empty text is a document of the end token alone. A text of any
    length is cut after each `room` ids, without loss. Rows that share an id are
    packed each on its own. Other columns of df are not read. An empty table
    gives no pieces. With a column of positions (numbers from 0, no nulls)
    sequences follow it, up to a range of SPREAD groups.
    """
    if position:
        return packed_in_order(pieces(df, doc_id, text, room, vocabulary, end_id, with_ids, position), room, group)
    return packed(pieces(df, doc_id, text, room, vocabulary, end_id, with_ids), room, group)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_documents of all documents."""
    return pack_documents(documents(spark, sf_dir))

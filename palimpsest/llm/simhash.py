"""SimHash near-duplicates, joined by a Gray-order hierarchical index.

Two 64-bit fingerprints that differ in at most b bits agree on one of b + 1
blocks of bits. Distinct fingerprints are dealt by block and value, and in each
such bucket an index is built: fingerprints in order of their Gray rank are
bundled eight by eight, a node keeps the bits that all below it share as a
masked pattern, and pairs of nodes whose shared bits already differ too often
are pruned with everything below them. What a task hands on is a spanning
forest of the links it has found, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.components import components
from palimpsest.operators.lineage import dropped
from palimpsest.llm import likeness
from palimpsest.llm.tables import alone, documents, fresh, in_short_batches, written

#: Fingerprints of a bucket beyond which it is dealt anew by the bits that it leaves open.
LARGE = 8192
#: Children of an index node.
FAN = 8
#: Pairs of nodes that a task compares at a time.
FRONT = 1 << 15
#: Shingles whose bits are counted at a time.
STEP = 1 << 16
#: Rows of whole buckets that a task joins at a time.
CHUNK = 1 << 17


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash over XXH64 (seed 42) of word shingles; a bit is set if it is in over half of them."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    width = min(width, len(words))
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - width + 1
    for i in range(0, n, STEP):
        to = min(n, i + STEP)
        h = np.fromiter((digest(joined[a : b - 1], 42) for a, b in zip(ends[i:to], ends[i + width : to + width])), np.uint64, to - i)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, width: int = 3) -> Column:
    """Fingerprints as signed 64-bit numbers. Null and wordless texts have fingerprint 0."""

    @F.pandas_udf("long")
    def of(s: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in s], np.uint64).view(np.int64))

    return of(text)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence: each bit is the parity of the bits from it upward."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def linked(codes: np.ndarray, bucket: np.ndarray, bits: int) -> np.ndarray:
    """For each code the first position that it is joined to by codes of its bucket that differ in at most `bits` bits, found through the index. Codes come sorted by bucket and Gray rank."""
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    # a level: pattern, mask of shared bits, begin and end of the children, bucket
    levels = [(codes, np.full(len(codes), ones), None, None, bucket)]
    while True:
        pattern, mask, _, _, of = levels[-1]
        head = np.r_[True, of[1:] != of[:-1]]
        if head.all():
            break
        start = np.maximum.accumulate(np.where(head, np.arange(len(of)), 0))
        begin = np.flatnonzero((np.arange(len(of)) - start) % FAN == 0)
        shared = np.bitwise_and.reduceat(mask, begin) & (np.bitwise_and.reduceat(pattern, begin) | ~np.bitwise_or.reduceat(pattern, begin))
        levels.append((pattern[begin] & shared, shared, begin, np.r_[begin[1:], len(of)], of[begin]))
    root, a, b = np.arange(len(codes)), [], []
    roots = np.arange(len(levels[-1][0]))
    stack = [(len(levels) - 1, roots[i : i + FRONT], roots[i : i + FRONT]) for i in range(0, len(roots), FRONT)]
    while stack:
        level, x, y = stack.pop()
        if level == 0:
            keep = x < y
            a.append(x[keep])
            b.append(y[keep])
            if sum(map(len, a)) > FRONT * FAN:
                root, a, b = joined(root, np.concatenate(a), np.concatenate(b)), [], []
            continue
        _, _, begin, end, _ = levels[level]
        pattern, mask = levels[level - 1][:2]
        nx, ny = end[x] - begin[x], end[y] - begin[y]
        count = nx * ny
        pair = np.repeat(np.arange(len(x)), count)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
        cx, cy = begin[x][pair] + nth // ny[pair], begin[y][pair] + nth % ny[pair]
        near = (cx <= cy) & (np.bitwise_count((pattern[cx] ^ pattern[cy]) & mask[cx] & mask[cy]) <= bits)
        cx, cy = cx[near], cy[near]
        stack += [(level - 1, cx[i : i + FRONT], cy[i : i + FRONT]) for i in range(0, len(cx), FRONT)]
    return joined(root, np.concatenate(a), np.concatenate(b)) if a else root


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that each position is joined to, once links a - b are added to what `root` says."""
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def block_masks(open_bits: int, parts: int) -> list[int]:
    """Splits the set bits of open_bits into masks of neighbouring bits, as even as can be."""
    free = [i for i in range(64) if open_bits >> i & 1]
    cuts = [round(len(free) * k / parts) for k in range(parts + 1)]
    return [sum(1 << i for i in free[p:q]) for p, q in zip(cuts, cuts[1:])]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def buckets(codes: DataFrame, bits: int, large: int = LARGE) -> DataFrame:
    """(code, id, fixed, value): each code once for each block of bits that a partner may share.

    Buckets of over `large` codes are dealt again by the bits that are still
    open, until they are small or the open bits are so few that a bucket's
    distinct codes are: each step fixes a third of what is open (at 2 bits), so
    after six steps no bucket has over 64 distinct codes' worth of open bits.
    """
    masks, done = [0], []
    todo = codes.select("code", "id", F.lit(0).cast("long").alias("fixed"))
    for step in range(6):
        choices = sorted({(f, f | m) for f in masks for m in block_masks(~f & 0xFFFFFFFFFFFFFFFF, bits + 1) if m})
        table = F.create_map(*(x for f in masks for x in (F.lit(signed(f)), F.array(*(F.lit(signed(g)) for h, g in choices if h == f)))))
        dealt = todo.withColumn("fixed", F.explode(table[F.col("fixed")])).withColumn("value", F.col("code").bitwiseAND(F.col("fixed")))
        masks = sorted({g for _, g in choices})
        open_bits = max(64 - m.bit_count() for m in masks)
        if open_bits <= large.bit_length() - 1 or len(masks) > 200:
            done.append(dealt)
            break
        big = dealt.groupBy("fixed", "value").count().where(F.col("count") > large).select("fixed", "value")
        big = written(big, "large-buckets")
        if big.isEmpty():
            done.append(dealt)
            break
        done.append(dealt.join(big.hint("merge"), ["fixed", "value"], "left_anti").select(dealt.columns))
        todo = written(dealt.join(big.hint("merge"), ["fixed", "value"], "left_semi").select("code", "id", "fixed").distinct(), "codes-of-large-buckets")
    return reduce(DataFrame.unionByName, done)


def near_links(codes: DataFrame, bits: int, large: int = LARGE) -> DataFrame:
    """(a, b): links that join the ids of all codes that differ in at most `bits` bits, and only those, directly or through others.

    A task reads its buckets in order and holds about CHUNK rows of whole
    buckets at a time, however many it has been dealt.
    """

    def join(table: pa.Table) -> pa.RecordBatch:
        code, ids, fixed, value = (table.column(c).to_numpy() for c in ("code", "id", "fixed", "value"))
        code = code.view(np.uint64)
        order = np.lexsort((gray_rank(code), value, fixed))
        code, ids, fixed, value = code[order], ids[order], fixed[order], value[order]
        bucket = np.cumsum(np.r_[True, (fixed[1:] != fixed[:-1]) | (value[1:] != value[:-1])])
        root = linked(code, bucket, bits)
        moved = root != np.arange(len(code))
        kind = table.schema.field("id").type
        return pa.RecordBatch.from_arrays([pa.array(ids[moved], kind), pa.array(ids[root[moved]], kind)], ["a", "b"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held, rows = [*held, b], rows + b.num_rows
            if rows < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            fixed, value = table.column("fixed").to_numpy(), table.column("value").to_numpy()
            ends = np.flatnonzero((fixed[1:] != fixed[:-1]) | (value[1:] != value[:-1])) + 1
            if len(ends):
                yield join(table.slice(0, ends[-1]))
                held = table.slice(ends[-1]).combine_chunks().to_batches()
                rows = sum(h.num_rows for h in held)
        if held:
            yield join(pa.Table.from_batches(held))

    kind = dict(codes.dtypes)["id"]
    dealt = buckets(codes, bits, large).repartition("fixed", "value").sortWithinPartitions("fixed", "value")
    return dealt.mapInArrow(stream, f"a {kind}, b {kind}")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, bits: int = 2, large: int = LARGE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of df: 16 hexadecimal digits, and the smallest doc_id that links lead to.

    Fingerprints that differ in at most `bits` bits are linked, equal ones too.
    A null text, and one without a word, has fingerprint 0 and is linked like
    any other. Texts of any length are read whole. Ids are of any type that has
    an order. Rows that share an id stay rows of their own; a null id is linked
    to nothing and is its own (null) component. Other columns of df are not
    read. An empty table gives an empty table.
    """
    docs = written(in_short_batches(df).select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), width).alias("code")), "fingerprints")
    # distinct fingerprints stand for all their copies from here on
    codes = written(docs.where("doc_id is not null").groupBy("code").agg(F.min("doc_id").alias("id")), "distinct-fingerprints")
    found = components(near_links(codes, bits, large))
    named = codes.join(found.hint("merge"), "id", "left").select("code", F.coalesce("component_id", "id").alias("component_id"))
    # most fingerprints are of one document, which names itself; the rest, of whatever number of copies, is joined
    out = docs.join(named.hint("merge"), "code", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = likeness.WIDTH, like: tuple[int, int] = likeness.LIKE, bits: int = 2, large: int = LARGE, small: int = likeness.SMALL) -> DataFrame:
    """(doc_id, component_id) for each row of df: the smallest doc_id that links between near copies lead to.

    Near copies are texts whose sets of shingles of `width` words have a Jaccard
    likeness of `like` or more. Those whose SimHash differs in at most `bits`
    bits are found by the Gray-order index, and checked. Near copies may differ
    in more bits than an index can look up (about ten at 0.8), so those that are
    not joined yet are then found by likeness.py.

    Case and white space don't count, a text of fewer than `width` words is one
    shingle, and null texts and those without a word are alike. Ids are of any
    type that has an order; a null id is linked to nothing and is its own (null)
    component. Rows that share an id stay rows of their own. Texts of any length
    are read whole. Other columns are not read. An empty table gives an empty table.
    """
    docs = written(likeness.prefixes(df.where(F.col(doc_id).isNotNull()), doc_id, text, width, like), "prefixes")
    # equal sets stand for all their copies from here on
    classes = written(docs.groupBy("code").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.min("fingerprint").alias("fingerprint")), "distinct-sets")
    ids = written(docs.select("id", "code"), "codes-of-ids")
    dropped(docs)
    firsts = written(classes.select("code", "id", "fingerprint"), "first-ids")
    prints = firsts.groupBy(F.col("fingerprint").alias("print")).agg(F.min("code").alias("id"))
    prints = written(prints, "distinct-fingerprints")
    same = firsts.select(F.col("code").alias("a"), F.col("fingerprint").alias("print")).join(prints.hint("merge"), "print").where("a != id").select("a", F.col("id").alias("b"))
    close = written(same.unionByName(near_links(prints.select(F.col("print").alias("code"), "id"), bits, large)), "close-fingerprints")
    repeated = not ids.groupBy("id").count().where("count > 1").isEmpty()
    owns = likeness.alike_owners(classes, firsts, df, doc_id, text, close, width, like, small, repeated)
    named = written(firsts.select("code", "id").join(owns.hint("merge"), "code"), "named-sets")
    first = named.groupBy("own").agg(F.min("id").alias("component_id"))
    named = named.join(first.hint("merge"), "own").select("code", "component_id")
    out = ids.select(F.col("id").alias("doc_id"), "code").join(named.hint("merge"), "code").select("doc_id", "component_id")
    none = F.lit(None).cast(dict(df.dtypes)[doc_id])
    return out.unionByName(df.where(F.col(doc_id).isNull()).select(none.alias("doc_id"), none.alias("component_id")))


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of df whose id is the smallest of its near copies, with df's columns. Rows without an id stay; of rows that share an id one stays."""
    return first_of_components(df, near_copies(df, doc_id, text, **how), doc_id)


def first_of_components(df: DataFrame, found: DataFrame, doc_id: str) -> DataFrame:
    """The rows of df that are the first of their component in found (doc_id, component_id), and those without an id."""
    key = fresh(df, "dropped_id")
    found = found.where("doc_id is not null")
    seen = written(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("kept")), "seen-ids")
    out = seen.where("doc_id != kept").select(F.col("doc_id").alias(key))
    rows = df.join(out.hint("merge"), F.col(doc_id) == F.col(key), "left_anti")
    twice = written(seen.where("doc_id = kept and n > 1").select(F.col("doc_id").alias(key)), "repeated-ids")
    if twice.isEmpty():
        return rows
    again = rows.join(twice.hint("merge"), F.col(doc_id) == F.col(key), "left_semi").dropDuplicates([doc_id])
    return rows.join(twice.hint("merge"), F.col(doc_id) == F.col(key), "left_anti").unionByName(again)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of all documents, by three words and two bits."""
    return near_duplicates(documents(spark, sf_dir))

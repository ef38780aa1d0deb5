"""Document fingerprints from closed syncmers, by DataFrame functions alone.

A text is read as a row of tokens: words, and the single characters of longer
runs such as text that is written without spaces, so a token depends on no more
than a few characters around it. Every k tokens are an anchor if the smallest
of the inner substrings of s tokens that they contain is the first or the last.
That depends on these k tokens only: an edit changes no anchor that it doesn't
touch, and about 2 of k - s + 1 places are anchors. A fingerprint is the
anchors of smallest hash, each with its position. Two fingerprints are matched
by hash and position: what they share counts where several shared anchors lie
on about one diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.tables import documents, written
from palimpsest.operators.ordering import running

#: Tokens of an anchor, tokens of an inner substring, anchors of a fingerprint.
K, S, HASHES = 7, 2, 64
#: Characters of a run from which each is a token of its own.
RUN = 17
#: Tokens by which neighbours on a diagonal may be shifted.
BAND = 16
#: Types of ids that need no numbers of their own.
INTEGERS = ("bigint", "int", "smallint", "tinyint")
#: Documents for each range of ids, about.
RANGE_DOCS = 4096
#: Ranges at most, and ids at most that are cut into several ranges.
RANGES, HOT = 65_536, 1000


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    """Words of fewer than RUN characters, and all characters of longer ones. White space is 0x20 and 0x09 to 0x0D."""
    word = rf"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{{1,{RUN - 1}}}(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(word), F.lit(0))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Array of (hash, position): closed syncmers of the text, positions in tokens. A text of 1 to k - 1 tokens is one anchor at 0, one without tokens has none."""
    last = k - s  # of the inner substrings of an anchor, from 0
    # inner substrings that have all tokens of an anchor between them
    cover = sorted({*range(0, last + 1, s), last})

    def chosen(inner: Column, n: Column) -> Column:
        at = lambda i, j: F.get(inner, i + F.lit(j)) if j else F.get(inner, i)
        edges = lambda i: F.least(at(i, 0), at(i, last))
        middle = lambda i: F.least(*(at(i, j) for j in range(1, last))) if last > 2 else at(i, 1)
        places = F.sequence(F.lit(0), n - k)
        places = F.filter(places, lambda i: edges(i) <= middle(i)) if last > 1 else places
        return F.transform(places, lambda i: F.struct(F.xxhash64(*(at(i, j) for j in cover)).alias("hash"), i.alias("position")))

    def of(found: Column) -> Column:
        n = F.size(found)
        inner = F.transform(F.sequence(F.lit(0), n - s), lambda i: F.xxhash64(*(F.get(found, i + F.lit(j)) for j in range(s))))
        whole = F.array(F.struct(F.xxhash64(F.concat_ws(" ", found)).alias("hash"), F.lit(0).alias("position")))
        return F.when(n >= k, let(inner, lambda x: chosen(x, n))).when(n > 0, whole).otherwise(F.slice(whole, 1, 0))

    return let(tokens(text), of)


def sketch(text: Column, k: int = K, s: int = S, hashes: int = HASHES) -> Column:
    """The anchors of smallest hash, ascending, each once, at its first position. Equal texts have equal sketches."""
    first = lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["hash"] != x["hash"]))
    return F.slice(let(F.array_sort(anchors(text, k, s)), first), 1, hashes)


def text_of(sketched: Column) -> Column:
    """Hashes and positions as text."""
    return F.array_join(F.transform(sketched, lambda x: F.concat_ws("@", F.hex(x["hash"]), x["position"])), ".")


def likeness(a: Column, b: Column, hashes: int = HASHES, band: int = BAND) -> Column:
    """The share, among the smallest hashes of two sketches together, of anchors that both have in matching positions. 1 for two empty ones.

    The diagonal of a shared anchor is how far it has moved. It matches if
    another shared anchor's diagonal is within `band` tokens of its own, so a
    moved passage counts and a chance phrase doesn't; one that is alone counts
    only where a sketch has no other.
    """
    sides = F.concat(*(F.transform(x, lambda y, side=n: F.struct(y["hash"].alias("hash"), F.lit(side).alias("side"), y["position"].alias("position"))) for n, x in enumerate((a, b))))

    def of(every: Column) -> Column:
        new = F.filter(F.sequence(F.lit(0), F.size(every) - 1), lambda i: (i == 0) | (F.get(every, i - 1)["hash"] != F.get(every, i)["hash"]))
        return let(F.slice(new, 1, hashes), lambda joint: matched(every, joint) / F.size(joint))

    def matched(every: Column, joint: Column) -> Column:
        both = F.filter(joint, lambda i: F.get(every, i)["hash"] == F.get(every, i + 1)["hash"])
        moved = F.array_sort(F.transform(both, lambda i: F.get(every, i + 1)["position"] - F.get(every, i)["position"]))
        near = lambda d: F.size(F.filter(d, lambda x, i: F.coalesce(x - F.get(d, i - 1) <= band, F.lit(False)) | F.coalesce(F.get(d, i + 1) - x <= band, F.lit(False))))
        alone = F.least(F.size(a), F.size(b)) == 1
        return let(moved, lambda d: F.when(alone, F.size(d)).otherwise(near(d)))

    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(let(F.array_sort(sides), of))


def bounds(df: DataFrame, column: str, ranges: int, alone: list[int]) -> list[list[int]]:
    """Values that cut the column into ranges of about as many rows each, and one for each value of `alone`, in two levels to be searched one after the other."""
    found = df.agg(F.percentile_approx(column, [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges))).first()[0] if ranges > 1 else []
    cuts = sorted({*(found or []), *alone, *(x + 1 for x in alone if x < (1 << 63) - 1)})
    if not cuts:
        return []
    step = max(1, round(len(cuts) ** 0.5))
    return [cuts[i : i + step] for i in range(0, len(cuts), step)]


def range_of(value: Column, levels: list[list[int]]) -> Column:
    """How many bounds are at or below the value; -1 for null."""
    constant = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= value))
    if not levels:
        return F.when(value.isNull(), F.lit(-1)).otherwise(F.lit(0))
    inner = F.array(*map(constant, levels))
    fine = let(below(constant([x[0] for x in levels])), lambda c: F.when(c == 0, F.lit(0)).otherwise((c - 1) * len(levels[0]) + below(F.get(inner, c - 1))))
    return F.when(value.isNull(), F.lit(-1)).otherwise(fine)


def with_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, text, next_id, next_text): each row and the row after it by descending id; after the last comes the first.

    `extra` are columns made from the column `text`; each moves along with it, as
    <name> and next_<name>.

    Ids are integers (compared() numbers others). They are cut into ranges of some thousand rows, and each range is sorted by itself, so
    texts move once. A copy of each range's first row is put at the end of the
    range before, which is all that one range needs of another. Rows that share
    an id follow one another by a hash of their text; an id of very many rows is
    cut into ranges by that hash, and its equal rows move as one, with a count.
    Null ids come last; a null text counts as empty; the only row of a table is
    its own next.
    """
    extra = extra or {}
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ids = rows.select("doc_id")
    n = ids.count()
    size = max(RANGE_DOCS, n // RANGES)
    # fewer than HOT ids have over a HOT-th of all rows
    hot = [(r["doc_id"], -(-r["count"] // size)) for r in ids.groupBy("doc_id").count().where(F.col("count") > max(size, n // HOT)).collect()]
    levels = bounds(ids, "doc_id", max(1, n // size), [i for i, _ in hot if i is not None])
    rows = rows.withColumns({"n": F.lit(1).cast("long"), "cut": F.lit(0).cast("long")})
    if hot:
        table = F.broadcast(df.sparkSession.createDataFrame(hot, "hot long, cuts long"))
        same = F.col("doc_id").eqNullSafe(F.col("hot"))
        many = rows.join(table, same).groupBy("doc_id", "text", "tie", "cuts").agg(F.count("*").alias("n"))
        many = many.withColumn("cut", F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * F.col("cuts")).cast("long"))
        rows = rows.join(table, same, "left_anti").unionByName(many.select(rows.columns))
    rows = rows.withColumn("range", range_of(F.col("doc_id"), levels))
    last_first = F.struct(F.col("doc_id").isNull().alias("null"), F.bitwise_not("doc_id").alias("down"), F.col("tie").alias("tie"))
    # a row for each range, of which there are at most some RANGES
    found = rows.groupBy("range", "cut").agg(F.min(last_first).alias("head")).collect()
    found = sorted(found, key=lambda r: (-r["range"], r["cut"]))
    heads = [(*found[(i + 1) % len(found)]["head"][1:], f["range"], f["cut"]) for i, f in enumerate(found)]
    heads = df.sparkSession.createDataFrame(heads, "head long, head_tie long, to_range int, to_cut long")
    firsts = rows.join(F.broadcast(heads), F.bitwise_not("doc_id").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("head_tie")))
    firsts = firsts.groupBy("doc_id", "tie", "to_range", "to_cut").agg(F.min("text").alias("text"))
    firsts = firsts.select("doc_id", "text", "tie", F.lit(1).cast("long").alias("n"), F.col("to_cut").alias("cut"), F.col("to_range").alias("range"))
    both = rows.withColumn("copy", F.lit(0)).unionByName(firsts.withColumn("copy", F.lit(1)))
    both = both.repartition("range", "cut").withColumns(extra)
    order = Window.partitionBy("range", "cut").orderBy("copy", F.col("doc_id").desc_nulls_last(), "tie", "text")
    moving = {"next_id": "doc_id", "next_text": "text", **{f"next_{c}": c for c in extra}}
    follow = both.withColumns({new: F.lead(old).over(order) for new, old in moving.items()}).where("copy = 0")
    if hot:
        # of n equal rows all but the last are followed by one of them
        pieces = F.expr("explode(sequence(0L, (n - 1) div 10000))").alias("piece")
        follow = follow.select("*", pieces).repartition("doc_id", "tie", "piece")
        follow = follow.select("*", F.expr("explode(sequence(piece * 10000 + 1, least(n, piece * 10000 + 10000)))").alias("nth"))
        follow = follow.withColumns({new: F.when(F.col("nth") < F.col("n"), F.col(old)).otherwise(F.col(new)) for new, old in moving.items()})
    return follow.select("doc_id", "text", *extra, *moving)


def edited(text: Column, following: Column) -> Column:
    """The text with its last half replaced by as much of the beginning of the following one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def compared(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, s: int = S, hashes: int = HASHES) -> DataFrame:
    """Fingerprints of every row of df and of its edited text, and how alike they and the next row's are.

    Null and empty texts have the empty fingerprint, of likeness 1 to another
    empty one and 0 to any other. Texts of any length are read whole. Repeated
    rows have equal fingerprints. An empty table gives an empty table. Other
    columns of df are not read. Ids may have any type that can be ordered, and
    come back as they are; those that aren't integers are numbered in their
    order first. See with_next for ties and null ids.
    """
    kind = df.schema[doc_id].dataType
    if kind.simpleString() not in INTEGERS:
        ids = written(running(df.select(F.col(doc_id).alias("named")).where("named is not null").distinct().withColumn("all", F.lit(0)), ["all"], [F.col("named")], {"place": F.lit(1).cast("long")}, "ids"), "ids")
        rows = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
        rows = rows.join(ids.hint("merge"), F.col("id") == F.col("named"), "left").select("place", "text")
        out = compared(rows, "place", "text", k, s, hashes).withColumnRenamed("doc_id", "at")
        out = out.join(ids.hint("merge"), F.col("at") == F.col("place"), "left")
        return out.select(F.col("named").alias("doc_id"), *(c for c in out.columns if c not in ("at", "all", "named", "place")))
    rows = with_next(df, doc_id, text, {"own": sketch(F.col("text"), k, s, hashes)})
    rows = rows.select(F.col("doc_id").cast(kind).alias("doc_id"), "text", edited(F.col("text"), F.col("next_text")).alias("edited"), "own", "next_own")
    rows = rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "own",
        sketch(F.col("edited"), k, s, hashes).alias("changed"),
        "next_own",
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_of(F.col("own")).alias("fingerprint"),
        text_of(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed"), hashes).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own"), hashes).alias("near_next"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """compared for all documents."""
    return compared(documents(spark, sf_dir))

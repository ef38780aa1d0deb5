"""What extracted items cite, and what may be stored from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.expressions import cosine

#: Kinds of relation of a fact to the time it was told. Fixed values.
RELATIONS = ["past", "present", "future", "recurring", "atemporal", "unknown"]
#: Statements of where somebody lives now; {value} is the place. Fixed values.
RESIDENCE = [
    r"\b(?:currently\s+|now\s+)?(?:live|living|reside|residing|based|settled)\s+(?:in|at)\s+{value}\b",
    r"\b(?:my\s+)?(?:current\s+)?(?:home|residence|address)\s+(?:is|is\s+in|in)\s+{value}\b",
    r"\b(?:moved|relocated)\s+to\s+{value}\b",
    r"(?:现居|现住|住在|居住在|定居于?|搬到|搬去了?)\s*{value}",
]


def cited_turns(items: DataFrame, turns: DataFrame) -> DataFrame:
    """(session_id, item, turn_id, turn): each item's citations that are turns of its session.

    items(session_id, item, source_turn_ids, source_turn_indices), turns(session_id,
    turn, turn_id). Named turns count; where none of them exists, numbered ones;
    where there is neither and the session has one turn, that one.
    """
    known = turns.select("session_id", F.col("turn").cast("long").alias("turn"), "turn_id")
    known = known.withColumn("alone", F.count("*").over(Window.partitionBy("session_id")) == 1)
    named = items.select("session_id", "item", F.explode("source_turn_ids").alias("turn_id")).join(known.hint("merge"), ["session_id", "turn_id"])
    numbered = items.select("session_id", "item", F.explode(F.col("source_turn_indices").cast("array<bigint>")).alias("turn")).join(known.hint("merge"), ["session_id", "turn"])
    lone = items.select("session_id", "item").join(known.where("alone").hint("merge"), "session_id")
    every = None
    for way, found in enumerate((named, numbered, lone)):
        part = found.select("session_id", "item", "turn_id", "turn", F.lit(way).alias("way"))
        every = part if every is None else every.union(part)
    best = F.min("way").over(Window.partitionBy("session_id", "item"))
    return every.withColumn("best", best).where("way = best").select("session_id", "item", "turn_id", "turn").distinct()


def supported(cites: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Citations (item_vector, context_vector, ...) with `accepted`: their vectors are near enough."""
    return cites.withColumn("score", F.round(cosine(F.col("item_vector"), F.col("context_vector")), 6)).withColumn("accepted", F.col("score") >= threshold)


def instant(value: Column, zone: Column, end: bool = False) -> Column:
    """ISO text as a time: one without a zone is taken in `zone`, a bare date ends at 23:59:59 if `end`; null where it is none."""
    text = F.trim(value)
    whole = F.when(F.length(text) == 10, F.concat(text, F.lit("T23:59:59" if end else "T00:00:00"))).otherwise(text)
    zoned = whole.rlike(r"(Z|[+-]\d\d:\d\d)$")
    parsed = F.coalesce(*(F.try_to_timestamp(whole, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss")))
    return F.when(zoned, parsed).otherwise(F.to_utc_timestamp(parsed, zone))


def temporal(items: DataFrame) -> DataFrame:
    """Text fields of time as times, in the session's zone UTC.

    items need observed_at, event_start, event_end, valid_from, valid_until,
    temporal_relation (text), confidence (text) and zone. An unknown relation
    becomes `unknown`; confidence is held between 0 and 1, null if it is no
    number. Where valid_from is missing it is the start of the event, or else
    the time of observation, if the relation places the fact in time.
    """
    zone = F.coalesce("zone", F.lit("UTC"))
    relation = F.lower(F.trim("temporal_relation"))
    relation = F.when(F.coalesce(relation, F.lit("")) == "", None).when(relation.isin(RELATIONS), relation).otherwise("unknown")
    times = {c: instant(F.col(c), zone, c in ("event_end", "valid_until")) for c in ("observed_at", "event_start", "event_end", "valid_from", "valid_until")}
    number = F.col("confidence").try_cast("double")
    held = F.when(number.isNotNull() & ~F.isnan(number), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
    rows = items.withColumns({**times, "temporal_relation": relation, "confidence": held})
    placed = F.col("temporal_relation").isin("past", "present", "future", "recurring")
    return rows.withColumn("valid_from", F.when(F.col("valid_from").isNull() & placed, F.coalesce("event_start", "observed_at")).otherwise(F.col("valid_from")))


def residence(kv: DataFrame, turns: DataFrame) -> DataFrame:
    """kv(session_id, key, value) without a location that no user turn of the session states as the present home."""
    places = kv.where("key = 'location'").select("session_id", "value").distinct()
    literal = F.regexp_replace("value", r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    said = turns.where("role = 'user'").select("session_id", "text").join(places.hint("merge"), "session_id")
    pattern = F.concat(F.lit("(?i)"), F.array_join(F.array(*(F.concat(F.lit("(?:" + a), literal, F.lit(b + ")")) for a, b in (p.split("{value}") for p in RESIDENCE))), "|"))
    stated = said.where(F.regexp_like("text", pattern)).select("session_id", "value").distinct().withColumn("key", F.lit("location"))
    other = kv.where("key <> 'location'")
    return other.unionByName(kv.where("key = 'location'").join(stated.hint("merge"), ["session_id", "key", "value"], "left_semi"))


def tool_calls(turns: DataFrame) -> DataFrame:
    """(conv_id, call_id, name, arguments, result): calls paired with their results; either may be missing.

    turns(conv_id, role, content, tool_call_id, tool_name, calls array(id, name, arguments)).
    A call without a name takes that of its result.
    """
    calls = turns.select("conv_id", F.explode("calls").alias("c")).select("conv_id", F.col("c.id").alias("call_id"), F.nullif("c.name", F.lit("")).alias("called"), "c.arguments")
    results = turns.where("role = 'tool'").select("conv_id", F.col("tool_call_id").alias("call_id"), "tool_name", F.col("content").alias("result"))
    return calls.join(results.hint("merge"), ["conv_id", "call_id"], "full").select("conv_id", "call_id", F.coalesce("called", "tool_name").alias("name"), "arguments", "result")

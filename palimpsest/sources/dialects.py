"""Chats as they are logged, in nested and in JSON form, as one table of turns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a message may hold; unknown fields are ignored. Fixed values.
CALL = "struct<id: string, function: struct<name: string, arguments: string>>"
BLOCK = "struct<type: string, text: string, id: string, name: string, input: string, tool_use_id: string, content: string>"
MESSAGE = f"role string, content string, turn_id string, dia_id string, message_id string, tool_call_id string, name string, tool_calls array<{CALL}>"


def nested_turns(raw: DataFrame, conversation: str = "conversation") -> DataFrame:
    """(sample_id, session, turn, role, text, turn_id, said_at) of conversations whose sessions are fields session_1, session_2, ...

    Each session is an array of (speaker, dia_id, text, blip_caption). speaker_a
    is the user, everybody else the assistant. A caption follows the text; turns
    left without any text are dropped, and the others keep their place.
    """
    fields = [f.name for f in raw.schema[conversation].dataType.fields]
    numbers = sorted(int(m.group(1)) for f in fields if (m := re.fullmatch(r"session_(\d+)", f)))
    part = F.col(conversation)
    sessions = F.array(*(F.struct(F.lit(n).alias("session"), (part[f"session_{n}_date_time"] if f"session_{n}_date_time" in fields else F.lit(None).cast("string")).alias("said_at"), part[f"session_{n}"].alias("turns")) for n in numbers))
    rows = raw.select("sample_id", part["speaker_a"].alias("speaker_a"), F.explode(sessions).alias("s"))
    rows = rows.select("sample_id", "speaker_a", "s.session", "s.said_at", F.posexplode("s.turns").alias("turn", "t"))
    caption = F.when(F.coalesce("t.blip_caption", F.lit("")) != "", F.concat(F.lit(" [Shared image description: "), "t.blip_caption", F.lit("]"))).otherwise("")
    text = F.concat(F.trim(F.coalesce("t.text", F.lit(""))), caption)
    role = F.when(F.col("t.speaker") == F.col("speaker_a"), "user").otherwise("assistant")
    return rows.select("sample_id", "session", "turn", role.alias("role"), text.alias("text"), F.coalesce("t.dia_id", F.lit("")).alias("turn_id"), "said_at").where("text <> ''")


def arguments(text: Column) -> Column:
    """Arguments of a call as JSON text: an object stays, nothing is {}, whatever else there is goes under _raw."""
    some = F.trim(F.coalesce(text, F.lit("")))
    is_object = some.startswith("{") & F.try_parse_json(some).isNotNull()
    return F.when(some == "", "{}").when(is_object, some).otherwise(F.to_json(F.struct(text.alias("_raw"))))


def messages(raw: DataFrame, key: str, text: str) -> DataFrame:
    """(key, part, role, content, turn_id, tool_call_id, tool_name, calls array(id, name, arguments)) of JSON messages in either dialect.

    One dialect lists calls beside the text and answers them in messages of
    role tool; the other has a list of text, tool_use and tool_result blocks.
    A message gives one row (part 0), a row for each tool_result after it, and
    none if there is neither text nor call nor result. Text that is no JSON
    object gives no row.
    """
    rows = raw.select(key, F.from_json(F.col(text), MESSAGE).alias("m")).where("m.role is not null")
    turn = F.coalesce("m.turn_id", "m.dia_id", "m.message_id", F.lit(""))
    blocks = F.when(F.trim("m.content").startswith("["), F.from_json("m.content", f"array<{BLOCK}>"))
    rows = rows.select(key, "m.*", turn.alias("turn"), blocks.alias("blocks"))

    listed = F.transform(F.coalesce("tool_calls", F.array().cast(f"array<{CALL}>")), lambda c: F.struct(F.coalesce(c["id"], F.lit("")).alias("id"), F.coalesce(c["function"]["name"], F.lit("")).alias("name"), arguments(c["function"]["arguments"]).alias("arguments")))
    used = F.transform(F.filter(F.coalesce("blocks", F.array().cast(f"array<{BLOCK}>")), lambda b: b["type"] == "tool_use"), lambda b: F.struct(F.coalesce(b["id"], F.lit("")).alias("id"), F.coalesce(b["name"], F.lit("")).alias("name"), arguments(b["input"]).alias("arguments")))
    said = F.trim(F.array_join(F.transform(F.filter("blocks", lambda b: (b["type"] == "text") & (b["text"] != "")), lambda b: b["text"]), "\n"))
    is_tool = F.col("role") == "tool"
    calls = F.when(is_tool, F.array().cast("array<struct<id: string, name: string, arguments: string>>")).otherwise(F.concat(listed, used))
    content = F.when(is_tool | F.col("blocks").isNull(), F.coalesce("content", F.lit(""))).otherwise(said)
    spoken = F.struct(F.lit(0).alias("part"), F.col("role"), content.alias("content"), F.col("turn").alias("turn_id"), "tool_call_id", F.col("name").alias("tool_name"), calls.alias("calls"))
    results = F.filter(F.coalesce("blocks", F.array().cast(f"array<{BLOCK}>")), lambda b: b["type"] == "tool_result")
    answers = F.transform(
        results,
        lambda b, i: F.struct(
            (i + 1).alias("part"),
            F.lit("tool").alias("role"),
            F.coalesce(F.when(b["content"].startswith("["), F.array_join(F.transform(F.from_json(b["content"], "array<struct<text: string>>"), lambda t: t["text"]), "\n")), b["content"], F.lit("")).alias("content"),
            F.lit("").alias("turn_id"),
            b["tool_use_id"].alias("tool_call_id"),
            F.lit(None).cast("string").alias("tool_name"),
            F.array().cast("array<struct<id: string, name: string, arguments: string>>").alias("calls"),
        ),
    )
    keep = is_tool | F.col("blocks").isNull() | (content != "") | (F.size(calls) > 0)
    parts = F.concat(F.when(keep, F.array(spoken)).otherwise(F.slice(F.array(spoken), 1, 0)), F.when(is_tool, F.slice(answers, 1, 0)).otherwise(answers))
    return rows.select(key, F.explode(parts).alias("p")).select(key, "p.*")


def transcript(raw: DataFrame, key: str, text: str) -> DataFrame:
    """(key, message, role, content) of texts with lines "[role]: words"; lines without a role continue the message before."""
    lines = raw.select(key, F.posexplode(F.split(text, "\n")).alias("line", "words"))
    head = r"^\[([A-Za-z]+)\]:\s?"
    by = Window.partitionBy(key).orderBy("line")
    lines = lines.withColumn("message", F.sum(F.col("words").rlike(head).cast("int")).over(by)).where("message > 0")
    said = F.array_sort(F.collect_list(F.struct("line", F.regexp_replace("words", head, "").alias("w"))))
    role = F.max(F.when(F.col("words").rlike(head), F.lower(F.regexp_extract("words", head, 1))))
    return lines.groupBy(key, "message").agg(role.alias("role"), F.array_join(F.transform(said, lambda x: x["w"]), "\n").alias("content"))

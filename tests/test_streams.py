"""Streams that go on in later runs: buffers, merged minutes, and a table under a log of changes."""

import datetime
import random

from pyspark.sql import functions as F
from test_queries import MEMORY, OPS, day, plain_apply

from palimpsest.streaming import jobs

TURNS = "user_id string, agent_id string, session_id string, turn long, role string, text string, at timestamp"


def at(d, minute):
    return datetime.datetime(2024, 1, d) + datetime.timedelta(minutes=minute)


def test_buffer_over_runs_and_days(spark, tmp_path):
    src, place = str(tmp_path / "in"), str(tmp_path / "place")

    def run(rows):
        spark.createDataFrame(rows, TURNS).coalesce(1).write.mode("append").parquet(src)
        out = jobs.buffered(spark.readStream.schema(TURNS).parquet(src), 2, keep=1, most=5)
        found = jobs.drained(out, "buffer", place).collect()
        return sorted((r["buffer_key"], r["batch"], r["reason"], r["n_user"], r["first_turn"], [x.split(": ")[1] for x in r["lines"]]) for r in found)

    assert run([("u", None, "s", 0, "user", "a", at(1, 0)), ("u", None, "s", 1, "assistant", "b", at(1, 1)), ("v", "g", None, 0, "user", "z", at(1, 2)), ("u", None, "s", 2, "user", "  ", at(1, 2))]) == []
    first = ("u::default_agent::s::2024-01-01", 0, "ready", 2, 0, ["a", "b", "c"])
    assert run([("u", None, "s", 4, "assistant", "d", at(1, 6)), ("u", None, "s", 3, "user", "c", at(1, 5))]) == [first]
    # the kept line and what follows wait for the end of the day; five lines are never exceeded
    many = [("w", "g", "t", k, "assistant", str(k), at(1, 10)) for k in range(7)]
    full = ("w::g::t::2024-01-01", 0, "full", 0, 0, ["0", "1", "2", "3", "4"])
    assert run(many) == sorted([first, full])
    got = run([("x", "g", "t", 0, "user", "next", at(2, 30))])
    got = run([("x", "g", "t", 1, "assistant", "more", at(2, 31))]) if len(got) < 5 else got
    assert got == sorted([first, full, ("u::default_agent::s::2024-01-01", 1, "day end", 1, 3, ["c", "d"]), ("v::g::default_session::2024-01-01", 0, "day end", 1, 0, ["z"]), ("w::g::t::2024-01-01", 1, "day end", 0, 4, ["4", "5", "6"])])


def test_any_split_of_events_gives_one_table_of_minutes(spark, tmp_path):
    rng = random.Random(1)
    rows = [(at(rng.choice([1, 5, 8, 9]), rng.randrange(4)), rng.choice("ab"), float(rng.randrange(9))) for _ in range(200)]
    schema, want = "ts timestamp, event_type string, value double", {}
    newest = max(t for t, *_ in rows).replace(second=0)
    for t, k, v in rows:
        if t > newest - datetime.timedelta(days=7):
            n, total = want.get((t, k), (0, 0.0))
            want[t, k] = (n + 1, total + v)
    for name, runs in (("one", [[rows]]), ("many", [[rows[:3], rows[3:4], rows[4:60]], [rows[60:61], rows[61:120]], [rows[120:]]])):
        src, place = str(tmp_path / name / "in"), str(tmp_path / name / "place")
        for run in runs:
            for part in run:
                spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
            got = jobs.merged_minutes(stream, place, most_parts=2).collect()
        assert {(r["minute"], r["event_type"]): (r["n"], r["total"]) for r in got} == want
    # a run without new events, and a batch that comes again, add nothing
    assert jobs.merged_minutes(stream, place, most_parts=2).count() == len(want)
    sums = spark.createDataFrame(rows[120:], schema).groupBy(F.date_trunc("minute", "ts").alias("minute"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    merged, parts = jobs.minute_parts(spark, place)
    sums.write.mode("overwrite").parquet(f"{place}/parts/batch={parts[-1]}")
    assert {(r["minute"], r["event_type"]): (r["n"], r["total"]) for r in jobs.minutes(spark, place).collect()} == want
    assert len(merged) <= 2 and len(parts) <= 4


def test_what_a_batch_reads_follows_its_targets(spark, tmp_path):
    memory = [(f"m{i}", f"text {i}", ["D0"], day(1, 1), None, True, None, None) for i in range(3000)]
    base, ops, rng = spark.createDataFrame(memory, MEMORY), [], random.Random(2)
    batches = 10
    for b in range(batches):
        part = [(100 * b + k, "ADD", f"n{b}-{k}", None, "new text", [], day(2, 1)) if k >= 10 else (100 * b + k, "UPDATE", None, f"m{rng.randrange(3000)}", f"text of {b}", [f"D{b}"], day(3, 1)) for k in range(40)]
        ops += part
        spark.createDataFrame(part, OPS).coalesce(1).write.parquet(str(tmp_path / "ops" / f"p{b:02}"))
    stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ops" / "*"))
    place = str(tmp_path / "table")
    after = jobs.applied(stream, base, "memory", place, buckets=8, rows=100, parts=2)
    assert jobs.table_folder(spark, place)[1] >= 32  # the first look doubled them
    want, rejected = plain_apply(memory, ops)
    assert rejected == [] and sorted(repr(list(r)) for r in after.collect()) == want
    reads = {r["batch"]: (r["parts"], r["bytes"]) for r in spark.read.parquet(f"{place}/reads").collect()}
    assert len(reads) == batches
    early, late = ([reads[b][1] for b in some] for some in (range(1, 4), range(batches - 3, batches)))
    assert sum(late) < 2 * sum(early), reads
    assert max(n for n, _ in reads.values()) <= 10 * 5

"""Structured Streaming jobs. Each takes a stream and gives one; drained() runs one over what its source holds now."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from palimpsest.operators.lineage import file_system, folders, removed, settings, shared_dir, size_of, written
from palimpsest.operators.versions import changed_rows


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream. A file source reads folders, so a table of one file is picked from its folder by name."""
    table = spark.read.parquet(f"{sf_dir}/{name}")
    reader = spark.readStream.schema(table.schema)
    alone = any(f.rstrip("/").endswith(f"/{name}") for f in table.inputFiles())
    return reader.option("pathGlobFilter", name).parquet(sf_dir) if alone else reader.parquet(f"{sf_dir}/{name}")


def events(spark: SparkSession, sf_dir: str, name: str = "events.parquet") -> DataFrame:
    rows = table_stream(spark, sf_dir, name)
    return rows.withColumn("ts", rows["ts"].cast("timestamp"))


def minute_metrics(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each minute and type; a minute is given out once no more of it can come."""
    by_minute = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "event_type")
    return by_minute.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("minute"), "event_type", "n", "total")


def recent_completions(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events of the last 60 seconds, every 10 seconds."""
    sliding = stream.withWatermark("ts", late).groupBy(F.window("ts", "60 seconds", "10 seconds"))
    return sliding.agg(F.count("*").alias("n")).select(F.col("window.end").alias("until"), "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Stretches of a user's events without a pause of `gap`."""
    grouped = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("session"))
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("session.start").alias("begin"), "n", "total")


def first_inserts(stream: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the time that rows may be late."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


#: What comes out of a buffer.
READY = "buffer_key string, batch long, reason string, n_lines long, n_user long, first_turn long, lines array<string>"


class Buffer(StatefulProcessor):
    """Lines of a key until there are enough. The key is (user, agent, session, day)."""

    def __init__(self, size: int, keep: int, most: int):
        self.size, self.keep, self.most = size, keep, most

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "batch long, n_user long")
        self.lines = handle.getListState("lines", "turn long, role string, line string")

    def fired(self, key, reason: str, batch: int, lines: list) -> tuple:
        return "::".join(map(str, key)), batch, reason, len(lines), sum(r == "user" for _, r, _ in lines), lines[0][0], [x for _, _, x in lines]

    def handleInputRows(self, key, rows, timerValues):
        batch, n_user = (int(x) for x in self.counts.get()) if self.counts.exists() else (0, 0)
        # turns of one trigger come in any order; a key has those of one session and day
        new = pd.concat(list(rows)).sort_values(["turn", "role", "text"])
        held, added, out = None, [], []
        for turn, role, text in zip(new["turn"], new["role"], new["text"]):
            added.append((int(turn), role, f"[{role}]: {text}"))
            n_user += role == "user"
            if held is None and (n_user >= self.size or len(added) >= self.most):
                held = [(int(t), r, x) for t, r, x in self.lines.get()]
            if held is not None and (n_user >= self.size or len(held) + len(added) >= self.most):
                lines = held + added
                out.append(self.fired(key, "ready" if n_user >= self.size else "full", batch, lines))
                batch, held, added = batch + 1, lines[len(lines) - self.keep :] if self.keep else [], []
                n_user = sum(r == "user" for _, r, _ in held)
        if held is not None:
            self.lines.put(held + added) if held + added else self.lines.clear()
        elif added:
            self.lines.appendList(added)
        self.counts.update((batch, int(n_user)))
        end = int((pd.Timestamp(key[-1]) + pd.Timedelta(days=1)).timestamp() * 1000)
        if end not in list(self.handle.listTimers()):
            self.handle.registerTimer(end)
        yield pd.DataFrame(out, columns=["buffer_key", "batch", "reason", "n_lines", "n_user", "first_turn", "lines"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        lines = [(int(t), r, x) for t, r, x in self.lines.get()]
        batch = int(self.counts.get()[0]) if self.counts.exists() else 0
        self.lines.clear()
        self.counts.clear()
        rest = [self.fired(key, "day end", batch, lines)] if lines else []
        yield pd.DataFrame(rest, columns=["buffer_key", "batch", "reason", "n_lines", "n_user", "first_turn", "lines"])

    def close(self) -> None:
        pass


def buffered(turns: DataFrame, size: int = 10, keep: int = 0, most: int = 1000, late: str = "10 minutes") -> DataFrame:
    """READY rows of turns(user_id, agent_id, session_id, turn, role, text, at): each time `size` user turns of one user, agent, session and day have come together, or `most` lines.

    Other turns wait with them. The last `keep` lines of a batch stay for the
    next one (keep < size). What a day leaves is given out when the watermark
    passes its end, and its state goes then; a key's state never holds `most`
    lines. Null owners have default names, and blank texts are no lines. State
    needs the RocksDB provider, under which drained() runs the job.
    """
    owner = [F.coalesce("user_id", F.lit("")).alias("user_id"), F.coalesce("agent_id", F.lit("default_agent")).alias("agent_id"), F.coalesce("session_id", F.lit("default_session")).alias("session_id")]
    rows = turns.where("trim(text) <> ''").select(*owner, F.date_format("at", "yyyy-MM-dd").alias("day"), F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), "text", "at").withWatermark("at", late)
    return rows.groupBy("user_id", "agent_id", "session_id", "day").transformWithStateInPandas(Buffer(size, keep, most), READY, "append", "eventTime")


def merged_minutes(stream: DataFrame, place: str, keep: str = "7 days", most_parts: int = 8) -> DataFrame:
    """Counts and sums of each minute and event type over all runs into `place`, of the minutes within `keep` of the newest one.

    Each batch writes its own sums as a part, so a batch that is replayed
    replaces what it wrote. Several parts of a minute add up. Over `most_parts`
    parts are merged into one, without the minutes that are too old; parts are
    deleted a batch later, when the batch that merged them can't come again.
    Events of one minute may come in any batch or run, at any time.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        merged, parts = minute_parts(spark, place)
        if number <= max(merged, default=-1):
            return
        sums = batch.groupBy(F.date_trunc("minute", "ts").alias("minute"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        sums.write.mode("overwrite").parquet(f"{place}/parts/batch={number}")
        for old in parts:
            if old <= max(merged, default=-1):
                removed(spark, f"{place}/parts/batch={old}")
        for old in merged[:-1]:
            removed(spark, f"{place}/merged/batch={old}")
        if len([p for p in parts if p > max(merged, default=-1)]) >= most_parts:
            minutes(spark, place, keep).write.mode("overwrite").parquet(f"{place}/merged/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return minutes(spark, place, keep)


def minute_parts(spark: SparkSession, place: str) -> tuple[list[int], list[int]]:
    """Numbers of the merged parts that are whole, and of the single ones."""
    fs, path = file_system(spark, place)
    whole = lambda kind, f: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{place}/{kind}/{f}/_SUCCESS"))
    return tuple(sorted(int(f.split("=")[1]) for f in folders(spark, f"{place}/{kind}") if f.startswith("batch=") and whole(kind, f)) for kind in ("merged", "parts"))


def minutes(spark: SparkSession, place: str, keep: str = "7 days") -> DataFrame:
    """The table in `place`: (minute, event_type, n, total)."""
    merged, parts = minute_parts(spark, place)
    paths = [f"{place}/merged/batch={merged[-1]}"] if merged else []
    paths += [f"{place}/parts/batch={p}" for p in parts if p > max(merged, default=-1)]
    schema = "minute timestamp, event_type string, n long, total double"
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*paths)
    newest = rows.agg(F.max("minute") - F.expr(f"interval {keep}")).scalar()
    return rows.where(F.col("minute") > newest).groupBy("minute", "event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def expired(stream: DataFrame, windows: DataFrame, now: str, minutes: int) -> DataFrame:
    """Rows (layer, at, valid_until, ...) with `gone`: older than their layer's window(layer, minutes) at `now`; an intention past its validity becomes a fact.

    windows is a small table of settings, a row for each layer.
    """
    at = F.to_timestamp(F.lit(now))
    rows = stream.join(F.broadcast(windows), "layer", "left")
    gone = F.unix_micros("at") < F.unix_micros(at) - F.coalesce("minutes", F.lit(minutes)).cast("long") * 60_000_000
    over = F.coalesce((F.col("layer") == "l7_intention") & (F.col("valid_until") < at), F.lit(False))
    return rows.withColumn("gone", gone).withColumn("layer", F.when(over, "l2_fact").otherwise(F.col("layer"))).drop("minutes")


#: Rows of a bucket before buckets are doubled, parts of a bucket before they are merged, batches between looks at the number of rows.
ROWS, PARTS, LOOK = 50_000, 6, 16


def bucket_of(node: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")


def table_folder(spark: SparkSession, place: str) -> tuple[str, int]:
    """The folder of the table with the most buckets that is whole, and how many these are."""
    fs, _ = file_system(spark, place)
    found = [int(f.split("=")[1]) for f in folders(spark, place) if f.startswith("buckets=")]
    whole = [n for n in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{place}/buckets={n}/_SUCCESS"))]
    return (f"{place}/buckets={max(whole)}", max(whole)) if whole else ("", 0)


def parts_of(spark: SparkSession, folder: str, buckets: list[int], before: int) -> dict[int, list[int]]:
    """Versions of each bucket that count before a version: the last whole one (odd numbers) and the changes since (even ones)."""
    out = {}
    for b in buckets:
        found = sorted(v for f in folders(spark, f"{folder}/bucket={b}") if (v := int(f.split("=")[1])) < before)
        base = max((v for v in found if v % 2), default=found[0] if found else 0)
        out[b] = [v for v in found if v >= base]
    return out


def newest(spark: SparkSession, folder: str, memory: DataFrame, parts: dict[int, list[int]]) -> DataFrame:
    """The rows of these parts, each in its last version, with their bucket."""
    paths = [f"{folder}/bucket={b}/version={v}" for b, versions in parts.items() for v in versions]
    schema = StructType([*memory.schema.fields]).add("bucket", "integer").add("version", "long")
    if not paths:
        return spark.createDataFrame([], schema).drop("version")
    rows = spark.read.schema(schema).option("basePath", folder).parquet(*paths)
    last = F.row_number().over(Window.partitionBy("bucket", "node_id").orderBy(F.col("version").desc()))
    return rows.withColumn("nth", last).where("nth = 1").drop("nth", "version")


def put_parts(rows: DataFrame, folder: str, version: int) -> None:
    """Writes rows with their bucket as parts of a version, replacing those of that version alone."""
    rows.withColumn("version", F.lit(version)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(folder)


def doubled(spark: SparkSession, place: str, memory: DataFrame, version: int, rows: int) -> None:
    """Writes the table anew with more buckets, once buckets hold over `rows` rows on average: every row is moved about once for each doubling of the table."""
    folder, buckets = table_folder(spark, place)
    n = spark.read.parquet(folder).count()
    if n <= buckets * rows:
        return
    more = buckets
    while n > more * rows / 2:
        more *= 2
    every = [int(f.split("=")[1]) for f in folders(spark, folder) if f.startswith("bucket=")]
    now = newest(spark, folder, memory, parts_of(spark, folder, every, version)).drop("bucket")
    now.withColumn("bucket", bucket_of("node_id", more)).withColumn("version", F.lit(-1)).repartition("bucket").write.mode("overwrite").partitionBy("bucket", "version").parquet(f"{place}/buckets={more}")


def applied(stream: DataFrame, memory: DataFrame, name: str, place: str | None = None, buckets: int = 8, rows: int = ROWS, parts: int = PARTS) -> DataFrame:
    """The memory table after all operations of the stream, applied batch by batch.

    Rows lie in buckets by their node_id. A batch reads the buckets that its
    targets are in, and of each the last whole version and the few changes since;
    it writes the rows that it changes or makes. A bucket of over `parts` parts
    is written whole again, and its older parts go with the next batch. Buckets
    are doubled as the table grows, so one holds about `rows` rows at any size:
    what a batch reads follows its targets, not the table or its history
    (`reads` in the place says how many bytes each batch had to read). A batch
    that is replayed replaces its own parts. A job that goes on in a later run
    names the same place.
    """
    spark = memory.sparkSession
    place = place or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not table_folder(spark, place)[1]:
        memory.withColumn("bucket", bucket_of("node_id", buckets)).withColumn("version", F.lit(-1)).repartition("bucket").write.mode("overwrite").partitionBy("bucket", "version").parquet(f"{place}/buckets={buckets}")

    def put(batch: DataFrame, number: int) -> None:
        version = 2 * number
        if number % LOOK == 0:
            doubled(spark, place, memory, version, rows)
        folder, n = table_folder(spark, place)
        batch = written(batch, "batch")
        # no more numbers than there are targets
        near = [r[0] for r in batch.where("target_id is not null").select(bucket_of("target_id", n)).distinct().collect()]
        read = parts_of(spark, folder, near, version)
        before = newest(spark, folder, memory, read).join(batch.select(F.col("target_id").alias("node_id")).distinct().hint("merge"), "node_id", "left_semi")
        changed, rejected = changed_rows(written(before.select(memory.columns), "targets"), batch)
        changed = written(changed.withColumn("bucket", bucket_of("node_id", n)), "changed")
        put_parts(changed, folder, version)
        rejected.write.mode("overwrite").parquet(f"{place}/rejected/batch={number}")
        size = sum(size_of(spark, f"{folder}/bucket={b}/version={v}") for b, versions in read.items() for v in versions)
        spark.createDataFrame([(sum(map(len, read.values())), size)], "parts long, bytes long").coalesce(1).write.mode("overwrite").parquet(f"{place}/reads/batch={number}")
        touched = [r[0] for r in changed.select("bucket").distinct().collect()]
        now = parts_of(spark, folder, touched, version + 1)
        for b in touched:
            # what an earlier batch has replaced can't be needed again
            for f in folders(spark, f"{folder}/bucket={b}"):
                if int(f.split("=")[1]) < min(parts_of(spark, folder, [b], version)[b], default=-1):
                    removed(spark, f"{folder}/bucket={b}/{f}")
        full = {b: v for b, v in now.items() if len(v) > parts}
        if full:
            put_parts(newest(spark, folder, memory, full), folder, version + 1)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return current(spark, place, memory)


def current(spark: SparkSession, place: str, memory: DataFrame) -> DataFrame:
    """The table in `place` as it is now."""
    folder, _ = table_folder(spark, place)
    every = [int(f.split("=")[1]) for f in folders(spark, folder) if f.startswith("bucket=")]
    return newest(spark, folder, memory, parts_of(spark, folder, every, 1 << 62)).select(memory.columns)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(stream: DataFrame, name: str, place: str | None = None) -> DataFrame:
    """Runs the stream over all that is there, in append mode into Parquet in the shared folder, and reads the result.

    A job that goes on in a later run names the same place.

    Windows that the watermark has not passed at the end stay open in the
    checkpoint, for the next run to close.
    """
    spark = stream.sparkSession
    place = place or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, **{"spark.sql.streaming.stateStore.providerClass": ROCKSDB}):
        query = stream.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")

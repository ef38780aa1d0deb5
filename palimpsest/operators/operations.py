"""Operations as a model writes them: parsing, references, checks, and what they make of drafts and schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.expressions import owner
from palimpsest.operators.lineage import parts, written

ONE = "op string, content string, layer string, owner string, memory_id string, memory_ids array<string>, tags array<string>, reason string, source_indices array<int>, state_transition boolean"
OPS = f"array<struct<{ONE}, ops array<struct<{ONE}>>>>"
DRAFTS = "memories array<struct<task string, solution string, boundary_scope string, boundary_envs string, search_keys array<string>, confidence string>>"
#: Where a code memory holds. Fixed values.
SCOPES = ["strict", "project", "user", "global"]


def unfenced(text: Column) -> Column:
    """The inside of a fenced block, or the trimmed text."""
    return F.trim(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?s)^```[A-Za-z]*\s*\n(.*?)\n?```.*$", "$1"))


def json_array(text: Column) -> Column:
    """The first fenced block, or what stands between the first [ and the last ], if that is JSON; else null."""
    fenced = F.regexp_extract(text, r"(?s)```[A-Za-z]*\s*\n(.*?)\n?```", 1)
    bare = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    found = F.when(fenced != "", fenced).otherwise(bare)
    return F.when((found != "") & F.try_parse_json(found).isNotNull(), F.trim(found))


def parsed(raw: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Operations (key, nth, op, content, layer, owner, memory_ids, tags, reason, source_indices) in JSON text, and rejects (key, nth, reason).

    A list, a single object, or groups of a reason and ops; fenced or not. Tags
    are lower-cased, the first three count. An UPDATE that changes the state is
    a SUPERSEDE. The last of memory_ids is the newest; memory_id goes to its
    end. Text that is no JSON is a reject, as is an operation without target or
    of an unknown kind.
    """
    body = unfenced(F.col(text))
    listed = F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    rows = raw.select(key, F.from_json(F.when(F.try_parse_json(listed).isNotNull(), listed), OPS).alias("entries"))
    bad = rows.where("entries is null").select(key, F.lit(None).cast("int").alias("nth"), F.lit("no JSON").alias("reason"))
    fields = [f.split()[0] for f in ONE.split(", ")]
    flat = F.flatten(
        F.transform(
            "entries",
            lambda e: F.when(e["ops"].isNotNull(), F.transform(e["ops"], lambda o: F.struct(*(F.coalesce(F.nullif(F.trim(o[f]), F.lit("")), e["reason"]).alias(f) if f == "reason" else o[f].alias(f) for f in fields)))).otherwise(F.array(F.struct(*(e[f].alias(f) for f in fields)))),
        )
    )
    rows = rows.where("entries is not null").select(key, F.posexplode(flat).alias("nth", "o")).select(key, "nth", "o.*")
    kind = F.upper(F.trim("op"))
    kind = F.when((kind == "UPDATE") & F.coalesce("state_transition", F.lit(False)), "SUPERSEDE").otherwise(kind)
    listed_ids = F.filter(F.transform(F.coalesce("memory_ids", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda i: i != "")
    one = F.trim(F.coalesce("memory_id", F.lit("")))
    ids = F.when((one != "") & ~F.array_contains(listed_ids, one), F.array_append(listed_ids, one)).otherwise(listed_ids)
    tags = F.slice(F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), lambda t: t != ""), 1, 3)
    sources = F.array_distinct(F.filter(F.coalesce("source_indices", F.array().cast("array<int>")), lambda i: i >= 0))
    rows = rows.select(key, "nth", kind.alias("op"), "content", "layer", owner(F.col("owner")).alias("owner"), ids.alias("memory_ids"), tags.alias("tags"), F.coalesce("reason", F.lit("")).alias("reason"), sources.alias("source_indices"))
    why = F.when(F.col("op").isNull() | ~F.col("op").isin("ADD", "UPDATE", "SUPERSEDE", "DELETE"), "unknown operation").when((F.col("op") != "ADD") & (F.size("memory_ids") == 0), "target is missing")
    rows = rows.withColumn("why", why)
    return rows.where("why is null").drop("why"), bad.unionByName(rows.where("why is not null").select(key, "nth", F.col("why").alias("reason")))


def scope_error(scope: Column, workspace: Column, branch: Column) -> Column:
    """What a scope lacks, or null."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(~F.coalesce(scope, F.lit("")).isin(SCOPES), F.concat(F.lit("invalid boundary_scope="), F.coalesce(scope, F.lit(""))))
        .when((scope == "strict") & (empty(workspace) | empty(branch)), "boundary_scope='strict' requires both workspace_id and branch")
        .when((scope == "project") & empty(workspace), "boundary_scope='project' requires workspace_id")
    )


def drafts(raw: DataFrame, key: str, text: str) -> DataFrame:
    """(key, nth, task, solution, scope, search_keys, confidence) of JSON {"memories": [...]}; raw has workspace and branch too.

    Drafts without task or solution are left out, as are those whose scope lacks
    its workspace or branch. An unknown scope means project. The first five
    search keys that differ from the task count; confidence is 0.7 where it is
    no number, and held between 0 and 1.
    """
    body = unfenced(F.col(text))
    json = F.coalesce(*(F.when(F.try_parse_json(b).isNotNull(), b) for b in (body, F.regexp_extract(body, r"(?s)\{.*\}", 0))))
    rows = raw.select(key, "workspace", "branch", F.posexplode(F.from_json(json, DRAFTS)["memories"]).alias("nth", "m")).select(key, "workspace", "branch", "nth", "m.*")
    task, solution = (F.trim(F.coalesce(c, F.lit(""))) for c in ("task", "solution"))
    scope = F.lower(F.trim(F.coalesce("boundary_scope", F.lit("project"))))
    scope = F.when(scope.isin(SCOPES), scope).otherwise("project")
    keys = F.array_distinct(F.filter(F.transform(F.coalesce("search_keys", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda k: (k != "") & (k != task)))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.7))))
    rows = rows.select(key, "nth", "workspace", "branch", task.alias("task"), solution.alias("solution"), scope.alias("scope"), F.slice(keys, 1, 5).alias("search_keys"), sure.alias("confidence"))
    good = (F.col("task") != "") & (F.col("solution") != "") & scope_error(F.col("scope"), F.col("workspace"), F.col("branch")).isNull()
    return rows.where(good).drop("workspace", "branch")


def resolved(ops: DataFrame, tokens: list[str]) -> DataFrame:
    """ops(request_id, seq, ref, created_id, ...) with temporary references in the token columns replaced by real ids.

    created_id is set where a schema was made. Its own ref names it, and so do
    schema_k and schema_id_k, where it is the request's k-th; only what was made
    before an operation is known to it. Of several meanings the latest ref
    counts. Other tokens stay.
    """
    made = ops.where("created_id is not null").withColumn("k", F.row_number().over(Window.partitionBy("request_id").orderBy("seq")))
    names = F.filter(F.array(F.struct(F.nullif("ref", F.lit("")).alias("token"), F.lit(1).alias("explicit")), *(F.struct(F.concat(F.lit(p), "k").alias("token"), F.lit(0).alias("explicit")) for p in ("schema_", "schema_id_"))), lambda x: x["token"].isNotNull())
    known = made.select("request_id", F.col("seq").alias("made_at"), "created_id", F.explode(names).alias("n")).select("request_id", "made_at", F.col("created_id").alias("real"), "n.*")
    out = ops
    for c in tokens:
        found = ops.select("request_id", "seq", F.col(c).alias("token")).join(known.hint("shuffle_hash"), ["request_id", "token"]).where("made_at < seq")
        best = found.groupBy("request_id", "seq").agg(F.max(F.struct("explicit", "made_at", "real")).alias("b")).select("request_id", "seq", F.col("b.real").alias(f"real_{c}"))
        out = out.join(best.hint("shuffle_hash"), ["request_id", "seq"], "left").withColumn(c, F.coalesce(f"real_{c}", c)).drop(f"real_{c}")
    return out


def judged_evidence(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """candidates(request_id, owner, fact_id) with the reason against the fact, and whether its whole request is accepted."""
    rows = candidates.join(facts.select("fact_id", F.col("owner").alias("fact_owner")).hint("merge"), "fact_id", "left")
    why = F.when(F.col("fact_owner").isNull(), "missing").when(F.col("fact_owner") != F.col("owner"), "isolation")
    rows = rows.withColumn("reason", why)
    bad = rows.where("reason is not null").select("request_id", F.lit(True).alias("bad")).distinct()
    return rows.join(bad.hint("merge"), "request_id", "left").select("request_id", "fact_id", "reason", F.col("bad").isNull().alias("accepted"))


def made_schemas(candidates: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Schemas(node_id, owner, content), evidence(node_id, fact_id), topics(node_id, topic_id), uses(fact_id, n) from candidates(request_id, owner, content, facts, tags).

    A request counts as a whole: all its facts exist and are its owner's, and
    there is at least one.
    """
    candidates = written(candidates.select("request_id", "owner", "content", "facts", "tags"), "candidates")
    cites = candidates.select("request_id", "owner", F.explode(F.array_distinct("facts")).alias("fact_id"))
    rows = cites.join(facts.select("fact_id", F.col("owner").alias("fact_owner")).hint("merge"), "fact_id", "left")
    good = F.col("fact_owner").isNotNull() & F.coalesce(F.col("fact_owner") == F.col("owner"), F.lit(True))
    rows = rows.withColumn("ok", F.bool_and(good).over(Window.partitionBy("request_id"))).where("ok and request_id is not null")
    accepted = written(rows.select("request_id", "owner", "fact_id").distinct(), "accepted")
    made = written(candidates.drop("facts").join(accepted.select("request_id").distinct().hint("merge"), "request_id", "left_semi"), "made")
    # names are hashed after what shuffles them
    name, node_id = F.concat_ws(":", F.lit("schema"), "owner", "request_id"), F.sha2("name", 256).alias("node_id")
    evidence = accepted.select(name.alias("name"), "fact_id").select(node_id, "fact_id")
    topics = made.select(name.alias("name"), "owner", F.explode("tags").alias("tag")).select("name", F.concat_ws(":", "owner", "tag").alias("topic")).distinct().select(node_id, F.sha2("topic", 256).alias("topic_id"))
    return made.select(name.alias("name"), "owner", "content").select(node_id, "owner", "content"), evidence, topics, evidence.groupBy("fact_id").agg(F.count("*").alias("n"))


def segments(ops: DataFrame) -> DataFrame:
    """(node, superseded_by): a SUPERSEDE of several rows, ops(new_id, memory_ids), links them in their order, the last to the new one."""
    rows = ops.select("new_id", F.posexplode("memory_ids").alias("place", "node"), "memory_ids")
    return rows.select("node", F.coalesce(F.try_element_at("memory_ids", F.col("place") + 2), "new_id").alias("superseded_by"))


def enriched(ops: DataFrame, items: DataFrame, fields: list[str]) -> DataFrame:
    """ops(request_id, seq, content, source_indices, fields) with empty fields taken from the source items, where all that have a value agree.

    items(request_id, item, content, fields). The sources are those the
    operation names; without any, those of the same content; without any, the
    request's only item.
    """
    n = parts(items)
    items, ops = items.repartition(n, "request_id"), ops.repartition(n, "request_id", "seq")
    known = items.select("request_id", "item", F.col("content").alias("item_content"), *(F.col(f).alias(f"i_{f}") for f in fields), (F.count("*").over(Window.partitionBy("request_id")) == 1).alias("alone"))
    own = ops.select("request_id", "seq", "content", F.coalesce("source_indices", F.array().cast("array<int>")).alias("sources"))
    met = own.repartition(n, "request_id").join(known.hint("merge"), "request_id")
    way = F.when(F.array_contains("sources", F.col("item").cast("int")), 0).when(F.col("item_content") == F.col("content"), 1).when(F.col("alone"), 2)
    met = met.withColumn("way", way).where("way is not null").withColumn("best", F.min("way").over(Window.partitionBy("request_id", "seq"))).where("way = best")
    agreed = met.groupBy("request_id", "seq").agg(*(F.when(F.min(f"i_{f}") == F.max(f"i_{f}"), F.min(f"i_{f}")).alias(f"i_{f}") for f in fields))
    out = ops.join(agreed.repartition(n, "request_id", "seq").hint("merge"), ["request_id", "seq"], "left")
    return out.select(*(F.coalesce(c, f"i_{c}").alias(c) if c in fields else F.col(c) for c in ops.columns))


def code_changes(ops: DataFrame, proposed: DataFrame) -> DataFrame:
    """(request_id, action, draft, memory_id) that operations on code memories come to.

    ops(request_id, seq, action, draft, target), proposed(request_id, draft). A
    draft is used once, by its first ADD, UPDATE with a target, or SKIP. DELETE
    needs a target. Drafts that nothing used are added.
    """
    rows = ops.join(proposed.select("request_id", "draft", F.lit(True).alias("known")).hint("merge"), ["request_id", "draft"], "left")
    has = F.coalesce("target", F.lit("")) != ""
    takes = F.coalesce("known", F.lit(False)) & ((F.col("action").isin("ADD", "SKIP")) | ((F.col("action") == "UPDATE") & has))
    turn = F.row_number().over(Window.partitionBy("request_id", "draft", F.col("takes")).orderBy("seq"))
    rows = rows.withColumn("takes", takes).withColumn("turn", turn)
    new_id = F.sha2(F.concat_ws(":", F.lit("code"), "request_id", "draft"), 256)
    done = rows.where("(takes and turn = 1 and action <> 'SKIP')").select("request_id", "action", "draft", F.when(F.col("action") == "ADD", new_id).otherwise(F.col("target")).alias("memory_id"))
    gone = rows.where((F.col("action") == "DELETE") & has).select("request_id", "action", F.lit(None).cast("int").alias("draft"), F.col("target").alias("memory_id"))
    used = rows.where("takes").select("request_id", "draft").distinct()
    rest = proposed.select("request_id", "draft").join(used.hint("merge"), ["request_id", "draft"], "left_anti").select("request_id", F.lit("ADD").alias("action"), "draft", new_id.alias("memory_id"))
    return done.unionByName(gone).unionByName(rest)


def code_keys(memories: DataFrame) -> DataFrame:
    """(key_id, memory_id, place, text): the task, then each search key, of memories(memory_id, task, search_keys)."""
    rows = memories.select("memory_id", F.posexplode(F.concat(F.array("task"), F.coalesce("search_keys", F.array().cast("array<string>")))).alias("place", "text"))
    return rows.select(F.concat_ws("#", "memory_id", "place").alias("key_id"), "memory_id", "place", "text")


def replaced_keys(keys: DataFrame, memories: DataFrame) -> DataFrame:
    """Keys with all those of the given memories made new, so that none of an older place is left."""
    return keys.join(memories.select("memory_id").hint("merge"), "memory_id", "left_anti").select(keys.columns).unionByName(code_keys(memories))

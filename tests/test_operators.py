"""Operators that SQL can't express, against plain versions, and rules of parsing and storing on small tables."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import expressions as X
from palimpsest.operators import citations, clusters, entities, evaluation, fusion, graph, operations, profiles, retrieval, versions
from palimpsest.plans import catalog


def cos(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b)) / n, 9) if n else 0.0


def plain_dense(nums, near, least):
    ring = {n: {m for m in nums if m != n and near(n, m)} for n in nums}
    cores = {n for n in nums if len(ring[n]) + 1 >= least}
    label, out = {}, {}
    for n in sorted(cores):
        if n not in label:
            todo = [n]
            while todo:
                m = todo.pop()
                if m not in label:
                    label[m] = n
                    todo += [x for x in ring[m] if x in cores]
    for n in nums:
        found = [label[n]] if n in cores else [label[m] for m in ring[n] if m in cores]
        if found:
            out[n] = min(found)
    return out


def plain_kept(nums, near):
    kept = []
    for n in sorted(nums):
        if not any(near(k, n) for k in kept):
            kept.append(n)
    return kept


def groups_of(labels):
    out = {}
    for n, c in labels.items():
        out.setdefault(c, []).append(n)
    return out


def plain_clusters(rows, similarity, finer, largest, least, same):
    vector, result = {n: v for n, _, v in rows}, {}
    for user in {u for _, u, _ in rows}:
        nums = [n for n, u, _ in rows if u == user]
        near = lambda t: lambda a, b: cos(vector[a], vector[b]) >= t
        final = []
        for members in groups_of(plain_dense(nums, near(similarity), least)).values():
            if len(members) <= largest:
                final.append(members)
                continue
            parts = groups_of(plain_dense(members, near(finer), least))
            placed = {n for p in parts.values() for n in p}
            means = {p: [sum(vector[n][i] for n in m) / len(m) for i in range(len(vector[members[0]]))] for p, m in parts.items()}
            strays = [n for n in members if n not in placed]
            if not parts:
                final.append(strays)
                continue
            for n in strays:
                parts[min(means, key=lambda p: (-cos(vector[n], means[p]), p))].append(n)
            final += parts.values()
        for members in final:
            members = plain_kept(members, near(same)) if len(members) >= least else []
            if len(members) >= least:
                mean = [sum(vector[n][i] for n in members) / len(members) for i in range(len(vector[members[0]]))]
                best = min(members, key=lambda n: (round(sum((x - y) ** 2 for x, y in zip(vector[n], mean)), 9), n))
                result |= {n: n == best for n in members}
    return result


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_agree_with_a_plain_version(spark, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(4)]
    rows = [(n, n % 2, [x + rng.gauss(0, 0.45) for x in rng.choice(centres)]) for n in range(110)] + [(200 + n, 0, [9.0, 9.0, 9.0, 9.0]) for n in range(5)]
    got = clusters.clusters(spark.createDataFrame(rows, "num long, user_id long, embedding array<double>"), 0.9, 0.96, 12, 4, 0.995).collect()
    want = plain_clusters(rows, 0.9, 0.96, 12, 4, 0.995)
    assert {r["num"]: r["is_representative"] for r in got} == want and want


def test_clusters_of_nothing(spark):
    assert clusters.clusters(spark.createDataFrame([], "num long, user_id long, embedding array<double>")).count() == 0


def test_first_kept_agrees_with_a_pass_in_order(spark):
    rng = random.Random(5)
    links = {tuple(sorted(rng.sample(range(80), 2))) for _ in range(150)}
    nodes = spark.range(80).withColumnRenamed("id", "num")
    got = clusters.first_kept(nodes, spark.createDataFrame(list(links) + [(3, 3)], "a long, b long")).collect()
    assert sorted(r["num"] for r in got) == plain_kept(range(80), lambda a, b: (a, b) in links)


def test_names(spark):
    text = 'We met Anna Smith of the Royal Society in Paris. Paris was cold; "green tea" and "Green Tea" helped Anna. Note: x'
    got = entities.entities(spark.createDataFrame([("m", "u", text), ("n", "u", None), ("o", "u", "")], "node_id string, user_id string, content string")).collect()
    assert {(r["node_id"], r["kind"], r["entity"]) for r in got} == {("m", "PROPER", "Anna Smith of the Royal Society in Paris"), ("m", "PROPER", "Green Tea")}


def test_citations_keep_known_turns_only(spark):
    turns = spark.createDataFrame([("s", 0, "D2:1"), ("s", 1, "D2:2"), ("t", 0, "D3:1")], "session_id string, turn int, turn_id string")
    items = spark.createDataFrame([("s", 1, ["D2:1", "invented", "D2:2"], [1]), ("s", 2, None, [1, 7]), ("s", 3, None, None), ("t", 4, ["no"], None)], "session_id string, item int, source_turn_ids array<string>, source_turn_indices array<int>")
    got = {(r["session_id"], r["item"], r["turn_id"]) for r in citations.cited_turns(items, turns).collect()}
    assert got == {("s", 1, "D2:1"), ("s", 1, "D2:2"), ("s", 2, "D2:2"), ("t", 4, "D3:1")}


def test_residence_needs_a_statement(spark):
    kv = spark.createDataFrame([("a", "location", "Norway"), ("a", "name", "X"), ("b", "location", "Berlin")], "session_id string, key string, value string")
    turns = spark.createDataFrame([("a", "user", "I moved away from my home country, Norway"), ("b", "user", "I currently live in Berlin."), ("a", "assistant", "you live in Norway")], "session_id string, role string, text string")
    assert {(r["session_id"], r["key"]) for r in citations.residence(kv, turns).collect()} == {("a", "name"), ("b", "location")}


def test_temporal_days_end_late(spark):
    row = ("2023-10-22T09:55:00", "2023-10-20", "2023-10-20", None, None, "past", "0.5", None)
    items = spark.createDataFrame([row], "observed_at string, event_start string, event_end string, valid_from string, valid_until string, temporal_relation string, confidence string, zone string")
    got = citations.temporal(items).select(*(F.col(c).cast("string") for c in ("event_start", "event_end", "valid_from", "valid_until"))).first()
    assert tuple(got) == ("2023-10-20 00:00:00", "2023-10-20 23:59:59", "2023-10-20 00:00:00", None)


def test_operations_keep_their_ids_whole(spark):
    raw = spark.createDataFrame([(1, '[{"op":"DELETE","memory_ids":["0","11"," 2 "]},{"op":"FLY"}]'), (2, None)], "k int, text string")
    good, bad = operations.parsed(raw, "k", "text")
    assert [r["memory_ids"] for r in good.collect()] == [["0", "11", "2"]]
    assert {(r["k"], r["reason"]) for r in bad.collect()} == {(1, "unknown operation")}


def test_references_know_only_what_was_made_before(spark):
    ops = spark.createDataFrame([("r", 1, None, None, "schema_1"), ("r", 2, "x", "id2", None), ("r", 3, None, None, "x"), ("r", 4, None, None, "schema_id_1"), ("q", 5, None, None, "x")], "request_id string, seq int, ref string, created_id string, node string")
    got = {r["seq"]: r["node"] for r in operations.resolved(ops, ["node"]).collect()}
    assert got == {1: "schema_1", 2: None, 3: "id2", 4: "id2", 5: "x"}


def test_a_copy_needs_an_empty_target_and_holds_no_old_id(spark):
    rows = spark.createDataFrame([("a", "u", None, "c", ["D1", "b", "c", "a", "a"], 1), ("c", "u", "a", None, None, 2), ("d", "u", None, None, [], 2), ("b", "v", None, None, ["a"], 1)], "node_id string, user_id string, supersedes string, superseded_by string, evidence array<string>, access_count int")
    edges = spark.createDataFrame([("a", "b"), ("c", "a")], "src string, dst string")
    log = spark.createDataFrame([("1", "u", "c", "a", ["a", "x", "c"]), ("2", "v", "b", None, ["a"])], "id string, user_id string, memory_id string, old_memory_id string, supersedes array<string>")
    with pytest.raises(ValueError):
        profiles.cloned(rows, edges, log, "u", "v")
    new, links, said = profiles.cloned(rows, edges, log, "u", "w")
    name = {k: spark.range(1).select(profiles.copied_id(F.lit(k), "w")).first()[0] for k in "acd1"}
    got = {r["node_id"]: (r["user_id"], r["supersedes"], r["superseded_by"], r["evidence"], r["access_count"]) for r in new.collect()}
    assert got == {name["a"]: ("w", None, name["c"], ["D1", "b", name["c"], name["a"], name["a"]], 0), name["c"]: ("w", name["a"], None, None, 0), name["d"]: ("w", None, None, [], 0)}
    assert [tuple(r) for r in links.collect()] == [(name["c"], name["a"])]
    assert [tuple(r) for r in said.collect()] == [(name["1"], "w", name["c"], name["a"], [name["a"], "x", name["c"]])]


def test_scopes_by_tier(spark):
    memory = spark.createDataFrame([(i, f"u{i % 2}", f"a{i % 3}", f"u{i % 2}::a{i % 3}", "l2_fact", "active", i != 4, datetime.datetime(2024, 1, 1 + i)) for i in range(6)], "num int, user_id string, agent_id string, isolation_key string, layer string, status string, is_latest boolean, gmt_created timestamp")
    fields = "query_id int, keys array<string>, key string, users array<string>, agents array<string>, layers array<string>, statuses array<string>, latest boolean, created_after timestamp"
    scopes = [(1, ["u0::a0", "u0::a0", "u1::a1"], "u0::a2", ["u1"], None, None, None, None, None), (2, None, "u0::a2", ["u1"], None, None, None, None, None), (3, [], None, ["u0"], ["a0", "a2"], [], [], None, datetime.datetime(2024, 1, 2)), (4, [], None, [], ["a1"], None, None, False, None), (5, None, None, None, None, None, None, None, None), (6, ["u0::a1"], None, None, None, ["l1_raw"], None, False, None)]
    got = sorted((r["query_id"], r["num"]) for r in retrieval.tiered(memory, spark.createDataFrame(scopes, fields)).collect())
    assert got == [(1, 0), (1, 1), (2, 2), (3, 2), (4, 4)]


def test_boundaries(spark):
    rows = spark.createDataFrame([(1, "u", "user", None, None), (2, "u", "project", "w", None), (3, "u", "strict", "w", "b"), (4, "u", "strict", "w", None), (5, "v", "global", "w", "b"), (6, "u", "other", "w", "b"), (7, None, "user", "w", "b"), (8, "u", None, "w", "b")], "num int, user_id string, scope string, workspace string, branch string")
    contexts = spark.createDataFrame([(1, "u", "w", "b"), (2, "u", "w", None), (3, "u", None, "b"), (4, "v", "x", "b"), (5, None, "w", "b")], "query_id int, user_id string, workspace string, branch string")
    got = sorted((r["query_id"], r["num"]) for r in retrieval.visible(rows, contexts).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 1), (4, 5)]


def test_expansion_is_cut_at_each_hop(spark):
    edges = [(0, 10), (10, 20), (20, 0), (3, 0), (10, 10), (None, 4)]
    topics = [(n, "hub") for n in range(100, 400)] + [(10, "hub"), (0, "t"), (7, "t"), (8, "t")]
    anchors = [(1, 0), (1, 0), (2, 10), (2, 100)]
    got = graph.expand(*(spark.createDataFrame(x, s) for x, s in ((anchors, "query_id int, node int"), (edges, "src int, dst int"), (topics, "node int, topic string"))), 2, 3)
    want = [(1, 0, 0), (1, 3, 1), (1, 7, 1), (1, 8, 1), (2, 10, 0), (2, 100, 0), (2, 0, 1), (2, 20, 1), (2, 101, 1), (2, 3, 2), (2, 7, 2), (2, 8, 2)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_sample_limits_before_it_shuffles(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 2).alias("c"), (F.col("id") % 7).alias("w"), F.md5(F.col("id").cast("string")).alias("h"))
    out = retrieval.round_robin(rows, "c", "w", "h", 20)
    assert out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 3
    assert [r["n"] for r in out.groupBy("c").agg(F.count("*").alias("n")).collect()] == [20, 20]
    assert all(r["n"] in (2, 3) for r in out.groupBy("c", "w").agg(F.count("*").alias("n")).collect())


def test_additions_meet_no_target(spark):
    memory = spark.createDataFrame([("m", "t", [], None, None, True, None, None)], "node_id string, content string, evidence array<string>, valid_from timestamp, valid_until timestamp, is_latest boolean, supersedes string, superseded_by string")
    ops = [(i, "ADD", f"n{i}", None, "x", None, datetime.datetime(2024, 1, 1)) for i in range(50)] + [(50, "UPDATE", None, None, "x", None, None), (None, "UPDATE", None, "m", "x", None, None), (51, None, None, "m", "x", None, None), (52, "UPDATE", None, "n3", "y", ["e"], datetime.datetime(2024, 1, 2))]
    after, rejected = versions.apply_operations(memory, spark.createDataFrame(ops, "seq long, op string, new_id string, target_id string, content string, evidence array<string>, at timestamp"))
    assert after.count() == 51 and {r["node_id"]: r["content"] for r in after.collect()}["n3"] == "y"
    assert sorted((str(r["seq"]), r["reason"]) for r in rejected.collect()) == [("50", "target is missing"), ("51", "unknown operation"), ("None", "target is missing")]


def test_weights_and_patches(spark):
    assert fusion.renormalised({"a": 0.5, "b": 0.5}, {"a": 1.5, "b": None}) == {"a": 0.75, "b": 0.25}
    custom = X.map_patch(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("9")))
    assert spark.range(1).select(custom.alias("m")).first()["m"] == {"a": "9", "b": "2"}


def test_operations_as_a_stream_come_to_the_same_table(spark, sf_dir):
    a, b = (catalog.QUERIES[n](spark, sf_dir) for n in ("ver_apply_ops", "st_ops_apply"))
    assert a.exceptAll(b.select(a.columns)).isEmpty() and b.select(a.columns).exceptAll(a).isEmpty()


def test_recall_exact_hits_and_means(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "a"), (3, None)], "question_id int, evidence string")
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 7, "b"), (2, 11, "a"), (4, 1, "z")], "question_id int, rank int, evidence string")
    got = {r["question_id"]: r.asDict() for r in evaluation.recalls(gold, hits).collect()}
    assert set(got) == {1, 2} and [got[1][c] for c in ("hit_1", "exact_1", "recall_1", "exact_5", "recall_10", "exact_10")] == [True, False, 0.5, False, 1.0, True] and not got[2]["hit_10"]
    rows = [(1, True, None, 10.0, True, True, 1.0), (1, None, 0.5, None, None, None, None), (5, False, 1.0, 20.0, True, True, 1.0)]
    fields = "category int, correct boolean, coverage double, elapsed_ms double, hit_1 boolean, exact_1 boolean, recall_1 double"
    out = {r["category"]: tuple(r)[1:] for r in evaluation.evaluation(spark.createDataFrame(rows, fields), (1,)).collect()}
    assert out == {None: (3, 0.3333, 0.5, 1.0, 1.0, 0.75, 10.0), 1: (2, 0.5, 0.5, 1.0, 1.0, 0.5, 5.0), 5: (1, 0.0, None, None, None, 1.0, 20.0)}


def test_relations_and_tags_again_change_nothing(spark):
    nodes = spark.createDataFrame([(1, "u", "l6_schema"), (2, "u", "l7_intention"), (3, "u", "l2_fact"), (4, "v", "l6_schema"), (5, "u", None)], "node int, owner string, layer string")
    candidates = spark.createDataFrame([(1, 2), (2, 1), (1, 1), (1, 3), (1, 4), (1, 9), (5, 1), (1, 2)], "src int, dst int")
    none = spark.createDataFrame([], "src int, dst int")
    reasons = {(r["src"], r["dst"]): r["reason"] for r in graph.judged_edges(candidates, nodes, none).collect()}
    assert reasons == {(1, 2): None, (2, 1): "exists", (1, 1): "self", (1, 3): "layer", (1, 4): "isolation", (1, 9): "missing", (5, 1): "layer"}
    once = graph.related(candidates, nodes, none)
    assert sorted(map(tuple, once.collect())) == [(1, 2), (2, 1)] == sorted(map(tuple, graph.related(candidates, nodes, once).collect()))
    index = spark.createDataFrame([("u", "a", None)], "user_id string, tag string, embedding array<double>")
    mentions = spark.createDataFrame([("u", "a", 1, [1.0]), ("u", "b", 2, [3.0]), ("u", "b", 1, [2.0])], "user_id string, tag string, num int, embedding array<double>")
    first = entities.tag_index(index, mentions)
    want = [("u", "a", None), ("u", "b", [2.0])]
    assert sorted(map(tuple, first.collect())) == want == sorted(map(tuple, entities.tag_index(first, mentions).collect()))


def test_context_lines_and_profile_values(spark):
    rows = [(1, "l2_fact", datetime.datetime(2023, 5, 25), "future", datetime.datetime(2023, 6, 1), datetime.datetime(2023, 8, 31), " x "), (2, " ", None, "atemporal", None, datetime.datetime(2023, 8, 31), None), (3, None, None, None, datetime.datetime(2023, 6, 1), datetime.datetime(2023, 6, 1, 5), "y")]
    df = spark.createDataFrame(rows, "rank int, layer string, observed timestamp, relation string, a timestamp, b timestamp, content string")
    got = [r[0] for r in df.orderBy("rank").select(X.context_line(*map(F.col, df.columns))).collect()]
    assert got == ["[1] layer=l2_fact observed=2023-05-25 time_relation=future event=2023-06-01..2023-08-31 | x", "[2] ", "[3] event=2023-06-01 | y"]
    kv = [("age", " 41.0 "), ("age", "old"), ("name", "True"), ("name", " None "), ("job", "x"), ("employer", None), ("occupation", " cook ")]
    got = [r[0] for r in spark.createDataFrame(kv, "k string, v string").select(X.profile_value(F.col("k"), F.col("v"))).collect()]
    assert got == ["41", "old", "yes", None, None, None, "cook"]

"""Near-duplicates, top-k search and chats against brute force."""

import random
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import chat, hamming, likeness, simhash
from palimpsest.operators.components import components

SCHEMA = "doc_id long, text string, lang string, source string, code string, bucket string"


def rows_of(*texts):
    return [(i, t, "en", "s", "x", "y") for i, t in enumerate(texts)]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes, bits=2):
    parent = {i: i for i in codes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(codes)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (codes[a] ^ codes[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_of_whole_table(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    codes = {i: plain_fingerprint(t) for i, t in docs.items()}
    want = plain_components(codes)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op2(spark, sf_dir).collect()}
    assert got == {i: (f"{codes[i]:016x}", want[i]) for i in docs}


def test_simhash_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    texts = ["Same Words here now", "same words HERE now", None, "", " \t\n", "one", "One", "a b", long, long + " more", "É é", "é é"]
    df = spark.createDataFrame([*rows_of(*texts), (3, "", "en", "s", "x", "y"), (None, "nothing else", "en", "s", "x", "y")], SCHEMA)
    got = [(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(df).collect()]
    codes = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    want = plain_components(codes)
    assert sorted(x for x in got if x[0] is not None) == sorted([(i, codes[i], want[i]) for i in codes] + [(3, 0, want[3])])
    assert [x[2] for x in got if x[0] is None] == [None]
    empty = df.limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicated(empty).columns == df.columns
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(want.values()))


def test_index_finds_every_link_in_large_buckets(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    codes = {base}
    while len(codes) < 1500:  # a ball of near codes, codes that share most bits, and unrelated ones
        kind = rng.random()
        x = rng.choice(sorted(codes)) if len(codes) % 50 == 0 else base
        for _ in range(rng.randrange(1, 6) if kind < 0.5 else rng.randrange(8, 20)):
            x ^= 1 << rng.randrange(64 if kind < 0.7 else 20)
        codes.add(x if kind < 0.9 else rng.getrandbits(64))
    by_id = dict(enumerate(sorted(codes)))
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c, i) for i, c in by_id.items()], "code long, id long")
    for bits, large in ((2, 8192), (2, 100), (1, 50), (3, 200)):
        found = {r["id"]: r["component_id"] for r in components(simhash.near_links(df, bits, large)).collect()}
        assert {i: found.get(i, i) for i in by_id} == plain_components(by_id, bits), (bits, large)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 400)] + [(5000, i) for i in range(4000, 4300)] + [(7, 7), (None, 3), (9, 8), (9, 8)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 401)} | {i: 4000 for i in [*range(4000, 4300), 5000]} | {8: 8, 9: 8}
    assert got == want


def test_topk_is_exact(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    codes = {r["vec_id"]: sum(1 << i for i, x in enumerate(r["embedding"]) if x > 0) for r in rows}
    got = defaultdict(list)
    for r in hamming.op7(spark, sf_dir).collect():
        got[r["query_id"]].append((r["rank"], r["distance"], r["vec_id"]))
    for q in (i for i in codes if i % 100 == 0):
        best = sorted(((codes[q] ^ c).bit_count(), i) for i, c in codes.items())[:10]
        assert sorted(got.pop(q)) == [(n + 1, *x) for n, x in enumerate(best)]
    assert not got


def test_topk_odd_rows(spark):
    data = [(1, 5), (2, 5), (3, 5), (4, 13), (5, None), (None, 5), (6, 7), (6, 7)]
    codes = spark.createDataFrame(data, "id long, code long")
    got = sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in hamming.nearest(codes, codes.where("id = 4 or id = 1 or code is null"), 2).collect())
    assert got == [(1, 1, 1, 0), (1, 2, 2, 0), (4, 1, 4, 0), (4, 2, 1, 1)]
    assert hamming.nearest(codes.limit(0), codes.limit(0)).count() == 0
    assert hamming.nearest(codes.limit(0), codes).count() == 0
    few = hamming.nearest(codes, codes.where("id = 1"), 50)
    assert few.count() == 6
    signs = spark.createDataFrame([([1.0] * 70,), ([-1.0, None, 2.0],), ([],), (None,)], "v array<double>").select(hamming.sign_code(F.col("v")).alias("c"))
    assert [r["c"] for r in signs.collect()] == [-1, 4, 0, None]


def test_chats(spark):
    def turns(conv, *texts, start=0):
        return [(conv, start + i, "user" if i % 2 == 0 else "assistant", t, "extra") for i, t in enumerate(texts)]

    many = turns(9, *(f"t{i}" for i in range(300)))
    data = [
        *turns(1, "a", "b"), *turns(2, "a", "b", "c"), *turns(3, "a", "b", "c"), *turns(4, "a", "x"), *turns(5, "a"), *many,
        *turns(10, *(f"t{i}" for i in range(130))), *turns(11, "a", "b", "d", start=7), *turns(None, "a", "b"), *turns(12, None), (12, None, None, "z", "e"), (13, 0, "user", "q", "e"), (13, 0, "user", "q", "e"),
    ]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, block string").orderBy(F.rand(1))
    got = {(r["conv_id"], r["part"]): r for r in chat.rendered(df, part=256).collect()}
    assert set(got) == {(2, 0), (4, 0), (9, 0), (9, 1), (11, 0), (12, 0), (13, 0)}
    assert got[2, 0]["text"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert (got[2, 0]["n_copies"], got[2, 0]["n_turns"], got[9, 1]["n_turns"]) == (2, 3, 300)
    assert got[9, 1]["text"].startswith("<|im_start|>user\nt256<|im_end|>")
    assert got[12, 0]["text"] == "<|im_start|>unknown\nz<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert chat.rendered(df.limit(0)).count() == 0


def test_no_python_in_native_plans(spark, sf_dir):
    for q in (chat.op3,):
        plan = q(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert np.bitwise_count(np.uint64(3)) == 2


def plain_likeness(texts, least=0.8):
    """For each id the smallest that pairs of five-word likeness lead to, and all such pairs."""
    sets = {}
    for i, t in texts.items():
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    ids, own, pairs = sorted(sets), {i: i for i in sets}, []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or min(len(x), len(y)) >= least * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                pairs.append((a, b, len(x & y), len(x | y)))
                old, new = max(own[a], own[b]), min(own[a], own[b])
                own = {i: new if c == old else c for i, c in own.items()}
    return own, pairs


def test_near_copies_are_all_found(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want, _ = plain_likeness(texts)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df).collect()} == want
    kept = corpus_pipeline.near_duplicates(spark, df, sf_dir)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_near_copies_of_edited_texts(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    base, line = [word() for _ in range(120)], " ".join(word() for _ in range(30))
    texts = []
    for _ in range(150):  # one large group of edited copies, some of them alike only to others of it
        words = list(base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [" ".join(word() for _ in range(rng.randrange(1, 60))) + " " + line for _ in range(80)]  # a common line
    texts += [" ".join(word() for _ in range(40)) for _ in range(30)]
    texts += [t + " " + word() for t in texts[-30:]] + [None, "", " \n", "One two", "one  TWO", "one two three four five", "one two three four five six"]
    rng.shuffle(texts)
    want, _ = plain_likeness(dict(enumerate(texts)))
    df = spark.createDataFrame(rows_of(*texts), SCHEMA)
    for small in (2, 16):
        assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df, small=small).collect()} == want
    twice = df.union(spark.createDataFrame([(0, "quite another text", "en", "s", "x", "y"), (None, texts[0], "en", "s", "x", "y")], SCHEMA))
    kept = simhash.deduplicated(twice)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(set(want.values()))
    assert kept.where("doc_id is null").count() == 1 and simhash.deduplicated(df.limit(0)).count() == 0


def test_ids_of_other_types_and_many_equal_rows(spark):
    df = spark.createDataFrame([(f"d{i}", "one two three four five six seven" if i < 3 else f"text of its own {i}") for i in range(6)] + [(None, "one two three four five six seven")], "doc_id string, text string")
    for found in (simhash.near_duplicates(df), simhash.near_copies(df)):
        assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {"d0": "d0", "d1": "d0", "d2": "d0", "d3": "d3", "d4": "d4", "d5": "d5", None: None}
    same = spark.range(50_000).select("id", F.lit("the same words in each and every row").alias("text"))
    assert simhash.near_duplicates(same, "id").where("component_id = 0").count() == 50_000
    assert simhash.deduplicated(same, "id").count() == 1


def test_streamed_buckets_are_whole(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    rng = random.Random(3)
    codes = {i: rng.getrandbits(64) for i in range(60)}
    codes |= {100 + i: codes[i] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for i in range(60)}
    df = spark.createDataFrame([(simhash.signed(c), i) for i, c in codes.items()], "code long, id long")
    found = {r["id"]: r["component_id"] for r in components(simhash.near_links(df, 2)).collect()}
    assert {i: found.get(i, i) for i in codes} == plain_components(codes)


def test_unlike_copies_of_a_text_are_not_held_against_its_whole_group(spark, monkeypatch):
    rng = random.Random(11)
    base, texts = [f"w{i}" for i in range(150)], []
    for i in range(120):  # every second one has too many words of its own to be alike to any other
        words = list(base)
        for at in rng.sample(range(10, 150, 15), 5 if i % 2 else i % 3):
            words[at] = f"own{i}x{at}"
        texts.append(" ".join(words))
    made, written = [], likeness.written

    def counted(df, name):
        out = written(df, name)
        made.extend([out.count()] if name == "possible-pairs" else [])
        return out

    monkeypatch.setattr(likeness, "written", counted)
    found = simhash.near_copies(spark.createDataFrame(rows_of(*texts), SCHEMA), small=16)
    want, _ = plain_likeness(dict(enumerate(texts)))
    assert len(set(want.values())) == 61
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == want
    assert sum(made) <= 4 * len(texts), made

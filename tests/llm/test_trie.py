"""The prefix trie against one of plain dictionaries."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from palimpsest.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(turns, rebuild=True):
    """turns: (conv_id, turn, role, text). Rows as the query gives them."""
    convs = {}
    for c, t, r, x in turns:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(r or '')}:{r or ''}{x or ''}".encode()).hexdigest(), r or "", x or ""))
    convs = {c: [(r, x) for *_, r, x in sorted(rows)] for c, rows in convs.items()}
    whole = convs
    if rebuild:
        whole = {}
        for c, own in convs.items():
            h, base = zlib.crc32(str(c).encode()) % 6, c - int(np.fmod(c, 100))
            whole[c] = convs.get(base, [])[:h] + own[h:]
    members = {}
    for c, rows in whole.items():
        for d in range(len(rows) + 1):
            members.setdefault(tuple(rows[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        n = children.get(node, 0)
        leaves[node] = leaves.get(node, 0) + (n == 0)
        saved[node] = saved.get(node, 0) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        if node:
            up = node[:-1]
            children[up], leaves[up], saved[up] = children.get(up, 0) + 1, leaves.get(up, 0) + leaves[node], saved.get(up, 0) + saved[node]
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(node))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children.get(node, 0), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_table(spark, sf_dir):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(trie.op12(spark, sf_dir)) == plain_trie(turns)


def branching(seed, n):
    rng, out = random.Random(seed), []
    for c in range(n):
        for t in range(rng.choice([1, 3, 8, 30])):
            out.append((c, t, "user", str(rng.randrange(2)) if t < 6 else f"{c % 5} {t}"))
    return out


@pytest.mark.parametrize("limit,span,bin_nodes", [(50_000, 65_536, 50_000), (20, 65_536, 10), (3, 11, 7)])
def test_shards_of_any_size_give_one_trie(spark, limit, span, bin_nodes):
    turns = branching(1, 60)
    rows = trie.own_turns(trie.numbered(spark.createDataFrame(turns, SCHEMA)))
    assert rows_of(trie.trie(*rows, limit=limit, span=span, bin_nodes=bin_nodes)) == plain_trie(turns, rebuild=False)


def test_rebuilt_conversations_and_odd_rows(spark):
    rng = random.Random(2)
    turns = [(c, t, "user", f"{t % 3}") for c in [*range(95, 130), *range(200, 212), 305, 307, -7, -150, -100] for t in range(rng.choice([1, 2, 5, 7]))]
    turns += [(100, None, None, None), (100, None, "user", ""), (100, 2, "a", "b"), (100, 2, "a", "b"), (100, 2, "ab", ""), (None, 1, "user", "x"), (None, None, None, None)]
    turns += [(130, t, "user", "very long " * 20_000) for t in range(2)] + [(131, t, "user", "ü𝄞" * 7) for t in range(3)]
    assert rows_of(trie.trie(*trie.rebuilt(trie.numbered(spark.createDataFrame(turns, SCHEMA))))) == plain_trie(turns)


def test_many_equal_rows_and_conversations(spark):
    turns = [(5, 1, "user", "again")] * 9000 + [(c, t, "user", f"same {t}") for c in range(6000, 11_000) for t in range(3)]
    assert rows_of(trie.prefix_trie(spark.createDataFrame(turns, SCHEMA))) == plain_trie(turns, rebuild=False)


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", 5, "x"), (1, 1, "user", "b", 5, "y")], SCHEMA + ", depth int, d1 string")
    assert len(rows_of(trie.prefix_trie(df))) == 3
    assert rows_of(trie.prefix_trie(df.limit(0))) == []


def test_perfect_hash_has_a_slot_for_each(spark):
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 20_000):
        a, b = rng.integers(0, 2**63, (2, n)).astype(np.uint64)
        slots = trie.PerfectHash(a, b).slots(a, b)
        assert np.array_equal(np.sort(slots), np.arange(n))
    with pytest.raises(ValueError):
        trie.PerfectHash(np.array([3, 3], np.uint64), np.array([4, 4], np.uint64))

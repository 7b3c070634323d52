"""The prefix trie against nested dictionaries of prefixes."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, heads):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % heads if heads else 0 for c in own}
    whole = {c: own.get(c - c % 100, [])[: h[c]] + v[h[c] :] if heads else v for c, v in own.items()}
    members, children = collections.defaultdict(list), collections.defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    sums, out = {}, []
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(sums[k][0] for k in children[node]) or 1
        saved = sum(sums[k][1] for k in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
        sums[node] = leaves, saved
        ends = ",".join(str(c) for c in sorted(members[node]) if len(whole[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, heads, **options):
    return sorted((tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), heads=heads, **options).collect()), key=str)


def conversations(seed, n):
    rnd, rows = random.Random(seed), []
    for c in range(n):
        rows += [(c * 7, t, rnd.choice("ab"), rnd.choice(["x", "yy"]) if t > 4 else "hello") for t in range(rnd.randrange(14))]
    return rows + [(700, None, "a", "first"), (700, 3, None, None), (None, 1, "a", "b")]


@pytest.mark.parametrize("options, heads", [({}, 6), ({}, None), ({"shard": 5}, 6), ({"shard": 7, "segment": 2}, 6), ({"shard": 7, "segment": 3}, None)])
def test_nodes_in_any_shards(spark, options, heads):
    rows = conversations(1, 40)
    assert found(spark, rows, heads, **options) == brute(rows, heads)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in df.collect()]
    assert found(spark, rows, 6) == brute(rows, 6)


def test_hot_conversations(spark):
    """A conversation that most others copy, and a long one, which stays no task's."""
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3)]
    rows += [(999, t, "user", f"turn {t % 7}") for t in range(500)]
    assert found(spark, rows, None, shard=64, segment=32) == brute(rows, None)


def test_odd_rows(spark):
    assert found(spark, [], 6) == []
    one = [(5, 1, None, ""), (5, 1, None, "")]  # repeated rows are turns of their own
    assert found(spark, one, None) == brute(one, None)
    assert found(spark, [(3, 0, "a", "word " * 50_000)], None)[1][6] == 0
    turnless = [(1, 0, "a", "b")]  # its head is absent, its own turn goes
    assert zlib.crc32(b"1") % 6 > 0 and found(spark, turnless, 6) == brute(turnless, 6)
    more = spark.createDataFrame(conversations(2, 10), SCHEMA).withColumns({"depth": F.lit(1), "seg": F.lit("x"), "saved": F.lit(2)})
    assert sorted((tuple(r) for r in trie.prefix_trie(more).collect()), key=str) == brute(conversations(2, 10), None)


def test_double_array():
    """Every sequence has its path, no other symbol has one, and wide nodes leave few holes."""
    rng = np.random.default_rng(3)
    sequences = [rng.integers(0, 40, rng.integers(1, 9)) for _ in range(500)]
    lengths = np.array([len(s) for s in sequences])
    roots = np.arange(500) % 3
    packed, symbol = trie.pack(roots, np.cumsum(lengths) - lengths, lengths, np.concatenate(sequences))
    prefixes = {(r, *s[:d].tolist()) for r, s in zip(roots, sequences, strict=True) for d in range(1, len(s) + 1)}
    reached = {(r,): r for r in range(3)}
    for depth in range(8):
        for node in [n for n in reached if len(n) == depth + 1]:
            for turn in range(40):
                to = int(packed.step(np.array([reached[node]]), symbol[[turn]])[0])
                assert (to >= 0) == ((*node, turn) in prefixes)
                if to >= 0:
                    reached[(*node, turn)] = to
    assert len(set(reached.values())) == len(prefixes) + 3
    assert len(packed.check) < 3 * len(prefixes)

"""Ranked search against scoring every document."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall(text.translate(LOWER)) if text else []


def brute(docs, items, k=10):
    held = [(d, collections.Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    all_docs, all_terms = len(held), sum(c.total() for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * all_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in set(items):
        scores = []
        for d, c in held:
            m = 25 + 75 * c.total() * all_docs // all_terms
            s = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "score": F.lit("x")})
    items = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    return sorted((tuple(r) for r in ranked.ranked(docs, items, **options).collect()), key=str)


@pytest.fixture
def small_chunks(monkeypatch):
    """Workers read these from the closure's module, so a test of chunks calls the evaluation itself."""
    monkeypatch.setattr(ranked, "BLOCK_DOCS", 4)
    monkeypatch.setattr(ranked, "WAVE", 2)


def test_given_tables(spark):
    read = lambda t: [tuple(r)[:2] for r in spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").collect()]
    docs, items = read("documents"), read("benchmark")
    assert found(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("short", [0.0, 1 / 16, 1.0])
def test_skipping_loses_nothing(small_chunks, monkeypatch, short):
    """Whatever is summed first and whatever is skipped, the best documents and their scores are the same."""
    import numpy as np

    monkeypatch.setattr(ranked, "SHORT", short)
    rng = np.random.default_rng(1)
    for case in range(60):
        docs, vocabulary = int(rng.integers(1, 90)), int(rng.integers(1, 12))
        lengths = rng.integers(0, vocabulary + 1, docs)
        numbers = np.concatenate([np.sort(rng.permutation(vocabulary)[:n]) for n in lengths]) if lengths.sum() else np.array([0])
        if not lengths.sum():
            lengths[0] = 1
        n, tfs = rng.integers(1, 500, docs), rng.integers(1, 5, len(numbers))
        weights = rng.integers(0, 4000, vocabulary)
        chunk = ranked._Chunk(n, lengths, numbers, tfs, weights, docs, int(n.sum()))
        own, repeats = rng.permutation(vocabulary)[: rng.integers(1, vocabulary + 1)], None
        repeats = rng.integers(1, 3, len(own))
        exact, doc = np.zeros(docs, np.int64), np.repeat(np.arange(docs), lengths)
        m = 25 + 75 * n * docs // int(n.sum())
        for d, t, tf in zip(doc, numbers, tfs, strict=True):
            if t in own:
                exact[d] += weights[t] * (1_000_000_000 * tf // (1000 * tf + 8 * m[d])) * repeats[list(own).index(t)]
        at, score = ranked._best(chunk, own, repeats, 5, 0)
        top = lambda d, s: sorted((-b, a) for a, b in zip(d.tolist(), s.tolist(), strict=True) if b > 0)[:5]
        assert top(at, score) == top(np.arange(docs), exact), case


def test_queries_in_blocks_and_odd_rows(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(30)] + ["Ünï", "日本", "A1"]
    text = lambda n: rnd.choice(" .-_") .join(rnd.choices(words, k=n))
    docs = [(i, text(rnd.randrange(1, 60))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, " .,\x7f"), (None, docs[0][1]), (1, docs[1][1]), (303, "w1 " * 400_000)]
    items = [(i, text(rnd.randrange(1, 9))) for i in range(12)] + [(0, "w1 w1"), (50, None), (51, "..."), (None, "w2 日本"), (52, "unseen")]
    items.append(items[0])  # a repeated query counts once
    assert found(spark, docs, items, query_chars=40) == brute(docs, items)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def test_equal_scores_go_by_id(spark):
    docs = [(i, "same words here") for i in range(40, 0, -1)]
    assert [r[2] for r in sorted(found(spark, docs + [(99, "other")], [(1, "words")]), key=lambda r: r[1])] == list(range(1, 11))

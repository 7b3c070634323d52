"""Mixing against an independent solution of the dual, and the rows that the mix must keep."""

import collections
import math
import random

import pytest

from tidemark.llm import mixing

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def made(seed, sources, rows):
    rng = random.Random(seed)
    return [(k, " ".join(["w"] * rng.choice([0, 1, 2, 5, 30, rng.randint(1, 400)])), "en", rng.choice(sources), k) for k in range(rows)]


def bisected(sizes, target, cap=3.0):
    """Rates min(cap, exp(l * size / mean)) whose words add up to the target, by halving l."""
    mean = sum(sizes) / max(1, sum(s > 0 for s in sizes))
    low, high = -1e4, 1e4
    rate = lambda x, s: min(cap, math.exp(min(700, x * s / mean)))
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(s * rate(mid, s) for s in sizes) < target else (low, mid)
    return lambda s: rate(low, s)


@pytest.mark.parametrize("sources", [["a", "b", "c"], ["a"] * 9 + ["b", None], ["only"]])
def test_rates_solve_the_dual(spark, sources):
    rows = made(len(sources), sources, 500)
    got = mixing.mix_table(spark.createDataFrame(rows, DOC)).collect()
    source, by, target = {r[0]: r[3] for r in rows}, collections.defaultdict(list), {}
    for r in got:
        by[source[r["doc_id"]]].append(r)
        target[source[r["doc_id"]]] = r["target"]
    for s, own in by.items():
        sizes = [r["size"] for r in own]
        full = target[s] >= 3 * sum(sizes) * (1 - 1e-9)
        rate = (lambda n: 3.0) if full else bisected(sizes, target[s])
        for r in own:
            if r["size"]:
                assert r["rate"] == pytest.approx(rate(r["size"]), abs=2e-5 * max(1, r["size"] / (sum(sizes) / len(sizes))))
                assert r["copies"] <= 3 and abs(r["copies"] - r["rate"]) < 2 + 1e-6
        assert abs(sum(r["taken"] for r in own) - target[s]) <= max(sizes)


def test_rows_that_differ_anywhere_are_kept(spark):
    text = "some words of one text"
    rows = [(1, "a", "en", None, 5), (1, None, "en", "a", 5), (1, text, "en", "a", 5), (1, text, "de", "a", 5), (1, text, None, "a", None), (None, text, "en", "a", 5), (None, text, "en", "a", 5), (2, text, "en", "b", 5)]
    df = spark.createDataFrame(rows, DOC)
    table = mixing.mix_table(df).collect()
    assert len(table) == len(rows)
    for _ in range(2):
        got = collections.Counter(tuple(r) for r in mixing.mixed(df.repartition(3)).collect())
        assert all(got[r] <= 3 * rows.count(r) for r in got) and set(got) <= set(rows)
        assert got[rows[1]] == 1 and got[rows[0]] <= 3  # no words: one copy
    assert sum(got.values()) == sum(r["copies"] for r in table)


def test_hot_repeats_share_their_copies(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARED_ROWS", 7)
    rows = [(7, "the same text again", "en", "a", 1)] * 400 + made(3, ["a", "b"], 60)
    df = spark.createDataFrame(rows, DOC)
    table = [r for r in mixing.mix_table(df).collect() if r["doc_id"] == 7 and r["size"] == 4]
    copies = collections.Counter(r["copies"] for r in table)
    assert len(table) == 400 and len(copies) <= 2 and max(copies) - min(copies) <= 1
    again = mixing.mix_table(df.repartition(5))
    key = lambda d: collections.Counter((r["doc_id"], r["size"], r["copies"]) for r in d.collect())
    assert key(again) == key(mixing.mix_table(df))
    assert mixing.mixed(df).where("doc_id = 7 and n_chars = 1").count() == sum(r["copies"] for r in table)

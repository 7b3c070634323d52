"""Exact search: one floor a query over all blocks."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import vafile


def classes(spark, n=3000, dim=8):
    rng = np.random.default_rng(7)
    rows = [(i, [int(x) for x in v], 1, int(i % 50 == 0), dim) for i, v in enumerate(rng.integers(-300, 300, (n, dim)))]
    return spark.createDataFrame(rows, "class long, v array<long>, many long, asks int, dim int").cache()


def test_survivors_do_not_grow_with_the_blocks(spark, monkeypatch):
    table = classes(spark)
    found = {}
    for block in (4096, 256):
        monkeypatch.setattr(vafile, "CANDIDATE_BLOCK", block)
        found[block] = vafile.survivors(table, 5)
    whole, cut = (found[b].agg(F.count("*"), F.sum(F.xxhash64("q_class", "c_class") % 1000)).first() for b in (4096, 256))
    assert whole == cut and 60 * 6 <= whole[0] < 60 * 60


def test_the_second_round_reads_what_the_first_leaves_open(spark, monkeypatch):
    """With nothing but the greatest upper bounds read first, the results are those of all pairs."""
    monkeypatch.setattr(vafile, "FIRST", 1)
    table = classes(spark)
    v = {r["class"]: np.array(r["v"]) for r in table.collect()}
    got = {}
    for r in vafile.read_exact(vafile.survivors(table, 5), table, 5).collect():
        got.setdefault(r["q_class"], []).append(r["score"])
    for q in range(0, 3000, 50):
        assert sorted(got[q], reverse=True)[:6] == sorted((int(v[q] @ w) for w in v.values()), reverse=True)[:6]

"""Near-duplicate vectors against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hyperplanes


def brute(rows, least):
    """n_links and component per row, in order; rows are (id, vector or None)."""
    sound = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sound)):
        for b in range(a + 1, len(sound)):
            i, j = sound[a], sound[b]
            x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                links[i] += 1
                links[j] += 1
                root[find(j)] = find(i)
    low = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            low[find(i)] = min(low.get(find(i), name), name)
    return sorted((str(n), links[i], str(low.get(find(i))), n is not None and n == low.get(find(i))) for i, (n, _) in enumerate(rows))


def found(df, **options):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in hyperplanes.near_vectors(df, **options).collect())


def clusters(n, copies, dim=32, noise=0.02, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n, dim))
    return [(i, (centres[i % n] + noise * rng.standard_normal(dim)).tolist()) for i in range(n * copies)]


@pytest.mark.parametrize("block", [1024, 32])
def test_clusters_and_a_large_group(spark, block):
    """A large group of near copies goes through blocks; rows are copied, scaled and negated."""
    rows = clusters(20, 4) + [(1000 + i, v) for i, (_, v) in enumerate(clusters(1, 150, seed=1))]
    rows += [(2000, rows[0][1]), (2001, [3 * x for x in rows[0][1]]), (2002, [-x for x in rows[0][1]]), (0, rows[0][1])]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=block) == brute(rows, 0.95)


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [1.0, float("inf")]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (None, [1.0, 0.0]), (8, [1.0]), (9, [1e300, 1e290]), (10, [-0.0, 2.0]), (11, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"class": F.lit(1), "n": F.lit(2), "key": F.lit("x")})
    got = found(df)
    assert ("7", 3, "7", True) in got and ("None", 3, "7", False) in got and ("9", 3, "7", False) in got
    assert ("10", 1, "10", True) in got and ("3", 0, "3", True) in got and len(got) == len(rows)
    assert found(df.limit(0)) == []


def test_recall_at_the_bound(spark):
    """Pairs just above the least cosine, the hardest there are, are found as often as the plan says."""
    rng = np.random.default_rng(5)
    rows, angle = [], math.acos(0.951)
    for i in range(1500):
        x, y = rng.standard_normal((2, 48))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        rows += [(2 * i, x.tolist()), (2 * i + 1, (math.cos(angle) * x + math.sin(angle) * y).tolist())]
    got = hyperplanes.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.where("n_links = 1").count() >= 0.97 * 3000


def test_plan_grows_slowly():
    for n in (1, 500, 10**6, 10**9):
        bits, tables = hyperplanes.plan(n, 0.95)
        assert 1 - (1 - (1 - math.acos(0.95) / math.pi) ** bits) ** tables >= 0.99
        assert n / 2**bits <= 0.25 or n < 8

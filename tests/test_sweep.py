"""Fills by sweeps against loops over all rows of a horizon."""

import numpy as np
import pytest

from tidemark.operators import fills, sweep


@pytest.fixture(params=[7, 1 << 17])
def chunk(request, monkeypatch):
    monkeypatch.setattr(sweep, "CHUNK", request.param)


def test_tree_sums_and_first_rows():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 64, 100):
        price, size = rng.integers(0, 9, n).astype(float), rng.integers(0, 5, n).astype(float)
        tree = sweep.PriceTree(price, size)
        limit, row = rng.integers(-1, 10, 200).astype(float), rng.integers(0, n + 1, 200)
        rank, target = tree.upto(limit), rng.integers(1, 40, 200).astype(float)
        sums = np.array([np.cumsum(np.where(price <= x, size, 0)) for x in limit])
        assert (tree.before(rank, row, 0) == [np.r_[0, s][r] for s, r in zip(sums, row, strict=True)]).all()
        assert (tree.first(rank, target, 0) == [np.searchsorted(s, t) for s, t in zip(sums, target, strict=True)]).all()


def test_first_fills(chunk):
    rng = np.random.default_rng(2)
    ms = np.sort(rng.integers(0, 2000, 900))
    price, size = rng.integers(0, 20, 900).astype(float), rng.integers(0, 4, 900).astype(float)
    since, limit, need = rng.integers(-50, 2100, 300), rng.integers(-1, 21, 300).astype(float), rng.integers(-1, 60, 300).astype(float)
    limit[:5] = np.nan
    got = sweep.first_fills(ms, price, size, since, limit, need, 150)
    for q in range(300):
        at = np.flatnonzero((ms >= since[q]) & (ms <= since[q] + 150) & (price <= limit[q]))
        hit = at[np.cumsum(size[at]) >= need[q]]
        assert got[q] == (hit[0] if len(hit) else -1)


def test_order_fills(chunk):
    rng = np.random.default_rng(3)
    ms = np.sort(rng.integers(0, 2000, 900))
    price, size = rng.integers(0, 20, 900).astype(float), rng.choice([0.0, 3.0, 25.0, 47.0], 900)
    since, quantity = rng.integers(-50, 2100, 300), rng.integers(1, 60, 300).astype(float)
    limit = np.where(rng.random(300) < 0.3, np.inf, rng.integers(-1, 21, 300))
    order, row, filled = sweep.order_fills(ms, price, size, since, limit, quantity, 150, 0.1)
    got = sorted(zip(order.tolist(), row.tolist(), filled.round(9).tolist(), strict=True))
    want = []
    for q in range(300):
        given = 0.0
        for i in np.flatnonzero((ms >= since[q]) & (ms <= since[q] + 150) & (price <= limit[q])):
            offered = max(1.0, size[i] * 0.1) if size[i] > 0 else quantity[q]
            if given < quantity[q]:
                want.append((q, int(i), round(min(offered, quantity[q] - given), 9)))
            given += offered
    assert got == want


def test_rows_stay_linear_where_trades_are_dense(spark):
    """A hundred times the density: what is shuffled grows with the rows, not with their pairs."""
    made = {}
    for dense in (1, 100):
        t = spark.range(20 * dense).selectExpr("'A' product", f"id * {1000 // dense} ms", "id seq", "double(id % 7) last_px", "1.0D last_sz", "-1 last_side")
        q = spark.range(20).selectExpr("'A' product", "id * 1000 ms", "id seq", "3.0D bid", "9.0D ask", "2.0D bid_queue_ahead", "0.0D ask_queue_ahead")
        out = fills.fill_labels(q, t, "product", 20_000)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan
        assert out.where("bid_fill = 1").count() == (20 if dense == 100 else out.where("bid_fill = 1").count())
        made[dense] = out.count()
    assert made[1] == made[100] == 20


def test_missing_values(spark):
    t = spark.createDataFrame([("A", 5, 1, 1.0, 9.0, -1), ("A", None, 2, 1.0, 9.0, -1), ("A", 6, 3, None, 9.0, -1), ("A", 7, 4, 1.0, None, -1), (None, 5, 5, 1.0, 9.0, -1)], "product string, ms long, seq long, last_px double, last_sz double, last_side int")
    q = spark.createDataFrame([("A", 1, 1, 1.0, 2.0, 0.0, 0.0), ("A", None, 2, 1.0, 2.0, 0.0, 0.0), ("A", 1, 3, None, None, 0.0, 0.0), ("B", 1, 4, 1.0, 2.0, 0.0, 0.0)], "product string, ms long, seq long, bid double, ask double, bid_queue_ahead double, ask_queue_ahead double")
    got = {r["seq"]: (r["bid_fill"], r["bid_fill_lat_ms"]) for r in fills.fill_labels(q, t, "product", 100).collect()}
    assert got == {1: (1, 4), 2: (0, None), 3: (0, None), 4: (0, None)}
    assert fills.fill_labels(q, t.limit(0), "product", 100).where("bid_fill = 1").count() == 0
    assert fills.fill_labels(q.limit(0), t, "product", 100).count() == 0

"""Hand-computed cases of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import market, text
from tidemark.operators import bins, corpus, features, fills, panel, pricing, quality, risk, windows


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_returns_stay_inside_an_instrument(spark):
    day = windows.DAY_MS
    df = spark.createDataFrame([("A", 0, 1, 100.0), ("B", 10, 2, 200.0), ("A", day + 5, 3, 101.0), ("B", day + 9, 4, 198.0), ("A", 3 * day, 5, 102.0)], "inst string, ms long, seq long, mid double")
    got = {r["seq"]: r["ret"] for r in features.returns(df, "inst").collect()}
    assert got == pytest.approx({1: 0, 2: 0, 3: math.log(101 / 100), 4: math.log(198 / 200), 5: math.log(102 / 101)})


def test_returns_of_bad_prices_are_zero(spark):
    df = spark.createDataFrame([("A", 0, 1, 0.0), ("A", 1, 2, 5.0), ("A", 2, 3, None)], "inst string, ms long, seq long, mid double")
    assert [r["ret"] for r in features.returns(df, "inst").orderBy("seq").collect()] == [0, 0, 0]


def test_order_flow(spark):
    q = [("A", 1, 1, 10.0, 5.0, 11.0, 7.0), ("A", 2, 2, 10.0, 8.0, 11.0, 6.0), ("A", 3, 3, 10.5, 2.0, 11.5, 4.0), ("A", 4, 4, 10.0, 0.0, 11.0, 0.0)]
    df = spark.createDataFrame(q, "inst string, ms long, seq long, bid_px double, bid_sz double, ask_px double, ask_sz double")
    got = rows(features.order_flow(df, "inst").select("ofi", "micro", "first_tick", "seq"), "seq")
    assert [g[0] for g in got] == [0, 3 - (-1), 2 - (-6), -2 - 0]
    assert got[0][1] == pytest.approx((11 * 5 + 10 * 7) / 12) and got[3][1] == 10.5 and got[0][2]


@pytest.mark.parametrize("values", [[1.0] * 60, [0.0] * 50 + [1.0, 2.0, 3.0] * 4, list(range(100))])
def test_quantile_edges_increase_and_pad(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    e = bins.quantile_edges(df, ["x"], 8, least=2).first()["edges"]
    assert len(e) == 9 and e[0] == -math.inf and e[-1] == math.inf and all(a < b for a, b in zip(e, e[1:]))


def test_sketch_edges_near_exact_on_sorted_data(spark):
    df = spark.range(20_000).select((F.col("id") / 100.0).alias("x"))
    exact, near = (bins.quantile_edges(df, ["x"], 64, exact=x).first()["edges"] for x in (True, False))
    assert max(abs(a - b) for a, b in zip(exact[1:-1], near[1:-1])) <= 0.02


def test_bucket_edges_and_nan(spark):
    edges = [-math.inf, 1.0, 2.0, math.inf]
    df = spark.createDataFrame([(0.5,), (1.0,), (1.5,), (2.0,), (float("nan"),), (None,)], "x double")
    got = [tuple(r) for r in df.select(bins.bucket(F.col("x"), edges), bins.bucket(F.col("x"), edges, left=True)).collect()]
    assert got == [(0, 0), (1, 0), (1, 1), (2, 1), (2, 2), (2, 2)]


def test_edges_json_round_trip(spark):
    df = spark.createDataFrame([("x", "quantile", [-math.inf, 0.25, math.inf])], "feature string, kind string, edges array<double>")
    assert bins.edges_from_json(bins.edges_json(df)).collect() == df.collect()


def test_asof_sides(spark):
    left = spark.createDataFrame([("A", 5, 1), ("A", 10, 2), ("A", 3 * windows.DAY_MS, 3), ("B", 1, 4)], "k string, ms long, seq long")
    right = spark.createDataFrame([("A", 5, 1, 1.0), ("A", 7, 2, 2.0), ("A", 7, 3, 3.0)], "k string, ms long, seq long, v double")
    of = lambda **a: [r["v"] for r in windows.asof(left, right, "k", "ms", ["v"], **a).orderBy("seq").collect()]
    assert of() == [1.0, 3.0, 3.0, None]
    assert of(ties=False) == [None, 3.0, 3.0, None]
    assert of(forward=True) == [1.0, None, None, None]


def test_running_sum_over_chunks(spark):
    df = spark.createDataFrame([("A", d * windows.DAY_MS, d, 1.0) for d in range(10)], "k string, ms long, seq long, x double")
    assert [r["s"] for r in windows.running_sum(df, "k", "ms", "seq", "x", "s").orderBy("ms").collect()] == list(range(1, 11))


def test_fill_labels_queue_and_window(spark):
    q = spark.createDataFrame([(1, "A", 100, 10.0, 11.0, 2.0, 0.0)], "seq long, product string, ms long, bid double, ask double, bid_queue_ahead double, ask_queue_ahead double")
    t = spark.createDataFrame([("A", 100, 1, 10.0, 2.0, -1), ("A", 300, 2, 10.0, 1.0, -1), ("A", 301, 3, 11.0, 9.0, 1)], "product string, ms long, seq long, last_px double, last_sz double, last_side int")
    got = fills.fill_labels(q, t, "product", 200).first()
    assert (got["bid_fill"], got["bid_fill_lat_ms"], got["ask_fill"]) == (1, 200, 0)  # the queue clears at equality, the window is inclusive


def test_replay_fills_no_more_than_ordered(spark):
    o = spark.createDataFrame([(1, "A", 0, "buy", 3.0, None)], "order_id long, product string, ms long, side string, qty double, limit_px double")
    b = spark.createDataFrame([("A", i, i, 9.0, 10.0, 5.0, 12.0) for i in range(5)], "product string, ms long, seq long, bid_px double, ask_px double, bid_sz double, ask_sz double")
    got = fills.order_summary(fills.replay_orders(o, b, "product", 1000)).first()
    assert got["cum_filled"] == 3.0 and got["remaining"] == 0 and got["avg_fill_px"] == 10.0


def test_margin_of_two_positions(spark):
    p = spark.createDataFrame([(1, 5.0, 5500.0, 0.52, 0.002, 0.8), (1, -3.0, 5500.0, -0.41, 0.0025, 0.9)], "account int, qty double, spot double, delta double, gamma double, vega double")
    r = risk.required_margin(risk.exposures(p, ["account"])).first()
    assert (r["gross"], round(r["delta_dollars"]), round(r["vega"]), round(r["gamma_dollars"])) == (4_400_000, 2_106_500, 670, 52_937_500)
    assert r["required"] == pytest.approx(589_716.5)


def test_gamma_cap_scale(spark):
    got = [r[0] for r in spark.createDataFrame([(0,), (300,), (385,), (390,)], "m int").select(market.gamma_cap_scale(F.col("m"))).collect()]
    assert got == pytest.approx([1.0, 1.0, 0.1, 0.1])


def test_normal_cdf(spark):
    z = [-40.0, -8.0, -1.96, 0.0, 0.5, 3.0, 9.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(market.normal_cdf(F.col("z"))).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in z], abs=1e-13)


def test_greeks_in_bounds(spark):
    g = pricing.grid(spark.createDataFrame([(5500.0,)], "s double"), 7, 5, [0.1, 0.4])
    c = market.call_value(*map(F.col, ("s", "k", "tau", "sigma")))
    bad = g.select(*[v.alias(k) for k, v in c.items()]).where("delta < 0 or delta > 1 or gamma < 0 or vega < 0 or price < -1e-9 or isnan(price)")
    assert bad.count() == 0 and g.count() == 70


def test_tickers_and_symbols(spark):
    df = spark.createDataFrame([("$TSLA and NVDA, THE CEO of F", "SPX   240119C04500000")], "t string, s string")
    r = df.select(text.tickers(F.col("t")).alias("t"), *[c.alias(n) for n, c in text.option_symbol(F.col("s")).items()]).first()
    assert r["t"] == ["NVDA", "TSLA"] and (r["root"], r["expiry"], r["cp_flag"], r["strike"]) == ("SPX", "2024-01-19", "C", 4500.0)


def test_l1_projection(spark):
    df = spark.createDataFrame([(1, "a", 3.0), (1, "b", -1.0), (2, "a", 0.2)], "p int, n string, w double")
    got = rows(risk.l1_projection(df, "p", "n", "w", 2.0).select("p", "n", "projected"), "p", "n")
    assert [g[2] for g in got] == pytest.approx([2.0, 0.0, 0.2])


def test_context_packing_overlaps_by_one(spark):
    df = spark.createDataFrame([("A", i, i, [i * 2, i * 2 + 1]) for i in range(6)], "k string, ms long, seq long, tokens array<int>")
    got = [r["tokens"] for r in corpus.pack_contexts(df, "k", 4, 2).orderBy("block").collect()]
    assert got == [[0, 1, 2, 3, 4], [4, 5, 6, 7, 8]]


def test_percentile_rank_averages_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, 3.0)], "d int, x double").select("x", panel.percentile_rank("d", "x").alias("p"))
    assert [g[1] for g in rows(df, "x")] == pytest.approx([0.25, 0.625, 0.625, 1.0])


def test_metric_gate_names_reasons(spark):
    falling = [("good", i, 5 - i * 0.1, 5 - i * 0.1, 0.6) for i in range(8)]
    flat = [("flat", i, 5.0, 5.0, 0.6) for i in range(8)]
    got = dict(rows(quality.metric_gate(spark.createDataFrame(falling + flat, "run string, step int, train_loss double, val_loss double, accuracy double")).select("run", "reasons"), "run"))
    assert got == {"good": [], "flat": ["not_falling"]}


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="b"):
        features.require_columns(spark.range(1), {"id", "b"})


def test_a_run_has_a_folder_of_its_own(spark):
    from tidemark.sources import shared

    with shared.run_folder(spark) as path:
        inside = shared.written(spark.range(3)).inputFiles()
    assert inside and all(f.startswith(path) for f in inside)
    assert not any(f.startswith(path) for f in shared.written(spark.range(3)).inputFiles())

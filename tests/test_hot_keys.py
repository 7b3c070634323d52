"""Windows, sums, quantiles and readers with one key that holds most rows, in blocks of a few rows."""

import gzip
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import bins, corpus, fills, panel, quality, risk, sliding, toxicity, windows
from tidemark.sources import readers, schemas, sinks
from tidemark.streaming import replay


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(windows, "BLOCK_ROWS", 7)
    monkeypatch.setattr(bins, "MARKS", 5)
    monkeypatch.setattr(bins, "SPAN", 9)


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(8)
    rows = []
    for seq in range(600):
        key = "hot" if rng.random() < 0.9 else rng.choice("ab")
        rows.append((key, rng.randint(0, 9) * windows.DAY_MS + rng.randint(0, 50), seq, float(rng.randint(1, 9)), rng.choice([None, *range(5)]), rng.choice([-1, 0, 1]), float(rng.randint(1, 5))))
    return spark.createDataFrame(rows, "k string, ms long, seq long, last_px double, x int, last_side int, last_sz double").cache()


W = None


@pytest.fixture(autouse=True)
def _plain_window(spark):  # a window needs a session
    global W
    W = Window.partitionBy("k").orderBy("ms", "seq")


def same(got, want, *columns):
    pick = lambda df: {r["seq"]: tuple(r[c] for c in columns) for r in df.collect()}
    a, b = pick(got), pick(want)
    assert a.keys() == b.keys()
    for seq, row in a.items():
        for x, y in zip(row, b[seq]):
            assert x == y or x == pytest.approx(y, rel=1e-9, abs=1e-12), (seq, row, b[seq])


def test_numbers_sums_and_fills(hot, small_blocks):
    upto = W.rowsBetween(Window.unboundedPreceding, 0)
    onward = W.rowsBetween(0, Window.unboundedFollowing)
    same(windows.numbered(hot, "k", "ms", "seq", "n"), hot.withColumn("n", F.row_number().over(W) - 1), "n")
    same(windows.running_sum(hot, "k", "ms", "seq", "last_sz", "s"), hot.withColumn("s", F.sum("last_sz").over(upto)), "s")
    same(windows.last_known(hot, "k", "ms", "seq", "x", "f"), hot.withColumn("f", F.last("x", True).over(upto)), "f")
    same(windows.last_known(hot, "k", "ms", "seq", "x", "f", backward=True), hot.withColumn("f", F.first("x", True).over(onward)), "f")


@pytest.mark.parametrize("broadcast", [True, False])
def test_spans_of_one_feature_are_bounded(spark, small_blocks, monkeypatch, broadcast):
    """However many values one feature has, no span holds more than its bound, and the ranks are exact."""
    if not broadcast:
        monkeypatch.setattr(bins, "SENT_ROWS", 0)
    rng = random.Random(2)
    values = [rng.gauss(0, 1) ** 3 for _ in range(700)] + [1.5] * 300
    rows = spark.createDataFrame([("f", x) for x in values], "feature string, value double")
    counts = rows.groupBy("feature", F.col("value").alias("_v")).agg(F.count("*").alias("_n"))
    sizes = [r["n"] for r in bins._spans(counts, ["feature"]).groupBy("feature", "_low").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 9 and sum(sizes) == 701
    got = bins.exact_quantiles(rows, ["feature"], [0.0, 0.1, 0.55, 0.999, 1.0]).first()
    values.sort()
    for q, level in zip(got["q"], [0.0, 0.1, 0.55, 0.999, 1.0], strict=True):
        place = level * (len(values) - 1)
        low = values[int(place)]
        assert q == pytest.approx(low + (place - int(place)) * (values[min(int(place) + 1, len(values) - 1)] - low))
    assert got["rows"] == 1000


def test_buckets_of_literal_edges_are_those_of_an_array(spark):
    edges = [-math.inf, -1.0, 0.0, 0.0, 2.5, 7.0, math.inf]
    df = spark.createDataFrame([(x,) for x in (-5.0, -1.0, -0.5, 0.0, 1.0, 2.5, 6.9, 7.0, 99.0, math.nan, None, math.inf, -math.inf)], "x double")
    for left in (False, True):
        for kind in ("quantile", "log"):
            rows = df.select(bins.bucket(F.col("x"), edges, kind, left).alias("a"), bins.bucket(F.col("x"), F.array(*map(F.lit, edges)), kind, left).alias("b")).collect()
            assert all(r["a"] == r["b"] for r in rows)


@pytest.mark.parametrize(("back", "ahead"), [(0, 0), (3, 0), (0, 4), (6, 2), (20, 9)])
def test_frames_in_blocks(hot, small_blocks, back, ahead):
    frame = lambda df, w: df.withColumns({"m": F.sum("last_px").over(w.rowsBetween(-back, ahead)), "a": F.lag("x", back).over(w), "b": F.lead("x", ahead).over(w)})
    same(windows.in_blocks(hot, "k", "ms", "seq", frame, back, ahead), frame(hot, W), "m", "a", "b")


def test_toxicity_of_a_hot_key_equals_plain_windows(hot, small_blocks):
    got = toxicity.volume_classes(hot, "k", 20)
    dp = hot.withColumn("dp", F.coalesce(F.col("last_px") - F.lag("last_px").over(W), F.lit(0.0)))
    f = W.rowsBetween(-19, 0)
    sd = dp.withColumn("sd", F.when((F.count("dp").over(f) >= 20) & (F.stddev_samp("dp").over(f) > 0), F.stddev_samp("dp").over(f)))
    sd = sd.withColumn("sd", F.coalesce(F.first("sd", True).over(W.rowsBetween(0, Window.unboundedFollowing)), F.stddev_samp("dp").over(Window.partitionBy("k"))))
    from tidemark.functions.market import normal_cdf

    same(got, sd.withColumn("p_buy", normal_cdf(F.col("dp") / F.col("sd"))), "p_buy")
    assert toxicity.vpin(hot, "k", window=5).count() == hot.count()
    side = F.coalesce(F.last(F.when(F.col("last_side") != 0, F.col("last_side")), True).over(W.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    rows = hot.withColumns({"d": F.abs(F.col("last_px") - F.lag("last_px").over(W)), "sv": F.col("last_sz") * side})
    f = W.rowsBetween(-29, 0)
    num, den = F.when(F.count("d").over(f) >= 10, F.sum(F.col("d") * F.abs("sv")).over(f)), F.when(F.count("sv").over(f) >= 10, F.sum(F.col("sv") * F.col("sv")).over(f))
    rows = rows.withColumn("raw", F.when(den != 0, num / den)).withColumn("kyle_lambda", F.coalesce(F.last("raw", True).over(W.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    same(toxicity.kyle_lambda(hot, "k", 30), rows, "kyle_lambda")


def test_markouts_end_at_the_last_row(hot, small_blocks):
    tob = hot.select("k", "ms", "seq", F.col("last_px").alias("mid"))
    deals = hot.where("seq % 5 = 0").select("k", "ms", "seq", F.lit("buy").alias("side"), F.lit(0.0).alias("fill_px"))
    last = F.last("mid").over(W.rowsBetween(0, Window.unboundedFollowing))
    book = tob.withColumns({f"m_{h}": F.coalesce(F.lead("mid", h).over(W), last) for h in (1, 12)}).collect()
    by_key = {}
    for r in sorted(book, key=lambda r: (r["ms"], r["seq"])):
        by_key.setdefault(r["k"], []).append(r)
    for r in fills.markout_rows(deals, tob, "k", [1, 12]).collect():
        at = next(b for b in by_key[r["k"]] if b["ms"] >= r["ms"])
        assert (r["mkout_1"], r["mkout_12"]) == (at["m_1"], at["m_12"])


def test_quantiles_are_exact_in_spans(spark, small_blocks):
    rng = random.Random(9)
    rows = [("hot", rng.choice([0.0, 1.0, rng.random()])) for _ in range(900)] + [("few", float(k)) for k in range(3)] + [("one", 5.0), ("one", None), ("one", float("nan"))]
    df = spark.createDataFrame(rows, "k string, value double")
    levels = [0.0, 0.0001, 0.1, 0.25, 1 / 3, 0.5, 0.9, 0.9999, 1.0]
    got = {r["k"]: (r["q"], r["rows"]) for r in bins.exact_quantiles(df, ["k"], levels).collect()}
    want = {r["k"]: r["q"] for r in df.where("not isnan(value)").groupBy("k").agg(F.percentile("value", F.array(*map(F.lit, levels))).alias("q")).collect()}
    assert got["one"][1] == 1 and got["hot"][1] == 900
    assert all(got[k][0] == pytest.approx(want[k]) for k in want)
    assert bins.exact_quantiles(df, [], [0.5]).count() == 1 and bins.exact_quantiles(df.where("k = 'no'"), ["k"], [0.5]).count() == 0


def test_sketches_merge_near_exact_edges(spark):
    df = spark.range(30_000).select((F.hash("id") % 1000).cast("double").alias("x"), (F.col("id") % 7).alias("day"))
    exact = bins.quantile_edges(df, ["x"], 16).first()["edges"]
    parts = bins.sketches(df, ["x"], ["day"])
    near = bins.sketch_edges(bins.merged_sketches(parts), 16).first()["edges"]
    assert parts.count() == 7 and max(abs(a - b) for a, b in zip(exact[1:-1], near[1:-1])) < 15  # of a range of 2000


def test_other_operators_in_blocks(hot, small_blocks):
    t = hot.select("k", "ms", "seq", F.array(F.col("seq").cast("int")).alias("tokens"), "last_px", "last_sz")
    got = corpus.history_windows(t, "k", 9)
    w = W.rowsBetween(-9, -1)
    same(got, t.withColumn("history", F.flatten(F.collect_list("tokens").over(w))).where(F.size("history") == 9), "history")
    runs = {(r["k"], r["start"]): r["window"] for r in corpus.sliding_windows(t, "k", "seq", 8).collect()}
    n = {r["k"]: r["count"] for r in t.groupBy("k").count().collect()}
    assert len(runs) == sum(max(0, c - 8) for c in n.values()) and all(len(x) == 8 for x in runs.values())
    contexts = corpus.pack_contexts(t, "k", 10, 1).where("k = 'hot'").orderBy("block").collect()
    order = [r["seq"] for r in t.where("k = 'hot'").orderBy("ms", "seq").collect()]
    assert [c["tokens"] for c in contexts] == [order[a : a + 11] for a in range(0, len(order) - 10, 10)]
    weights = hot.select("k", "seq", (F.col("last_sz") + F.col("seq") % 3).alias("weight"))
    top = {r["k"]: r["top_mass"] for r in corpus.mass_concentration(weights, "k", 0.13).collect()}
    for k, c in n.items():
        own = sorted((r["weight"] for r in weights.where(F.col("k") == k).collect()), reverse=True)
        assert top[k] == pytest.approx(sum(own[: math.ceil(c * 0.13)]))
    rates = risk.order_rates(hot.withColumn("notional", F.col("last_px")), "k", 50.0, 3, 25, 10)
    m, s = W.orderBy("ms").rangeBetween(-25, 0), W.orderBy("ms").rangeBetween(-10, 0)
    same(rates, hot.withColumns({"notional_1m": F.sum("last_px").over(m), "orders_1s": F.count("*").over(s)}), "notional_1m", "orders_1s")
    same(risk.budget_prefix(hot, "ms", "seq", "last_sz", 40.0), hot.withColumn("running_cost", F.sum("last_sz").over(Window.orderBy("ms", "seq").rowsBetween(Window.unboundedPreceding, 0))), "running_cost")
    late = quality.tick_findings(hot.select("k", "ms", "seq", F.lit(1.0).alias("bid_px"), F.lit(2.0).alias("ask_px"), F.lit(0.0).alias("trade_sz")), "k").where("name = 'out_of_order'").first()["detail"]
    lag = Window.partitionBy("k").orderBy("seq")
    assert int(late) == hot.withColumn("p", F.lag("ms").over(lag)).where("p > ms").count()


def test_correlation_matrix_forms(spark):
    df = spark.createDataFrame([(d, t, float((d * 7 + len(t) * d * d) % 5)) for d in range(9) for t in ("x", "yy", "zzz")], "date int, ticker string, ret double")
    long = {(r["a"], r["b"]): r["corr"] for r in panel.correlation_matrix(df).collect()}
    wide = {r["a"]: r for r in panel.correlation_matrix(df, ["x", "yy", "zzz"]).collect()}
    assert len(long) == 9 and all(wide[a][b] == pytest.approx(c) == long[b, a] for (a, b), c in long.items()) and long["x", "x"] == 1.0


@pytest.mark.parametrize("least", [0.95, 0.3])
def test_correlated_pairs_skip_blocks_that_cannot_reach(spark, monkeypatch, least):
    """Every pair at the threshold is found, of either sign and with dates missing, and far blocks do not meet."""
    import numpy as np

    monkeypatch.setattr(panel, "TICKERS", 5)
    rng = np.random.default_rng(6)
    market, other = rng.normal(size=40), rng.normal(size=40)
    made = {}
    for i in range(60):
        angle = np.pi * i / 60
        made[f"t{i:02}"] = np.cos(angle) * market + np.sin(angle) * other + 0.1 * rng.normal(size=40) + 0.3 * market
    made["same"], made["flat"] = made["t00"], np.zeros(40)
    rows = [(d, t, float(x[d])) for t, x in made.items() for d in range(40) if not (t in ("t05", "t33", "t34") and d < 4)]
    df = spark.createDataFrame(rows, "date int, ticker string, ret double")
    by_ticker = {t: {d: x for d, u, x in rows if u == t} for t in made}
    want = {}
    for a in made:
        for b in made:
            days = sorted(by_ticker[a].keys() & by_ticker[b].keys())
            if a < b and "flat" not in (a, b):
                want[a, b] = np.corrcoef([by_ticker[a][d] for d in days], [by_ticker[b][d] for d in days])[0, 1]
    want = {k: c for k, c in want.items() if abs(c) >= least}
    got = {(r["a"], r["b"]): r["corr"] for r in panel.correlated_pairs(df, least).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(c) for k, c in want.items())
    assert any(c < 0 for c in want.values()) and any("t33" in k for k in want)
    series = df.groupBy("ticker").agg(F.collect_list("date").alias("dates"), F.collect_list("ret").alias("rets"))
    met = panel._by_angle(df, series, 13, least).select("ticker", "block", "other").collect()
    assert {r["ticker"] for r in met} == made.keys()
    n = len({(r["block"], r["other"]) for r in met})
    assert n < 100 if least == 0.95 else n <= 169


def test_series_that_do_not_vary_have_no_correlation(spark):
    rows = [(d, t, {"flat": 1.0, "up": float(d), "wave": float(d * d % 7)}[t], float(d * 3 % 5)) for d in range(30) for t in ("flat", "up", "wave")]
    df = spark.createDataFrame(rows, "date int, ticker string, x double, y double")
    got = {(r["ticker"], r["date"]): r["rolling_corr"] for r in panel.rolling_corr(df, "ticker", "date", "x", "y").collect()}
    assert got["flat", 29] is None and got["up", 19] is None and -1 <= got["up", 29] <= 1
    lags = {r["ticker"]: (r["lag"], r["corr"]) for r in panel.lead_lag(df, "x", "y").collect()}
    assert lags["flat"] == (0, 0.0) and lags["wave"][1] != 0


def test_quantiles_of_groups_of_any_size(spark):
    """One value, ties, unsorted levels, null keys and values; the same with and without spans."""
    rng = random.Random(3)
    rows = [("one", 5.0), ("two", 1.0), ("two", 2.0), (None, 3.0), ("two", None), ("nan", float("nan"))]
    rows += [("many", float(rng.choice([1, 1, 1, rng.randint(-500, 500)]))) for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, value double")
    levels = [1.0, 0.0, 0.333, 0.5, 0.999]
    got = {r["k"]: (r["q"], r["rows"]) for r in bins.exact_quantiles(df, ["k"], levels).collect()}
    held = bins.SPAN
    try:
        bins.SPAN = 9
        assert got == {r["k"]: (r["q"], r["rows"]) for r in bins.exact_quantiles(df, ["k"], levels).collect()}
    finally:
        bins.SPAN = held
    assert got.keys() == {"one", "two", "many"} and got["one"] == ([5.0] * 5, 1) and got["two"] == ([2.0, 1.0, pytest.approx(1.333), 1.5, pytest.approx(1.999)], 2)
    values = sorted(x for k, x in rows if k == "many")
    at = lambda p: (lambda h, i: values[i] + (h - i) * (values[min(i + 1, 899)] - values[i]))(p * 899, int(p * 899))
    assert got["many"][0] == [pytest.approx(at(p)) for p in levels]


def test_packed_files_and_shard_scans(spark, tmp_path):
    import zstandard

    names = [c.split()[0] for c in schemas.OPTION_TRADES.split(", ")]
    line = lambda n: ",".join({"underlying_symbol": n, "strike": "5.5", "trade_volume": "3"}.get(c, "") for c in names)
    text = lambda *ns: "\n".join([",".join(names), *map(line, ns)]) + "\n"
    (tmp_path / "csv" / "deep").mkdir(parents=True)
    (tmp_path / "csv" / "a.csv").write_text(text("plain"))
    (tmp_path / "csv" / "deep" / "b.csv.gz").write_bytes(gzip.compress(text("gz").encode()))
    (tmp_path / "csv" / "deep" / "c.csv.zst").write_bytes(zstandard.compress(text("z1", "z2").encode()) + zstandard.compress((line("z3") + "\n").encode()))
    got = readers.option_trade_csv(spark, f"file://{tmp_path}/csv", ["underlying_symbol", "strike"]).collect()
    assert sorted(r[0] for r in got) == ["gz", "plain", "z1", "z2", "z3"] and {r[1] for r in got} == {5.5}
    for day in range(4):
        spark.createDataFrame([([day, day], day)], "tokens array<int>, day int").coalesce(1).write.mode("append").partitionBy("day").parquet(f"file://{tmp_path}/shards")
    root = f"file://{tmp_path}/shards"
    read = lambda globs, **o: sorted(r["tokens"][0] for r in readers.token_shards(spark, globs, **o).collect())
    assert read(root) == [0, 1, 2, 3] and read(f"{root}/day=1, {root}/day=[12]") == [1, 2] and read(root, most=3) == [0, 1, 2]


def test_bins_are_saved_and_loaded(spark, tmp_path):
    edges = spark.createDataFrame([("x", "quantile", [-math.inf, 0.25, math.inf])], "feature string, kind string, edges array<double>")
    sinks.save_bins(edges, f"file://{tmp_path}/bins")
    assert sinks.load_bins(spark, f"file://{tmp_path}/bins").collect() == edges.collect()


def test_extremes_of_the_next_rows(hot, small_blocks):
    for n in (1, 3, 10):
        w = W.rowsBetween(1, n)
        full = F.count("*").over(w) == n
        want = hot.withColumns({"next_min": F.when(full, F.min("x").over(w)), "next_max": F.when(full, F.max("x").over(w))})
        same(windows.next_extremes(hot, "k", "ms", "seq", "x", n), want, "next_min", "next_max")


def test_percentiles_of_the_last_rows(hot, small_blocks):
    frame = W.rowsBetween(-5, 0)
    want = hot.withColumns({"a": F.percentile("x", 0.5).over(frame), "b": F.percentile("x", 0.9).over(frame)})
    same(sliding.rolling_percentiles(hot, "k", "ms", "seq", "x", {"a": 0.5, "b": 0.9}, 6), want, "a", "b")


def test_time_of_a_sliding_percentile_hardly_grows_with_the_frame():
    values = np.random.default_rng(1).random(20_000)
    took = []
    for frame in (50, 5_000):
        began = time.perf_counter()
        sliding.sliding_quantiles(values, frame, [0.5, 0.9, 0.99])
        took.append(time.perf_counter() - began)
    assert took[1] < 3 * took[0]


def test_the_most_frequent_value_with_ties_and_hot_values(spark):
    rng = random.Random(6)
    rows = [("hot", 7)] * 3000 + [("hot", rng.randint(0, 900)) for _ in range(3000)] + [("tie", x) for x in (5, 3, 3, 5, 9)] + [("flat", x) for x in range(2000)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, x int")
    for tracked in (16, 1024):  # a small sketch leaves groups undecided, which are then counted
        got = {r["g"]: (r["x"], r["n"]) for r in sliding.most_frequent(df, ["g"], "x", tracked).collect()}
        assert got == {"hot": (7, 3000 + sum(x == 7 for g, x in rows[3000:6000])), "tie": (3, 2), "flat": (0, 1)}


def test_markouts_of_all_horizons_are_one_pass(hot):
    rows = hot.select("k", "ms", "seq", F.col("last_px").alias("mid_at_fill"))
    got = fills.markout_time(rows, "k", [10, windows.DAY_MS])
    data = sorted(tuple(r) for r in rows.collect())
    found = {r["seq"]: (r["markout_10"], r[f"markout_{windows.DAY_MS}"]) for r in got.collect()}
    for k, ms, seq, mid in data:
        want = []
        for h in (10, windows.DAY_MS):
            later = [x for x in data if x[0] == k and x[1] >= ms + h]
            want.append(later[0][3] - mid if later else None)
        assert found[seq] == tuple(want)
    long = fills.markouts(rows, "k", [10, windows.DAY_MS, 7])._jdf.queryExecution().optimizedPlan().toString()
    assert long.count("Window [last(") <= 2 and len(found) == len(data)


def test_several_rows_of_margin_values_for_one_place_are_refused(spark):
    table = spark.createDataFrame([(None, None, None, 0.001), (None, None, None, 0.002)], "underlying string, bucket string, regime string, k_gamma double")
    rows = spark.createDataFrame([("0", "0", "calm", 5)], "underlying string, bucket string, regime string, minute int")
    with pytest.raises(ValueError, match="several rows"):
        risk.resolve_margin(rows, table)
    assert risk.resolve_margin(rows, table.limit(1)).first()["k_gamma"] in (0.001, 0.002)


def test_shards_that_are_missing_or_short_of_a_column(spark):
    of = lambda df: {r["name"]: r["ok"] for r in quality.shard_findings(df, 2, ["d"]).collect()}
    good = spark.createDataFrame([("d", [1, 2])], "day string, tokens array<int>")
    assert of(good) == dict.fromkeys(("exists", "schema", "rows", "token_length", "day_coverage"), True)
    assert of(None) == dict.fromkeys(("exists", "schema", "rows", "token_length", "day_coverage"), False)
    assert of(good.drop("tokens")) == {"exists": True, "schema": False, "rows": True, "token_length": False, "day_coverage": True}


def test_a_rolling_sink_survives_a_crash_and_compaction(spark, tmp_path):
    sink = sinks.RollingSink(spark, f"file://{tmp_path}/log", rows=50)
    schema = "ms long, seq long"
    part = lambda k: spark.createDataFrame([(k * 1_000_000 + 10 * i, 1000 * k + i) for i in range(120)], schema)
    seqs = lambda: sorted(r["seq"] for r in sink.read(schema).collect())
    assert seqs() == []
    sink(part(0), 0)
    commit, sink._commit = sink._commit, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError, match="lost"):
        sink(part(1), 1)
    assert seqs() == list(range(120))  # data without a manifest does not count
    sink._commit = commit
    sink(part(1), 1)
    sink(part(1), 1)  # a repeated batch counts once
    want = seqs()
    assert len(want) == 240 and len(list((tmp_path / "log/data").rglob("*.parquet"))) >= 6
    sink.compact(schema)
    assert seqs() == want and len(sink.folders()) == 1 and sink.folders()[0].startswith("whole-")
    sink(part(1), 1)  # also after compaction
    sink(part(2), 2)
    assert len(seqs()) == 360 and {r["day"] for r in sink.read(schema).collect()} == {"1970-01-01"}


def test_a_paced_replay_restarts_where_it_stood(spark, tmp_path):
    table = spark.range(100).selectExpr("id seq", "timestamp_millis(id * 1000) ts")
    seen = []
    sink = lambda rows, number: seen.append((number, sorted(r["seq"] for r in rows.collect())))
    run = lambda **k: replay.paced(spark, table, "ts", -1, 99_000, sink, f"file://{tmp_path}/state", step_ms=20_000, **k)
    assert run(speed=0, most=2) >= 39_999
    done = len(seen)
    assert run(speed=0) == 99_000
    assert sorted(x for _, part in seen for x in part) == list(range(100)) and done < len(seen)
    assert max(len(part) for _, part in seen) <= 20  # admission
    began, seen[:] = time.time(), []
    replay.paced(spark, table, "ts", -1, 30_000, sink, f"file://{tmp_path}/paced", speed=10, step_ms=20_000)
    assert time.time() - began >= 3.0 and sum(len(part) for _, part in seen) == 31  # thirty seconds at ten times the pace

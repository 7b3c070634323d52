"""Every query with SQL against DuckDB on the smallest tables, and every other one for a stable schema."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {n: f for n, f in entry.catalog.queries().items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return "null"
    if isinstance(v, (bool, str)) or type(v).__name__ == "bool_":
        return str(v)
    if isinstance(v, (list, tuple)) or (hasattr(v, "tolist") and getattr(v, "ndim", 0)):
        return str([x.item() if hasattr(x, "item") else x for x in v])
    try:
        return repr(float(v) + 0.0)
    except (TypeError, ValueError):
        return str(v)[:10]


def table(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted("|".join(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.catalog.oracle_sql()))
def test_sql(spark, duck, name):
    assert table(QUERIES[name](spark, DATA).toPandas()) == table(duck.sql(entry.catalog.oracle_sql()[name]).df())


def collected(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, DATA).collect()]


def test_every_query_has_sql_or_a_test_here():
    left = set(QUERIES) - set(entry.catalog.oracle_sql())
    assert left == {"a8_sketch_edges", "a9_uniform_sample", "s15_report", "st1_stream_book", "st7_order_gate", "st9_refit", "t5_importances", "u5_shard_slices", "w23_weighted_order", "x3_merged_sketches", "x5_clusters", "x6_return_model", "x7_fill_model", "x8_directional_probe"}


@pytest.mark.parametrize("name", ["a8_sketch_edges", "x3_merged_sketches"])
def test_sketches_stand_near_exact_edges(spark, name):
    from tidemark.plans import ticks

    exact = {(r["feature"], r["pos"]): r["edge"] for r in ticks.edge_rows(ticks.bins.quantile_edges(ticks.feature_table(spark, DATA), ticks.QUANTILE, 64)).collect()}
    values = {f: sorted(r[f] for r in ticks.feature_table(spark, DATA).select(f).collect()) for f in ticks.QUANTILE}
    got = collected(spark, name)
    assert {r["feature"] for r in got} == set(ticks.QUANTILE) and len(got) == 2 * 65
    for r in got:
        if math.isfinite(r["edge"]) and r["feature"] == "mid":  # a few ranks off at most
            own = values["mid"]
            a, b = sorted((r["edge"], exact["mid", r["pos"]]))
            assert sum(a < x < b for x in own) <= 0.02 * len(own)


def test_samples_slices_and_draws(spark, duck):
    sample = collected(spark, "a9_uniform_sample")
    assert len({r["seq"] for r in sample}) == 500 and sample == collected(spark, "a9_uniform_sample")
    assert abs(sum(r["seq"] for r in sample) / 500 / duck.sql("select avg(event_id) from events").fetchall()[0][0] - 1) < 0.1
    slices = collected(spark, "u5_shard_slices")
    assert len(slices) == len({r["day"] for r in slices}) == 30 and {r["rank"] for r in slices} <= {0, 1, 2, 3} and len({r["rank"] for r in slices}) > 2
    draws, weights = collected(spark, "w23_weighted_order"), {r["seq"]: r["weight"] for r in collected(spark, "w22_quality_weights")}
    assert len(draws) == len(weights) and all(r["draw"] > 0 for r in draws)
    scaled = [r["draw"] * weights[r["seq"]] for r in draws]  # draw * weight is exponential with mean 1
    assert abs(sum(scaled) / len(scaled) - 1) < 0.15 and abs(sorted(scaled)[len(scaled) // 2] - math.log(2)) < 0.12


def test_report_sections_come_back(spark):
    import json

    rows = collected(spark, "s15_report")
    by = {}
    for r in rows:
        by.setdefault(r["section"], []).append(json.loads(r["row"]))
    names = {"snapshot": "w7_snapshot", "anomalies": "t1_top_anomalies", "pairs": "j9_correlated_pairs", "clusters": "x5_clusters", "lead_lag": "w6_lead_lag", "sentiment": "a2_market_sentiment", "hours": "a13_costs_by_hour", "tick_quality": "a15_tick_findings", "shard_quality": "a16_shard_findings"}
    assert {k: len(by.get(k, [])) for k in names} == {k: len(collected(spark, q)) for k, q in names.items()}
    assert len(by["edge"]) == 2 and len(by["symbols"]) == 10 and set(by) <= {*names, "edge", "symbols", "spikes"}
    costs = {r["product"]: r["total_spread_cost"] for r in collected(spark, "a12_costs_by_symbol")}
    assert {r["product"]: r["total_spread_cost"] for r in by["symbols"]} == pytest.approx(costs)


def test_report_sections_share_what_they_read(spark):
    from tidemark.plans import ingest, panels

    sections = ingest.report_sections(spark, DATA)
    for name in ("snapshot", "anomalies", "pairs", "clusters", "lead_lag", "spikes", "sentiment", "edge", "symbols", "hours"):
        read = " ".join(sections[name].inputFiles())
        assert not [t for t in ("lineitem", "part.parquet", "documents", "events") if t in read], name
    # words meet a small lexicon without a shuffle
    scored = panels.tagged(spark, DATA).select("item", "sentiment")
    scored.collect()
    assert "hashpartitioning(word" not in scored._jdf.queryExecution().executedPlan().toString()


def test_clusters_do_not_depend_on_the_layout_of_rows(spark):
    from tidemark.operators import models

    rows = spark.range(40 * 30).selectExpr("concat('T', id div 30) AS ticker", "date_add(date'2024-01-01', cast(id % 30 AS int)) AS date", "sin(id * 12.9898) AS ret")
    found = [{r["ticker"]: r["cluster"] for r in models.cluster_tickers(rows.repartition(n, "date", "ticker")).collect()} for n in (1, 3, 7)]
    assert len(found[0]) == 40 and found[0] == found[1] == found[2]


def test_stream_queries_against_loops(spark):
    from tidemark.plans import views

    ticks = sorted(views.ticks(spark, DATA).collect(), key=lambda r: (r["ms"], r["seq"]))
    books, want = {}, {}
    for t in ticks:
        b, a = books.setdefault(str(t["product"]), ({}, {}))
        b[t["bid_px"]], a[t["ask_px"]] = t["bid_sz"], t["ask_sz"]
        want[t["seq"]] = (max(b), b[max(b)], min(a), a[min(a)])
    got = {r["seq"]: (r["bid_px"], r["bid_sz"], r["ask_px"], r["ask_sz"]) for r in collected(spark, "st1_stream_book")}
    assert got == want
    past, gate = {}, {}
    for t in sorted(ticks, key=lambda t: (t["ms"] // 1000, t["seq"])):
        own, ms, notional = past.setdefault(t["product"], []), t["ms"] // 1000, t["bid_sz"] * t["bid_px"] * 1000
        total, last = sum(n for s, n in own if ms - s <= 60_000) + notional, sum(ms - s <= 1_000 for s, _ in own)
        if ok := total <= 1e6 and last < 20:
            own.append((ms, notional))
        gate[t["seq"]] = (ok, total, last)
    assert {r["seq"]: (r["approved"], r["notional_1m"], r["orders_1s"]) for r in collected(spark, "st7_order_gate")} == gate
    edges = {r["feature"]: r["edges"] for r in collected(spark, "st9_refit")}
    recent = [t for t in ticks if t["ms"] >= ticks[-1]["ms"] - 7 * 86_400_000]
    for f in ("bid_px", "bid_sz"):
        own = sorted(t[f] for t in recent)
        assert edges[f][8] == pytest.approx((own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2)


def test_models(spark):
    clusters = collected(spark, "x5_clusters")
    assert len(clusters) == len({r["ticker"] for r in clusters}) and {r["cluster"] for r in clusters} <= {0, 1, 2, 3}
    rows = collected(spark, "x6_return_model")
    error = [r["y"] - r["mu"] for r in rows]
    mean = sum(error) / len(error)
    assert rows[0]["sigma"] == pytest.approx(math.sqrt(sum((e - mean) ** 2 for e in error) / len(error)), rel=1e-6)
    assert sum(e * e for e in error) <= sum((r["y"] - sum(x["y"] for x in rows) / len(rows)) ** 2 for r in rows)  # better than the mean
    fills = collected(spark, "x7_fill_model")
    brier = sum((r["p_fill"] - r["label"]) ** 2 for r in fills) / len(fills)
    pairs = [(a["p_fill"], b["p_fill"]) for a in fills if a["label"] for b in fills if not b["label"]]
    auc = sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)
    assert all(0 <= r["p_fill"] <= 1 for r in fills) and fills[0]["brier"] == pytest.approx(brier) and fills[0]["auc"] == pytest.approx(auc, abs=0.01)
    mean_y = sum(r["y"] for r in rows) / len(rows)
    assert sum(e * e for e in error) <= 0.35 * sum((r["y"] - mean_y) ** 2 for r in rows)  # 0.27 measured
    # 0.567 and 0.077 measured; always saying the share of fills has 0.066, as these features hardly tell fills apart
    assert fills[0]["auc"] >= 0.54 and brier <= 0.085
    probe = collected(spark, "x8_directional_probe")
    assert {r["pred"] for r in probe} <= {0, 1} and len(probe) > 20
    top = collected(spark, "t5_importances")
    values = [r["importance"] for r in top]
    assert len(top) == 5 and values == sorted(values, reverse=True) and 0 < sum(values) <= 1 + 1e-9


def test_models_have_their_rounds():
    import inspect

    from tidemark.operators import models

    rounds = {f.__name__: inspect.signature(f).parameters["rounds"].default for f in (models.fit_return_model, models.fit_fill_model, models.fit_probe, models.directional_probe)}
    assert rounds == {"fit_return_model": 120, "fit_fill_model": 80, "fit_probe": 200, "directional_probe": 200}


def test_trees_checkpoint(spark):
    from pyspark.ml.regression import GBTRegressor

    from tidemark.operators import models

    rows = spark.range(300).selectExpr("id % 7 * 1.0 AS a", "cast(id % 7 > 3 AS double) AS y")
    trees = models._trees(GBTRegressor, rows, 3 * models.EVERY, featuresCol="x", labelCol="y", seed=0)
    assert trees.getCheckpointInterval() == models.EVERY > 0 and trees.getMaxIter() == 3 * models.EVERY
    assert spark.sparkContext.getCheckpointDir()
    model, sigma = models.fit_return_model(rows, ["a"], "y", rounds=3 * models.EVERY)
    assert sigma < 0.05


def test_return_model_grows_with_cells_not_rows(spark, monkeypatch):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    from pyspark.sql import functions as F

    from tidemark.operators import models

    seen, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, rows, *a: (seen.append(rows.count()), fit(self, rows, *a))[1])
    one = spark.range(600).selectExpr("id", "id % 7 * 1.5 - 3 AS a", "id % 11 * 1.0 AS b", "(id * 37 % 101) / 10.0 + id % 7 * (id % 11) AS y")
    many = one.join(spark.range(30).withColumnRenamed("id", "copy"))
    (model, sigma), (same, _) = (models.fit_return_model(rows, ["a", "b"], "y", rounds=3) for rows in (one, many))
    assert seen == [77, 77]
    # features of few values: the trees of MLlib's fit on the rows themselves
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(one)
    plain = fit(models._trees(GBTRegressor, rows, 3, featuresCol="x", labelCol="y", seed=0), rows).transform(rows)
    want = {r["id"]: r["prediction"] for r in plain.collect()}
    for m in (model, same):
        assert {r["id"]: r["prediction"] for r in m.transform(one).collect()} == pytest.approx(want, rel=1e-9)
    assert sigma == pytest.approx(plain.agg(F.stddev_pop(F.col("y") - F.col("prediction"))).first()[0], rel=1e-9)


def test_thresholds_are_exact_beyond_few_values(spark):
    from tidemark.operators import models

    rows = spark.range(20_001).selectExpr("id * 0.5 AS a", "cast(id % 32 AS double) AS b", "1.0 AS c", "cast(id AS double) AS y")
    found = models._thresholds(rows, ["a", "b", "c"])
    assert found == {"a": pytest.approx([i / 32 * 10_000 for i in range(1, 32)]), "b": [i + 0.5 for i in range(31)], "c": [0.0]}
    cells = models._cells(rows, found, "y")
    assert cells.agg({"weight": "sum"}).first()[0] == 20_001 and cells.count() <= 32 * 32


def test_entry(spark):
    assert entry.entry(spark).count() > 0

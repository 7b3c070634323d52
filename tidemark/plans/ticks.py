"""Queries on ticks: features, bins, tokens, toxicity, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import market
from ..operators import bins, features, toxicity
from ..sources.shared import written
from . import views as v
from .registry import query
from .views import cdf_sql, half_up, sql

FEATURES = ["ret", "mid", "spread", "bid_sz", "ask_sz", "last_sz", "inter_arrival_ms"]
QUANTILE, LOG = ["ret", "mid"], ["spread", "bid_sz", "ask_sz", "last_sz", "inter_arrival_ms"]
N = 16

W = "WINDOW w AS (PARTITION BY inst ORDER BY ms, seq)"
FEAT = """feat AS (SELECT inst, seq, ms, mid, greatest(ask_px - bid_px, 1e-6) AS spread, bid_sz, ask_sz, trade_sz AS last_sz,
    CASE WHEN mid > 0 AND lag(mid) OVER w > 0 THEN ln(mid / lag(mid) OVER w) ELSE 0.0 END AS ret,
    greatest(coalesce(CAST(ms - lag(ms) OVER w AS DOUBLE), 0.0), 1e-3) AS inter_arrival_ms
    FROM (SELECT *, (bid_px + ask_px) / 2 AS mid FROM ticks) WINDOW w AS (PARTITION BY inst ORDER BY ms, seq))"""


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.returns(features.base_features(v.ticks(spark, sf_dir)), "inst")


def fitted(spark: SparkSession, sf_dir: str, n: int = N) -> tuple[DataFrame, DataFrame]:
    rows = written(feature_table(spark, sf_dir).select("inst", "seq", "ms", *FEATURES))  # the fit and the encoding read it
    return rows, bins.quantile_edges(rows, QUANTILE, n).unionByName(bins.log_edges(rows, LOG, n))


def r6(*names: str):
    return [F.round(c, 6).alias(c) for c in names]


@query(sql("ticks", f"WITH {FEAT} SELECT inst, seq, round(ret, 6) AS ret, inter_arrival_ms, mid, spread FROM feat"))
def w1_returns(spark, sf_dir):
    """Per-instrument log return and inter-arrival."""
    return feature_table(spark, sf_dir).select("inst", "seq", *r6("ret"), "inter_arrival_ms", "mid", "spread")


@query(sql("ticks", """
SELECT inst, seq, round(CASE WHEN bid_px > 0 AND lag(m) OVER w > 0 THEN ln(m / lag(m) OVER w) ELSE 0 END, 6) AS ret,
  greatest(coalesce(CAST(ms - lag(ms) OVER w AS DOUBLE), 0.0), 1.0) AS inter_arrival_ms
FROM (SELECT *, (bid_px + ask_px) / 2 AS m FROM ticks WHERE bid_px > 0 AND ask_px > 0) WINDOW w AS (PARTITION BY inst ORDER BY ms, seq)"""))
def w28_refit_stream(spark, sf_dir):
    """Returns against the last valid mid with a floor of 1 ms."""
    rows = features.base_features(features.valid_quotes(v.ticks(spark, sf_dir)))
    return features.returns(rows, "inst", least_gap=1.0).select("inst", "seq", *r6("ret"), "inter_arrival_ms")


@query(sql("trades", """
SELECT inst, seq, round(CASE WHEN last_px > 0 AND lag(last_px) OVER w > 0 THEN ln(last_px / lag(last_px) OVER w) ELSE 0 END, 6) AS ret, round(last_px * 0.0001, 6) AS spread
FROM trades WINDOW w AS (PARTITION BY inst ORDER BY ms, seq)"""))
def w29_trade_features(spark, sf_dir):
    """Returns on trade prices, spread of one basis point."""
    rows = features.returns(v.trades(spark, sf_dir), "inst", price="last_px")
    return rows.select("inst", "seq", *r6("ret"), F.round(F.col("last_px") * 0.0001, 6).alias("spread"))


@query(sql("ticks", """
SELECT inst, seq, CASE WHEN lag(bid_px) OVER w IS NULL THEN 0.0 ELSE
    (CASE WHEN bid_px > lag(bid_px) OVER w THEN bid_sz WHEN bid_px = lag(bid_px) OVER w THEN bid_sz - lag(bid_sz) OVER w ELSE -lag(bid_sz) OVER w END)
  - (CASE WHEN ask_px < lag(ask_px) OVER w THEN ask_sz WHEN ask_px = lag(ask_px) OVER w THEN ask_sz - lag(ask_sz) OVER w ELSE -lag(ask_sz) OVER w END) END AS ofi,
  round((ask_px * bid_sz + bid_px * ask_sz) / (bid_sz + ask_sz), 6) AS micro, round((bid_sz - ask_sz) / (bid_sz + ask_sz), 6) AS imbalance,
  round((ask_px - bid_px) / ((bid_px + ask_px) / 2), 6) AS rel_spread
FROM ticks WINDOW w AS (PARTITION BY inst ORDER BY ms, seq)"""))
def w2_order_flow(spark, sf_dir):
    """Order-flow imbalance and the microprice bundle."""
    return features.order_flow(v.ticks(spark, sf_dir), "inst").select("inst", "seq", "ofi", *r6("micro", "imbalance", "rel_spread"))


@query(sql("ticks", """
SELECT inst, seq, round(ln(lead(micro) OVER w / micro), 6) AS r_1step, round(ln(lead(mid, 5) OVER w / mid), 6) AS y
FROM (SELECT *, (bid_px + ask_px) / 2 AS mid, (ask_px * bid_sz + bid_px * ask_sz) / (bid_sz + ask_sz) AS micro FROM ticks WHERE bid_px > 0) WINDOW w AS (PARTITION BY inst ORDER BY ms, seq)"""))
def w3_forward_labels(spark, sf_dir):
    """Forward log returns of microprice and mid."""
    rows = features.order_flow(v.ticks(spark, sf_dir).where("bid_px > 0"), "inst")
    rows = features.forward_returns(features.forward_returns(rows, "inst", "micro", 1, "r_1step"), "inst", "mid", 5, "y")
    return rows.select("inst", "seq", *r6("r_1step", "y"))


@query(sql("ticks", """
SELECT inst, seq, ms, prev_ms FROM (SELECT inst, seq, ms, lag(ms) OVER (PARTITION BY inst ORDER BY seq % 1000, seq) AS prev_ms FROM ticks) WHERE prev_ms > ms"""))
def w24_out_of_order(spark, sf_dir):
    """Arrivals with an earlier time than the one before (arrival order stirred on purpose)."""
    stirred = v.ticks(spark, sf_dir).withColumn("arrival", F.col("seq") % 1000)
    return features.out_of_order(stirred, "inst", "arrival", "seq").select("inst", "seq", "ms", "prev_ms")


@query(sql("ticks", "SELECT inst, seq, nth FROM (SELECT inst, seq, row_number() OVER (PARTITION BY inst ORDER BY ms, seq) AS nth FROM ticks) WHERE nth % 5 = 0 AND nth >= 20"))
def p14_every_fifth(spark, sf_dir):
    """P14 ST5: every fifth update once 20 have come."""
    return features.every_nth(v.ticks(spark, sf_dir), "inst", 5, 20).select("inst", "seq", F.col("nth").cast("long").alias("nth"))


QUANTILE_SQL = f"""WITH {FEAT}, long AS (SELECT 'ret' AS feature, ret AS value FROM feat UNION ALL SELECT 'mid', mid FROM feat),
 qr AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS at, count(*) OVER (PARTITION BY feature) AS n FROM long WHERE value IS NOT NULL),
 qh AS (SELECT feature, i / {N}::DOUBLE * (n - 1) AS h FROM (SELECT feature, max(n) AS n FROM qr GROUP BY feature), range(0, {N + 1}) t(i)),
 qv AS (SELECT qh.feature, CASE WHEN a.value = b.value THEN a.value ELSE (ceil(h) - h) * a.value + (h - floor(h)) * b.value END AS v FROM qh JOIN qr a ON a.feature = qh.feature AND a.at = floor(h) JOIN qr b ON b.feature = qh.feature AND b.at = ceil(h)),
 q AS (SELECT feature, list_sort(list_distinct(list(v))) AS d FROM qv GROUP BY feature),
 p AS (SELECT feature, CASE WHEN len(d) < {N + 1} THEN list_concat(d, list_transform(range(1, {N + 2} - len(d)), lambda i: d[len(d)] + i / CAST({N + 1} - len(d) AS DOUBLE))) ELSE d END AS e FROM q),
 qe AS (SELECT feature, i - 1 AS pos, CASE WHEN i = 1 THEN '-Infinity'::DOUBLE WHEN i = {N + 1} THEN 'Infinity'::DOUBLE ELSE e[i] END AS edge FROM p, range(1, {N + 2}) t(i))"""
LOG_SQL = """,
 ll AS (SELECT 'spread' AS feature, abs(spread) + 1e-9 AS x FROM feat UNION ALL SELECT 'bid_sz', abs(bid_sz) + 1e-9 FROM feat UNION ALL SELECT 'ask_sz', abs(ask_sz) + 1e-9 FROM feat
   UNION ALL SELECT 'last_sz', abs(last_sz) + 1e-9 FROM feat UNION ALL SELECT 'inter_arrival_ms', abs(inter_arrival_ms) + 1e-9 FROM feat)"""
LOG_FIT = f""",
 lm AS (SELECT feature, ln(min(x)) AS lo, CASE WHEN ln(max(x)) - ln(min(x)) < 1e-9 THEN 1.0 ELSE ln(max(x)) - ln(min(x)) END AS span FROM ll GROUP BY feature),
 le AS (SELECT feature, i AS pos, CASE WHEN i = 0 THEN 0.0 WHEN i = {N} THEN 'Infinity'::DOUBLE ELSE exp(lo + span * i / {N}) END AS edge FROM lm, range(0, {N + 1}) t(i))"""


def edge_rows(edges: DataFrame) -> DataFrame:
    return edges.select("feature", F.posexplode("edges").alias("pos", "edge")).select("feature", F.col("pos").cast("long").alias("pos"), F.round("edge", 6).alias("edge"))


@query(sql("ticks", f"{QUANTILE_SQL} SELECT feature, pos, round(edge, 6) AS edge FROM qe"))
def a4_quantile_edges(spark, sf_dir):
    """A4: exact quantile edges, distinct and padded."""
    return edge_rows(bins.quantile_edges(feature_table(spark, sf_dir), QUANTILE, N))


@query(sql("ticks", f"WITH {FEAT}{LOG_SQL}{LOG_FIT} SELECT feature, pos, round(edge, 6) AS edge FROM le"))
def a6_log_edges(spark, sf_dir):
    """Edges in equal logarithmic steps."""
    return edge_rows(bins.log_edges(feature_table(spark, sf_dir), LOG, N))


@query(sql("ticks", f"""WITH {FEAT}{LOG_SQL},
 lm AS (SELECT feature, greatest(quantile_cont(x, 0.0001), 1e-9) AS l, quantile_cont(x, 0.9999) AS h FROM ll GROUP BY feature),
 ls AS (SELECT feature, ln(l) AS lo, ln(greatest(h, l * 10)) - ln(l) AS span FROM lm)
 SELECT feature, i AS pos, round(CASE WHEN i = 0 THEN 0.0 WHEN i = {N} THEN 'Infinity'::DOUBLE ELSE exp(lo + span * i / {N}) END, 6) AS edge FROM ls, range(0, {N + 1}) t(i)"""))
def a7_robust_log_edges(spark, sf_dir):
    """Logarithmic edges between the outer percentiles."""
    return edge_rows(bins.log_edges(feature_table(spark, sf_dir), LOG, N, robust=True))


@query()
def a8_sketch_edges(spark, sf_dir):
    """Quantile edges from a mergeable sketch; tests hold its error against exact edges."""
    return edge_rows(bins.quantile_edges(feature_table(spark, sf_dir), QUANTILE, 64, exact=False))


@query()
def x3_merged_sketches(spark, sf_dir):
    """A sketch a day, kept as a table, read again, merged and asked for edges; tests hold its error against exact edges."""
    days = feature_table(spark, sf_dir).withColumn("day", F.expr("ms div 86400000L"))
    return edge_rows(bins.sketch_edges(bins.merged_sketches(written(bins.sketches(days, QUANTILE, ["day"]))), 64))


@query(sql("panel", f"""
WITH r AS (SELECT ticker, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS ret FROM panel),
 q AS (SELECT ticker, quantile_cont(ret, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM r WHERE ret IS NOT NULL GROUP BY ticker HAVING count(*) >= 10)
SELECT ticker, i - 1 AS pos, round(CASE WHEN i = 1 THEN '-Infinity'::DOUBLE WHEN i = 5 THEN 'Infinity'::DOUBLE ELSE e[i] END, 6) AS edge FROM q, range(1, 6) t(i)"""))
def a5_ticker_edges(spark, sf_dir):
    """Quantile edges per ticker with ten returns at least."""
    w = F.lag("close")
    from ..operators.windows import by

    r = v.panel(spark, sf_dir).withColumn("ret", F.log(F.col("close") / w.over(by("ticker", "date"))))
    e = bins.quantile_edges(r, ["ret"], 4, keys=["ticker"], least=10)
    return e.select("ticker", F.posexplode("edges").alias("pos", "edge")).select("ticker", F.col("pos").cast("long").alias("pos"), F.round("edge", 6).alias("edge"))


BUCKETED = f"""{QUANTILE_SQL}{LOG_SQL}{LOG_FIT},
 inner_e AS (SELECT feature, list(edge) FILTER (pos BETWEEN 1 AND {N - 1}) AS e FROM (SELECT * FROM qe UNION ALL SELECT feature, pos, edge FROM le) GROUP BY feature),
 vals AS (SELECT inst, seq, 'ret' AS feature, ret AS x FROM feat UNION ALL SELECT inst, seq, 'mid', mid FROM feat UNION ALL SELECT inst, seq, 'spread', abs(spread) + 1e-9 FROM feat
   UNION ALL SELECT inst, seq, 'bid_sz', abs(bid_sz) + 1e-9 FROM feat UNION ALL SELECT inst, seq, 'ask_sz', abs(ask_sz) + 1e-9 FROM feat UNION ALL SELECT inst, seq, 'last_sz', abs(last_sz) + 1e-9 FROM feat
   UNION ALL SELECT inst, seq, 'inter_arrival_ms', abs(inter_arrival_ms) + 1e-9 FROM feat),
 codes AS (SELECT inst, seq, feature, len(list_filter(e, lambda b: b <= x)) AS code FROM vals JOIN inner_e USING (feature))"""


@query(sql("ticks", f"{BUCKETED} SELECT inst, feature, CAST(code AS INTEGER) AS bucket, count(*) AS n FROM codes GROUP BY 1, 2, 3"))
def flagship_tokens(spark, sf_dir):
    """Ticks to per-instrument features, fitted bins, tokens and a bucket histogram."""
    rows, edges = fitted(spark, sf_dir)
    coded = bins.tokens(rows, bins.collect_edges(edges), FEATURES)
    codes = coded.select("inst", F.posexplode("tokens").alias("i", "bucket"))
    name = F.element_at(F.array(*map(F.lit, FEATURES)), F.col("i") + 1)
    return codes.groupBy("inst", name.alias("feature"), F.col("bucket").cast("int").alias("bucket")).agg(F.count("*").alias("n"))


@query(sql("ticks", f"{BUCKETED} SELECT inst, seq, feature, CAST(code AS INTEGER) AS bucket FROM codes WHERE feature IN ('ret', 'spread')"))
def f14_bucketise(spark, sf_dir):
    """buckets by edges that are columns of the row."""
    rows, edges = fitted(spark, sf_dir)
    long = bins.long_features(rows, ["ret", "spread"], ["inst", "seq"]).join(F.broadcast(edges), "feature")  # one row a feature
    code = F.when(F.col("kind") == "log", bins.bucket(F.col("value"), F.col("edges"), "log")).otherwise(bins.bucket(F.col("value"), F.col("edges")))
    return long.select("inst", "seq", "feature", code.alias("bucket"))


@query(sql("ticks", f"""{QUANTILE_SQL}, i AS (SELECT feature, list(edge) FILTER (pos BETWEEN 1 AND {N - 1}) AS e FROM qe GROUP BY feature)
SELECT inst, seq, CAST(len(list_filter(e, lambda b: b < mid)) AS INTEGER) AS bucket FROM feat, i WHERE i.feature = 'mid'"""))
def f15_bucketise_left(spark, sf_dir):
    """buckets whose edges belong to the left."""
    rows = written(feature_table(spark, sf_dir).select("inst", "seq", "mid"))
    edges = bins.collect_edges(bins.quantile_edges(rows, ["mid"], N))["mid"][1]
    return rows.select("inst", "seq", bins.bucket(F.col("mid"), edges, left=True).alias("bucket"))


@query(sql("ticks", f"""{QUANTILE_SQL}, i AS (SELECT list(edge ORDER BY pos) AS e FROM qe WHERE feature = 'mid'),
 c AS (SELECT inst, seq, e, len(list_filter(e[2:{N}], lambda b: b <= mid)) AS code FROM feat, i)
SELECT inst, seq, round(CASE WHEN code = 0 THEN e[2] - (e[3] - e[2]) WHEN code = {N - 1} THEN e[{N}] + (e[{N}] - e[{N - 1}]) ELSE (e[code + 1] + e[code + 2]) / 2 END, 6) AS mid_point FROM c"""))
def f16_decode(spark, sf_dir):
    """F16: bucket to midpoint, the outer ones extended."""
    rows = written(feature_table(spark, sf_dir).select("inst", "seq", "mid"))
    edges = bins.quantile_edges(rows, ["mid"], N).select("edges")
    coded = rows.join(F.broadcast(edges)).withColumn("code", bins.bucket(F.col("mid"), F.col("edges")))  # one row of edges
    return coded.select("inst", "seq", F.round(bins.midpoint(F.col("code"), F.col("edges")), 6).alias("mid_point"))


@query(sql("ticks", f"""{QUANTILE_SQL}{LOG_SQL}{LOG_FIT} SELECT feature, CAST(count(*) AS INTEGER) AS n_interior, CAST(count(DISTINCT edge) AS INTEGER) AS n_distinct,
 count(*) < 2 OR count(DISTINCT edge) < count(*) * 0.5 AS degenerate FROM (SELECT * FROM qe UNION ALL SELECT feature, pos, edge FROM le) WHERE pos BETWEEN 1 AND {N - 1} GROUP BY feature"""))
def a17_degenerate_bins(spark, sf_dir):
    """Bin models that carry too little."""
    return bins.degenerate(fitted(spark, sf_dir)[1])


@query(sql("ticks", f"{QUANTILE_SQL}{LOG_SQL}{LOG_FIT} SELECT feature, pos, round(edge, 6) AS edge FROM qe UNION ALL SELECT feature, pos, round(edge, 6) FROM le"))
def s13_edges_json(spark, sf_dir):
    """Edges through JSON and back."""
    return edge_rows(bins.edges_from_json(bins.edges_json(fitted(spark, sf_dir)[1])))


@query(sql("ticks", f"""{QUANTILE_SQL}{LOG_SQL}{LOG_FIT}, e AS (SELECT * FROM qe UNION ALL SELECT feature, pos, edge FROM le),
 l AS (SELECT feature || ':' || string_agg(CASE WHEN abs(edge) = 'Infinity'::DOUBLE THEN 'inf' ELSE printf('%.6f', edge) END, ',' ORDER BY pos) AS line FROM e GROUP BY feature)
SELECT left(sha256(string_agg(line, ';' ORDER BY line)), 16) AS model_hash FROM l"""))
def a39_model_hash(spark, sf_dir):
    """Content hash of a bin model."""
    return bins.model_hash(fitted(spark, sf_dir)[1])


@query()
def a9_uniform_sample(spark, sf_dir):
    """A uniform sample of fixed size (the size is the feature)."""
    return bins.uniform_sample(v.ticks(spark, sf_dir).select("inst", "seq", "ms"), "seq", 500)


DP = """dp AS (SELECT *, coalesce(last_px - lag(last_px) OVER (PARTITION BY product ORDER BY ms, seq), 0.0) AS d FROM trades),
 s0 AS (SELECT *, CASE WHEN count(d) OVER f >= 50 AND stddev_samp(d) OVER f > 0 THEN stddev_samp(d) OVER f END AS sd, stddev_samp(d) OVER (PARTITION BY product) AS all_sd FROM dp
   WINDOW f AS (PARTITION BY product ORDER BY ms, seq ROWS 49 PRECEDING)),
 s1 AS (SELECT *, d / coalesce(first_value(sd IGNORE NULLS) OVER (PARTITION BY product ORDER BY ms, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), CASE WHEN all_sd > 0 THEN all_sd END, 1e-9) AS z FROM s0),
 bvc AS (SELECT *, """ + cdf_sql("z") + """ AS p_buy FROM s1)"""
BUCKET = """,
 bs AS (SELECT product, sum(last_sz) / greatest(count(*) / 20.0::DOUBLE, 1.0) AS bucket_size FROM bvc GROUP BY product),
 vb AS (SELECT bvc.*, CAST(floor(sum(last_sz) OVER (PARTITION BY product ORDER BY ms, seq ROWS UNBOUNDED PRECEDING) / bucket_size) AS BIGINT) AS bucket FROM bvc JOIN bs USING (product)),
 im AS (SELECT product, bucket, sum(last_sz * p_buy) AS b, sum(last_sz * (1 - p_buy)) AS s FROM vb GROUP BY 1, 2),
 vp AS (SELECT *, CASE WHEN b + s <> 0 THEN abs(b - s) / (b + s) END AS imbalance, avg(CASE WHEN b + s <> 0 THEN abs(b - s) / (b + s) END) OVER (PARTITION BY product ORDER BY bucket ROWS 49 PRECEDING) AS vpin FROM im)"""


@query(sql("trades", f"WITH {DP} SELECT product, seq, round(p_buy, 6) AS p_buy FROM bvc"))
def w12_volume_classes(spark, sf_dir):
    """Bulk volume classification."""
    return toxicity.volume_classes(v.trades(spark, sf_dir), "product").select("product", "seq", *r6("p_buy"))


@query(sql("trades", f"WITH {DP}{BUCKET} SELECT product, bucket, round(imbalance, 6) AS imbalance FROM vp"))
def a10_bucket_imbalance(spark, sf_dir):
    """Buy and sell volume per volume bucket."""
    rows = toxicity.volume_buckets(toxicity.volume_classes(v.trades(spark, sf_dir), "product"), "product")
    return toxicity.bucket_imbalance(rows, "product").select("product", "bucket", *r6("imbalance"))


@query(sql("trades", f"WITH {DP}{BUCKET} SELECT product, seq, round(coalesce(vpin, 0), 6) AS vpin FROM vb JOIN vp USING (product, bucket)"))
def w13_vpin(spark, sf_dir):
    """Flow toxicity over volume buckets, mapped back to trades."""
    return toxicity.vpin(v.trades(spark, sf_dir), "product").select("product", "seq", *r6("vpin"))


@query(sql("trades", """
WITH d AS (SELECT *, abs(last_px - lag(last_px) OVER (PARTITION BY product ORDER BY ms, seq)) AS dp, last_sz * last_side AS sv FROM trades),
 k AS (SELECT *, CASE WHEN count(sv) OVER f >= 10 AND count(dp) OVER f >= 10 AND sum(sv * sv) OVER f <> 0 THEN sum(dp * abs(sv)) OVER f / sum(sv * sv) OVER f END AS raw FROM d
   WINDOW f AS (PARTITION BY product ORDER BY ms, seq ROWS 199 PRECEDING))
SELECT product, seq, round(coalesce(last_value(raw IGNORE NULLS) OVER (PARTITION BY product ORDER BY ms, seq ROWS UNBOUNDED PRECEDING), 0), 6) AS kyle_lambda FROM k"""))
def w11_kyle_lambda(spark, sf_dir):
    """Rolling price impact."""
    return toxicity.kyle_lambda(v.trades(spark, sf_dir), "product").select("product", "seq", *r6("kyle_lambda"))


@query(sql("book", """
WITH r AS (SELECT *, ln(mid / lag(mid) OVER w) AS r1, ln(mid / lag(mid, 4) OVER w) AS rq FROM book WINDOW w AS (PARTITION BY product ORDER BY ms, seq)),
 f AS (SELECT product, seq, CASE WHEN count(r1) OVER a >= 5 THEN sum(r1 * r1) OVER a END AS rv, CASE WHEN count(r1) OVER b >= 10 THEN var_samp(r1) OVER b END AS v1,
   CASE WHEN count(rq) OVER b >= 10 THEN var_samp(rq) OVER b END AS vq FROM r
   WINDOW a AS (PARTITION BY product ORDER BY ms, seq ROWS 99 PRECEDING), b AS (PARTITION BY product ORDER BY ms, seq ROWS 199 PRECEDING))
SELECT product, seq, round(rv, 5) AS rv, round(CASE WHEN v1 > 0 THEN vq / (4 * v1) END, 5) AS vr FROM f"""))
def w9_volatility(spark, sf_dir):
    """Realised variance and variance ratio."""
    rows = toxicity.volatility(v.book(spark, sf_dir), "product")
    return rows.select("product", "seq", F.round("rv", 5).alias("rv"), F.round("vr", 5).alias("vr"))


@query(sql("trades book", """
WITH r AS (SELECT *, ln(mid / lag(mid) OVER (PARTITION BY product ORDER BY ms, seq)) AS r FROM book),
 b AS (SELECT product, coalesce(pow(10.0, floor(log10(min(CASE WHEN ask_px > bid_px THEN ask_px - bid_px END)))), 0.01) AS tick, stddev_samp(r) * arg_max(mid, ms * 1000000 + seq) AS sigma, arg_min(ask_px, ms * 1000000 + seq) AS first_ask FROM r GROUP BY product),
 buys AS (SELECT t.product, greatest(0.0, least(20.0, round_even((t.last_px - coalesce(k.ask_px, b.first_ask)) / b.tick, 0))) AS away, b.tick
   FROM (SELECT * FROM trades WHERE last_side = 1) t ASOF LEFT JOIN book k ON t.product = k.product AND t.ms >= k.ms JOIN b ON b.product = t.product),
 c AS (SELECT product, away, count(*) AS n, max(tick) AS tick FROM buys GROUP BY 1, 2),
 s AS (SELECT product, sum(n) AS buys FROM c GROUP BY 1),
 f AS (SELECT product, count(*) AS bins, regr_slope(ln(n), away * tick) AS slope FROM c WHERE n >= 3 GROUP BY 1)
SELECT b.product, tick, round(CASE WHEN sigma > 0 THEN sigma ELSE tick * 0.5 END, 6) AS sigma,
  round(CASE WHEN buys >= 10 AND bins >= 2 AND -slope > 0 AND -slope <= 1e6 THEN -slope ELSE 500.0 END, 6) AS kappa
FROM b LEFT JOIN s USING (product) LEFT JOIN f USING (product)"""))
def a32_calibration(spark, sf_dir):
    """Tick size, volatility and fill intensity."""
    return toxicity.calibrate(v.book(spark, sf_dir), v.trades(spark, sf_dir), "product").select("product", "tick", *r6("sigma", "kappa"))


@query(sql("book", f"""
WITH q AS (SELECT product, seq, (ask_px * bid_sz + bid_px * ask_sz) / (bid_sz + ask_sz) AS s, CAST(seq % 21 - 10 AS INTEGER) AS inv, greatest(0.0, least(1.0, (seq % 10) / 10.0::DOUBLE - 0.4)) AS tox FROM book),
 r AS (SELECT *, s - inv * 0.1::DOUBLE * 0.25::DOUBLE AS r, (0.1::DOUBLE * 0.25::DOUBLE / 2 + ln(1 + 0.1::DOUBLE / 1.5::DOUBLE) / 0.1::DOUBLE) * (1 + tox) AS h FROM q)
SELECT product, seq, {half_up("r", 6)} AS reservation, {half_up("h", 6)} AS half_spread,
 round(CASE WHEN inv >= 10 THEN '-Infinity'::DOUBLE ELSE floor({half_up("(r - h) / 0.01::DOUBLE", 6)}) * 0.01 END, 4) AS bid, round(CASE WHEN inv <= -10 THEN 'Infinity'::DOUBLE ELSE ceil({half_up("(r + h) / 0.01::DOUBLE", 6)}) * 0.01 END, 4) AS ask FROM r"""))
def f4_quotes(spark, sf_dir):
    """reservation price, half spread, toxicity widening, inventory limits."""
    b = v.book(spark, sf_dir)
    micro = market.microprice(F.col("bid_px"), F.col("ask_px"), F.col("bid_sz"), F.col("ask_sz"))
    tox = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("seq") % 10) / 10.0 - 0.4))
    rows = b.withColumns({"s": micro, "inv": (F.col("seq") % 21 - 10).cast("int"), "tox": tox})
    q = market.quotes_around(F.col("s"), F.col("inv"), F.lit(0.5), gamma=0.1, kappa=1.5, limit=10, toxicity=F.col("tox"))
    low, high = F.floor(F.round((q["reservation"] - q["half_spread"]) / 0.01, 6)) * 0.01, F.ceil(F.round((q["reservation"] + q["half_spread"]) / 0.01, 6)) * 0.01
    bid = F.when(F.col("inv") >= 10, q["bid"]).otherwise(low)
    ask = F.when(F.col("inv") <= -10, q["ask"]).otherwise(high)
    return rows.select("product", "seq", F.round(q["reservation"], 6).alias("reservation"), F.round(q["half_spread"], 6).alias("half_spread"), F.round(bid, 4).alias("bid"), F.round(ask, 4).alias("ask"))


@query(sql("book", """
SELECT product, seq, CASE WHEN (seq % 100) / 100.0 > 0.95 THEN 'halt' WHEN (seq % 10) / 10.0 > 0.7 THEN 'pull' ELSE 'quote' END AS action,
  round(greatest(0.0, least(1.0, ((seq % 10) / 10.0::DOUBLE - 0.4) / 0.3)), 6) AS toxicity, CASE WHEN bid_px - seq % 2 <= bid_px THEN bid_sz ELSE 0.0 END AS bid_queue_ahead FROM book"""))
def f5_decision(spark, sf_dir):
    """Halt, pull or quote, mapped toxicity and queue ahead."""
    from ..operators.decide import decide

    b = v.book(spark, sf_dir).withColumns({"sigma": (F.col("seq") % 100) / 100.0, "vpin": (F.col("seq") % 10) / 10.0, "bid": F.col("bid_px") - F.col("seq") % 2, "ask": F.col("ask_px")})
    return decide(b, sigma_halt=0.95).select("product", "seq", "action", *r6("toxicity"), "bid_queue_ahead")

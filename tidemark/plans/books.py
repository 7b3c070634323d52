"""Queries on order books and fills: as-of joins, fill labels, markouts, costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fills as fl
from ..operators import bins, models, quality, sliding
from ..operators.windows import asof, next_extremes
from ..sources import readers
from ..sources.shared import written
from . import views as v
from .registry import query
from .views import HOUR_MS, sql

H = 6 * HOUR_MS


def r6(*names: str):
    return [F.round(c, 6).alias(c) for c in names]


@query(sql("ticks", """
WITH m AS (SELECT inst, seq, ms, event_type IN ('purchase','click') AS is_trade, CASE WHEN event_type IN ('purchase','click') THEN NULL ELSE bid_px END AS bid, CASE WHEN event_type IN ('purchase','click') THEN NULL ELSE ask_px END AS ask FROM ticks),
 f AS (SELECT *, last_value(bid IGNORE NULLS) OVER w AS bid_then, last_value(ask IGNORE NULLS) OVER w AS ask_then FROM m WINDOW w AS (PARTITION BY inst ORDER BY ms, CASE WHEN is_trade THEN 0 ELSE 1 END, seq ROWS UNBOUNDED PRECEDING))
SELECT inst, seq, bid_then, ask_then FROM f WHERE is_trade AND bid_then IS NOT NULL AND ask_then IS NOT NULL"""))
def j1_trades_with_quotes(spark, sf_dir):
    """Trades with the quote before them; at equal times a trade sees the earlier quote."""
    t = v.ticks(spark, sf_dir)
    is_trade = F.col("event_type").isin("purchase", "click")
    left = t.where(is_trade).select("inst", "seq", "ms")
    right = t.where(~is_trade).select("inst", "seq", "ms", F.col("bid_px").alias("bid_then"), F.col("ask_px").alias("ask_then"))
    return asof(left, right, "inst", "ms", ["bid_then", "ask_then"], ties=False).dropna(subset=["bid_then", "ask_then"]).select("inst", "seq", "bid_then", "ask_then")


@query(sql("trades book", "SELECT t.product, t.seq, k.mid AS mid_then FROM trades t ASOF LEFT JOIN book k ON t.product = k.product AND t.ms >= k.ms"))
def j2_asof_book(spark, sf_dir):
    """Trades with the last book row at or before them."""
    right = v.book(spark, sf_dir).select("product", "seq", "ms", F.col("mid").alias("mid_then"))
    return asof(v.trades(spark, sf_dir).select("product", "seq", "ms"), right, "product", "ms", ["mid_then"]).select("product", "seq", "mid_then")


@query(sql("trades book", "SELECT k.product, k.seq, coalesce(t.last_sz, 0.0) AS toxicity FROM book k ASOF LEFT JOIN trades t ON t.product = k.product AND k.ms >= t.ms"))
def j12_aligned_series(spark, sf_dir):
    """A trade-level series aligned to book rows, 0 before its first value."""
    t = v.trades(spark, sf_dir).select("product", "seq", "ms", F.col("last_sz").alias("toxicity"))
    out = asof(v.book(spark, sf_dir).select("product", "seq", "ms"), t, "product", "ms", ["toxicity"])
    return out.select("product", "seq", F.coalesce("toxicity", F.lit(0.0)).alias("toxicity"))


@query(sql("trades book", "SELECT k.product, k.seq, t.seq AS t_seq, t.last_px AS t_last_px FROM book k LEFT JOIN trades t ON k.product = t.product AND k.ms // 1000 = t.ms // 1000"))
def j15_same_second(spark, sf_dir):
    """A path with the trades of the same second."""
    path = v.book(spark, sf_dir).select("product", "seq", "ms")
    return fl.by_second(path, v.trades(spark, sf_dir), "product", ["seq", "last_px"]).select("product", "seq", "t_seq", "t_last_px")


FILL = f"""WITH w AS (SELECT q.seq AS q_seq, q.ms AS q_ms, q.bid, q.ask, q.bid_queue_ahead, q.ask_queue_ahead, t.ms AS t_ms, t.seq AS t_seq, t.last_px, t.last_sz, t.last_side
   FROM quotes q JOIN trades t ON q.product = t.product AND t.ms BETWEEN q.ms AND q.ms + {H}),
 b AS (SELECT q_seq, min(t_ms - q_ms) AS lat FROM (SELECT *, sum(last_sz) OVER (PARTITION BY q_seq ORDER BY t_ms, t_seq ROWS UNBOUNDED PRECEDING) AS eaten FROM w WHERE last_side = -1 AND last_px <= bid) WHERE eaten >= bid_queue_ahead + 1 GROUP BY 1),
 a AS (SELECT q_seq, min(t_ms - q_ms) AS lat FROM (SELECT *, sum(last_sz) OVER (PARTITION BY q_seq ORDER BY t_ms, t_seq ROWS UNBOUNDED PRECEDING) AS eaten FROM w WHERE last_side = 1 AND last_px >= ask) WHERE eaten >= ask_queue_ahead + 1 GROUP BY 1),
 lab AS (SELECT q.*, b.lat AS bid_fill_lat_ms, a.lat AS ask_fill_lat_ms, CASE WHEN b.lat IS NULL THEN 0 ELSE 1 END AS bid_fill, CASE WHEN a.lat IS NULL THEN 0 ELSE 1 END AS ask_fill FROM quotes q LEFT JOIN b ON q.seq = b.q_seq LEFT JOIN a ON q.seq = a.q_seq)"""


def labelled(spark, sf_dir):
    return fl.fill_labels(v.quotes(spark, sf_dir), v.trades(spark, sf_dir), "product", H)


@query(sql("quotes trades", f"{FILL} SELECT product, seq, bid_fill, ask_fill, bid_fill_lat_ms, ask_fill_lat_ms FROM lab"))
def j3_fill_labels(spark, sf_dir):
    """Queue-aware fill labels and latencies."""
    return labelled(spark, sf_dir).select("product", "seq", "bid_fill", "ask_fill", "bid_fill_lat_ms", "ask_fill_lat_ms")


@query(sql("quotes trades", f"""
SELECT q.product, q.seq, min(CASE WHEN t.last_side = -1 AND t.last_px <= q.bid THEN t.ms - q.ms END) AS bid_fill_lat_ms, min(CASE WHEN t.last_side = 1 AND t.last_px >= q.ask THEN t.ms - q.ms END) AS ask_fill_lat_ms
FROM quotes q LEFT JOIN trades t ON q.product = t.product AND t.ms BETWEEN q.ms AND q.ms + {H} GROUP BY 1, 2"""))
def j4_first_crossing(spark, sf_dir):
    """Labels by the first crossing trade, without a queue."""
    out = fl.fill_labels(v.quotes(spark, sf_dir), v.trades(spark, sf_dir), "product", H, queue_aware=False)
    return out.select("product", "seq", "bid_fill_lat_ms", "ask_fill_lat_ms")


@query(sql("quotes trades", f"""{FILL}, f AS (SELECT *, (ask * bid_sz + bid * ask_sz) / (bid_sz + ask_sz) AS micro, (seq % 7) / 100.0::DOUBLE AS mu FROM lab)
SELECT seq, 'bid' AS side, round((micro - bid) / 0.01, 4) AS distance_ticks, round((ask - bid) / greatest(micro, 1e-9), 6) AS rel_spread, round(micro - (bid + ask) / 2, 6) AS micro_dev, mu AS predicted_return, bid_queue_ahead AS queue_ahead, bid_fill AS label FROM f
UNION ALL SELECT seq, 'ask', round((ask - micro) / 0.01, 4), round((ask - bid) / greatest(micro, 1e-9), 6), round(micro - (bid + ask) / 2, 6), -mu, ask_queue_ahead, ask_fill FROM f"""))
def u4_two_sided(spark, sf_dir):
    """One training row per side of a quote."""
    return sided(spark, sf_dir).select("seq", "side", F.round("distance_ticks", 4).alias("distance_ticks"), *r6("rel_spread", "micro_dev"), "predicted_return", "queue_ahead", "label")


def sided(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("mu", (F.col("seq") % 7) / 100.0)
    micro = (F.col("ask") * F.col("bid_sz") + F.col("bid") * F.col("ask_sz")) / (F.col("bid_sz") + F.col("ask_sz"))
    return fl.two_sided(rows, micro, 0.01, ["seq"])


@query(sql("trades", """
SELECT product, seq, CASE WHEN count(*) OVER w = 20 THEN min(last_px) OVER w END AS low, CASE WHEN count(*) OVER w = 20 THEN CAST(min(last_px) OVER w <= bid_px AS INTEGER) END AS hit
FROM trades WINDOW w AS (PARTITION BY product ORDER BY ms, seq ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)"""))
def w17_forward_hits(spark, sf_dir):
    """Whether the next 20 prints reach a level."""
    rows = next_extremes(v.trades(spark, sf_dir), "product", "ms", "seq", "last_px", 20)
    return rows.select("product", "seq", F.col("next_min").alias("low"), (F.col("next_min") <= F.col("bid_px")).cast("int").alias("hit"))


@query(sql("fills book", """
WITH b AS (SELECT product, seq, ms, mid, coalesce(lead(mid, 1) OVER w, last_value(mid) OVER g) AS m_1, coalesce(lead(mid, 5) OVER w, last_value(mid) OVER g) AS m_5, coalesce(lead(mid, 25) OVER w, last_value(mid) OVER g) AS m_25 FROM book
   WINDOW w AS (PARTITION BY product ORDER BY ms, seq), g AS (PARTITION BY product ORDER BY ms, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT f.product, f.seq, (CASE WHEN side = 'buy' THEN 1.0 ELSE -1.0 END) * (m_1 - fill_px) AS mkout_1, (CASE WHEN side = 'buy' THEN 1.0 ELSE -1.0 END) * (m_5 - fill_px) AS mkout_5, (CASE WHEN side = 'buy' THEN 1.0 ELSE -1.0 END) * (m_25 - fill_px) AS mkout_25
FROM fills f ASOF LEFT JOIN b ON f.product = b.product AND f.ms <= b.ms"""))
def j5_markout_rows(spark, sf_dir):
    """Markouts some book rows ahead."""
    return fl.markout_rows(v.fills(spark, sf_dir), v.book(spark, sf_dir), "product", [1, 5, 25]).select("product", "seq", "mkout_1", "mkout_5", "mkout_25")


MT = f"""WITH m AS (SELECT f.*, a.mid_at_fill - f.mid_at_fill AS m1, b.mid_at_fill - f.mid_at_fill AS m6 FROM fills f
   ASOF LEFT JOIN (SELECT product, ms - {HOUR_MS} AS ms, arg_min(mid_at_fill, seq) AS mid_at_fill FROM fills GROUP BY product, ms) a ON f.product = a.product AND f.ms <= a.ms
   ASOF LEFT JOIN (SELECT product, ms - {H} AS ms, arg_min(mid_at_fill, seq) AS mid_at_fill FROM fills GROUP BY product, ms) b ON f.product = b.product AND f.ms <= b.ms)"""


def timed(spark, sf_dir):
    return fl.markout_time(v.fills(spark, sf_dir), "product", [HOUR_MS, H])


@query(sql("fills", f"{MT} SELECT product, seq, m1 AS markout_{HOUR_MS}, m6 AS markout_{H} FROM m"))
def j6_markout_time(spark, sf_dir):
    """Markouts at the first fill an hour and six hours later."""
    return timed(spark, sf_dir).select("product", "seq", f"markout_{HOUR_MS}", f"markout_{H}")


@query(sql("fills", f"""{MT}, l AS (SELECT {HOUR_MS} AS horizon_ms, side, mid_at_fill, spread_cost_per_unit, m1 AS mo FROM m UNION ALL SELECT {H}, side, mid_at_fill, spread_cost_per_unit, m6 FROM m),
 s AS (SELECT *, (CASE WHEN side = 'buy' THEN 1.0 ELSE -1.0 END) * mo / nullif(mid_at_fill, 0) * 1e4 AS signed, abs(spread_cost_per_unit / nullif(mid_at_fill, 0)) * 1e4 AS spread, CASE WHEN (CASE WHEN side = 'buy' THEN 1.0 ELSE -1.0 END) * mo > 0 THEN 1.0 ELSE 0.0 END AS hit FROM l)
SELECT CAST(horizon_ms AS INTEGER) AS horizon_ms, round(avg(signed), 6) AS mean_markout_bps, round(avg(spread), 6) AS mean_spread_bps, round(avg(signed - spread), 6) AS mean_edge_bps, round(avg(hit), 6) AS hit_rate, count(signed - spread) AS n_fills FROM s GROUP BY 1"""))
def a11_post_trade(spark, sf_dir):
    """Edge per horizon."""
    return post_trade(v.fills(spark, sf_dir))


def post_trade(fills):
    out = fl.post_trade(fl.markouts(fills, "product", [HOUR_MS, H]))
    return out.select("horizon_ms", *r6("mean_markout_bps", "mean_spread_bps", "mean_edge_bps", "hit_rate"), "n_fills")


@query(sql("fills", """
SELECT product, count(*) AS n, round(avg(abs(spread_cost_per_unit / nullif(mid_at_fill, 0)) * 1e4), 6) AS mean_spread_bps, arg_max(total, ms * 1000000 + seq) AS total_spread_cost
FROM (SELECT *, sum(spread_cost_per_unit * fill_qty) OVER (PARTITION BY product ORDER BY ms, seq ROWS UNBOUNDED PRECEDING) AS total FROM fills) GROUP BY product"""))
def a12_costs_by_symbol(spark, sf_dir):
    """Per symbol count, spread and last running cost."""
    return costs_by_symbol(v.fills(spark, sf_dir))


def costs_by_symbol(fills):
    from ..operators.windows import running_sum

    rows = running_sum(fills.withColumn("cost", F.col("spread_cost_per_unit") * F.col("fill_qty")), "product", "ms", "seq", "cost", "total")
    bps = F.abs(F.col("spread_cost_per_unit") / F.when(F.col("mid_at_fill") != 0, F.col("mid_at_fill"))) * 1e4
    return rows.groupBy("product").agg(F.count("*").alias("n"), F.round(F.avg(bps), 6).alias("mean_spread_bps"), F.max_by("total", F.struct("ms", "seq")).alias("total_spread_cost"))


@query(sql("fills", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:00') AS hour, count(*) AS n, round(avg(abs(spread_cost_per_unit / nullif(mid_at_fill, 0)) * 1e4), 6) AS mean_spread_bps FROM fills GROUP BY 1"""))
def a13_costs_by_hour(spark, sf_dir):
    """Per UTC hour count and spread."""
    return costs_by_hour(v.fills(spark, sf_dir))


def costs_by_hour(fills):
    from ..functions.text import hour_label

    bps = F.abs(F.col("spread_cost_per_unit") / F.when(F.col("mid_at_fill") != 0, F.col("mid_at_fill"))) * 1e4
    return fills.groupBy(hour_label(F.col("ts").cast("timestamp")).alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg(bps), 6).alias("mean_spread_bps"))


@query(sql("fills book", """
WITH b AS (SELECT product, ms, coalesce(lead(mid, 5) OVER w, last_value(mid) OVER g) AS m_5 FROM book WINDOW w AS (PARTITION BY product ORDER BY ms, seq), g AS (PARTITION BY product ORDER BY ms, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 m AS (SELECT f.*, (CASE WHEN side = 'buy' THEN 1.0 ELSE -1.0 END) * (m_5 - fill_px) AS mkout FROM fills f ASOF LEFT JOIN b ON f.product = b.product AND f.ms <= b.ms),
 e AS (SELECT list_sort(list_distinct(quantile_cont(fill_qty, [0.2, 0.4, 0.6, 0.8]))) AS q FROM fills)
SELECT CAST(len(list_filter(q, lambda x: x < fill_qty)) AS INTEGER) AS bucket, round(avg(mkout), 6) AS mkout_5, count(*) AS n FROM m, e GROUP BY 1"""))
def a14_edge_curve(spark, sf_dir):
    """Mean markout by quantile bin of a signal, bins closed on the right."""
    m = fl.markout_rows(v.fills(spark, sf_dir), v.book(spark, sf_dir), "product", [5])
    edges = bins.exact_quantiles(v.fills(spark, sf_dir), [], [0.2, 0.4, 0.6, 0.8], "fill_qty").select(F.array_distinct("q").alias("q"))
    binned = m.join(F.broadcast(edges)).withColumn("bucket", F.size(F.filter("q", lambda x: x < F.col("fill_qty"))))  # one row of edges
    return binned.groupBy("bucket").agg(F.round(F.avg("mkout_5"), 6).alias("mkout_5"), F.count("*").alias("n"))


REPLAY = f"""WITH o AS (SELECT product, seq AS order_id, ms, CASE WHEN seq % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, 5.0 + seq % 40 AS qty, CASE WHEN seq % 3 = 0 THEN CASE WHEN seq % 2 = 0 THEN ask ELSE bid END END AS limit_px FROM quotes),
 t AS (SELECT o.*, b.ms AS t_ms, b.seq AS t_seq, bid_px, ask_px, CASE WHEN side = 'buy' THEN ask_px ELSE bid_px END AS px, CASE WHEN side = 'buy' THEN ask_sz ELSE bid_sz END AS sz FROM o JOIN book b ON o.product = b.product AND b.ms BETWEEN o.ms AND o.ms + {H}),
 c AS (SELECT *, CASE WHEN sz <= 0 THEN qty ELSE greatest(1.0, sz * 0.1) END AS cap FROM t WHERE limit_px IS NULL OR CASE WHEN side = 'buy' THEN px <= limit_px ELSE px >= limit_px END),
 u AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY order_id ORDER BY t_ms, t_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM c),
 r AS (SELECT *, least(cap, greatest(qty - upto, 0)) AS fill_qty, CASE WHEN side = 'buy' THEN px - (bid_px + ask_px) / 2 ELSE (bid_px + ask_px) / 2 - px END AS cost FROM u)"""


def placed_orders(quotes):
    """Every quote is an order."""
    buy = F.col("seq") % 2 == 0
    return quotes.select("product", F.col("seq").alias("order_id"), "ms", F.when(buy, "buy").otherwise("sell").alias("side"), (5.0 + F.col("seq") % 40).alias("qty"), F.when(F.col("seq") % 3 == 0, F.when(buy, F.col("ask")).otherwise(F.col("bid"))).alias("limit_px"))


def replayed(spark, sf_dir):
    return fl.replay_orders(placed_orders(v.quotes(spark, sf_dir)), v.book(spark, sf_dir), "product", H)


@query(sql("quotes book", f"{REPLAY} SELECT order_id, t_seq AS seq, round(fill_qty, 6) AS fill_qty, px AS fill_px FROM r WHERE fill_qty > 0"))
def j17_replay(spark, sf_dir):
    """J17 ST8: orders against the displayed book with a share per tick and an expiry."""
    return replayed(spark, sf_dir).select("order_id", "seq", *r6("fill_qty"), "fill_px")


@query(sql("quotes book", f"{REPLAY} SELECT order_id, round(sum(fill_qty), 6) AS cum_filled, round(max(qty) - sum(fill_qty), 6) AS remaining, round(sum(fill_qty * px) / sum(fill_qty), 6) AS avg_fill_px, round(sum(cost * fill_qty), 6) AS total_spread_cost FROM r WHERE fill_qty > 0 GROUP BY 1"))
def a37_order_summary(spark, sf_dir):
    """Running averages of orders."""
    return fl.order_summary(replayed(spark, sf_dir)).select("order_id", *r6("cum_filled", "remaining", "avg_fill_px", "total_spread_cost"))


@query(sql("fills", """
SELECT product, round(sum(pnl), 6) AS pnl, round(avg(pnl) / stddev_pop(pnl) * sqrt(252 * 390.0::DOUBLE), 6) AS sharpe, round(avg(fill_qty), 6) AS mean_turnover
FROM (SELECT *, CASE WHEN side = 'buy' THEN mid_at_fill - fill_px ELSE fill_px - mid_at_fill END * fill_qty AS pnl FROM fills) GROUP BY product"""))
def a34_strategy_summary(spark, sf_dir):
    """Profit, Sharpe ratio and turnover."""
    pnl = F.when(F.col("side") == "buy", F.col("mid_at_fill") - F.col("fill_px")).otherwise(F.col("fill_px") - F.col("mid_at_fill")) * F.col("fill_qty")
    rows = v.fills(spark, sf_dir).withColumn("pnl", pnl)
    sharpe = F.avg("pnl") / F.stddev_pop("pnl") * F.sqrt(F.lit(252 * 390.0))
    return rows.groupBy("product").agg(F.round(F.sum("pnl"), 6).alias("pnl"), F.round(sharpe, 6).alias("sharpe"), F.round(F.avg("fill_qty"), 6).alias("mean_turnover"))


LATENCY = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


@query(sql("ticks", "SELECT product, round(quantile_cont(bid_sz, 0.5), 6) AS p50, round(quantile_cont(bid_sz, 0.9), 6) AS p90, round(quantile_cont(bid_sz, 0.99), 6) AS p99 FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY ms DESC, seq DESC) AS nth FROM ticks) WHERE nth <= 2000 GROUP BY product"))
def a28_latency(spark, sf_dir):
    """Percentiles of a latency column over the last 2000 rows of each group."""
    return sliding.last_percentiles(v.ticks(spark, sf_dir), "product", "ms", "seq", "bid_sz", LATENCY).select("product", *r6(*LATENCY))


@query(sql("ticks", "SELECT product, seq, round(quantile_cont(bid_sz, 0.5) OVER w, 6) AS p50, round(quantile_cont(bid_sz, 0.9) OVER w, 6) AS p90, round(quantile_cont(bid_sz, 0.99) OVER w, 6) AS p99 FROM ticks WINDOW w AS (PARTITION BY product ORDER BY ms, seq ROWS 1999 PRECEDING)"))
def w30_rolling_latency(spark, sf_dir):
    """Percentiles over the last 2000 rows, at every row."""
    rows = v.ticks(spark, sf_dir).select("product", "ms", "seq", "bid_sz")
    return sliding.rolling_percentiles(rows, "product", "ms", "seq", "bid_sz", LATENCY).select("product", "seq", *r6(*LATENCY))


@query(sql("ticks", "WITH n AS (SELECT product, event_type, bid_sz, count(*) AS n FROM ticks GROUP BY 1, 2, 3) SELECT product, event_type, bid_sz, n FROM (SELECT *, row_number() OVER (PARTITION BY product, event_type ORDER BY n DESC, bid_sz) AS nth FROM n) WHERE nth = 1"))
def t3_most_frequent(spark, sf_dir):
    """The most frequent size of each product and kind of event."""
    return sliding.most_frequent(v.ticks(spark, sf_dir), ["product", "event_type"], "bid_sz").select("product", "event_type", "bid_sz", "n")


@query(sql("ticks", """
SELECT inst, seq, bid_px, ask_px, bid_sz, CAST(CASE WHEN seq % 3 = 0 THEN trade_sz ELSE 0 END AS DOUBLE) AS trade_sz FROM ticks"""))
def s4_book_updates(spark, sf_dir):
    """Exchange records in fixed point to quotes with trade volume."""
    t = v.ticks(spark, sf_dir)
    raw = t.select(F.col("inst").alias("instrument_id"), F.col("seq"), (F.col("ms") * 1_000_000).alias("ts_event"), F.when(F.col("seq") % 3 == 0, "t").otherwise("A").alias("action"), F.col("trade_sz").cast("long").alias("size"), (F.col("bid_px") * 1e9).cast("long").alias("bid_px_00"), (F.col("ask_px") * 1e9).cast("long").alias("ask_px_00"), F.col("bid_sz").cast("long").alias("bid_sz_00"), F.col("ask_sz").cast("long").alias("ask_sz_00"))
    keyed = readers.book_updates(raw.withColumn("instrument_id", F.struct("instrument_id", "seq")))
    return keyed.select("instrument_id.instrument_id", "instrument_id.seq", F.round("bid_px", 6).alias("bid_px"), F.round("ask_px", 6).alias("ask_px"), "bid_sz", "trade_sz").withColumnRenamed("instrument_id", "inst")


@query()
def x7_fill_model(spark, sf_dir):
    """Fill probabilities with holdout AUC and Brier score by time."""
    # the first four fifths of each side train, by exact quantiles of the order as no window holds a side
    rows = written(sided(spark, sf_dir))
    ends = bins.exact_quantiles(rows, ["side"], [0.8], "seq").select("side", F.col("q")[0].alias("end"))
    rows = rows.join(F.broadcast(ends), "side")  # two sides
    names = ["distance_ticks", "rel_spread", "micro_dev", "predicted_return", "queue_ahead"]
    model = models.fit_fill_model(rows.where("seq <= end"), names)
    scored = models.fill_probability(model, rows.where("seq > end"), names)
    auc, brier = models.auc_brier(scored, "p_fill", "label")
    return scored.select("seq", "side", "label", "p_fill", F.lit(auc).alias("auc"), F.lit(brier).alias("brier"))


@query()
def x6_return_model(spark, sf_dir):
    """A return regressor and its residual deviation."""
    from ..operators import features

    names = ["ofi", "imbalance", "rel_spread", "micro_dev"]
    rows = features.forward_returns(features.order_flow(v.ticks(spark, sf_dir).where("bid_px > 0"), "inst"), "inst", "mid", 5, "y")
    rows = written(rows.select("inst", "seq", "y", *names))  # thresholds, cells, deviation and scores read it
    model, sigma = models.fit_return_model(rows, names, "y")
    return model.transform(rows.dropna(subset=["y"])).select("inst", "seq", "y", F.col("prediction").alias("mu"), F.lit(sigma).alias("sigma"))


@query(sql("predictions", """
WITH m AS (SELECT quantile_disc(target, 0.5) AS median FROM predictions)
SELECT round(avg(CASE WHEN pred = target THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN target IN (pred, (pred + 1) % 64, (pred + 2) % 64, (pred + 3) % 64, (pred + 4) % 64) THEN 1.0 ELSE 0.0 END), 6) AS top5, round(-avg(logprob), 6) AS ce,
 round(avg(CASE WHEN target <> median THEN CASE WHEN sign(pred - median) = sign(target - median) THEN 1.0 ELSE 0.0 END END), 6) AS direction,
 round(avg(CASE WHEN target <> median AND feature_index = 0 THEN CASE WHEN sign(pred - median) = sign(target - median) THEN 1.0 ELSE 0.0 END END), 6) AS direction_feature0, count(*) AS n FROM predictions, m"""))
def a26_prediction_scores(spark, sf_dir):
    """Accuracy, cross-entropy and direction of token predictions."""
    return quality.score_predictions(v.predictions(spark, sf_dir)).select(*r6("top1", "top5", "ce", "direction", "direction_feature0"), "n")

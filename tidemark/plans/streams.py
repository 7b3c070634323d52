"""Streaming queries over the event table, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.windows import DAY_MS
from ..sources.sinks import RollingSink
from ..streaming import queries as sq
from ..streaming import replay, stateful
from . import books
from . import views as v
from .ingest import scratch
from .registry import query
from .views import sql


def event_stream(spark, sf_dir):
    """The event table as a file stream."""
    schema = v.table(spark, sf_dir, "events").schema
    return sq.replay(spark, sf_dir, schema, "events.parquet")


def stream_view(spark, sf_dir, view):
    """A market view over the event stream."""
    return view(spark, v.Live(sf_dir, {"events": event_stream(spark, sf_dir)}))


def finished(spark, stream, mode="append"):
    path = scratch(spark)
    return sq.finished(stream, f"{path}/out", f"{path}/state", mode)


def with_state(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.STATE_STORE)


@query(sql("fills", """
SELECT hour, n, mean_spread_bps FROM (SELECT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:00') AS hour, date_trunc('hour', ts) + INTERVAL 1 HOUR AS past, count(*) AS n, round(avg(abs(spread_cost_per_unit / nullif(mid_at_fill, 0)) * 1e4), 6) AS mean_spread_bps FROM fills GROUP BY 1, 2)
WHERE past <= (SELECT max(ts) FROM fills) - INTERVAL 1 HOUR"""))
def st11_hourly_costs(spark, sf_dir):
    """ST11: hourly fill costs with a watermark; hours that it has not passed are not out yet."""
    fills = stream_view(spark, sf_dir, v.fills).withColumn("ts", F.col("ts").cast("timestamp"))
    return finished(spark, sq.hourly_costs(fills)).select("hour", "n", F.round("mean_spread_bps", 6).alias("mean_spread_bps"))


@query(sql("ticks", "SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H') AS hour, count(*) AS n FROM ticks GROUP BY 1, 2"))
def st3_hourly_sink(spark, sf_dir):
    """ST3 S8: a stream rotated into hourly folders."""
    path = scratch(spark)
    sq.rotate_hours(stream_view(spark, sf_dir, v.ticks).select("inst", "seq", "ms"), f"{path}/log", f"{path}/state").awaitTermination()
    read = spark.read.schema("inst long, seq long, ms long, day string, hour string").parquet(f"{path}/log")
    return read.groupBy("day", "hour").agg(F.count("*").alias("n"))


@query(sql("ticks", "SELECT seq, CAST((ms - low + 86399999) // 86400000 AS INTEGER) AS step FROM ticks, (SELECT min(ms) // 86400000 * 86400000 AS low FROM ticks) WHERE ms > low AND ms <= low + 10 * 86400000"))
def s14_paced_replay(spark, sf_dir):
    """The first ten days released in steps of a day of event time, unpaced."""
    path = scratch(spark)
    t = v.ticks(spark, sf_dir).select("seq", "ms", F.col("ts").cast("timestamp").alias("ts"))
    low = t.agg(F.min("ms")).first()[0] // DAY_MS * DAY_MS
    sink = lambda rows, number: rows.select("seq").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
    replay.paced(spark, t, "ts", low, low + 10 * DAY_MS, sink, f"{path}/state", speed=0, step_ms=DAY_MS)
    return spark.read.schema("seq long, batch int").parquet(f"{path}/rows").select("seq", (F.col("batch") + 1).alias("step"))


@query(sql("ticks", "SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H') AS hour, count(*) AS n, sum(seq) AS seqs FROM ticks GROUP BY 1, 2"))
def s8_rolling_sink(spark, sf_dir):
    """A stream flushed by rows and micro-batches with a manifest, compacted and read again."""
    path = scratch(spark)
    t = stream_view(spark, sf_dir, v.ticks).select("inst", "seq", "ms")
    sink = RollingSink(spark, f"{path}/log", rows=500)
    t.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    sink.compact(t.schema)
    return sink.read(t.schema).groupBy("day", "hour").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query(sql("quotes trades", "SELECT q.seq AS q_seq, t.seq AS t_seq FROM quotes q JOIN trades t ON q.product = t.product AND t.ts >= q.ts AND t.ts <= q.ts + INTERVAL 1 HOUR"))
def st10_quote_trade_pairs(spark, sf_dir):
    """ST10: quotes and trades of two streams joined on an interval, with watermarks; pairs are laid open from blocks when they are read."""
    with_state(spark)
    q = stream_view(spark, sf_dir, v.quotes).select("product", F.col("seq").alias("q_seq"), F.col("ts").cast("timestamp").alias("ts"))
    t = stream_view(spark, sf_dir, v.trades).select("product", F.col("seq").alias("t_seq"), F.col("ts").cast("timestamp").alias("ts"))
    blocks = finished(spark, stateful.stream_pair_blocks(q, t, "product", v.HOUR_MS, "q_seq", "t_seq"))
    return stateful.pairs_of(blocks, "q_seq", "t_seq")


@query(sql("ticks", """
SELECT CAST(inst AS VARCHAR) AS product, seq, CASE WHEN lag(bid_px) OVER w IS NULL THEN 0.0 ELSE
    (CASE WHEN bid_px > lag(bid_px) OVER w THEN bid_sz WHEN bid_px = lag(bid_px) OVER w THEN bid_sz - lag(bid_sz) OVER w ELSE -lag(bid_sz) OVER w END)
  - (CASE WHEN ask_px < lag(ask_px) OVER w THEN ask_sz WHEN ask_px = lag(ask_px) OVER w THEN ask_sz - lag(ask_sz) OVER w ELSE -lag(ask_sz) OVER w END) END AS ofi,
  round((ask_px * bid_sz + bid_px * ask_sz) / (bid_sz + ask_sz), 6) AS micro FROM ticks WINDOW w AS (PARTITION BY inst ORDER BY ms, seq)"""))
def st2_stream_order_flow(spark, sf_dir):
    """ST2: order flow with the last quote as state; equals the batch form."""
    with_state(spark)
    t = stream_view(spark, sf_dir, v.ticks).select(F.col("inst").cast("string").alias("product"), "ms", "seq", "bid_px", "bid_sz", "ask_px", "ask_sz")
    return finished(spark, stateful.stream_order_flow(t)).select("product", "seq", F.round("ofi", 6).alias("ofi"), F.round("micro", 6).alias("micro"))


@query()
def st1_stream_book(spark, sf_dir):
    """ST1: top of book from level updates with price levels as state."""
    from ..sources.readers import book_messages
    from .ingest import messages

    with_state(spark)
    raw = stream_view(spark, sf_dir, messages)
    return finished(spark, stateful.stream_book(book_messages(raw).select("product_id", "ms", "seq", "event_type", "event_no", "update_no", "side", "price", "size")))


@query(sql("quotes book", f"{books.REPLAY} SELECT order_id, t_seq AS seq, round(fill_qty, 6) AS fill_qty, px AS fill_px FROM r WHERE fill_qty > 0"))
def st8_order_expiry(spark, sf_dir):
    """ST8: orders filled tick by tick on a stream and closed by timers; the fills of the batch replay."""
    with_state(spark)
    text = F.col("product").cast("string").alias("product")
    orders = books.placed_orders(stream_view(spark, sf_dir, v.quotes)).withColumn("product", text)
    ticks = stream_view(spark, sf_dir, v.book).withColumn("product", text)
    fills = finished(spark, stateful.stream_fills(orders, ticks, books.H)).where("kind = 'fill'")
    return fills.select("order_id", "seq", F.round("fill_qty", 6).alias("fill_qty"), "fill_px")


@query()
def st7_order_gate(spark, sf_dir):
    """ST7: orders approved against what was approved before."""
    with_state(spark)
    t = stream_view(spark, sf_dir, v.ticks)
    orders = t.select(F.col("product").cast("string").alias("account"), F.expr("ms div 1000L").alias("ms"), "seq", (F.col("bid_sz") * F.col("bid_px") * 1000).alias("notional"))
    return finished(spark, stateful.stream_gate(orders))


@query(sql("ticks", """
WITH r AS (SELECT CAST(inst % 10 AS VARCHAR) AS product, ms, seq, i, [CAST(bid_px AS INTEGER) % 64, CAST(ask_px AS INTEGER) % 64, CAST(bid_sz AS INTEGER) % 64][i] AS token FROM ticks, range(1, 4) t(i)),
 n AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY ms DESC, seq DESC, i DESC) AS back FROM r)
SELECT product, max(ms) AS ms, list(CAST(token AS INTEGER) ORDER BY ms, seq, i) AS context FROM n WHERE back <= 256 GROUP BY 1"""))
def st6_token_context(spark, sf_dir):
    """ST6: the last 256 tokens per product."""
    from .corpora import token_rows

    with_state(spark)
    t = stream_view(spark, sf_dir, lambda s, d: token_rows(s, d).withColumn("product", (F.col("inst") % 10).cast("string")))
    return finished(spark, stateful.stream_context(t.select("product", "ms", "seq", "tokens")))


@query(sql("ticks", "SELECT CAST(product AS VARCHAR) AS product, seq, nth, round(m, 6) AS mean FROM (SELECT product, seq, row_number() OVER w AS nth, avg(bid_px) OVER (PARTITION BY product ORDER BY ms, seq ROWS 2047 PRECEDING) AS m FROM ticks WINDOW w AS (PARTITION BY product ORDER BY ms, seq)) WHERE nth % 5 = 0 AND nth >= 20"))
def st5_count_buffers(spark, sf_dir):
    """ST5: every fifth update with a mean over a buffer of the last 2048, both as state."""
    with_state(spark)
    t = stream_view(spark, sf_dir, v.ticks).select(F.col("product").cast("string").alias("product"), "ms", "seq", F.col("bid_px").alias("value"))
    return finished(spark, stateful.stream_every_nth(t)).select("product", "seq", "nth", F.round("mean", 6).alias("mean"))


@query(sql("ticks trades", "SELECT 'quote' AS kind, count(*) AS n, sum(seq) AS seqs FROM ticks WHERE trade_sz = 0 UNION ALL SELECT 'trade', count(*), sum(seq) FROM trades"))
def st4_tagged_outputs(spark, sf_dir):
    """ST4: one tagged stream as one output per kind."""
    t = stream_view(spark, sf_dir, v.ticks).select("seq", F.when(F.col("trade_sz") > 0, "trade").otherwise("quote").alias("kind"))
    outs = [finished(spark, part) for part in sq.by_kind(t, ["quote", "trade"]).values()]
    both = outs[0].unionByName(outs[1])
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query(sql("options", "SELECT 'O:' || contract AS ticker, round(s, 2) AS strike, CASE WHEN contract % 2 = 0 THEN 'C' ELSE 'P' END AS cp_flag, round(sigma, 4) AS iv FROM options"))
def st12_snapshots(spark, sf_dir):
    """ST12: landed snapshots as micro-batches."""
    from ..sources.readers import chain_snapshots
    from .ingest import chain_messages

    path = scratch(spark)
    chain_messages(spark, sf_dir).write.text(path)
    return finished(spark, chain_snapshots(sq.snapshots(spark, path)).select("ticker", "strike", "cp_flag", "iv"))


@query()
def st9_refit(spark, sf_dir):
    """ST9: bin edges refitted on the last days of what has come, after each micro-batch."""
    path = scratch(spark)
    t = stream_view(spark, sf_dir, v.ticks).select("ms", "bid_px", "bid_sz")
    sink = lambda edges, number: edges.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{path}/edges")
    sq.refit_edges(t, ["bid_px", "bid_sz"], 16, 7 * 86_400_000, sink, f"{path}/state", f"{path}/log").awaitTermination()
    return spark.read.schema("feature string, kind string, edges array<double>, batch int").parquet(f"{path}/edges")

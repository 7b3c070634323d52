"""Queries on sources and sinks: messages, symbols, files derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..sources import readers, sinks
from ..sources.shared import new_path as scratch
from ..sources.shared import written
from . import ticks as tk
from . import views as v
from .registry import query
from .views import sql


def messages(spark, sf_dir):
    t = v.ticks(spark, sf_dir)
    level = lambda side, px, sz: F.struct(F.lit(side).alias("side"), F.col(px).cast("string").alias("price_level"), F.col(sz).cast("string").alias("new_quantity"))
    event = F.struct(F.col("product").cast("string").alias("product_id"), F.array(level("bid", "bid_px", "bid_sz"), level("offer", "ask_px", "ask_sz")).alias("updates"))
    return t.select("ms", "seq", F.to_json(F.struct(F.lit("l2_data").alias("channel"), F.array(event).alias("events"))).alias("value"))


@query(sql("ticks", "SELECT CAST(product AS VARCHAR) AS product_id, seq, 'bid' AS side, bid_px AS price, bid_sz AS size FROM ticks UNION ALL SELECT CAST(product AS VARCHAR), seq, 'offer', ask_px, ask_sz FROM ticks"))
def s7_book_messages(spark, sf_dir):
    """S7 ST4: level-2 messages to price updates."""
    return readers.book_messages(messages(spark, sf_dir)).select("product_id", "seq", "side", "price", "size")


@query(sql("trades", "SELECT CAST(product AS VARCHAR) AS product_id, seq, last_px, last_sz, last_side FROM trades"))
def s7_trade_messages(spark, sf_dir):
    """Trade messages to prints with the taker's sign."""
    t = v.trades(spark, sf_dir)
    one = F.struct(F.col("product").cast("string").alias("product_id"), F.when(F.col("last_side") == 1, "SELL").otherwise("BUY").alias("side"), F.col("last_px").cast("string").alias("price"), F.col("last_sz").cast("string").alias("size"))
    raw = t.select("seq", F.to_json(F.struct(F.lit("market_trades").alias("channel"), F.array(F.struct(F.array(one).alias("trades"))).alias("events"))).alias("value"))
    return readers.trade_messages(raw).select("product_id", "seq", "last_px", "last_sz", "last_side")


@query(sql("items", "SELECT CAST(item AS VARCHAR) AS id, source AS subreddit, coalesce(text, '') AS title, item % 50 AS score FROM items"))
def s6_posts(spark, sf_dir):
    """Listing posts from landed JSON."""
    i = v.items(spark, sf_dir)
    post = F.struct(F.struct(F.col("item").cast("string").alias("id"), F.col("text").alias("title"), (F.col("item") % 50).alias("score"), F.col("source").alias("subreddit")).alias("data"))
    raw = i.select(F.to_json(F.struct(F.struct(F.array(post).alias("children")).alias("data"))).alias("value"))
    return readers.posts(raw).select("id", "subreddit", "title", "score")


@query(sql("items", "SELECT source, coalesce(text, '') AS title, url, CAST(day AS VARCHAR) AS published FROM items"))
def s6_articles(spark, sf_dir):
    """Articles from landed JSON."""
    i = v.items(spark, sf_dir)
    a = F.struct(F.col("text").alias("title"), F.col("url").alias("url"), F.col("day").cast("string").alias("publishedAt"), F.struct(F.col("source").alias("name")).alias("source"))
    return readers.articles(i.select(F.to_json(F.struct(F.array(a).alias("articles"))).alias("value"))).select("source", "title", "url", "published")


@query(sql("items", "SELECT CAST(item AS VARCHAR) AS id, text AS text, item % 9 AS likes, 0 AS retweets FROM items"))
def s6_tweets(spark, sf_dir):
    """Short posts with counts from landed JSON; missing counts are 0."""
    i = v.items(spark, sf_dir)
    t = F.struct(F.col("item").cast("string").alias("id"), F.col("text").alias("text"), F.struct((F.col("item") % 9).alias("like_count")).alias("public_metrics"))
    return readers.tweets(i.select(F.to_json(F.struct(F.array(t).alias("data"))).alias("value"))).select("id", "text", "likes", F.col("retweets").cast("int").alias("retweets"))


def chain_messages(spark, sf_dir):
    o = v.options(spark, sf_dir)
    d = F.struct(F.concat(F.lit("O:"), F.col("contract").cast("string")).alias("ticker"), F.round("s", 2).alias("strike_price"), F.when(F.col("contract") % 2 == 0, "call").otherwise("put").alias("contract_type"))
    return o.select(F.to_json(F.struct(F.array(F.struct(d.alias("details"), F.round("sigma", 4).alias("implied_volatility"))).alias("results"))).alias("value"))


@query(sql("options", "SELECT 'O:' || contract AS ticker, round(s, 2) AS strike, CASE WHEN contract % 2 = 0 THEN 'C' ELSE 'P' END AS cp_flag, round(sigma, 4) AS iv FROM options"))
def s6_chain(spark, sf_dir):
    """Option-chain snapshots from landed JSON."""
    return readers.chain_snapshots(chain_messages(spark, sf_dir)).select("ticker", "strike", "cp_flag", "iv")


@query(sql("", "SELECT p_partkey AS contract, 'SPX' AS root, '2024-01-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS expiry, CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'P' END AS cp_flag, p_partkey * 500 / 1000.0::DOUBLE AS strike FROM part"))
def f10_option_symbols(spark, sf_dir):
    """parts of option symbols, of 21 characters unless the strike has more than eight digits."""
    k = F.col("p_partkey")
    day = F.lpad((k % 28 + 1).cast("string"), 2, "0")
    strike = (k * 500).cast("string")  # eight digits at least; lpad alone would cut longer ones
    s = F.concat(F.rpad(F.lit("SPX"), 6, " "), F.lit("2401"), day, F.when(k % 2 == 0, "C").otherwise("P"), F.repeat(F.lit("0"), 8 - F.length(strike)), strike)
    return readers.symbol_definitions(v.table(spark, sf_dir, "part").select(k.alias("contract"), s.alias("symbol"))).select("contract", "root", "expiry", "cp_flag", "strike")


@query(sql("", "SELECT p_partkey AS contract, 'SPX' AS root, CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'P' END AS cp_flag, p_partkey * 500 / 1000.0::DOUBLE AS strike FROM part WHERE p_partkey % 3 <> 0"))
def p1_vendor_symbols(spark, sf_dir):
    """Option tickers of given roots and their parts."""
    k = F.col("p_partkey")
    strike = (k * 500).cast("string")  # eight digits at least, as the ticker ends with it; lpad alone would cut longer ones
    s = F.concat(F.lit("O:"), F.when(k % 3 == 0, "NDX").otherwise("SPX"), F.lit("240119"), F.when(k % 2 == 0, "C").otherwise("P"), F.repeat(F.lit("0"), 8 - F.length(strike)), strike)
    rows = readers.only_roots(v.table(spark, sf_dir, "part").select(k.alias("contract"), s.alias("ticker")), ["SPX", "XSP.W"])
    parts = text.vendor_option_symbol(F.col("ticker"))
    return rows.select("contract", parts["root"].alias("root"), parts["cp_flag"].alias("cp_flag"), parts["strike"].alias("strike"))


@query(sql("ticks", "SELECT seq, CASE WHEN seq % 5 = 0 THEN NULL ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS day FROM ticks"))
def f18_mixed_days(spark, sf_dir):
    """Days from epoch seconds or timestamps; anything else is null."""
    t = v.ticks(spark, sf_dir)
    raw = F.when(F.col("seq") % 5 == 0, "never").when(F.col("seq") % 2 == 0, F.expr("cast(ms div 1000 as string)")).otherwise(F.col("ts").cast("string"))
    return t.select("seq", text.utc_day(text.first_filled(F.lit(""), raw)).cast("string").alias("day"))


@query(sql("ticks", "SELECT inst, seq, bid_px AS bid, ask_px AS ask, trade_sz AS last_sz, 'C' AS cp_flag FROM ticks"))
def s1_option_csv(spark, sf_dir):
    """Option-trade CSV files, written, read with a schema and turned into events."""
    path = scratch(spark)
    t = v.ticks(spark, sf_dir)
    from ..sources.schemas import OPTION_TRADES

    names = [c.split()[0] for c in OPTION_TRADES.split(", ")]
    given = {"underlying_symbol": F.col("inst").cast("string"), "quote_datetime": F.col("ts").cast("string"), "root": F.col("seq").cast("string"), "option_type": F.lit("call"), "bid": F.col("bid_px"), "ask": F.col("ask_px"), "trade_volume": F.col("trade_sz"), "expiration": F.col("seq").cast("string")}
    t.select(*[given.get(n, F.lit(None).cast("string")).alias(n) for n in names]).write.option("header", True).option("compression", "gzip").csv(path + "/2024/day.csv")
    events = readers.option_rows_to_events(readers.option_trade_csv(spark, path))
    return events.select(F.col("underlying").cast("long").alias("inst"), F.col("expiry").cast("long").alias("seq"), "bid", "ask", "last_sz", "cp_flag")


@query(sql("ticks", "SELECT 'O:' || inst AS ticker, seq, trade_sz > 0 AS is_trade, CASE WHEN trade_sz > 0 THEN bid_px END AS last_px, trade_sz AS last_sz, CASE WHEN trade_sz = 0 THEN bid_px END AS bid, CASE WHEN trade_sz = 0 THEN ask_px END AS ask FROM ticks"))
def s2_vendor_days(spark, sf_dir):
    """Daily vendor files of trades and quotes under their dated paths, read day by day into one stream."""
    path = scratch(spark)
    t = v.ticks(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    from ..sources.schemas import VENDOR_QUOTES, VENDOR_TRADES

    given = {"ticker": F.concat(F.lit("O:"), F.col("inst").cast("string")), "sequence_number": F.col("seq"), "sip_timestamp": F.col("ms") * 1_000_000, "price": F.col("bid_px"), "size": F.col("trade_sz"), "bid_price": F.col("bid_px"), "ask_price": F.col("ask_px"), "bid_size": F.col("bid_sz"), "ask_size": F.col("ask_sz")}
    columns = lambda schema: [given.get(c.split()[0], F.lit(None).cast("string")).alias(c.split()[0]) for c in schema.split(", ")]
    days = sorted(r["day"] for r in t.select("day").distinct().collect())  # a calendar
    for kind, schema, rows in (("trades", VENDOR_TRADES, t.where("trade_sz > 0")), ("quotes", VENDOR_QUOTES, t.where("trade_sz = 0"))):
        by_day = scratch(spark)  # a day is then read from its own folder; Spark splits large days and joins small ones by size
        rows = rows.select("day", *columns(schema)).hint("rebalance", "day")
        rows.write.partitionBy("day").parquet(by_day)
        staged = spark.read.schema(rows.drop("day").schema.add("day", "string")).parquet(by_day)
        for d in days:
            staged.where(F.col("day") == d).drop("day").write.option("header", True).option("compression", "gzip").csv(f"{path}/{kind}/{d[:4]}/{d[5:7]}/{d}.csv.gz")
    events = readers.vendor_events(readers.vendor_days(spark, path, "trades", days), readers.vendor_days(spark, path, "quotes", days))
    return events.select("ticker", "seq", "is_trade", "last_px", "last_sz", "bid", "ask")


@query(sql("ticks", "SELECT inst, seq, ms FROM ticks WHERE ms >= (SELECT max(ms) FROM ticks) - 48 * 3600000"))
def s9_recent_events(spark, sf_dir):
    """An hourly event log and its last 48 hours."""
    path = scratch(spark)
    t = v.ticks(spark, sf_dir).select("inst", "seq", "ms")
    sinks.append_events(t, path)
    now = t.agg(F.max("ms")).first()[0]
    return sinks.recent_events(spark, path, now, 48).select("inst", "seq", "ms")


@query(sql("items", "SELECT CASE WHEN item % 2 = 0 THEN 'even' ELSE 'odd' END AS source, count(*) AS n, count(CASE WHEN item % 2 = 0 THEN 1 END) AS with_url FROM items GROUP BY 1"))
def s10_item_history(spark, sf_dir):
    """Items of several sources appended to one history."""
    path = scratch(spark)
    i = v.items(spark, sf_dir).select("item", "url", F.when(F.col("item") % 2 == 0, "even").otherwise("odd").alias("source"))
    sinks.append_items([i.where("source = 'even'"), i.where("source = 'odd'").drop("url")], path, "2024-01-01")
    return sinks.load_items(spark, path).groupBy(F.col("_source").alias("source")).agg(F.count("*").alias("n"), F.count("url").alias("with_url"))


@query(sql("ticks picks", "SELECT split, regime, count(*) AS n FROM ticks JOIN picks ON ms // 86400000 = picks.day GROUP BY 1, 2"))
def s12_split_layout(spark, sf_dir):
    """Token shards under split and regime, read back by globs."""
    path = scratch(spark)
    rows, edges = tk.fitted(spark, sf_dir)
    coded = tk.bins.tokens(rows, tk.bins.collect_edges(edges), tk.FEATURES).withColumn("day", F.expr("ms div 86400000L"))
    placed = coded.join(v.day_picks(spark, sf_dir), "day").select("day", "split", "regime", "tokens")
    sinks.write_shards(placed, path, 10_000, ("split", "regime"))
    return readers.token_shards(spark, path, ("tokens", "split", "regime")).groupBy("split", F.col("regime").cast("long").alias("regime")).agg(F.count("*").alias("n"))


def report_sections(spark, sf_dir):
    """Sections of the report by name; prices, returns, items and fills are written once and shared."""
    from . import books, corpora, panels

    prices = written(v.panel(spark, sf_dir))
    returns = written(panels.panel.panel_returns(prices))
    items = written(panels.tagged(spark, sf_dir).select("item", "day", "tickers", "sentiment"))
    fills = written(v.fills(spark, sf_dir))
    return {
        "snapshot": panels.snapshot(prices), "anomalies": panels.anomalies(returns), "pairs": panels.pairs(returns), "clusters": panels.models.cluster_tickers(returns),
        "spikes": panels.mention_spikes(items), "lead_lag": panels.lead_lags(returns), "sentiment": panels.market_sentiment(items),
        "edge": books.post_trade(fills), "symbols": books.costs_by_symbol(fills), "hours": books.costs_by_hour(fills),
        "tick_quality": corpora.a15_tick_findings(spark, sf_dir), "shard_quality": corpora.a16_shard_findings(spark, sf_dir),
    }


@query()
def s15_report(spark, sf_dir):
    """The report's sections as JSON, read back as one table of rows per section."""
    path = scratch(spark)
    sections = report_sections(spark, sf_dir)
    sinks.write_report(sections, path)
    out = None
    for name, df in sections.items():
        part = spark.read.schema(df.schema).json(f"{path}/{name}").select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out

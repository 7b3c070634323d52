"""Readers of landed files and converters to the common event shapes."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.market import aggressor_sign
from ..functions.text import fixed_point, option_symbol
from ..operators.features import require_columns
from . import schemas


def option_trade_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Option trades from a tree of CSV files (plain, gzip or Zstandard); ``columns`` prune the parse."""
    df = spark.read.schema(schemas.OPTION_TRADES).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv{,.gz}").csv(path)
    packed = zstd_lines(spark, path, "*.csv.zst").select(F.from_csv("line", schemas.OPTION_TRADES).alias("r")).select("r.*")
    df = df.unionByName(packed)
    return df.select(*columns) if columns else df


def zstd_lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Lines, without the header, of Zstandard files in a tree.

    Spark's own codec needs a native library that many installations lack. A file is one task, as with
    gzip, and is unpacked in pieces.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for file in batch.column("content"):
                with zstandard.ZstdDecompressor().stream_reader(file.as_buffer(), read_across_frames=True) as raw:
                    lines = io.TextIOWrapper(raw, encoding="utf-8")
                    next(lines, None)
                    while some := [x.rstrip("\r\n") for x in islice(lines, 10_000)]:
                        yield pa.RecordBatch.from_arrays([pa.array([x for x in some if x], pa.string())], ["line"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("content")
    return files.mapInArrow(unpack, "line string")


def vendor_days(spark: SparkSession, root: str, kind: str, days: list[str]) -> DataFrame:
    """Daily ``root/kind/YYYY/MM/YYYY-MM-DD.csv.gz`` files; ``kind`` is trades or quotes."""
    schema = schemas.VENDOR_TRADES if kind == "trades" else schemas.VENDOR_QUOTES
    return spark.read.schema(schema).option("header", True).csv([f"{root}/{kind}/{d[:4]}/{d[5:7]}/{d}.csv.gz" for d in days])


def token_shards(spark: SparkSession, globs: str, columns: tuple[str, ...] = ("tokens",), most: int | None = None) -> DataFrame:
    """Token rows from comma-separated globs; only ``columns`` are read.

    A file that several globs name is read once. With ``most`` only the first so many files, by path, are
    read; partition columns still come from their folders.
    """
    paths = [g.strip() for g in globs.split(",") if g.strip()]
    if most is None and len(paths) == 1:
        return spark.read.parquet(*paths).select(*columns)
    files: set[str] = set()
    for path in paths:  # one list of names for each glob, as a scan makes it
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
        files |= {r["path"] for r in found.select("path").collect()}
    roots = {re.split(r"/[^/=]+=[^/]*/|/[^/]*$", f, maxsplit=1)[0] for f in files}  # above the partition folders
    reader = spark.read.option("basePath", roots.pop()) if len(roots) == 1 else spark.read
    return reader.parquet(*sorted(files)[:most]).select(*columns)


def only_roots(df: DataFrame, roots: list[str], ticker: str = "ticker") -> DataFrame:
    """Option tickers ``O:ROOTyymmddC...`` of the given roots."""
    return df.where(F.col(ticker).rlike(rf"^O:({'|'.join(r.replace('.', chr(92) + '.') for r in roots)})\d{{6}}[CP]\d+$"))


def book_updates(df: DataFrame) -> DataFrame:
    """Exchange top-of-book records in fixed point to quotes with trade volume on trade actions."""
    require_columns(df, {"ts_event", "action", "size", "bid_px_00", "ask_px_00", "bid_sz_00", "ask_sz_00"})
    volume = F.when(F.upper("action") == "T", F.col("size")).otherwise(0)
    return df.select(
        "instrument_id", F.col("ts_event").alias("ts_ns"), F.expr("ts_event div 1000000L").alias("ms"),
        fixed_point(F.col("bid_px_00")).alias("bid_px"), fixed_point(F.col("ask_px_00")).alias("ask_px"),
        F.col("bid_sz_00").cast("double").alias("bid_sz"), F.col("ask_sz_00").cast("double").alias("ask_sz"), volume.cast("double").alias("trade_sz"),
    )


def option_rows_to_events(df: DataFrame) -> DataFrame:
    """Option-trade rows to unified chain events."""
    ts = F.unix_millis(F.col("quote_datetime").try_cast("timestamp"))
    return df.select(
        F.lit("chain").alias("kind"), ts.alias("ts"), F.col("underlying_symbol").alias("underlying"), "strike", F.col("expiration").alias("expiry"),
        F.substring(F.upper("option_type"), 1, 1).alias("cp_flag"), "bid", "ask", F.col("bid_size").alias("bid_sz"), F.col("ask_size").alias("ask_sz"),
        F.col("close").alias("last_px"), F.col("trade_volume").alias("last_sz"), F.lit(None).cast("int").alias("last_side"),
        F.col("implied_volatility").alias("iv"), "delta", "gamma", "theta", "vega",
    ).where("ts is not null")


def vendor_events(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """Trades and quotes in one stream: no book on trades, no size on quotes."""
    none = F.lit(None).cast("double")
    t = trades.select("ticker", F.col("sip_timestamp").alias("ts_ns"), F.lit(True).alias("is_trade"), F.col("sequence_number").alias("seq"), F.col("price").alias("last_px"), F.col("size").alias("last_sz"), none.alias("bid"), none.alias("ask"), none.alias("bid_sz"), none.alias("ask_sz"))
    q = quotes.select("ticker", F.col("sip_timestamp").alias("ts_ns"), F.lit(False).alias("is_trade"), F.col("sequence_number").alias("seq"), none.alias("last_px"), F.lit(0.0).alias("last_sz"), F.col("bid_price").alias("bid"), F.col("ask_price").alias("ask"), F.col("bid_size").alias("bid_sz"), F.col("ask_size").alias("ask_sz"))
    return t.unionByName(q)


def book_messages(df: DataFrame, value: str = "value") -> DataFrame:
    """Level-2 messages (JSON) to one row per price update; works on batches and streams.

    An event of type ``snapshot``, as a feed sends it after a reconnect, replaces the product's book.
    """
    m = df.withColumn("m", F.from_json(value, schemas.L2_MESSAGE)).where(F.col("m.channel") == "l2_data")
    e = m.select("*", F.posexplode("m.events").alias("event_no", "e")).select("*", F.posexplode("e.updates").alias("update_no", "u"))
    rest = [c for c in df.columns if c != value]
    return e.select(*rest, F.col("e.product_id").alias("product_id"), F.col("e.type").alias("event_type"), "event_no", "update_no", F.col("u.side").alias("side"), F.col("u.price_level").try_cast("double").alias("price"), F.col("u.new_quantity").try_cast("double").alias("size"))


def trade_messages(df: DataFrame, value: str = "value") -> DataFrame:
    """Trade messages (JSON) to prints; the message names the maker's side, the print the taker's sign."""
    m = df.withColumn("m", F.from_json(value, schemas.L2_MESSAGE)).where(F.col("m.channel") == "market_trades")
    t = m.select("*", F.explode("m.events").alias("e")).select("*", F.explode("e.trades").alias("t"))
    rest = [c for c in df.columns if c != value]
    return t.select(*rest, F.col("t.product_id").alias("product_id"), F.col("t.price").try_cast("double").alias("last_px"), F.col("t.size").try_cast("double").alias("last_sz"), aggressor_sign(F.col("t.side")).alias("last_side"))


def posts(df: DataFrame, value: str = "value") -> DataFrame:
    d = df.select(F.explode(F.from_json(value, schemas.POSTS)["data"]["children"]).alias("c")).select("c.data.*")
    return d.select(F.lit("reddit").alias("source"), "id", "subreddit", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("selftext", F.lit("")).alias("body"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("num_comments", F.lit(0)).alias("comments"), "created_utc", "url", "author")


def articles(df: DataFrame, value: str = "value") -> DataFrame:
    a = df.select(F.explode(F.from_json(value, schemas.ARTICLES)["articles"]).alias("a"))
    return a.select(F.coalesce("a.source.name", F.lit("news")).alias("source"), F.coalesce("a.title", F.lit("")).alias("title"), F.coalesce("a.description", F.lit("")).alias("summary"), F.col("a.url").alias("url"), F.col("a.publishedAt").alias("published"))


def tweets(df: DataFrame, value: str = "value") -> DataFrame:
    t = df.select(F.explode(F.from_json(value, schemas.TWEETS)["data"]).alias("t"))
    return t.select(F.lit("x").alias("source"), "t.id", "t.text", "t.created_at", F.coalesce("t.public_metrics.like_count", F.lit(0)).alias("likes"), F.coalesce("t.public_metrics.retweet_count", F.lit(0)).alias("retweets"))


def chain_snapshots(df: DataFrame, value: str = "value") -> DataFrame:
    r = df.select(F.explode(F.from_json(value, schemas.CHAIN)["results"]).alias("r"))
    return r.select(F.lit("chain").alias("kind"), F.col("r.details.ticker").alias("ticker"), F.col("r.details.strike_price").alias("strike"), F.col("r.details.expiration_date").alias("expiry"), F.substring(F.upper("r.details.contract_type"), 1, 1).alias("cp_flag"), "r.last_quote.bid", "r.last_quote.ask", F.col("r.implied_volatility").alias("iv"), "r.greeks.delta", "r.greeks.gamma", "r.greeks.theta", "r.greeks.vega")


def symbol_definitions(df: DataFrame, symbol: str = "symbol") -> DataFrame:
    """``df`` with the parts of a 21-character option symbol."""
    return df.withColumns(option_symbol(F.col(symbol)))

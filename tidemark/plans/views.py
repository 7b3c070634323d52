"""Market views over the generic tables, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


@dataclass(frozen=True)
class Live:
    """A folder of tables of which some are streams."""

    sf_dir: str
    streams: dict[str, DataFrame]


def table(spark: SparkSession, sf_dir: str | Live, name: str) -> DataFrame:
    if isinstance(sf_dir, Live):
        return sf_dir.streams[name] if name in sf_dir.streams else table(spark, sf_dir.sf_dir, name)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts) -> F.Column:
    return F.unix_millis(ts.cast("timestamp"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    low = F.floor("value").cast("double")
    seq = F.col("event_id")
    return e.select(
        F.col("user_id").alias("inst"), (F.col("user_id") % 10).alias("product"), seq.alias("seq"), F.col("ts"), millis(F.col("ts")).alias("ms"), "event_type",
        low.alias("bid_px"), (low + 1 + seq % 3).alias("ask_px"), (k + 1).cast("double").alias("bid_sz"), (seq * 7 % 100 + 1).cast("double").alias("ask_sz"),
        F.when(F.col("event_type").isin("purchase", "click"), k % 20 + 1).otherwise(0).cast("double").alias("trade_sz"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    buy = F.col("event_type") == "purchase"
    t = ticks(spark, sf_dir).where("trade_sz > 0")
    return t.select("product", "inst", "seq", "ts", "ms", F.when(buy, F.col("ask_px")).otherwise(F.col("bid_px")).alias("last_px"), F.col("trade_sz").alias("last_sz"), F.when(buy, 1).otherwise(-1).alias("last_side"), "bid_px", "ask_px")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ticks(spark, sf_dir).where(F.col("event_type").isin("view", "signup"))
    return q.select("product", "inst", "seq", "ts", "ms", F.col("bid_px").alias("bid"), F.col("ask_px").alias("ask"), "bid_sz", "ask_sz", (F.col("bid_sz") % 5).alias("bid_queue_ahead"), (F.col("ask_sz") % 5).alias("ask_queue_ahead"))


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top of book per product, from the quote events."""
    q = quotes(spark, sf_dir)
    return q.select("product", "seq", "ts", "ms", F.col("bid").alias("bid_px"), F.col("ask").alias("ask_px"), "bid_sz", "ask_sz", ((F.col("bid") + F.col("ask")) / 2).alias("mid"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    mid = (F.col("bid_px") + F.col("ask_px")) / 2
    side = F.when(F.col("last_side") == 1, "buy").otherwise("sell")
    return t.select("product", "seq", "ts", "ms", side.alias("side"), F.col("last_px").alias("fill_px"), F.col("last_sz").alias("fill_qty"), mid.alias("mid_at_fill"), F.abs(F.col("last_px") - mid).alias("spread_cost_per_unit"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), F.col("p_brand").alias("ticker")).agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("close"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 30).cast("int"))
    return d.select(F.col("doc_id").alias("item"), day.alias("day"), "text", "source", F.concat_ws("/", "source", (F.col("doc_id") % 500).cast("string")).alias("url"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    qty = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("account"), F.col("l_partkey").alias("contract"), qty.cast("double").alias("qty"), F.col("p_retailprice").cast("double").alias("spot"),
        (F.col("l_discount") * 5).cast("double").alias("delta"), (F.col("l_tax") / 100).cast("double").alias("gamma"), (F.col("l_tax") * 10).cast("double").alias("vega"),
    )


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(key.alias("contract"), F.col("p_retailprice").cast("double").alias("s"), (F.col("p_retailprice") * (0.97 + 0.06 * (key % 25) / 24)).cast("double").alias("k"), ((F.col("p_size") + 1) / 365.0).alias("tau"), (0.1 + (key % 7) * 0.05).alias("sigma"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    target, pred = (F.floor("value").cast("int") % 64).alias("target"), (i * 31 % 64).cast("int")
    return e.select(i.alias("position"), target, pred.alias("pred"), (i % 7).cast("int").alias("feature_index"), F.array(*[(pred + k) % 64 for k in range(5)]).alias("top5"), (-(i % 10 + 1) / 10.0).alias("logprob"))


def day_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = ticks(spark, sf_dir).select(F.expr("ms div 86400000L").alias("day")).distinct()
    return days.select("day", F.when(F.col("day") % 6 == 5, "eval").otherwise("train").alias("split"), (F.col("day") % 5).alias("regime"))


CTES = {
    "ticks": """ticks AS (SELECT user_id AS inst, user_id % 10 AS product, event_id AS seq, ts, epoch_us(ts) // 1000 AS ms, event_type,
        floor(value) AS bid_px, floor(value) + 1 + event_id % 3 AS ask_px, CAST(k + 1 AS DOUBLE) AS bid_sz, CAST(event_id * 7 % 100 + 1 AS DOUBLE) AS ask_sz,
        CAST(CASE WHEN event_type IN ('purchase','click') THEN k % 20 + 1 ELSE 0 END AS DOUBLE) AS trade_sz
        FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events))""",
    "trades": """trades AS (SELECT product, inst, seq, ts, ms, CASE WHEN event_type = 'purchase' THEN ask_px ELSE bid_px END AS last_px, trade_sz AS last_sz,
        CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS last_side, bid_px, ask_px FROM ticks WHERE trade_sz > 0)""",
    "quotes": """quotes AS (SELECT product, inst, seq, ts, ms, bid_px AS bid, ask_px AS ask, bid_sz, ask_sz, bid_sz % 5 AS bid_queue_ahead, ask_sz % 5 AS ask_queue_ahead
        FROM ticks WHERE event_type IN ('view','signup'))""",
    "book": "book AS (SELECT product, seq, ts, ms, bid AS bid_px, ask AS ask_px, bid_sz, ask_sz, (bid + ask) / 2 AS mid FROM quotes)",
    "fills": """fills AS (SELECT product, seq, ts, ms, CASE WHEN last_side = 1 THEN 'buy' ELSE 'sell' END AS side, last_px AS fill_px, last_sz AS fill_qty,
        (bid_px + ask_px) / 2 AS mid_at_fill, abs(last_px - (bid_px + ask_px) / 2) AS spread_cost_per_unit FROM trades)""",
    "panel": """panel AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, p_brand AS ticker, round(avg(l_extendedprice / l_quantity), 6) AS close
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""",
    "items": """items AS (SELECT doc_id AS item, DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS day, text, source, source || '/' || CAST(doc_id % 500 AS VARCHAR) AS url FROM documents)""",
    "positions": """positions AS (SELECT l_suppkey AS account, l_partkey AS contract, CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS DOUBLE) AS qty,
        CAST(p_retailprice AS DOUBLE) AS spot, CAST(l_discount * 5 AS DOUBLE) AS delta, CAST(l_tax / 100 AS DOUBLE) AS gamma, CAST(l_tax * 10 AS DOUBLE) AS vega
        FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "options": """options AS (SELECT p_partkey AS contract, CAST(p_retailprice AS DOUBLE) AS s, CAST(p_retailprice * (CAST(0.97 AS DOUBLE) + CAST(0.06 AS DOUBLE) * (p_partkey % 25) / 24) AS DOUBLE) AS k,
        (p_size + 1) / CAST(365 AS DOUBLE) AS tau, CAST(0.1 AS DOUBLE) + (p_partkey % 7) * CAST(0.05 AS DOUBLE) AS sigma FROM part)""",
    "predictions": """predictions AS (SELECT event_id AS position, CAST(floor(value) AS INTEGER) % 64 AS target, CAST(event_id * 31 % 64 AS INTEGER) AS pred, CAST(event_id % 7 AS INTEGER) AS feature_index,
        -(event_id % 10 + 1) / 10.0::DOUBLE AS logprob FROM events)""",
    "picks": """picks AS (SELECT day, CASE WHEN day % 6 = 5 THEN 'eval' ELSE 'train' END AS split, day % 5 AS regime FROM (SELECT DISTINCT ms // 86400000 AS day FROM ticks))""",
}
NEEDS = {"trades": ["ticks"], "quotes": ["ticks"], "book": ["ticks", "quotes"], "fills": ["ticks", "trades"], "picks": ["ticks"]}


def sql(views: str, body: str) -> str:
    """``body`` behind the named views (space separated) and what they need."""
    names: list[str] = []
    for v in views.split():
        for n in [*NEEDS.get(v, []), v]:
            if n not in names:
                names.append(n)
    text = ",\n".join(CTES[n] for n in names)
    body = body.strip()
    return f"WITH {text}{', ' + body[5:] if body.upper().startswith('WITH ') else chr(10) + body}" if text else body


def half_up(x: str, places: int) -> str:
    """A SQL expression rounded half up as Spark rounds: by the decimal that the double is written as."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), {places}) AS DOUBLE)"


def cdf_sql(z: str) -> str:
    """The normal distribution function of a SQL expression, by the same coefficients."""
    from ..functions.market import CDF_BOTTOM, CDF_TOP

    a = f"abs({z})"

    def poly(cs: tuple[float, ...]) -> str:
        out = f"{cs[0]!r}::DOUBLE"
        for c in cs[1:]:
            out = f"({out} * {a} + {c!r}::DOUBLE)"
        return out

    e = f"exp(-{a} * {a} / 2.0::DOUBLE)"
    far = f"({a} + 0.65::DOUBLE)"
    for k in (4, 3, 2, 1):
        far = f"({a} + {k}.0::DOUBLE / {far})"
    tail = f"(CASE WHEN {a} > 37 THEN 0.0::DOUBLE WHEN {a} < 7.07106781186547::DOUBLE THEN {e} * {poly(CDF_TOP)} / {poly(CDF_BOTTOM)} ELSE {e} / {far} / 2.506628274631::DOUBLE END)"
    return f"(CASE WHEN {z} > 0 THEN 1.0::DOUBLE - {tail} ELSE {tail} END)"

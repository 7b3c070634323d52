"""Queries on price panels, items and sentiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import corpus, models, panel, quality
from ..operators.windows import by
from ..sources.shared import written
from . import views as v
from .registry import query
from .views import sql

LEXICON = [("the", 0.5), ("and", -0.7), ("of", -1.0), ("is", 1.5)]
RET = "r AS (SELECT date, ticker, close, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS ret FROM panel)"
TAGGED = """lex AS (SELECT * FROM (VALUES ('the', 0.5), ('and', -0.7), ('of', -1.0), ('is', 1.5)) t(word, valence)),
 wd AS (SELECT item, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM items),
 sc AS (SELECT item, coalesce(sum(CAST(valence AS DOUBLE)), 0.0) AS s, count(*) AS n, count(*) FILTER (valence > 0) AS p, count(*) FILTER (valence < 0) AS m FROM wd LEFT JOIN lex USING (word) GROUP BY item)"""


def r6(*names: str):
    return [F.round(c, 6).alias(c) for c in names]


def returns(spark, sf_dir):
    return panel.panel_returns(v.panel(spark, sf_dir))


def kept_returns(spark, sf_dir):
    """The returns written once, for what reads them more often."""
    return written(returns(spark, sf_dir))


def tagged(spark, sf_dir):
    lexicon = spark.createDataFrame(LEXICON, "word string, valence double")
    items = v.items(spark, sf_dir).withColumn("tickers", text.tickers(F.col("text")))  # before the join, through which no text then goes unless asked for
    return panel.lexicon_sentiment(items, lexicon, "item", "text").withColumn("sentiment", F.round("compound", 9))


@query(sql("panel", f"""WITH {RET}, z AS (SELECT *, CASE WHEN count(ret) OVER w = 21 THEN stddev_samp(ret) OVER w END AS vol FROM r WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 20 PRECEDING))
SELECT date, ticker, round(ret, 6) AS ret, round(vol, 6) AS vol, round(CASE WHEN ret IS NOT NULL THEN (rank() OVER (PARTITION BY date, ret IS NULL ORDER BY ret) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY date, ret IS NULL) END, 6) AS pct_rank FROM z"""))
def w15_panel_returns(spark, sf_dir):
    """Returns, rolling deviation, percentile rank per date with average ties."""
    return returns(spark, sf_dir).select("date", "ticker", *r6("ret", "vol", "pct_rank"))


@query(sql("panel", """
WITH s AS (SELECT date, ticker, close, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS nth FROM panel)
SELECT ticker, close, round((close / prev - 1) * 100, 6) AS change_pct FROM s WHERE nth = 1"""))
def w7_snapshot(spark, sf_dir):
    """Last price and change per ticker."""
    return snapshot(v.panel(spark, sf_dir))


def snapshot(prices):
    w = by("ticker", "date")
    rows = prices.withColumn("change", F.col("close") / F.lag("close").over(w) - 1)
    last = rows.groupBy("ticker").agg(F.max_by(F.struct("close", "change"), "date").alias("l"))
    return last.select("ticker", "l.close", F.round(F.col("l.change") * 100, 6).alias("change_pct"))


Z = f"""WITH {RET}, z AS (SELECT *, CASE WHEN count(ret) OVER w = 63 AND stddev_samp(ret) OVER w > 0 THEN (ret - avg(ret) OVER w) / stddev_samp(ret) OVER w END AS z FROM r WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 62 PRECEDING))"""


@query(sql("panel", f"{Z} SELECT date, ticker, round(z, 5) AS z FROM z"))
def w4_rolling_z(spark, sf_dir):
    """Z-score of returns in their trailing window."""
    return panel.rolling_z(returns(spark, sf_dir), "ticker", "date", "ret", 63, "z").select("date", "ticker", F.round("z", 5).alias("z"))


@query(sql("panel", f"{Z} SELECT ticker, round(ret, 6) AS ret, round(z, 5) AS z FROM z WHERE date = (SELECT max(date) FROM panel) AND z IS NOT NULL ORDER BY abs(z) DESC, ticker LIMIT 15"))
def t1_top_anomalies(spark, sf_dir):
    """The 15 largest anomalies of the last date (a top-k report)."""
    return anomalies(kept_returns(spark, sf_dir))


def anomalies(returns):
    return panel.top_anomalies(returns).select("ticker", *r6("ret"), F.round("z", 5).alias("z"))


@query(sql("panel", f"WITH {RET} SELECT a.ticker AS a, b.ticker AS b, round(corr(a.ret, b.ret), 6) AS corr FROM r a JOIN r b ON a.date = b.date AND a.ticker < b.ticker WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2 HAVING abs(corr(a.ret, b.ret)) >= 0.1"))
def j9_correlated_pairs(spark, sf_dir):
    """Pairs of tickers by correlation of returns."""
    return pairs(returns(spark, sf_dir))


def pairs(returns):
    return panel.correlated_pairs(returns, 0.1).select("a", "b", *r6("corr"))


@query(sql("panel", f"WITH {RET} SELECT a.ticker AS a, b.ticker AS b, round(CASE WHEN a.ticker = b.ticker THEN 1.0 ELSE corr(a.ret, b.ret) END, 6) AS corr FROM r a JOIN r b ON a.date = b.date WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2"))
def a3_correlation_matrix(spark, sf_dir):
    """A3: the whole correlation matrix, in long form."""
    return panel.correlation_matrix(returns(spark, sf_dir)).select("a", "b", *r6("corr"))


@query(sql("panel", f"""WITH {RET}, p AS (SELECT a.date, b.ticker, a.ret AS x, b.ret AS y FROM r a JOIN r b USING (date) WHERE a.ticker = 'Brand#11' AND a.ret IS NOT NULL AND b.ret IS NOT NULL)
SELECT date, ticker, round(CASE WHEN count(*) OVER w = 21 THEN corr(x, y) OVER w END, 5) AS rolling_corr FROM p WHERE ticker <> 'Brand#11' WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 20 PRECEDING)"""))
def w5_rolling_corr(spark, sf_dir):
    """Rolling correlation with one ticker."""
    r = returns(spark, sf_dir).where("ret is not null")
    one = r.where("ticker = 'Brand#11'").select("date", F.col("ret").alias("x"))
    rows = r.where("ticker <> 'Brand#11'").select("date", "ticker", F.col("ret").alias("y")).join(one, "date")
    return panel.rolling_corr(rows, "ticker", "date", "x", "y").select("date", "ticker", F.round("rolling_corr", 5).alias("rolling_corr"))


LAGS = """, n AS (SELECT ticker, x, y, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM merged WHERE x IS NOT NULL AND y IS NOT NULL),
 l AS (SELECT a.ticker, k, corr(a.x, b.y) AS c, count(*) AS n FROM n a, range(-5, 6) t(k), n b WHERE b.ticker = a.ticker AND b.rn = a.rn + k GROUP BY 1, 2),
 f AS (SELECT ticker, k, c, row_number() OVER (PARTITION BY ticker ORDER BY round(abs(c), 12) DESC, k) AS nth FROM l WHERE n >= 10 AND c IS NOT NULL AND NOT isnan(c) AND abs(c) > 0)
SELECT t.ticker, CAST(coalesce(k, 0) AS INTEGER) AS lag, round(coalesce(c, 0.0), 6) AS corr FROM (SELECT DISTINCT ticker FROM n) t LEFT JOIN f ON f.ticker = t.ticker AND nth = 1"""


@query(sql("panel", f"WITH {RET}, merged AS (SELECT b.date, b.ticker, a.ret AS x, b.ret AS y FROM r a JOIN r b USING (date) WHERE a.ticker = 'Brand#11'){LAGS}"))
def w6_lead_lag(spark, sf_dir):
    """The lag with the largest correlation per ticker."""
    return lead_lags(kept_returns(spark, sf_dir))


def lead_lags(r):
    one = r.where("ticker = 'Brand#11'").select("date", F.col("ret").alias("x"))
    return panel.lead_lag(r.select("date", "ticker", F.col("ret").alias("y")).join(one, "date"), "x", "y").select("ticker", "lag", *r6("corr"))


@query(sql("items", "SELECT item, list_sort(list_filter(list_distinct(list_concat(regexp_extract_all(regexp_replace(text, '[^\\P{L}A-Za-z]', 'x', 'g'), '\\$([A-Z]{1,5})\\b', 1), regexp_extract_all(regexp_replace(text, '[^\\P{L}A-Za-z]', 'x', 'g'), '\\b([A-Z]{2,5})\\b', 1))), lambda t: len(t) >= 2 AND NOT list_contains([" + ", ".join(f"'{t}'" for t in text.NOT_TICKERS) + "], t))) AS tickers FROM items"))
def f13_tickers(spark, sf_dir):
    """Distinct sorted tickers of a text."""
    return v.items(spark, sf_dir).select("item", text.tickers(F.col("text")).alias("tickers"))


@query(sql("items", f"WITH {TAGGED} SELECT item, round(s / sqrt(s * s + 15), 6) AS compound, round(CASE WHEN n > 0 THEN p / n ELSE 0 END, 6) AS pos, round(CASE WHEN n > 0 THEN m / n ELSE 0 END, 6) AS neg FROM sc"))
def x1_lexicon_sentiment(spark, sf_dir):
    """Sentiment by a lexicon of the user."""
    return tagged(spark, sf_dir).where(F.col("text").rlike("[A-Za-z']")).select("item", *r6("compound", "pos", "neg"))


DAILY = TAGGED + """,
 tg AS (SELECT item, day AS date, list_sort(list_filter(list_distinct(list_concat(regexp_extract_all(regexp_replace(text, '[^\\P{L}A-Za-z]', 'x', 'g'), '\\$([A-Z]{1,5})\\b', 1), regexp_extract_all(regexp_replace(text, '[^\\P{L}A-Za-z]', 'x', 'g'), '\\b([A-Z]{2,5})\\b', 1))), lambda t: len(t) >= 2 AND NOT list_contains([""" + ", ".join(f"'{t}'" for t in text.NOT_TICKERS) + """], t))) AS tickers, round(coalesce(s, 0.0) / sqrt(coalesce(s, 0.0) * coalesce(s, 0.0) + 15), 9) AS sentiment FROM items LEFT JOIN sc USING (item)),
 ds AS (SELECT date, ticker, avg(sentiment) AS sentiment, count(*) AS mentions FROM (SELECT date, sentiment, unnest(CASE WHEN len(tickers) = 0 THEN ['_MARKET_'] ELSE tickers END) AS ticker FROM tg) GROUP BY 1, 2)"""


@query(sql("items", f"WITH {DAILY} SELECT date, ticker, round(sentiment, 6) AS sentiment, mentions FROM ds"))
def a1_daily_sentiment(spark, sf_dir):
    """A1: daily sentiment and mentions per ticker; items without one count for the market."""
    return panel.daily_sentiment(tagged(spark, sf_dir)).select("date", "ticker", *r6("sentiment"), "mentions")


@query(sql("items", f"WITH {DAILY} SELECT date, round(avg(sentiment), 6) AS sentiment FROM tg GROUP BY 1"))
def a2_market_sentiment(spark, sf_dir):
    """A2: daily mean over all items."""
    return market_sentiment(tagged(spark, sf_dir))


def market_sentiment(items):
    return items.groupBy(F.col("day").alias("date")).agg(F.round(F.avg("sentiment"), 6).alias("sentiment"))


@query(sql("items", f"""WITH {DAILY}, g AS (SELECT d.date, t.ticker, coalesce(mentions, 0) AS mentions FROM (SELECT DISTINCT date FROM ds) d CROSS JOIN (SELECT DISTINCT ticker FROM ds) t LEFT JOIN ds USING (date, ticker)),
 z AS (SELECT *, CASE WHEN count(*) OVER w = 14 AND stddev_samp(mentions) OVER w > 0 THEN (mentions - avg(mentions) OVER w) / stddev_samp(mentions) OVER w END AS z FROM g WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING))
SELECT ticker, round(z, 5) AS mention_z FROM z WHERE date = (SELECT max(date) FROM g) AND z >= 2"""))
def w8_mention_spikes(spark, sf_dir):
    """Tickers mentioned far more than lately."""
    return mention_spikes(tagged(spark, sf_dir))


def mention_spikes(items):
    return panel.mention_spikes(panel.daily_sentiment(items)).select("ticker", F.round("mention_z", 5).alias("mention_z"))


@query(sql("panel items", f"""WITH {RET}, {DAILY}, mk AS (SELECT date, avg(sentiment) AS sentiment FROM tg GROUP BY 1),
 pd AS (SELECT DATE '2024-01-01' + CAST((date - (SELECT min(date) FROM panel)) // 7 AS INTEGER) AS date, ticker, ret FROM r)
SELECT date, ticker, round(ret, 6) AS ret, round(coalesce(sentiment, 0.0), 6) AS sentiment FROM pd LEFT JOIN mk USING (date)"""))
def j8_sentiment_on_panel(spark, sf_dir):
    """Market sentiment on panel dates, 0 where there is none (panel weeks as days)."""
    r = returns(spark, sf_dir)
    first = F.broadcast(r.agg(F.min("date").alias("first")))
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (F.datediff("date", "first") / 7).cast("int"))
    moved = r.join(first).select(day.alias("date"), "ticker", "ret")
    market = tagged(spark, sf_dir).groupBy(F.col("day").alias("date")).agg(F.avg("sentiment").alias("sentiment"))
    return moved.join(market, "date", "left").select("date", "ticker", *r6("ret"), F.round(F.coalesce("sentiment", F.lit(0.0)), 6).alias("sentiment"))


@query(sql("panel items", f"""WITH {RET}, {DAILY}, pd AS (SELECT DATE '2024-01-01' + CAST((date - (SELECT min(date) FROM panel)) // 7 AS INTEGER) AS date, ticker AS brand, ret FROM r),
 one AS (SELECT date, avg(ret) AS ret FROM pd GROUP BY 1)
SELECT date, ticker, round(sentiment, 6) AS sentiment, mentions, round(ret, 6) AS ret FROM ds JOIN one USING (date) WHERE ret IS NOT NULL"""))
def j7_sentiment_returns(spark, sf_dir):
    """Daily sentiment with returns of the same date."""
    r = returns(spark, sf_dir)
    first = F.broadcast(r.agg(F.min("date").alias("first")))
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (F.datediff("date", "first") / 7).cast("int"))
    one = r.join(first).groupBy(day.alias("date")).agg(F.avg("ret").alias("ret")).where("ret is not null")
    return panel.daily_sentiment(tagged(spark, sf_dir)).join(one, "date").select("date", "ticker", *r6("sentiment"), "mentions", *r6("ret"))


@query(sql("items", "SELECT item, source, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY item) AS nth FROM items WHERE url <> '') WHERE nth = 1"))
def u3_first_by_url(spark, sf_dir):
    """The first item of each address."""
    rows = v.items(spark, sf_dir).where("url <> ''")
    return rows.withColumn("nth", F.row_number().over(by("url", "item"))).where("nth = 1").select("item", "source", "url")


@query(sql("items", "SELECT item, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY item) AS nth FROM items) WHERE nth <= 10"))
def t4_per_source(spark, sf_dir):
    """T4: the first ten items per source (the limit is the feature)."""
    return v.items(spark, sf_dir).withColumn("nth", F.row_number().over(by("source", "item"))).where("nth <= 10").select("item", "source")


BARS = """WITH b AS (SELECT inst, ms, seq, ask_px AS close, ask_px + bid_sz % 3 AS high, bid_px AS low, bid_sz AS volume FROM ticks),
 l AS (SELECT *, ln(greatest(close, 1e-9)) AS lp FROM b), r AS (SELECT *, lp - lag(lp) OVER w AS r1, lp - lag(lp, 5) OVER w AS r5, lp - lag(lp, 15) OVER w AS r15 FROM l WINDOW w AS (PARTITION BY inst ORDER BY ms, seq)),
 f AS (SELECT *, CASE WHEN count(r1) OVER a >= 15 THEN stddev_samp(r1) OVER a END AS rvol15, CASE WHEN count(volume) OVER c >= 30 THEN (volume - avg(volume) OVER c) / (stddev_samp(volume) OVER c + 1e-9) END AS vol_z,
   (high - low) / greatest(close, 1e-9) AS range, CASE WHEN count(r1) OVER d >= 5 THEN sum(r1) OVER d END AS mom, CAST(ms // 60000 % 390 AS INTEGER) AS minute, lead(r1) OVER w AS ahead FROM r
   WINDOW w AS (PARTITION BY inst ORDER BY ms, seq), a AS (PARTITION BY inst ORDER BY ms, seq ROWS 14 PRECEDING), c AS (PARTITION BY inst ORDER BY ms, seq ROWS 29 PRECEDING), d AS (PARTITION BY inst ORDER BY ms, seq ROWS 4 PRECEDING))"""


def bars(spark, sf_dir):
    t = v.ticks(spark, sf_dir)
    return t.select("inst", "ms", "seq", F.col("ask_px").alias("close"), (F.col("ask_px") + F.col("bid_sz") % 3).alias("high"), F.col("bid_px").alias("low"), F.col("bid_sz").alias("volume"))


@query(sql("ticks", f"{BARS} SELECT inst, seq, round(r1, 6) AS r1, round(r5, 6) AS r5, round(r15, 6) AS r15, round(rvol15, 6) AS rvol15, round(vol_z, 5) AS vol_z, round(range, 6) AS range, minute, CASE WHEN ahead IS NOT NULL THEN CAST(ahead > 0 AS INTEGER) END AS y FROM f"))
def w14_probe_features(spark, sf_dir):
    """Bar features and the sign of the next return."""
    return panel.probe_features(bars(spark, sf_dir), "inst").select("inst", "seq", *r6("r1", "r5", "r15", "rvol15"), F.round("vol_z", 5).alias("vol_z"), *r6("range"), "minute", "y")


@query(sql("ticks", f"""{BARS}, k AS (SELECT *, CASE WHEN ahead > 0 THEN 1 ELSE 0 END AS y, CAST(seq % 2 AS INTEGER) AS pred, CASE WHEN mom > 1e-12 THEN 1 ELSE 0 END AS momentum FROM f WHERE ahead IS NOT NULL AND mom IS NOT NULL),
 a AS (SELECT avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END) AS accuracy, avg(y) AS always_up, avg(CASE WHEN y = momentum THEN 1.0 ELSE 0.0 END) AS momentum_accuracy, count(*) AS n FROM k)
SELECT round(accuracy, 6) AS accuracy, round(always_up, 6) AS always_up, round(momentum_accuracy, 6) AS momentum_accuracy, n, round((accuracy - 0.5) / sqrt(0.25::DOUBLE / n), 6) AS z, round(greatest(always_up, 1 - always_up), 6) AS base_rate,
 CASE WHEN accuracy >= 0.53 THEN 'signal' WHEN accuracy >= 0.51 THEN 'weak' ELSE 'none' END AS verdict FROM a"""))
def a27_verdict(spark, sf_dir):
    """A probe's accuracy against a coin and baselines."""
    rows = panel.probe_features(bars(spark, sf_dir), "inst")
    rows = rows.withColumns({"pred": (F.col("seq") % 2).cast("int"), "momentum": F.when(F.col("mom_sum") > 1e-12, 1).otherwise(0)}).where("y is not null and mom_sign is not null")
    return quality.probe_verdict(rows).select(*r6("accuracy", "always_up", "momentum_accuracy"), "n", *r6("z", "base_rate"), "verdict")


@query()
def x8_directional_probe(spark, sf_dir):
    """A boosted-tree probe trained before a time and scored after it."""
    return models.directional_probe(probe_rows(spark, sf_dir), PROBE).select("inst", "seq", "y", "pred")


PROBE = ["r1", "r5", "r15", "rvol15", "vol_z", "range", "minute"]


def probe_rows(spark, sf_dir):
    return written(corpus.time_split(panel.probe_features(bars(spark, sf_dir), "inst")))


@query()
def t5_importances(spark, sf_dir):
    """T5: the most important features of the probe."""
    return models.importances(models.fit_probe(probe_rows(spark, sf_dir), PROBE), PROBE, spark, 5)


@query()
def x5_clusters(spark, sf_dir):
    """Tickers by co-movement."""
    return models.cluster_tickers(kept_returns(spark, sf_dir))


@query(sql("panel", f"""WITH {RET}, s AS (SELECT date, ticker, ret, ret * 10 AS score FROM r WHERE ret IS NOT NULL),
 w AS (SELECT *, exp(score - max(score) OVER (PARTITION BY date)) / sum(exp(score)) OVER (PARTITION BY date) * exp(max(score) OVER (PARTITION BY date)) AS weight, count(*) OVER (PARTITION BY date) AS n FROM s),
 o AS (SELECT *, coalesce(lag(weight) OVER (PARTITION BY ticker ORDER BY date), 1.0::DOUBLE / n) AS old FROM w),
 d AS (SELECT date, sum(abs(weight - old)) AS turnover, sum(weight * ret) AS gross FROM o GROUP BY 1)
SELECT date, round(turnover, 5) AS turnover, round(gross, 5) AS gross, round(ln(1 + gross) - 0.001 * turnover - 0.1 * coalesce(stddev_pop(gross) OVER (ORDER BY date ROWS 20 PRECEDING), 0), 5) AS reward FROM d"""))
def w32_portfolio_path(spark, sf_dir):
    """Softmax weights, turnover and reward per date."""
    rows = returns(spark, sf_dir).where("ret is not null").select("date", "ticker", "ret", (F.col("ret") * 10).alias("score"))
    return panel.portfolio_path(rows).select("date", *[F.round(c, 5).alias(c) for c in ("turnover", "gross", "reward")])

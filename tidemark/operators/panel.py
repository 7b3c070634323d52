"""Price panels (date, ticker, close) and daily sentiment of items."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .bins import SENT_ROWS
from .windows import before, by, if_enough, in_blocks

MARKET = "_MARKET_"
#: Tickers of a block, about.
TICKERS = 256


def correlation(x: str, y: str, over: Callable[[Column], Column] = lambda c: c) -> Column:
    """Correlation over rows that have both values (in a frame with ``over``), null where one of them does not vary."""
    with_other = lambda a, b: F.when(F.col(b).isNotNull(), F.col(a))
    spread = over(F.stddev_pop(with_other(x, y))) * over(F.stddev_pop(with_other(y, x)))
    return F.try_divide(over(F.covar_pop(x, y)), spread)


def panel_returns(panel: DataFrame, vol_window: int = 21) -> DataFrame:
    """Panel with prices filled forward, log return, its rolling deviation and its percentile rank per date."""
    w = by("ticker", "date")
    rows = panel.withColumn("close", F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("ret", F.log(F.col("close") / F.lag("close").over(w)))
    frame = before(vol_window, "ticker", "date")
    rows = rows.withColumn("vol", if_enough(F.stddev_samp("ret").over(frame), F.count("ret").over(frame), vol_window))
    return rows.withColumn("pct_rank", F.when(F.col("ret").isNotNull(), percentile_rank("date", "ret")))


def percentile_rank(group: str, value: str) -> Column:
    """Rank over count inside the group, ties by their average; rows with nulls are not counted."""
    own = Window.partitionBy(group, F.col(value).isNull())
    ties = F.count("*").over(Window.partitionBy(group, value))
    return (F.rank().over(own.orderBy(value)) + (ties - 1) / 2.0) / F.count("*").over(own)


def rolling_z(rows: DataFrame, key: str, order: str, value: str, window: int, name: str) -> DataFrame:
    """Z-score of a value in its trailing window, null before the window is full or without spread."""
    frame = before(window, key, order)
    sd = F.stddev_samp(value).over(frame)
    z = F.when(sd > 0, (F.col(value) - F.avg(value).over(frame)) / sd)
    return rows.withColumn(name, if_enough(z, F.count(value).over(frame), window))


def top_anomalies(returns: DataFrame, window: int = 63, n: int = 15) -> DataFrame:
    z = rolling_z(returns, "ticker", "date", "ret", window, "z")
    latest = z.agg(F.max("date").alias("date"))
    return z.join(F.broadcast(latest), "date").where("z is not null").orderBy(F.abs("z").desc(), "ticker").limit(n).select("ticker", "ret", "z")


def correlated_pairs(returns: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs of tickers a < b whose returns correlate by at least ``least`` in size, over their common dates."""
    return _pairs(returns, least)


def correlation_matrix(returns: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per ticker ``a`` with its correlation to every ticker, 1 with itself; ``columns`` name the tickers across, else long rows (a, b, corr)."""
    pairs = written(_pairs(returns))
    own = returns.where("ret is not null").select(F.col("ticker").alias("a"), F.col("ticker").alias("b"), F.lit(1.0).alias("corr")).distinct()
    long = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")).unionByName(own)
    return long if columns is None else long.groupBy("a").pivot("b", columns).agg(F.first("corr"))


def _pairs(returns: DataFrame, least: float | None = None) -> DataFrame:
    """(a, b, corr) of tickers a < b with a common date; with ``least`` those that reach it in size.

    Tickers are dealt into blocks of about ``TICKERS``, and two blocks meet once: counts, sums and
    products over common dates are matrix products of values and masks of what is there, so there is no
    row per pair and date. Two blocks of which no pair can reach ``least`` do not meet (``_by_angle``).
    What leaves a block are results. A pair with one common date or without variance has a null.
    """
    rows = returns.where("ret is not null and ticker is not null").select("date", "ticker", F.col("ret").cast("double").alias("ret"))
    series = written(rows.groupBy("ticker").agg(F.collect_list("date").alias("dates"), F.collect_list("ret").alias("rets")))  # as long as the calendar
    blocks = max(1, -(-series.count() // TICKERS))
    if least is None or blocks == 1:
        block = F.pmod(F.xxhash64("ticker"), F.lit(blocks)).cast("int")
        met = series.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    else:
        met = _by_angle(rows, series, blocks, least)
    met = met.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")

    def gram(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ticker", ignore_index=True)
        days = np.unique(np.concatenate([np.asarray(d, "datetime64[D]") for d in rows["dates"]]))
        x, there = np.zeros((len(rows), len(days))), np.zeros((len(rows), len(days)))
        for k, (d, r) in enumerate(zip(rows["dates"], rows["rets"], strict=True)):
            at = np.searchsorted(days, np.asarray(d, "datetime64[D]"))
            x[k, at] = np.asarray(r) - np.mean(r)  # correlations don't change, products lose fewer digits
            there[k, at] = 1.0
        one, two = ((rows["block"] == rows[c][0]).to_numpy() for c in ("i", "j"))
        x1, m1, x2, m2 = x[one], there[one], x[two], there[two]
        n, sx, sy = m1 @ m2.T, x1 @ m2.T, m1 @ x2.T
        with np.errstate(invalid="ignore", divide="ignore"):
            vx, vy = n * ((x1 * x1) @ m2.T) - sx * sx, n * (m1 @ (x2 * x2).T) - sy * sy
            corr = np.where((n > 1) & (vx > 0) & (vy > 0), (n * (x1 @ x2.T) - sx * sy) / np.sqrt(vx * vy), np.nan)
        keep = n > 0 if least is None else np.abs(corr) >= least
        if rows["i"][0] == rows["j"][0]:
            keep &= np.triu(np.ones(keep.shape, bool), 1)
        a, b = np.nonzero(keep)
        names = rows["ticker"].to_numpy()
        left, right = names[one][a], names[two][b]
        turn = left > right
        return pd.DataFrame({"a": np.where(turn, right, left), "b": np.where(turn, left, right), "corr": pd.Series(corr[a, b]).astype("Float64").mask(np.isnan(corr[a, b]))})

    kind = returns.schema["ticker"].dataType.simpleString()
    return met.groupBy("i", "j").applyInPandas(gram, f"a {kind}, b {kind}, corr double")


def _by_angle(rows: DataFrame, series: DataFrame, blocks: int, least: float) -> DataFrame:
    """``series`` with its ``block`` and, a row for each, every ``other`` block a pair with which may reach ``least`` in size.

    Series on all dates are vectors whose correlations are cosines, so two of them are at least the
    difference of their angles to a third apart, and at most the sum. The third is the mean of those
    series. Blocks are ranges of that angle and meet where these bounds leave room. A series with dates
    missing has no such angle; its block meets all others.
    """
    n_dates = rows.agg(F.count_distinct("date").alias("n_dates"))
    whole = series.join(F.broadcast(n_dates)).where((F.size("dates") == F.col("n_dates")) & (F.size(F.array_distinct("dates")) == F.col("n_dates"))).select("ticker")  # one row of dates
    own = rows.join(whole, "ticker", "left_semi")
    angles = own.join(own.groupBy("date").agg(F.avg("ret").alias("mean")), "date").groupBy("ticker").agg(correlation("ret", "mean").alias("c"))
    spread = F.pmod(F.xxhash64("ticker"), F.lit(1 << 20)) / float(1 << 20)  # tells equal angles apart
    known = F.when(~F.isnan("c"), F.acos(F.greatest(F.least("c", F.lit(1.0)), F.lit(-1.0))))
    placed = series.join(angles.select("ticker", known.alias("angle")), "ticker", "left").withColumn("at", F.coalesce(F.col("angle") + spread * 1e-9, 4.0 + spread))
    placed = written(placed)
    marks = placed.agg(F.percentile_approx("at", [i / blocks for i in range(1, blocks)], 100 * blocks).alias("marks"))
    placed = placed.join(F.broadcast(marks)).withColumn("block", F.size(F.filter("marks", lambda m: m <= F.col("at"))))  # one row of marks
    ends = placed.groupBy("block").agg(F.min(F.coalesce("angle", F.lit(0.0))).alias("low"), F.max(F.coalesce("angle", F.lit(math.pi))).alias("high"))
    ends = ends.agg(F.collect_list(F.struct("block", "low", "high")).alias("ends"))  # a few numbers for each ``TICKERS`` tickers
    placed = placed.join(F.broadcast(ends)).withColumn("mine", F.filter("ends", lambda e: e["block"] == F.col("block"))[0])

    def reach(e: Column) -> Column:
        room = math.acos(min(1.0, max(0.0, least))) + 1e-6
        near = F.greatest(F.col("mine.low") - e["high"], e["low"] - F.col("mine.high"))
        least_sum, most_sum = F.col("mine.low") + e["low"], F.col("mine.high") + e["high"]
        far = F.when(most_sum < math.pi, most_sum).when(least_sum > math.pi, 2 * math.pi - least_sum).otherwise(math.pi)
        return (near <= room) | (far >= math.pi - room)

    other = F.explode(F.transform(F.filter("ends", reach), lambda e: e["block"]))
    return placed.select(*series.columns, "block", other.alias("other"))


def lead_lag(merged: DataFrame, x: str, y: str, most: int = 5, least: int = 10) -> DataFrame:
    """Per ticker the lag k in -most..most with the largest |corr(x[t], y[t+k])|; k > 0 if x leads. (0, 0) if none."""
    rows = merged.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("ticker", F.row_number().over(by("ticker", "date")).alias("rn"), F.col(x).alias("x"), F.col(y).alias("y"))
    shifted = rows.select("ticker", "y", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("k"), "rn").select("ticker", "k", (F.col("rn") - F.col("k")).alias("rn"), "y")
    lags = rows.select("ticker", "rn", "x").join(shifted, ["ticker", "rn"]).groupBy("ticker", "k").agg(correlation("x", "y").alias("c"), F.count("*").alias("n"))
    best = lags.where((F.col("n") >= least) & F.col("c").isNotNull() & ~F.isnan("c") & (F.abs("c") > 0))
    first = best.withColumn("nth", F.row_number().over(by("ticker", F.abs(F.round("c", 12)).desc(), "k"))).where("nth = 1")
    every = rows.select("ticker").distinct().join(first.select("ticker", F.col("k").alias("lag"), F.col("c").alias("corr")), "ticker", "left")
    return every.select("ticker", F.coalesce("lag", F.lit(0)).alias("lag"), F.coalesce("corr", F.lit(0.0)).alias("corr"))


def daily_sentiment(items: DataFrame) -> DataFrame:
    """(date, ticker) mean sentiment and mentions of items (day, tickers, sentiment); no ticker counts for the market."""
    named = F.when(F.size("tickers") == 0, F.array(F.lit(MARKET))).otherwise(F.col("tickers"))
    rows = items.where("sentiment is not null and day is not null").select(F.col("day").alias("date"), F.explode(named).alias("ticker"), "sentiment")
    return rows.groupBy("date", "ticker").agg(F.avg("sentiment").alias("sentiment"), F.count("*").alias("mentions"))


def lexicon_sentiment(items: DataFrame, lexicon: DataFrame, ident: str, text: str) -> DataFrame:
    """compound, pos, neu, neg of each text from the valences of its words; an empty text is neutral.

    The lexicon (word, valence) is a table of the user; up to ``SENT_ROWS`` words it is sent along, so that
    only sums of texts are shuffled and not their words.
    """
    if lexicon.count() <= SENT_ROWS:
        lexicon = F.broadcast(lexicon)
    words = items.select(ident, F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z']+"), F.lit(0))).alias("word"))
    scored = words.join(lexicon, "word", "left").groupBy(ident).agg(
        F.coalesce(F.sum("valence"), F.lit(0.0)).alias("s"), F.count("*").alias("n"),
        F.count(F.when(F.col("valence") > 0, 1)).alias("p"), F.count(F.when(F.col("valence") < 0, 1)).alias("m"),
    )
    out = items.join(scored, ident, "left")
    s, n = F.coalesce("s", F.lit(0.0)), F.coalesce("n", F.lit(0))
    share = lambda c: F.when(n > 0, F.col(c) / n).otherwise(0.0)
    return out.withColumns({"compound": s / F.sqrt(s * s + 15.0), "pos": share("p"), "neg": share("m")}).withColumn("neu", 1.0 - F.col("pos") - F.col("neg")).drop("s", "n", "p", "m")


def mention_spikes(daily: DataFrame, window: int = 14, least: float = 2.0) -> DataFrame:
    """Tickers whose mentions on the last date stand ``least`` deviations over their trailing mean; absent days count 0."""
    daily = written(daily)  # read three times, and a row a day and ticker only
    # a calendar of days, small by nature, is one array that each ticker lays open
    calendar = daily.agg(F.collect_set("date").alias("days"))
    dense = daily.select("ticker").distinct().join(F.broadcast(calendar)).select("ticker", F.explode("days").alias("date"))
    dense = dense.join(daily.select("date", "ticker", "mentions"), ["date", "ticker"], "left").fillna(0, ["mentions"])
    z = rolling_z(dense, "ticker", "date", "mentions", window, "mention_z")
    return z.join(F.broadcast(daily.agg(F.max("date").alias("date"))), "date").where(F.col("mention_z") >= least).select("ticker", "mention_z")


def rolling_corr(rows: DataFrame, key: str, order: str, x: str, y: str, window: int = 21) -> DataFrame:
    """Correlation in the trailing window, null before it is full or where a value does not vary in it."""
    frame = before(window, key, order)
    return rows.withColumn("rolling_corr", if_enough(correlation(x, y, lambda c: c.over(frame)), F.count(F.col(x) + F.col(y)).over(frame), window))


def probe_features(bars: DataFrame, key: str) -> DataFrame:
    """Features of a bar from what is known at it, and y = whether the next return is positive (null at the end)."""
    return in_blocks(bars, key, "ms", "seq", _probe_features, back=31, ahead=1)


def _probe_features(bars: DataFrame, w) -> DataFrame:
    price = F.log(F.greatest(F.col("close"), F.lit(1e-9)))
    rows = bars.withColumn("lp", price).withColumn("r1", F.col("lp") - F.lag("lp").over(w))
    f5, f15, f30 = (w.rowsBetween(-(n - 1), 0) for n in (5, 15, 30))
    full = lambda c, f, n, of: if_enough(c, F.count(of).over(f), n)
    ahead = F.lead("r1").over(w)
    return rows.withColumns(
        {
            "r5": F.col("lp") - F.lag("lp", 5).over(w), "r15": F.col("lp") - F.lag("lp", 15).over(w),
            "rvol15": full(F.stddev_samp("r1").over(f15), f15, 15, "r1"),
            "vol_z": full((F.col("volume") - F.avg("volume").over(f30)) / (F.stddev_samp("volume").over(f30) + 1e-9), f30, 30, "volume"),
            "range": (F.col("high") - F.col("low")) / F.greatest(F.col("close"), F.lit(1e-9)),
            "mom_sum": F.sum("r1").over(f5), "mom_sign": full(F.signum(F.sum("r1").over(f5)), f5, 5, "r1"),
            "minute": F.expr("cast((ms div 60000L) % 390 as int)"),
            "y": F.when(ahead.isNotNull(), (ahead > 0).cast("int")),
        }
    ).drop("lp")


def portfolio_path(scores: DataFrame, cost: float = 1e-3, risk: float = 0.1, window: int = 21) -> DataFrame:
    """Per date: softmax weights' turnover against the date before (the first against equal weights) and reward."""
    per_date = Window.partitionBy("date")
    e = F.exp(F.col("score") - F.max("score").over(per_date))
    rows = scores.withColumn("weight", e / F.sum(e).over(per_date)).withColumn("n", F.count("*").over(per_date))
    rows = rows.withColumn("old", F.coalesce(F.lag("weight").over(by("ticker", "date")), 1.0 / F.col("n")))
    days = rows.groupBy("date").agg(F.sum(F.abs(F.col("weight") - F.col("old"))).alias("turnover"), F.sum(F.col("weight") * F.col("ret")).alias("gross"))
    frame = Window.orderBy("date").rowsBetween(-(window - 1), 0)  # one row per date
    days = days.withColumn("net", F.log1p("gross") - cost * F.col("turnover"))
    return days.withColumn("reward", F.col("net") - risk * F.coalesce(F.stddev_pop("gross").over(frame), F.lit(0.0)))

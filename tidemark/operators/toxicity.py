"""Flow toxicity and volatility of trade streams, and calibration of quoting parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.market import normal_cdf
from ..sources.shared import written
from .windows import BLOCK_ROWS, asof, if_enough, in_blocks, last_known, previous, running_sum


def volume_classes(trades: DataFrame, key: str, window: int = 50) -> DataFrame:
    """p_buy, buy_v and sell_v by bulk volume classification.

    p_buy = Phi(price change / rolling deviation). A rolling deviation that is missing or 0 is taken
    from the next row that has one, else from the whole key.
    """

    def deviations(rows: DataFrame, w) -> DataFrame:
        rows = rows.withColumn("dp", F.coalesce(F.col("last_px") - F.lag("last_px").over(w), F.lit(0.0)).cast("double"))
        frame = w.rowsBetween(-(window - 1), 0)
        sd = if_enough(F.stddev_samp("dp").over(frame), F.count("dp").over(frame), window)
        return rows.withColumn("sd", F.when(sd > 0, sd))

    rows = written(in_blocks(trades, key, "ms", "seq", deviations, back=window))  # read three times
    whole = rows.groupBy(key).agg(F.stddev_samp("dp").alias("all_sd"))
    rows = last_known(rows, key, "ms", "seq", "sd", "next_sd", backward=True).join(whole, key)
    sigma = F.coalesce("next_sd", F.when(F.col("all_sd") > 0, F.col("all_sd")), F.lit(1e-9))
    rows = rows.withColumn("p_buy", normal_cdf(F.col("dp") / sigma))
    return rows.withColumns({"buy_v": F.col("last_sz") * F.col("p_buy"), "sell_v": F.col("last_sz") * (1 - F.col("p_buy"))}).drop("sd", "next_sd", "all_sd")


def volume_buckets(classed: DataFrame, key: str, bucket_size: float | None = None) -> DataFrame:
    """Append ``bucket``, the number of full buckets of cumulative volume; by default 20 trades' volume each."""
    classed = written(classed)  # read three times
    rows = running_sum(classed, key, "ms", "seq", "last_sz", "cum_v")
    if bucket_size is None:
        sizes = classed.groupBy(key).agg((F.sum("last_sz") / F.greatest(F.count("*") / 20.0, F.lit(1.0))).alias("bucket_size"))
        rows = rows.join(sizes, key)
    else:
        rows = rows.withColumn("bucket_size", F.lit(float(bucket_size)))
    return rows.withColumn("bucket", F.floor(F.col("cum_v") / F.col("bucket_size")).cast("long"))


def bucket_imbalance(rows: DataFrame, key: str) -> DataFrame:
    sums = rows.groupBy(key, "bucket").agg(F.sum("buy_v").alias("buy_v"), F.sum("sell_v").alias("sell_v"))
    total = F.col("buy_v") + F.col("sell_v")
    return sums.withColumn("imbalance", F.when(total != 0, F.abs(F.col("buy_v") - F.col("sell_v")) / total))


def vpin(trades: DataFrame, key: str, bucket_size: float | None = None, window: int = 50) -> DataFrame:
    """Trades with ``vpin``: the mean imbalance of the last ``window`` volume buckets."""
    rows = written(volume_buckets(volume_classes(trades, key), key, bucket_size))
    mean = lambda b, w: b.withColumn("vpin", F.avg("imbalance").over(w.rowsBetween(-(window - 1), 0)))
    means = in_blocks(bucket_imbalance(rows, key), key, "bucket", "bucket", mean, back=window, chunk_ms=BLOCK_ROWS)
    return rows.join(means.select(key, "bucket", "vpin"), [key, "bucket"]).withColumn("vpin", F.coalesce("vpin", F.lit(0.0)))


def kyle_lambda(trades: DataFrame, key: str, window: int = 200, least: int = 10) -> DataFrame:
    """Rolling price impact per unit of signed volume; missing values take the last one, then 0."""
    rows = trades.withColumn("known_side", F.when(F.col("last_side") != 0, F.col("last_side")))
    rows = last_known(rows, key, "ms", "seq", "known_side", "side")
    rows = rows.withColumn("sv", (F.col("last_sz") * F.coalesce("side", F.lit(0))).cast("double"))

    def impact(rows: DataFrame, w) -> DataFrame:
        frame = w.rowsBetween(-(window - 1), 0)
        rows = rows.withColumn("dp", F.abs((F.col("last_px") - F.lag("last_px").over(w)).cast("double")))
        num = if_enough(F.sum(F.col("dp") * F.abs("sv")).over(frame), F.count("dp").over(frame), least)
        den = if_enough(F.sum(F.col("sv") * F.col("sv")).over(frame), F.count("sv").over(frame), least)
        return rows.withColumn("raw", F.when(den != 0, num / den))

    rows = last_known(written(in_blocks(rows, key, "ms", "seq", impact, back=window)), key, "ms", "seq", "raw", "kyle_lambda")
    return rows.withColumn("kyle_lambda", F.coalesce("kyle_lambda", F.lit(0.0))).drop("raw", "sv", "dp", "side", "known_side")


def volatility(tob: DataFrame, key: str, rv_window: int = 100, vr_window: int = 200, q: int = 4) -> DataFrame:
    """rv (sum of squared log returns, 5 at least) and vr (variance ratio at lag q, 10 at least)."""

    def measures(rows: DataFrame, w) -> DataFrame:
        rows = rows.withColumns({"r1": F.log(F.col("mid") / F.lag("mid").over(w)), "rq": F.log(F.col("mid") / F.lag("mid", q).over(w))})
        a, b = w.rowsBetween(-(rv_window - 1), 0), w.rowsBetween(-(vr_window - 1), 0)
        v1 = if_enough(F.var_samp("r1").over(b), F.count("r1").over(b), 10)
        vq = if_enough(F.var_samp("rq").over(b), F.count("rq").over(b), 10)
        return rows.withColumns({"rv": if_enough(F.sum(F.col("r1") * F.col("r1")).over(a), F.count("r1").over(a), 5), "vr": F.when(v1 > 0, vq / (q * v1))}).drop("r1", "rq")

    return in_blocks(tob, key, "ms", "seq", measures, back=max(rv_window, vr_window) + q)


def calibrate(tob: DataFrame, trades: DataFrame, key: str, default_kappa: float = 500.0) -> DataFrame:
    """Per key: tick, sigma (price units a step) and kappa (decay of buy prints with distance from the ask)."""
    spread = F.col("ask_px") - F.col("bid_px")
    r = F.log(F.col("mid") / F.col("prev_mid"))
    base = previous(tob, key, "ms", "seq", ["mid"]).withColumns({"r": r, "spread": spread}).groupBy(key).agg(
        F.min(F.when(F.col("spread") > 0, F.col("spread").cast("double"))).alias("least"),
        F.stddev_samp("r").alias("sd"), F.max_by("mid", F.struct("ms", "seq")).alias("last_mid"),
    )
    tick = F.coalesce(F.pow(F.lit(10.0), F.floor(F.log10("least"))), F.lit(0.01))
    base = base.select(key, tick.alias("tick"), (F.col("sd") * F.col("last_mid")).alias("sigma"))
    buys = asof(trades.where("last_side = 1"), tob.select(key, "ms", "seq", F.col("ask_px").alias("ask_then")), key, "ms", ["ask_then"])
    first = tob.groupBy(key).agg(F.min_by("ask_px", F.struct("ms", "seq")).alias("first_ask"))
    buys = buys.join(first, key).join(base.select(key, "tick"), key)
    away = F.bround((F.col("last_px") - F.coalesce("ask_then", "first_ask")) / F.col("tick"))
    buys = buys.withColumn("away", F.greatest(F.lit(0.0), F.least(F.lit(20.0), away.cast("double"))))
    counts = buys.groupBy(key, "away").agg(F.count("*").alias("n"), F.max("tick").alias("tick"))
    total = counts.groupBy(key).agg(F.sum("n").alias("buys"))
    fit = counts.where("n >= 3").groupBy(key).agg(F.count("*").alias("bins"), F.regr_slope(F.log("n"), F.col("away") * F.col("tick")).alias("slope"))
    out = base.join(total, key, "left").join(fit, key, "left")
    k = -F.col("slope")
    good = (F.col("buys") >= 10) & (F.col("bins") >= 2) & (k > 0) & (k <= 1e6)
    sigma = F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(F.col("tick") * 0.5)
    return out.select(key, "tick", sigma.alias("sigma"), F.when(good, k).otherwise(F.lit(default_kappa)).alias("kappa"))

"""Training windows from token tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.market import close_weight
from ..sources.shared import written
from .bins import exact_quantiles
from .windows import in_blocks, previous, running_sum


def history_windows(tokens: DataFrame, key: str, rows: int = 16) -> DataFrame:
    """Features: tokens of the ``rows`` rows before, flattened; rows without a full history are left out."""

    def histories(out: DataFrame, w) -> DataFrame:
        w = w.rowsBetween(-rows, -1)
        return out.withColumn("history", F.flatten(F.collect_list("tokens").over(w))).withColumn("_n", F.count("*").over(w))

    return in_blocks(tokens, key, "ms", "seq", histories, back=rows).where(F.col("_n") == rows).drop("_n")


def sliding_windows(rows: DataFrame, key: str, value: str, length: int) -> DataFrame:
    """All runs of ``length`` values per key but the last, T - length of them, by their start."""
    runs = lambda out, w: out.withColumns({"window": F.collect_list(value).over(w.rowsBetween(0, length - 1)), "start": F.col("_pos")})
    out = in_blocks(rows, key, "ms", "seq", runs, ahead=length).join(rows.groupBy(key).agg(F.count("*").alias("_n")), key)
    return out.where(F.col("start") < F.col("_n") - length).select(key, "start", "window")


def pack_contexts(tokens: DataFrame, key: str, context: int, features: int) -> DataFrame:
    """Contexts of context + 1 tokens with stride ``context`` over each key's tokens in time order.

    A token at a multiple of the stride ends one context and begins the next, so it is emitted
    twice; feature_offset is the feature that the first token belongs to.
    """
    size = F.size("tokens")
    tokens = running_sum(tokens.withColumn("_size", size), key, "ms", "seq", "_size", "_upto")
    upto = F.col("_upto")
    flat = tokens.withColumn("first", upto - size).select(key, "first", F.posexplode("tokens").alias("i", "token")).withColumn("pos", F.col("first") + F.col("i"))
    block = F.expr(f"pos div {context}L")
    own = F.when((F.col("pos") % context == 0) & (F.col("pos") > 0), F.array(block - 1, block)).otherwise(F.array(block))
    rows = flat.select(key, "pos", "token", F.explode(own).alias("block"))
    packed = rows.groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("p"))  # context + 1 at most
    packed = packed.where(F.size("p") == context + 1)
    return packed.select(key, "block", (F.col("block") * context % features).cast("int").alias("feature_offset"), F.transform("p", lambda x: x["token"]).alias("tokens"))


def quality_weights(rows: DataFrame, shard: str, proximity: float = 1.0, iv_rank: float = 0.5, activity: float = 1.0, move: float = 0.75) -> DataFrame:
    """Append ``weight``: closeness to the close, implied volatility, trade size and move size, summing to 1 per shard.

    Medians, deviations and maxima are one aggregate per shard, joined back.
    """
    moved = previous(rows, shard, "ms", "seq", ["mid"]).withColumn("_d", F.coalesce(F.abs(F.col("mid") - F.col("prev_mid")), F.lit(0.0)))
    medians = exact_quantiles(rows, [shard], [0.5], "iv").select(shard, F.col("q")[0].alias("_m"))
    stats = moved.groupBy(shard).agg(F.max("last_sz").alias("_x"), F.stddev_pop("_d").alias("_s")).join(medians, shard, "left")
    rows = moved.join(stats, shard)
    filled = rows.withColumn("_iv", F.coalesce("iv", "_m"))
    rows = filled.join(filled.groupBy(shard).agg(F.stddev_samp("_iv").alias("_sd")), shard)
    near = close_weight(F.expr("(ms div 60000L) % 1440"))
    z = (F.col("_iv") - F.col("_m")) / (F.col("_sd") + 1e-9)
    w = (1.0 + proximity * near) * (1.0 + iv_rank * F.greatest(F.lit(0.0), F.least(F.lit(3.0), z)))
    w = w * (1.0 + activity * F.log1p(F.coalesce(F.col("last_sz"), F.lit(0.0))) / F.log1p(F.col("_x") + 1.0))
    w = w * F.when(F.col("_s") > 0, 1.0 + move * F.least(F.lit(3.0), F.col("_d") / F.col("_s"))).otherwise(1.0)
    rows = rows.withColumn("_w", w)
    rows = rows.join(rows.groupBy(shard).agg(F.sum("_w").alias("_all")), shard)
    return rows.withColumn("weight", F.col("_w") / F.col("_all")).drop("_d", "_m", "_x", "_s", "_iv", "_sd", "_w", "_all", "prev_mid")


def weighted_order(rows: DataFrame, shard: str, key: str, seed: int = 0) -> DataFrame:
    """Append ``draw``: rows by it are a weighted draw without replacement (exponential keys from a hash)."""
    u = (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 52)) + 1).cast("double") / float((1 << 52) + 1)
    return rows.withColumn("draw", -F.log(u) / F.col("weight"))


def mass_concentration(weighted: DataFrame, shard: str, share: float = 0.1) -> DataFrame:
    """Per shard the weight in its heaviest ``share`` of rows: what lies over the last weight that counts, and as often that weight as rows are left."""
    rows = written(weighted.select(shard, "weight"))
    many = F.ceil(F.col("rows") * share)
    last = exact_quantiles(rows, [shard], [F.col("rows") - many], "weight").select(shard, F.col("q")[0].alias("_last"), many.alias("_many"))
    over = F.col("weight") > F.col("_last")
    sums = rows.join(last, shard).groupBy(shard, "_last", "_many").agg(F.sum(F.when(over, F.col("weight")).otherwise(0.0)).alias("_over"), F.count(F.when(over, 1)).alias("_n"))
    return sums.select(shard, (F.col("_over") + (F.col("_many") - F.col("_n")) * F.col("_last")).alias("top_mass"))


def pick_days(ticks: DataFrame, days: DataFrame) -> DataFrame:
    """Ticks of the picked days; ``days`` is a calendar, small by nature, and Spark decides whether to send it along."""
    return ticks.join(days.select("day"), "day", "left_semi")


def reusable_jobs(requests: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that an existing job covers (same dataset, schema, symbol set and days), and the others."""

    def keyed(df: DataFrame) -> DataFrame:
        symbols = F.array_join(F.array_sort(F.array_distinct(F.transform(F.split("symbols", ","), lambda s: F.trim(s)))), ",")
        return df.withColumns({"_symbols": symbols, "_start": F.substring("start", 1, 10), "_end": F.substring("end", 1, 10)})

    on = ["dataset", "schema", "_symbols", "_start", "_end"]
    r, j = keyed(requests), keyed(jobs).select(*on).distinct()
    drop = ["_symbols", "_start", "_end"]
    return r.join(j, on, "left_semi").drop(*drop), r.join(j, on, "left_anti").drop(*drop)


def shard_slices(rows: DataFrame, shard: str, world: int, seed: int = 0) -> DataFrame:
    """Append the rank that reads a shard; slices are disjoint."""
    return rows.withColumn("rank", F.pmod(F.xxhash64(F.col(shard), F.lit(seed)), F.lit(world)).cast("int"))


def time_split(rows: DataFrame, ms: str = "ms", share: float = 0.8) -> DataFrame:
    """split = train up to the ``share`` quantile of time, eval after."""
    cut = exact_quantiles(rows, [], [share], ms).first()["q"][0]
    return rows.withColumn("split", F.when(F.col(ms) <= F.lit(cut), "train").otherwise("eval"))


def trading_days(spark, start: str, end: str) -> DataFrame:
    """Weekdays in [start, end)."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.date_sub(F.to_date(F.lit(end)), 1))).alias("day"))
    return days.where(F.weekday("day") < 5)

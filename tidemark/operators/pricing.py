"""Evaluation grids and error reports of option values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid(spot: DataFrame, strikes: int, times: int, sigmas: list[float]) -> DataFrame:
    """Every combination of moneyness in [0.97, 1.03], hours in [0.5, 72] and volatility around spots."""
    k = F.explode(F.transform(F.sequence(F.lit(0), F.lit(strikes - 1)), lambda i: 0.97 + 0.06 * i / float(strikes - 1)))
    hours = F.explode(F.transform(F.sequence(F.lit(0), F.lit(times - 1)), lambda j: 0.5 + 71.5 * j / float(times - 1)))
    out = spot.select("s", k.alias("m")).select("s", (F.col("s") * F.col("m")).alias("k"), hours.alias("h"))
    return out.select("s", "k", (F.col("h") / 8760.0).alias("tau"), F.explode(F.array(*map(F.lit, sigmas))).alias("sigma"))


def normalised_errors(rows: DataFrame) -> DataFrame:
    """delta_err and gamma_err: absolute errors over the size of the value, at least 0.01 or 1 % of the largest gamma."""
    largest = rows.agg((0.01 * F.max(F.abs("gamma"))).alias("_least"))
    rows = rows.join(F.broadcast(largest))  # one row
    return rows.withColumns(
        {
            "delta_err": F.abs(F.col("delta_est") - F.col("delta")) / F.greatest(F.abs("delta"), F.lit(0.01)),
            "gamma_err": F.abs(F.col("gamma_est") - F.col("gamma")) / F.greatest(F.abs("gamma"), F.col("_least")),
        }
    ).drop("_least")


def error_summary(rows: DataFrame, names: list[str]) -> DataFrame:
    """Median, 95th percentile, largest and mean of finite errors."""
    parts = []
    for n in names:
        e = F.when(F.abs(f"{n}_err") < float("inf"), F.col(f"{n}_err"))
        q = F.percentile(e, F.array(F.lit(0.5), F.lit(0.95)))
        parts += [F.round(q[0], 6).alias(f"{n}_median"), F.round(q[1], 6).alias(f"{n}_p95"), F.round(F.max(e), 6).alias(f"{n}_max"), F.round(F.avg(e), 6).alias(f"{n}_mean")]
    return rows.agg(*parts)


def paired_gain(rows: DataFrame, key: str, gain: str) -> DataFrame:
    t = F.avg(gain) / (F.stddev_samp(gain) / F.sqrt(F.count("*")))
    return rows.groupBy(key).agg(F.round(F.avg(F.when(F.col(gain) > 0, 1.0).otherwise(0.0)), 6).alias("win_share"), F.round(F.avg(gain), 6).alias("mean_gain"), F.round(t, 6).alias("t"))

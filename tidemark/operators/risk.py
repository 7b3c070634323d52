"""Exposure, margin, gates and order limits per account or portfolio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.market import gamma_cap_scale
from .windows import DAY_MS, by, running_sum, trailing_sums

# Margin coefficients where a table has none.
DEFAULTS = {"k_gross": 0.05, "k_delta": 0.15, "k_vega": 1.2, "k_gamma": 0.001, "floor_dollars": 500.0, "tod_mult_power_hour": 1.2, "tod_mult_last_30": 1.5}


def exposures(positions: DataFrame, keys: list[str], multiplier: float = 100.0) -> DataFrame:
    """Gross, delta, vega and gamma dollars (absolute) per key."""
    q, s = F.abs("qty") * multiplier, F.col("spot")
    return positions.groupBy(*keys).agg(
        F.sum(q * s).alias("gross"), F.sum(q * F.abs("delta") * s).alias("delta_dollars"),
        F.sum(q * F.abs("vega")).alias("vega"), F.sum(q * F.abs("gamma") * s * s).alias("gamma_dollars"), F.max(F.abs("qty")).alias("max_qty"),
    )


def required_margin(exposed: DataFrame, regime: float = 1.0, k: dict[str, float] | None = None) -> DataFrame:
    """Append ``required``: weighted exposures, at least the floor. Columns k_* of the rows take the place of ``k``."""
    k = DEFAULTS | (k or {})
    of = lambda name: F.coalesce(F.col(name), F.lit(k[name])) if name in exposed.columns else F.lit(k[name])
    total = of("k_gross") * F.col("gross") + of("k_delta") * F.col("delta_dollars") + of("k_vega") * F.col("vega") + of("k_gamma") * F.col("gamma_dollars")
    return exposed.withColumn("required", F.greatest(F.lit(regime) * total, of("floor_dollars")))


def resolve_margin(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Coefficients of each row (underlying, bucket, regime, minute) by inheritance.

    ``table`` has underlying, bucket, regime (null: holds for all below) and coefficient columns. The
    most specific value wins, then the defaults; the last hour multiplies all but the floor. Several
    rows for one place in this order are an error, as no order says which of them holds.
    """
    names = [n for n in DEFAULTS if n in table.columns]
    twice = table.groupBy("underlying", "bucket", "regime").count().where("count > 1").first()
    if twice:
        raise ValueError(f"several rows of margin values for underlying {twice[0]}, bucket {twice[1]}, regime {twice[2]}")
    levels = [("underlying", "bucket", "regime"), ("underlying", "bucket"), ("underlying",), ()]
    out, found = rows, {n: [] for n in names}
    for i, level in enumerate(levels):
        others = {"underlying", "bucket", "regime"} - {*level}
        part = table.where(" and ".join([f"{c} is not null" for c in level] + [f"{c} is null" for c in sorted(others)]) or "true")
        part = part.select(*level, *[F.col(n).alias(f"_{n}{i}") for n in names])
        out = out.join(part, list(level), "left") if level else out.join(F.broadcast(part), how="left")  # one row of general values
        for n in names:
            found[n].append(F.col(f"_{n}{i}"))
    values = {n: F.coalesce(*found[n], F.lit(DEFAULTS[n])) if n in found else F.lit(DEFAULTS[n]) for n in DEFAULTS}
    tod = F.when(F.col("minute") >= 360, values["tod_mult_last_30"]).when(F.col("minute") >= 330, values["tod_mult_power_hour"]).otherwise(1.0)
    done = {n: values[n] * tod if n.startswith("k_") else values[n] for n in ("k_gross", "k_delta", "k_vega", "k_gamma", "floor_dollars")}
    return out.withColumns(done).drop(*[f"_{n}{i}" for n in names for i in range(len(levels))])


def pin_score(legs: DataFrame, keys: list[str], scale: float = 0.001, window: float = 120.0) -> DataFrame:
    """0..100 per key: interest-weighted nearness of strikes to spot, growing in the last ``window`` minutes."""
    width = F.greatest(F.col("spot") * scale, F.lit(1e-6))
    oi = F.greatest(F.col("open_interest").cast("double"), F.lit(0.0))
    near = F.sum(F.exp(-F.abs(F.col("strike") - F.col("spot")) / width) * oi)
    amp = 1.0 + (window - F.least(F.max("minutes_to_expiry"), F.lit(window))) / window
    total = F.sum(oi)
    score = F.when((F.max("minutes_to_expiry") > window) | (total <= 0), 0.0).otherwise(F.least(F.lit(100.0), 100.0 * near / total * amp))
    return legs.groupBy(*keys).agg(score.alias("pin_score"))


def gates(rows: DataFrame, caps: dict[str, float]) -> DataFrame:
    """Append failed (names of the gates that a portfolio fails) and ok.

    Rows have exposures, required, equity, minute, and optionally min_pin_dist and pin_score.
    """
    c = F.col
    tests: list[tuple[str, Column]] = [
        ("gross_cap", c("gross") > caps["gross_cap"]),
        ("delta_dollar_cap", c("delta_dollars") > caps["delta_dollar_cap"]),
        ("vega_cap", c("vega") > caps["vega_cap"]),
        ("gamma_dollar_cap_eod", c("gamma_dollars") > caps["gamma_dollar_cap"] * gamma_cap_scale(c("minute"))),
        ("per_symbol_cap", c("max_qty") > caps["per_symbol_cap"]),
        ("margin_buffer", c("required") > c("equity") * caps["equity_buffer_pct"]),
    ]
    if "min_pin_dist" in rows.columns:
        tests.append(("pin_dist", c("min_pin_dist") < caps["pin_dist_cap"]))
    if "pin_score" in rows.columns:
        tests.append(("pin_score_block", c("pin_score") > caps["pin_score_block"]))
    failed = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))
    return rows.withColumn("failed", failed).withColumn("ok", F.size("failed") == 0)


def can_place(positions: DataFrame, candidates: DataFrame, equity: DataFrame, key: str) -> DataFrame:
    """Per key whether equity covers the margin of its positions with the candidate added."""
    with_new = positions.unionByName(candidates)
    return required_margin(exposures(with_new, [key])).join(equity, key).select(key, "required", "equity", (F.col("equity") >= F.col("required")).alias("allowed"))


def order_rates(orders: DataFrame, key: str, notional_cap: float, rate_cap: int, minute_ms: int = 60_000, second_ms: int = 1_000) -> DataFrame:
    """Notional of the last minute and orders of the last second, own row included, against caps."""
    rows = trailing_sums(orders, key, "ms", {"notional_1m": (F.col("notional"), minute_ms), "orders_1s": (F.lit(1).cast("long"), second_ms)})
    return rows.withColumns({"velocity_ok": F.col("notional_1m") <= notional_cap, "rate_ok": F.col("orders_1s") <= rate_cap})


def budget_prefix(items: DataFrame, order: str, tie: str, cost: str, budget: float, key: str | None = None, chunk: int = DAY_MS) -> DataFrame:
    """Running cost in the order of the number ``order``, then ``tie``, and whether the item still fits; summed in chunks of ``order``."""
    name = key or "_all_items"
    rows = running_sum(items if key else items.withColumn(name, F.lit(0)), name, order, tie, cost, "running_cost", chunk)
    rows = rows.withColumn("status", F.when(F.col("running_cost") <= budget, "OK").otherwise("OVER"))
    return rows if key else rows.drop(name)


def l1_projection(weights: DataFrame, key: str, name: str, value: str, radius: float) -> DataFrame:
    """Weights projected onto the L1 ball of ``radius`` per key: sorted by size, the threshold shrinks all.

    A key's weights are one portfolio and are sorted together.
    """
    w = by(key, F.abs(value).desc(), name)
    rows = weights.withColumns({"_nth": F.row_number().over(w), "_sum": F.sum(F.abs(value)).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    whole = Window.partitionBy(key)
    theta = (F.col("_sum") - radius) / F.col("_nth")
    rows = rows.withColumn("_theta", F.max_by(theta, F.when(F.abs(value) > theta, F.col("_nth"))).over(whole)).withColumn("_norm", F.sum(F.abs(value)).over(whole))
    shrunk = F.signum(value) * F.greatest(F.abs(value) - F.col("_theta"), F.lit(0.0))
    return rows.withColumn("projected", F.when(F.col("_norm") <= radius, F.col(value)).otherwise(shrunk)).drop("_nth", "_sum", "_theta", "_norm")


def penny_closes(book: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Market orders that flatten positions whose quote has collapsed: longs with a tight spread, shorts with a low ask."""
    live = book.where((F.abs("qty") >= 1e-9) & (F.col("bid") > 0) & (F.col("ask") > 0))
    side = F.when((F.col("qty") > 0) & (F.col("ask") - F.col("bid") <= threshold), "sell").when((F.col("qty") < 0) & (F.col("ask") <= threshold), "buy")
    return live.withColumn("side", side).where("side is not null").withColumn("order_qty", F.abs("qty"))

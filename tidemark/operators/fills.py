"""Fills of quotes and orders by later market events, markouts and execution costs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from . import sweep
from .windows import asof, in_blocks


def by_second(path: DataFrame, trades: DataFrame, key: str, columns: list[str], ms: str = "ms") -> DataFrame:
    """Each row of ``path`` with the trades of its key in the same second, or with nulls if there are none."""
    second = F.expr(f"{ms} div 1000L")
    right = trades.select(key, second.alias("_second"), *[F.col(c).alias(f"t_{c}") for c in columns])
    return path.withColumn("_second", second).join(right, [key, "_second"], "left").drop("_second")


def fill_labels(quotes: DataFrame, trades: DataFrame, key: str, horizon_ms: int, our_size: float = 1.0, queue_aware: bool = True, ms: str = "ms", seq: str = "seq") -> DataFrame:
    """Quotes plus bid_fill, ask_fill and the latency of each fill in ms.

    A bid fills at the first trade at which sells at or under it have eaten the queue ahead and our
    size; an ask mirrors that. Without the queue the first crossing trade fills. Trades count from the
    quote's time on for ``horizon_ms``, in the order of (ms, seq). Quotes without a key or time don't fill.
    """
    added = [("bid_fill_lat_ms", -1, "bid", "bid_queue_ahead"), ("ask_fill_lat_ms", 1, "ask", "ask_queue_ahead")]

    def run(own: pa.Table, later: pa.Table) -> pa.Table:
        later = sweep.in_time(later, ms, seq)
        since = sweep.floats(own, ms)
        timed = np.flatnonzero(~np.isnan(since))
        for name, side, level, queue in added:
            mine = later.filter(pa.compute.equal(later["last_side"], side))
            mine = mine.filter(pa.compute.is_valid(mine["last_px"]))
            at = mine[ms].to_numpy()
            need = sweep.floats(own, queue) + our_size if queue_aware else np.zeros(own.num_rows)
            size = np.nan_to_num(sweep.floats(mine, "last_sz"))
            starts = since[timed].astype(np.int64)
            row = sweep.first_fills(at, -side * sweep.floats(mine, "last_px"), size, starts, -side * sweep.floats(own, level)[timed], need[timed], horizon_ms)
            latency, has = np.zeros(own.num_rows, np.int64), np.zeros(own.num_rows, bool)
            has[timed] = row >= 0
            latency[timed[row >= 0]] = at[row[row >= 0]] - starts[row >= 0]
            own = own.append_column(name, pa.array(latency, pa.int64(), mask=~has))
        return own

    schema = StructType([*quotes.schema.fields, *[StructField(name, LongType()) for name, *_ in added]])
    out = sweep.in_spans_of(quotes, trades.select(key, ms, seq, "last_px", "last_sz", "last_side"), key, horizon_ms, ms, run, schema)
    return out.withColumns({"bid_fill": F.col("bid_fill_lat_ms").isNotNull().cast("int"), "ask_fill": F.col("ask_fill_lat_ms").isNotNull().cast("int")})


def two_sided(labelled: DataFrame, fair: Column, tick: float, keep: list[str]) -> DataFrame:
    """One training row per side of a labelled quote; the drift is mirrored on the ask."""
    middle = (F.col("bid") + F.col("ask")) / 2.0
    rel = (F.col("ask") - F.col("bid")) / F.greatest(fair, F.lit(1e-9))

    def row(side: str, distance: Column, drift: Column, queue: str, label: str) -> Column:
        return F.struct(F.lit(side).alias("side"), (distance / tick).alias("distance_ticks"), rel.alias("rel_spread"), (fair - middle).alias("micro_dev"), drift.alias("predicted_return"), F.col(queue).alias("queue_ahead"), F.col(label).alias("label"))

    mu = F.col("mu")
    sides = F.array(row("bid", fair - F.col("bid"), mu, "bid_queue_ahead", "bid_fill"), row("ask", F.col("ask") - fair, -mu, "ask_queue_ahead", "ask_fill"))
    return labelled.select(*keep, F.explode(sides).alias("s")).select(*keep, "s.*")


def markout_rows(fills: DataFrame, tob: DataFrame, key: str, horizons: list[int]) -> DataFrame:
    """side * (mid ``h`` book rows after the fill - fill price), clipped to the key's last row."""
    end = tob.groupBy(key).agg(F.max_by("mid", F.struct("ms", "seq")).alias("end_mid"))
    leads = lambda rows, w: rows.withColumns({f"m_{h}": F.lead("mid", h).over(w) for h in horizons})
    book = in_blocks(tob, key, "ms", "seq", leads, ahead=max(horizons)).join(end, key)
    book = book.withColumns({f"m_{h}": F.coalesce(f"m_{h}", "end_mid") for h in horizons})
    at = asof(fills, book, key, "ms", [f"m_{h}" for h in horizons], forward=True)
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    return at.withColumns({f"mkout_{h}": sign * (F.col(f"m_{h}") - F.col("fill_px")) for h in horizons}).drop(*[f"m_{h}" for h in horizons])


def markouts(fills: DataFrame, key: str, horizons_ms: list[int]) -> DataFrame:
    """Each fill once a horizon, with horizon_ms and markout: the mid of the key's first fill at or after
    ts + horizon, minus the own mid; null if none. All horizons are probes of one pass."""
    probes = fills.withColumn("own_ms", F.col("ms")).withColumn("horizon_ms", F.explode(F.array(*map(F.lit, horizons_ms))))
    probes = probes.withColumn("ms", F.col("ms") + F.col("horizon_ms"))
    later = fills.select(key, "ms", "seq", F.col("mid_at_fill").alias("later_mid"))
    found = asof(probes, later, key, "ms", ["later_mid"], forward=True)
    return found.withColumn("markout", F.col("later_mid") - F.col("mid_at_fill")).withColumn("ms", F.col("own_ms")).drop("own_ms", "later_mid")


def markout_time(fills: DataFrame, key: str, horizons_ms: list[int]) -> DataFrame:
    """One row a fill (by key, ms and seq) with markout_h for every horizon."""
    others = [c for c in fills.columns if c not in (key, "ms", "seq")]
    at = lambda h: F.max(F.when(F.col("horizon_ms") == h, F.col("markout"))).alias(f"markout_{h}")
    out = markouts(fills, key, horizons_ms).groupBy(key, "ms", "seq").agg(F.first(F.struct(*others)).alias("own"), *[at(h) for h in horizons_ms])
    return out.select(key, "ms", "seq", "own.*", *[f"markout_{h}" for h in horizons_ms])


def post_trade(marked: DataFrame) -> DataFrame:
    """Per horizon of ``markouts``: mean signed markout, absolute spread and edge in bps, hit rate (a missing markout is a miss), n."""
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    base = F.when(F.col("mid_at_fill") != 0, F.col("mid_at_fill"))
    signed, spread = sign * F.col("markout") / base * 1e4, F.abs(F.col("spread_cost_per_unit") / base) * 1e4
    return marked.groupBy("horizon_ms").agg(
        F.avg(signed).alias("mean_markout_bps"), F.avg(spread).alias("mean_spread_bps"), F.avg(signed - spread).alias("mean_edge_bps"),
        F.avg(F.when(sign * F.col("markout") > 0, 1.0).otherwise(0.0)).alias("hit_rate"), F.count(signed - spread).alias("n_fills"),
    )


def replay_orders(orders: DataFrame, book: DataFrame, key: str, max_age_ms: int, share: float = 0.10, ident: str = "order_id", ms: str = "ms", seq: str = "seq") -> DataFrame:
    """Fills of orders against the displayed book, one row per filling tick.

    Each tick in the order's life offers max(1, ``share`` of the far side's size), all of the rest if
    that size is 0, to what is still open; limit orders (limit_px not null) only on ticks that cross.
    """

    def run(own: pa.Table, ticks: pa.Table) -> pa.Table:
        ticks, own = sweep.in_time(ticks, ms, seq), own.filter(pa.compute.is_valid(own[ms]))
        bid, ask = sweep.floats(ticks, "bid_px"), sweep.floats(ticks, "ask_px")
        limits, quantity, since = sweep.floats(own, "limit_px"), np.nan_to_num(sweep.floats(own, "qty")), own[ms].to_numpy()
        buys, parts = np.array(own["side"].to_pylist()) == "buy", []
        for buy, price, size in ((True, ask, "ask_sz"), (False, -bid, "bid_sz")):
            here, offered = np.flatnonzero(~np.isnan(price)), np.nan_to_num(sweep.floats(ticks, size))
            mine = np.flatnonzero(buys == buy)
            limit = np.where(np.isnan(limits[mine]), np.inf, limits[mine] if buy else -limits[mine])
            order, row, filled = sweep.order_fills(ticks[ms].to_numpy()[here], price[here], offered[here], since[mine], limit, quantity[mine], max_age_ms, share)
            parts.append((mine[order], here[row], filled))
        order, row, filled = (np.concatenate(x) for x in zip(*parts, strict=True))
        mid, px = (bid[row] + ask[row]) / 2.0, np.where(buys[order], ask[row], bid[row])
        cost = np.where(buys[order], px - mid, mid - px)
        out = own.select([ident, key, "side", "qty"]).take(pa.array(order))
        later = ticks.select([ms, seq]).take(pa.array(row))
        for name, column in (("ms", later[ms]), ("seq", later[seq]), ("fill_qty", pa.array(filled)), ("fill_px", pa.array(px)), ("mid_at_fill", pa.array(mid)), ("spread_cost_per_unit", pa.array(cost))):
            out = out.append_column(name, column)
        return out

    of = lambda df, c, name=None: StructField(name or c, df.schema[c].dataType)
    schema = StructType([of(orders, ident), of(orders, key), of(orders, "side"), of(orders, "qty"), of(book, ms, "ms"), of(book, seq, "seq"), *[StructField(c, DoubleType()) for c in ("fill_qty", "fill_px", "mid_at_fill", "spread_cost_per_unit")]])
    left = orders.select(ident, key, "side", "qty", "limit_px", ms)
    right = book.select(key, ms, seq, "bid_px", "ask_px", "bid_sz", "ask_sz")
    return sweep.in_spans_of(left, right, key, max_age_ms, ms, run, schema)


def order_summary(fills: DataFrame, ident: str = "order_id") -> DataFrame:
    """Per order: filled quantity, rest, average price and total spread cost."""
    return fills.groupBy(ident).agg(
        F.sum("fill_qty").alias("cum_filled"), (F.max("qty") - F.sum("fill_qty")).alias("remaining"),
        (F.sum(F.col("fill_qty") * F.col("fill_px")) / F.sum("fill_qty")).alias("avg_fill_px"),
        F.sum(F.col("spread_cost_per_unit") * F.col("fill_qty")).alias("total_spread_cost"),
    )

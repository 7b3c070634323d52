"""Per-instrument features of quote and trade streams.

An instrument key is a mandatory argument: a difference across contracts is not a return.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.market import book_imbalance, log_ratio, microprice, mid
from .windows import in_blocks, numbered, previous


def require_columns(df: DataFrame, needed: set[str]) -> DataFrame:
    """``df``, or an error at analysis time that names the missing columns."""
    if missing := sorted(needed - {*df.columns}):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def valid_quotes(df: DataFrame) -> DataFrame:
    """Rows with both sides present and positive."""
    return df.where((F.col("bid_px") > 0) & (F.col("ask_px") > 0))


def base_features(df: DataFrame) -> DataFrame:
    """mid, spread (at least 1e-6), sizes with nulls as 0."""
    return df.withColumns(
        {
            "mid": mid(F.col("bid_px"), F.col("ask_px")),
            "spread": F.greatest(F.col("ask_px") - F.col("bid_px"), F.lit(1e-6)),
            "bid_sz": F.coalesce(F.col("bid_sz").cast("double"), F.lit(0.0)),
            "ask_sz": F.coalesce(F.col("ask_sz").cast("double"), F.lit(0.0)),
            "last_sz": F.coalesce(F.col("trade_sz").cast("double"), F.lit(0.0)),
        }
    )


def returns(df: DataFrame, key: str, ms: str = "ms", seq: str = "seq", price: str = "mid", least_gap: float = 1e-3) -> DataFrame:
    """ret (log return of ``price``) and inter_arrival_ms per instrument; 0 and ``least_gap`` on its first row."""
    rows = previous(df, key, ms, seq, [price, ms])
    gap = F.greatest(F.coalesce((F.col(ms) - F.col(f"prev_{ms}")).cast("double"), F.lit(0.0)), F.lit(least_gap))
    return rows.withColumns({"ret": log_ratio(F.col(price), F.col(f"prev_{price}")), "inter_arrival_ms": gap}).drop(f"prev_{price}", f"prev_{ms}")


def order_flow(df: DataFrame, key: str, ms: str = "ms", seq: str = "seq") -> DataFrame:
    """Order-flow imbalance at the touch and the microprice bundle."""
    rows = previous(df, key, ms, seq, ["bid_px", "ask_px", "bid_sz", "ask_sz"])
    c = F.col

    def side(now, then, size, old, up):
        better = now > then if up else now < then
        return F.when(better, size).when(now == then, size - old).otherwise(-old)

    bid = side(c("bid_px"), c("prev_bid_px"), c("bid_sz"), c("prev_bid_sz"), True)
    ask = side(c("ask_px"), c("prev_ask_px"), c("ask_sz"), c("prev_ask_sz"), False)
    m, micro = mid(c("bid_px"), c("ask_px")), microprice(c("bid_px"), c("ask_px"), c("bid_sz"), c("ask_sz"))
    spread = c("ask_px") - c("bid_px")
    out = rows.withColumns(
        {
            "ofi": F.when(c("prev_bid_px").isNull(), 0.0).otherwise((bid - ask).cast("double")),
            "first_tick": c("prev_bid_px").isNull(),
            "mid": m, "micro": micro, "imbalance": book_imbalance(c("bid_sz"), c("ask_sz")),
            "spread": spread, "rel_spread": spread / m, "micro_dev": micro - m,
        }
    )
    return out.drop("prev_bid_px", "prev_ask_px", "prev_bid_sz", "prev_ask_sz")


def forward_returns(df: DataFrame, key: str, price: str, steps: int, name: str, ms: str = "ms", seq: str = "seq") -> DataFrame:
    """ln(price ``steps`` rows ahead / price), null at the end."""

    def ahead(rows: DataFrame, w) -> DataFrame:
        later = F.lead(price, steps).over(w)
        return rows.withColumn(name, F.when((later > 0) & (F.col(price) > 0), F.log(later / F.col(price))))

    return in_blocks(df, key, ms, seq, ahead, ahead=steps)


def out_of_order(df: DataFrame, key: str, arrival: str, tie: str, ms: str = "ms", chunk: int = 1 << 17) -> DataFrame:
    """Rows that arrive, by the number ``arrival`` and then ``tie``, with an earlier time than the row before."""
    return previous(df, key, arrival, tie, [ms], chunk).where(F.col(f"prev_{ms}") > F.col(ms))


def every_nth(df: DataFrame, key: str, n: int, least: int, ms: str = "ms", seq: str = "seq") -> DataFrame:
    """Every n-th row of a key once ``least`` rows have come."""
    rows = numbered(df, key, ms, seq, "nth").withColumn("nth", F.col("nth") + 1)
    return rows.where((F.col("nth") % n == 0) & (F.col("nth") >= least))

"""Quote decisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decide(quotes: DataFrame, *, sigma_halt: float = 5e-3, vpin_pull: float = 0.7, vpin_widen: float = 0.4, overlay: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Append action (halt, pull or quote), toxicity in [0, 1] and the displayed size ahead of each quote.

    ``overlay`` is a transformation of the user that runs last.
    """
    action = F.when(F.col("sigma") > sigma_halt, "halt").when(F.col("vpin") > vpin_pull, "pull").otherwise("quote")
    toxicity = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("vpin") - vpin_widen) / max(vpin_pull - vpin_widen, 1e-9)))
    out = quotes.withColumns(
        {
            "action": action, "toxicity": toxicity,
            "bid_queue_ahead": F.when(F.col("bid") <= F.col("bid_px"), F.col("bid_sz")).otherwise(0.0),
            "ask_queue_ahead": F.when(F.col("ask") >= F.col("ask_px"), F.col("ask_sz")).otherwise(0.0),
        }
    )
    return out.transform(overlay) if overlay else out

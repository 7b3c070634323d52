"""Structured Streaming forms: event time, watermarks, checkpoints and sinks.

Rows later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import hour_label
from ..operators.bins import quantile_edges
from ..sources.sinks import with_hour


def replay(spark: SparkSession, path: str, schema, glob: str, files_per_trigger: int = 1) -> DataFrame:
    """A directory of time-partitioned files as a stream; the pace is files per trigger."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON snapshots as a stream of texts."""
    return spark.readStream.text(path)


def hourly_costs(fills: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Fills and mean absolute spread in bps per hour, emitted once an hour is past the watermark."""
    spread = F.abs(F.col("spread_cost_per_unit") / F.when(F.col("mid_at_fill") != 0, F.col("mid_at_fill"))) * 1e4
    by_hour = fills.withWatermark(ts, late).groupBy(F.window(ts, "1 hour")).agg(F.count("*").alias("n"), F.avg(spread).alias("mean_spread_bps"))
    return by_hour.select(hour_label(F.col("window.start")).alias("hour"), "n", "mean_spread_bps")


def quote_trade_pairs(quotes: DataFrame, trades: DataFrame, key: str, horizon: str, late: str = "1 hour") -> DataFrame:
    """Trades within ``horizon`` after each quote of the same key, both sides with a watermark, which bounds the state.

    Sides meet by key and span of time, as long as the horizon: a trade stands in its own span, a quote
    in its own and the next, so every pair meets once and no row meets all of its key. Each pair is a row
    of the stream; ``stateful.stream_pair_blocks`` hands pairs of ids on in blocks.
    """
    size = F.expr(f"unix_micros(timestamp_seconds(0) + interval {horizon})")
    span = F.unix_micros("ts") - F.pmod(F.unix_micros("ts"), size)
    q = quotes.withWatermark("ts", late).withColumn("_span", F.explode(F.array(span, span + size))).alias("q")
    t = trades.withWatermark("ts", late).withColumn("_span", span).alias("t")
    when = (F.col(f"q.{key}") == F.col(f"t.{key}")) & (F.col("q._span") == F.col("t._span")) & (F.col("t.ts") >= F.col("q.ts")) & (F.col("t.ts") <= F.col("q.ts") + F.expr(f"interval {horizon}"))
    return q.join(t, when)


def by_kind(stream: DataFrame, kinds: list[str]) -> dict[str, DataFrame]:
    """One parsed stream as one output per kind."""
    return {k: stream.where(F.col("kind") == k) for k in kinds}


def rotate_hours(stream: DataFrame, path: str, checkpoint: str, ms: str = "ms") -> StreamingQuery:
    """Append a stream under day=/hour=, exactly once through its checkpoint, and stop when the input is read."""
    return with_hour(stream, ms).writeStream.format("parquet").partitionBy("day", "hour").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def refit_edges(stream: DataFrame, features: list[str], buckets: int, lookback_ms: int, sink: Callable[[DataFrame, int], None], checkpoint: str, log: str) -> StreamingQuery:
    """After every micro-batch refit bin edges on the last ``lookback_ms`` of all that has come.

    Rows are kept under ``log`` by micro-batch, which is rewritten if the batch is run again; a fit
    reads the batches from the look-back on, and older ones can be deleted.
    """
    spark = stream.sparkSession

    def fit(batch: DataFrame, number: int) -> None:
        rows = batch.select("ms", *features)
        rows.write.mode("overwrite").parquet(f"{log}/batch={number}")
        seen = spark.read.schema(rows.schema.add("batch", "long")).parquet(log).where(F.col("batch") <= number)
        newest = seen.agg(F.max("ms").alias("newest")).first()["newest"]
        if newest is not None:
            sink(quantile_edges(seen.where(F.col("ms") >= newest - lookback_ms), features, buckets, least=2), number)

    return stream.writeStream.foreachBatch(fit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over the input that is there and read what it wrote."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)

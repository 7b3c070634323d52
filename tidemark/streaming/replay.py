"""Paced replay of a table: event time runs on as a multiple of the clock.

The stream's source is the clock alone. Its offset is an event time, so a restart goes on where the
checkpoint stands, and each micro-batch is one row with the span of event time that is due: at most
``step`` of it (admission), and no more than ``speed`` times the time since the start. The rows of a
span are read by Spark from the table with a filter on time, which its scan can use.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery


class EventClock(DataSource):
    """Options: begin and end (ms, begin excluded), speed (event ms per ms, 0 for no pace), step (ms admitted at once)."""

    @classmethod
    def name(cls) -> str:
        return "event_clock"

    def schema(self) -> str:
        return "since long, upto long"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return ClockReader(**{k: float(self.options[k]) for k in ("begin", "end", "speed", "step")})


class ClockReader(SimpleDataSourceStreamReader):
    def __init__(self, begin: float, end: float, speed: float, step: float):
        self.begin, self.end, self.speed, self.step = int(begin), int(end), speed, int(step)
        self.started: tuple[float, int] | None = None

    def initialOffset(self) -> dict:
        return {"ms": self.begin}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        since = start["ms"]
        if self.started is None:  # pace counts from where this run begins
            self.started = time.monotonic(), since
        upto = min(self.end, since + self.step)
        if self.speed:
            due = self.started[1] + int((time.monotonic() - self.started[0]) * 1000 * self.speed)
            upto = min(upto, due)
        return (iter([(since, upto)]), {"ms": upto}) if upto > since else (iter([]), {"ms": since})

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(start["ms"], end["ms"])] if end["ms"] > start["ms"] else [])

    def commit(self, end: dict) -> None: ...


def paced(spark: SparkSession, table: DataFrame, ts: str, begin_ms: int, end_ms: int, sink: Callable[[DataFrame, int], None], checkpoint: str, speed: float = 1.0, step_ms: int = 60_000, most: int | None = None) -> int:
    """Release the rows of ``table`` with begin < ts <= end to ``sink(rows, batch)``, in spans of event time.

    Returns the event time reached: ``end_ms``, or less after ``most`` micro-batches. A span whose batch
    fails is released again with the same batch number.
    """
    spark.dataSource.register(EventClock)
    clock = spark.readStream.format("event_clock").options(begin=begin_ms, end=end_ms, speed=speed, step=step_ms).load()
    kind = table.schema[ts].dataType.simpleString()
    at = lambda ms: F.expr(f"cast(timestamp_millis({ms}L) as {kind})")
    reached, batches = [begin_ms], [0]

    def release(span: DataFrame, number: int) -> None:
        for since, upto in span.collect():  # one row: the span that is due
            sink(table.where((F.col(ts) > at(since)) & (F.col(ts) <= at(upto))), number)
            reached[0] = upto
            batches[0] += 1

    query: StreamingQuery = clock.writeStream.foreachBatch(release).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        while query.isActive and reached[0] < end_ms and (most is None or batches[0] < most):
            query.awaitTermination(0.05)
            if _offset(query) >= end_ms:  # a restart may find that all has been released
                reached[0] = max(reached[0], end_ms)
        if query.exception():
            raise query.exception()
        if reached[0] < end_ms and most is not None:
            while query.isActive and _offset(query) < reached[0]:  # the last batch is committed
                query.awaitTermination(0.05)
    finally:
        query.stop()
    return reached[0]


def _offset(query: StreamingQuery) -> int:
    progress = query.lastProgress
    found = re.search(r"-?[0-9]+", str(progress["sources"][0]["endOffset"])) if progress else None  # {"ms": number}
    return int(found[0]) if found else -(1 << 63)

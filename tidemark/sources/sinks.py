"""Sinks: event logs by hour, item history, token shards, bin models and reports."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bins import edges_from_json, edges_json


def with_hour(df: DataFrame, ms: str = "ms") -> DataFrame:
    ts = F.timestamp_millis(ms)
    return df.withColumns({"day": F.date_format(ts, "yyyy-MM-dd"), "hour": F.date_format(ts, "HH")})


def append_events(df: DataFrame, path: str, ms: str = "ms") -> None:
    """Append events under day=/hour= (UTC); a file is written once and never rewritten."""
    with_hour(df, ms).write.mode("append").partitionBy("day", "hour").parquet(path)


def recent_events(spark: SparkSession, path: str, now_ms: int, hours: int, ms: str = "ms") -> DataFrame:
    """Events of the last ``hours`` before ``now_ms`` in time order; only their day folders are read."""
    cutoff = now_ms - hours * 3_600_000
    first = F.date_format(F.timestamp_millis(F.lit(cutoff)), "yyyy-MM-dd")
    return spark.read.parquet(path).where((F.col("day").cast("string") >= first) & (F.col(ms) >= cutoff)).orderBy(ms)


class RollingSink:
    """A stream's event log that is flushed by rows or seconds, with a manifest and compaction.

    A micro-batch, whose trigger interval is the flush by seconds, goes to a folder of its own under
    data/, in files of at most ``rows`` rows a day and hour; one manifest file, which appears at once,
    then names the folder. Readers follow the manifest alone. A batch that failed before its manifest
    is written over when it comes again, and one that is named already is skipped, so each counts once.
    ``compact`` writes what many folders hold as one and names both in one manifest file: the new folder
    in, the old ones out.
    """

    MANIFEST = "added string, removed array<string>, at long"

    def __init__(self, spark: SparkSession, path: str, ms: str = "ms", rows: int = 1_000_000):
        self.spark, self.path, self.ms, self.rows = spark, path, ms, rows

    def _named(self) -> DataFrame:
        """Manifest rows; none before the first batch."""
        try:
            return self.spark.read.schema(self.MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.MANIFEST)

    def folders(self) -> list[str]:
        """Folders that count: named and not removed. One name a micro-batch until they are compacted."""
        named = self._named()
        gone = named.select(F.explode("removed").alias("added"))
        return sorted(r["added"] for r in named.select("added").distinct().join(gone, "added", "left_anti").collect())

    def _write(self, df: DataFrame, folder: str, removed: list[str]) -> None:
        out = with_hour(df, self.ms)
        out.write.mode("overwrite").option("maxRecordsPerFile", self.rows).partitionBy("day", "hour").parquet(f"{self.path}/data/{folder}")
        self._commit(folder, removed)

    def _commit(self, folder: str, removed: list[str]) -> None:
        entry = self.spark.createDataFrame([(folder, removed, time.time_ns())], self.MANIFEST)
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def __call__(self, batch: DataFrame, number: int) -> None:
        """Write a micro-batch; for ``foreachBatch``."""
        folder = f"batch-{number:012d}"
        if not self._named().where((F.col("added") == folder) | F.array_contains("removed", folder)).limit(1).count():
            self._write(batch, folder, [])

    def read(self, schema) -> DataFrame:
        """All rows, with their day and hour."""
        folders = self.folders()
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/data/{f}").withColumns({"day": F.date_format(F.timestamp_millis(self.ms), "yyyy-MM-dd"), "hour": F.date_format(F.timestamp_millis(self.ms), "HH")}) for f in folders]
        return reduce(DataFrame.unionByName, parts) if parts else with_hour(self.spark.createDataFrame([], schema), self.ms)

    def compact(self, schema) -> None:
        """Rewrite all folders as one, each day and hour in as few files as ``rows`` allows."""
        old = self.folders()
        if len(old) > 1:
            # an hour is dealt over as many tasks as it has full files
            rows = self.read(schema)
            files = rows.groupBy("day", "hour").agg(F.ceil(F.count("*") / self.rows).cast("int").alias("_files"))
            dealt = rows.join(F.broadcast(files), ["day", "hour"]).withColumn("_file", F.floor(F.rand(7) * F.col("_files")))  # one row an hour
            self._write(dealt.repartition("day", "hour", "_file").drop("day", "hour", "_files", "_file"), f"whole-{uuid.uuid4().hex}", old)


def append_items(items: list[DataFrame], path: str, fetched_at: str) -> None:
    """Append items of several sources to one history, with ``_source`` and ``_fetched_at``."""
    out = None
    for df in items:
        df = df.withColumns({"_source": F.col("source"), "_fetched_at": F.lit(fetched_at)})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    out.write.mode("append").parquet(path)


def load_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def write_shards(tokens: DataFrame, path: str, rows_per_file: int = 1_000_000, by: tuple[str, ...] = ("day",)) -> None:
    """Token rows under their partition columns, with at most ``rows_per_file`` rows a file."""
    tokens.write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy(*by).parquet(path)


def save_bins(edges: DataFrame, path: str) -> None:
    edges_json(edges).select("payload").coalesce(1).write.mode("overwrite").text(path)


def load_bins(spark: SparkSession, path: str) -> DataFrame:
    return edges_from_json(spark.read.text(path).withColumnRenamed("value", "payload"))


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """Each section of a report as JSON lines under its name."""
    for name, df in sections.items():
        df.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")

"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, written

__all__ = ["BATCH_ROWS", "WORD", "bounded_batches", "documents", "free_name", "shared_dir", "word_count", "words", "written"]

#: A word is a run of characters that are neither a space nor one of the five ASCII controls 9-13.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch of texts; Python workers hold a few batches at a time.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Arrow batches of whole texts hold at most ``rows`` rows; a smaller setting of the session stays.

    This is a setting of the session, so queries and the pipeline make it where they read their
    tables; no operator changes the session.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def free_name(df: DataFrame, base: str) -> str:
    """A column name starting with ``base`` that ``df`` does not use (Spark compares without case)."""
    taken, name, n = {c.lower() for c in df.columns}, base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def words(text: Column) -> Column:
    """Words of ``text`` as an array, A-Z lower-cased; null gives an empty array."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Number of words of ``text``; null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

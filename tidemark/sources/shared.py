"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Session setting that holds the folder of a run.
RUN = "spark.tidemark.runFolder"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where the setting is missing on a single machine (``local[..]``, as in tests) a temporary folder
    takes its place; on a cluster, whose executors would not share it, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables go to a folder of their own, which the caller can delete once results are written."""
    path = f"{shared_dir(spark)}/tidemark-run-{uuid.uuid4().hex}"
    before = spark.conf.get(RUN, None)
    spark.conf.set(RUN, path)
    try:
        yield path
    finally:
        spark.conf.set(RUN, before) if before else spark.conf.unset(RUN)


def new_path(spark: SparkSession) -> str:
    return f"{spark.conf.get(RUN, None) or shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage: what was computed is not computed again if an executor is lost or if the
    table is read twice, and Spark knows the table's real size when it chooses between join strategies.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

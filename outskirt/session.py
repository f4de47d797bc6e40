"""Session helpers: tables that later steps read again, scratch folder, task counts."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MOST_TASKS = 100_000
# A table of at most this many (narrow) rows may pass through the driver.
SMALL_ROWS = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; a fresh local one only where unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="outskirt-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """A table that several steps read: written once to the shared folder.

    Its rows and their order are fixed from then on, it outlives lost executors, and the
    plans of later steps start here.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def keep_small(df: DataFrame, rows: int) -> DataFrame:
    """Like :func:`keep` for a table of at most ``rows`` rows.

    A small one becomes a local table in one partition: steps on it need no shuffle.
    """
    if rows > SMALL_ROWS:
        return keep(df)
    return local_table(df.sparkSession, df.toArrow())


def local_table(spark: SparkSession, table: pa.Table) -> DataFrame:
    return spark.createDataFrame(table).coalesce(1)


def task_count(spark: SparkSession, boxes: int) -> int:
    return max(spark.sparkContext.defaultParallelism, min(boxes, MOST_TASKS))

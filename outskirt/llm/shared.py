"""Where intermediate tables go, and column rules that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only where that is unset (tests) an own one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="outskirt-llm-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(frame: DataFrame, folder: str, name: str, file_rows: int = 0) -> DataFrame:
    """Write ``frame`` as Parquet below ``folder`` and read it back: cuts the lineage, survives lost executors.

    A file has at most ``file_rows`` rows, if given."""
    path = f"{folder}/{name}"
    frame.write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` is right, and faster, where all characters are ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which the cluster's owner fits to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(frame: DataFrame, folder: str, name: str, key: str) -> DataFrame:
    """``frame`` as a table bucketed by ``key``: later joins and groups on it do not shuffle it again."""
    spark = frame.sparkSession
    n, full = width(spark), f"{name}_{uuid.uuid4().hex}"
    writer = frame.repartition(n, key).write.option("path", f"{folder}/{full}").option("compression", "zstd")
    writer.bucketBy(n, key).saveAsTable(full)
    return spark.table(full)


def rows_of(out: dict, schema):
    """A record batch of the columns in ``out``."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in schema], schema=schema)

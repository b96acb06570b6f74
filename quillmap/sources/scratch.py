"""Folders for files that are written and read again, where all executors see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder named in spark.checkpoint.dir; in a temporary one only where that is unset and Spark runs in one process. Gone when the application ends."""
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        _own = _own or "file://" + tempfile.mkdtemp(prefix="quillmap-")
        base = _own
    path = f"{base.rstrip('/')}/quillmap-{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def round_table(df: DataFrame, name: str) -> DataFrame:
    """A round of an iteration, written and read again: its plan doesn't grow and lost executors cost no earlier round."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by the keys to a fixed number of tasks: for few rows that make many, which adaptive execution would gather in one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)

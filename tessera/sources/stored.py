"""Tables that cut lineage: written to the folder that all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where it isn't set and Spark is one process (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = f"{tempfile.gettempdir()}/checkpoints"
    return known.rstrip("/")


#: Tables of this process that are still there.
_kept: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table: lineage ends there, and lost executors don't undo it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession) -> int:
    """Deletes all tables that `stored` made so far, and says how many. Results that still read them can't be read any more."""
    n = len(_kept)
    while _kept:
        path = spark._jvm.org.apache.hadoop.fs.Path(_kept.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n

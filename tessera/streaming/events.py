"""Structured Streaming over event tables: windows with watermarks, sessions, and late rows that are told apart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources.stored import shared_folder


def event_stream(spark: SparkSession, folder: str, name: str = "events", files_per_batch: int | None = None) -> DataFrame:
    """A table of the folder as a stream, with `time` as a timestamp in UTC."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # as a pattern, so that the table may be a folder or a single file
    return reader.parquet(f"{folder}/{name}[.]parquet").withColumn("time", F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))"))


def tumbling(stream: DataFrame, by: list[str], width: str, delay: str, value: str) -> DataFrame:
    w = stream.withWatermark("time", delay).groupBy(F.window("time", width), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(*by, F.unix_micros("window.start").alias("start"), "n", "total")


def sliding(stream: DataFrame, by: list[str], width: str, step: str, delay: str) -> DataFrame:
    w = stream.withWatermark("time", delay).groupBy(F.window("time", width, step), *by).agg(F.count("*").alias("n"))
    return w.select(*by, F.unix_micros("window.start").alias("start"), "n")


def sessions(stream: DataFrame, by: list[str], gap: str, delay: str) -> DataFrame:
    w = stream.withWatermark("time", delay).groupBy(F.session_window("time", gap), *by).agg(F.count("*").alias("n"))
    return w.select(*by, F.unix_micros("session_window.start").alias("start"), F.unix_micros("session_window.end").alias("stop"), "n")


def tag_late(stream: DataFrame, key: str, order: str) -> DataFrame:
    """Every row, in the order of arrival of its key, with how far (microseconds) it is behind the latest time before it;
    late rows are passed on, not dropped. The state is one number for each key."""
    rows = stream.select(key, order, F.unix_micros("time").alias("us"))

    def run(who, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest = state.get[0] if state.exists else None
        held = pd.concat(list(frames)).sort_values(order)  # rows of one key in one micro-batch
        top = held["us"].cummax().shift()
        if latest is not None:
            top = top.fillna(latest).clip(lower=latest)
        held["lateness"] = (top - held["us"]).clip(lower=0).fillna(0).astype("int64")
        state.update((int(max(held["us"].max(), latest or 0)),))
        yield held[[key, order, "us", "lateness"]]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, us bigint, lateness bigint"
    return rows.groupBy(key).applyInPandasWithState(run, schema, "latest bigint", "append", GroupStateTimeout.NoTimeout)


def all_available(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote, from the shared folder."""
    import uuid

    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")

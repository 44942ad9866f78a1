"""Event-time order with bounded lateness: keyed state holds what waits, and a flush gives what is left at the end."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources.stored import shared_folder

STATE = "us array<bigint>, turn array<bigint>, newest bigint, latest bigint, gone bigint"


def departures(us: np.ndarray, arrived: np.ndarray, wait: int, most: int | None, newest: int | None = None) -> np.ndarray:
    """The step at which each item leaves, or the number of steps where it doesn't. Items are in the order of arrival;
    those that wait from before arrived at step -1, and steps 0, 1, ... are the arrivals of now.

    What has left is always a beginning of the order by (time, arrival): the items that are `wait` behind the newest time so
    far, and all but the last `most` of those that have arrived. So an item leaves as soon as that beginning reaches its rank."""
    steps = int((arrived >= 0).sum())
    held = len(us) - steps
    if not steps:
        return np.zeros(held, np.int64)
    by_time = np.argsort(us, kind="stable")
    rank = np.empty(len(us), np.int64)
    rank[by_time] = np.arange(1, len(us) + 1)
    top = np.maximum.accumulate(us[held:])
    if newest is not None:
        top = np.maximum(top, newest)
    reached = np.searchsorted(us[by_time], top - wait, "right")
    if most is not None and len(us) > most:
        last = sorted(rank[:held].tolist())[-most - 1 :]  # at most `most` wait, so that this is a heap of the last most + 1
        full = np.zeros(steps, np.int64)
        for i, r in enumerate(rank[held:].tolist()):
            if len(last) <= most:
                heapq.heappush(last, r)
            else:
                heapq.heappushpop(last, r)
            full[i] = last[0] if len(last) > most else 0
        reached = np.maximum(reached, full)
    reached = np.maximum.accumulate(reached)
    return np.maximum(np.searchsorted(reached, rank), arrived)


def reordered(stream: DataFrame, key: str, order: str, wait: int, most: int | None = None) -> DataFrame:
    """Rows of a stream (with `time`) by the order of their event times. Within each key rows arrive in the order of `order`,
    a BIGINT. A row waits until a time of its key `wait` microseconds later has come, or more than `most` rows wait; rows
    leave by (time, arrival). `watermark` is the latest time that left before (NULL for the first); a row that is behind it when it comes
    is late: it leaves at once, and its `uncertainty` is how far it is behind (0 for others). `place` numbers the rows of a key as they leave.

    The state of a key is what waits: rows of the last `wait` microseconds, `most` at most. Rows without a time or an order are dropped before."""
    rows = stream.select(F.col(key), F.col(order).cast("bigint").alias("turn"), F.unix_micros("time").alias("us")).dropna(subset=["turn", "us"])

    def run(who, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, turns, newest, latest, gone = state.get if state.exists else ([], [], None, None, 0)
        now = pd.concat(list(frames)).sort_values("turn", kind="stable")
        us, turn = np.concatenate([np.array(waiting, np.int64), now["us"].to_numpy()]), np.concatenate([np.array(turns, np.int64), now["turn"].to_numpy()])
        arrived = np.concatenate([np.full(len(waiting), -1), np.arange(len(now))])
        step = departures(us, arrived, wait, most, newest)
        leaves = np.flatnonzero(step < len(now))
        leaves = leaves[np.lexsort((leaves, us[leaves], step[leaves]))]
        stay = np.flatnonzero(step >= len(now))
        out = us[leaves]
        before = np.maximum.accumulate(np.concatenate([[np.iinfo(np.int64).min if latest is None else latest], out]))
        state.update((us[stay].tolist(), turn[stay].tolist(), int(max(us.max(), us.max() if newest is None else newest)), int(before[-1]) if len(out) or latest is not None else None, gone + len(out)))
        mark = pd.array(before[:-1], "Int64")
        if len(out) and latest is None:
            mark[0] = pd.NA
        late = np.maximum(before[:-1] - out, 0) if latest is not None else np.concatenate([[0], np.maximum(before[1:-1] - out[1:], 0)]) if len(out) else out
        yield pd.DataFrame({key: who[0], order: turn[leaves], "us": out, "watermark": mark, "uncertainty": late, "place": gone + np.arange(len(out))})

    schema = f"`{key}` {stream.schema[key].dataType.simpleString()}, `{order}` bigint, us bigint, watermark bigint, uncertainty bigint, place bigint"
    return rows.groupBy(key).applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def reordered_all(stream: DataFrame, key: str, order: str, wait: int, most: int | None = None) -> DataFrame:
    """All rows that are there, as `reordered` gives them, and then those that still wait: the flush reads the state of the
    stream's last batch, a row for each key, and sends its rows off by (time, arrival)."""
    spark = stream.sparkSession
    out = reordered(stream, key, order, wait, most)
    base = f"{shared_folder(spark)}/streams/reorder-{uuid.uuid4().hex}"
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/rows")
    query.awaitTermination()
    left = spark.read.format("statestore").load(f"{base}/state").select(F.col(f"key.{key}").alias(key), "value.groupState.*")
    left = left.select(key, "latest", "gone", F.explode(F.arrays_zip("us", "turn")).alias("x")).select(key, "latest", "gone", F.col("x.us").alias("us"), F.col("x.turn").alias(order))
    w = Window.partitionBy(key).orderBy("us", order)
    mark = F.greatest(F.col("latest"), F.max("us").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    left = left.select(key, order, "us", mark.alias("watermark"), F.lit(0).cast("bigint").alias("uncertainty"), (F.col("gone") + F.row_number().over(w) - 1).cast("bigint").alias("place"))
    return spark.read.schema(out.schema).parquet(f"{base}/rows").unionByName(left)


def interval_joined(left: DataFrame, right: DataFrame, key: str, before: str, delays: tuple[str, str]) -> DataFrame:
    """Rows of two streams (with `time`, and an `id` each) of the same key, where the right one's time is at most `before`
    earlier than the left one's and not later: left_id, right_id, key. Either may come first. Each stream has its own
    watermark (`delays`), so that the state of both is bounded: the left's by its delay, the right's by `before` on top."""
    a = left.select(F.col(key), F.col("id").alias("left_id"), F.col("time").alias("left_time")).withWatermark("left_time", delays[0])
    b = right.select(F.col(key).alias("__key"), F.col("id").alias("right_id"), F.col("time").alias("right_time")).withWatermark("right_time", delays[1])
    near = F.expr(f"right_time <= left_time AND right_time >= left_time - INTERVAL {before}")
    return a.join(b, (F.col(key) == F.col("__key")) & near, "inner").select(key, "left_id", "right_id", F.unix_micros("left_time").alias("left_us"), F.unix_micros("right_time").alias("right_us"))

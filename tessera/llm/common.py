"""What the corpus operators share: reading tables, the shared folder, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows, at the width of its schema, come to this many bytes or fewer.
BROADCAST_BYTES = 8 << 20
#: Spark deletes the shuffle files of a query as soon as it is over.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch. Texts are long: batches of a fixed number of rows would take much of a worker's memory.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
_scopes = threading.local()
_kept: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where it is unset and Spark is one process."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = f"{tempfile.gettempdir()}/checkpoints"
    return known.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session are of BATCH_BYTES at most."""
    spark.conf.set(BATCH, str(min(BATCH_BYTES, int(spark.conf.get(BATCH)) if spark.conf.get(BATCH).isdigit() else BATCH_BYTES)))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: lineage ends there, and lost executors don't undo it.
    The shuffle files of the write go when it is over, as nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in (FREED, BATCH)}
    spark.conf.set(FREED, "true")
    small_batches(spark)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for own in getattr(_scopes, "open", [])[-1:]:
        own.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame | tuple[DataFrame, ...]]):
    """What build() returns, as a stored table (or tables). Those that build() stored on its way are deleted after that."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    own: list[str] = []
    _scopes.open.append(own)
    try:
        out = build()
        _scopes.open.pop()
        return tuple(stored(df, name) for df in out) if isinstance(out, tuple) else stored(out, name)
    finally:
        if own in _scopes.open:
            _scopes.open.remove(own)
        for path in own:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, marked for broadcast only if its counted rows are few; df should be a stored table of ids and flags."""
    width = 16 + 8 * len(df.columns)
    return F.broadcast(df) if (df.count() if rows is None else rows) * width <= BROADCAST_BYTES else df


class Marked:
    """A fixed-size map of the low bits of 64-bit keys, for passes over texts that need a part of them only. It is at most
    2**most bits (32 MB), however many keys there are; keys that aren't in it may pass, keys that are in it always do."""

    def __init__(self, keys: DataFrame, column: str, most: int = 28):
        n, spark = keys.count(), keys.sparkSession
        self.mask = (1 << min(most, max(15, (64 * n).bit_length()))) - 1
        slot = F.col(column).bitwiseAND(F.lit(self.mask))
        parts = keys.groupBy(F.shiftrightunsigned(slot, 15).alias("part")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767))).alias("bits"))
        bits = np.zeros((self.mask + 1 >> 15, 4096), np.uint8)
        for r in parts.collect():  # 4 KB for each 32,768 slots
            bits[r["part"]] = np.frombuffer(r["bits"], np.uint8)
        self.bits = spark.sparkContext.broadcast(bits.reshape(-1))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        slot = keys & np.int64(self.mask)
        return (self.bits.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def kept(name: str, build: Callable[[], object]):
    """What build() returns, which this Python worker keeps for its next tasks until one of another kind lets it go."""
    if name not in _kept:
        _kept[name] = build()
    return _kept[name]


def let_go() -> None:
    """Workers outlive stages: a pass that holds much itself drops what an earlier stage's tasks have kept."""
    _kept.clear()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 8192) -> Iterator[pa.Table]:
    """Tables of about `rows` rows of sorted batches, cut only where the keys change. Larger groups come alone; what is
    held is one table and the group that is being read."""
    held, n, limit = [], 0, rows
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= limit:
            joined = pa.Table.from_batches(held).combine_chunks()
            last = None
            for k in keys:
                same = pc.equal(joined.column(k), joined.column(k)[n - 1])
                last = same if last is None else pc.and_(last, same)
            start = pc.index(last, True).as_py()
            if start:
                yield joined.slice(0, start)
            held, n = joined.slice(start).to_batches(), n - start
            limit = max(rows, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(*columns: np.ndarray) -> np.ndarray:
    """Where each run of equal values of all columns begins, and the number of rows."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.append(np.flatnonzero(new), len(new))

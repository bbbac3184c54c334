"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import string
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that a broadcast may hold; larger sides are joined by shuffling.
BROADCAST_BYTES = 16 << 20
#: Rows and bytes of a batch on its way to Python; batches are held outside the heap, by both sides.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def free_name(columns: list[str], name: str) -> str:
    """`name`, with as many underscores before it as make it differ from all of `columns`."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is named, a local one if all run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    made = f"/tmp/checkpoints/{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(made)
    return f"file://{made}"


_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    except Exception:  # noqa: BLE001  the session has ended already
        return


def small_batches(spark: SparkSession) -> None:
    """Have this session hand rows to Python in small batches from now on, as whole texts go there."""
    for k, v in BATCHES.items():
        spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again.

    This cuts the lineage: a lost executor costs a reread, never a recomputation of what came before.
    The files go by `discard`, or when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brindle-{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in BATCHES}
    small_batches(spark)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    ease(spark)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that `written` gave and that nothing will read again."""
    path = _written.pop(df, None)
    if path is not None:
        _delete(df.sparkSession, path)


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """`df` marked for broadcasting if its counted rows fit the bound, else as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


_state: dict[Hashable, Any] = {}


def worker_state(owner: Hashable, make: Callable[[], Any] = dict) -> Any:
    """What this Python process keeps between tasks for `owner`, made when first asked for.

    Workers are used again by later stages, so what another owner left is let go first.
    """
    if owner not in _state:
        _state.clear()
        give_back()
        _state[owner] = make()
    return _state[owner]


def give_back() -> None:
    """Return memory that this process holds but doesn't use to the system, as Python workers live on between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the GNU C library has it
        trim(0)


def ease(spark: SparkSession) -> None:
    """Have the driver, its Python and its JVM, return memory that it doesn't use.

    The JVM's heap grows by the garbage of many small jobs and keeps what it took; a full collection shrinks it.
    One is made only when the heap has taken more than half of what it may.
    """
    give_back()
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        spark._jvm.System.gc()


def row_batches(batches: Iterable[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes, so that long texts don't pile up in a worker."""
    for batch in batches:
        rows = batch.num_rows
        if rows:
            step = max(1, min(rows, int(rows * most / max(1, batch.nbytes))))
            for at in range(0, rows, step):
                yield batch.slice(at, step)
    give_back()

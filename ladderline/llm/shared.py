"""Tables and files that every executor sees, and bounded filters built by aggregation."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LEFT: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, as in tests, a local one, but never on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local[") and master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ladderline-")
        spark.conf.set("spark.checkpoint.dir", folder)
        _LEFT.add(folder)
    return folder.rstrip("/")


#: Rows of an Arrow batch between Spark and Python: texts are long, so Spark's default of 10,000 is too many.
BATCH_ROWS = 2_000


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS where they still have Spark's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def tidy(run: Callable) -> Callable:
    """The same function for mapInArrow, that gives freed memory back to the system at the end of a task: workers live on from stage to stage."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return tidied


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one call; it goes when the driver's Python ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _LEFT.add(path)
    return path


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Opens a store from any process by its address (file, hdfs, s3, gs, or a plain path)."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


@atexit.register
def _clean() -> None:
    for path in _LEFT:
        try:
            store, at = filesystem(path)
            store.delete_dir(at)
        except Exception:  # noqa: BLE001  the store may be gone by then
            pass


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage, and survives lost executors."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same with its folder, for forget()."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(path: str | None) -> None:
    """Deletes a folder of new_folder() that nothing reads any more."""
    if path is not None:
        store, at = filesystem(path)
        store.delete_dir(at)
        _LEFT.discard(path)


def bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits with those set that stand in the column slot.

    Built by aggregation; at most 2**(bits - 6) words reach the driver, however many rows there are.
    A fuller bitmap only lets more rows pass: whoever uses it joins exactly afterwards.
    """
    word = F.shiftright("slot", 6).alias("w")
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    rows = slots.groupBy(word).agg(F.bit_or(bit).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(words: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (words[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) != 0


def publish(path: str, name: str, write) -> str:
    """Writes a file under a name of its own and then renames it, so that a retried or repeated task leaves one whole file."""
    store, at = filesystem(path)
    store.create_dir(at, recursive=True)
    part = f"{at}/.{name}.{uuid.uuid4().hex}{os.getpid()}"
    with store.open_output_stream(part) as out:
        write(out)
    store.move(part, f"{at}/{name}")
    return f"{path}/{name}"


#: Rows of ids, or of small structs, that may be broadcast; counted before.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table marked for broadcast if it has so few rows, and as it is, for a shuffled join, beyond. It should be a written one."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    while name in df.columns:
        name += "_"
    return name

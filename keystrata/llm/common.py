"""Shared folders, file systems and Arrow helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import re
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows (not documents' texts: slim keys) that a side may have to be broadcast.
BROADCAST_ROWS = 400_000
#: Largest number of bytes of texts in such a side.
BROADCAST_BYTES = 32 << 20
#: Bytes of an Arrow batch between the JVM and Python, about.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local one in local
    mode; on a cluster this raises, as executors couldn't read each other's files."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or "file:///tmp/checkpoints/keystrata").rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder, as zstandard, and read it again: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete tables of materialise(), or paths, that no later plan reads."""
    jvm = spark._jvm
    for table in tables:
        path = jvm.org.apache.hadoop.fs.Path(table if isinstance(table, str) else table._scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow file system and path of a URI (file:, hdfs:, s3:, gs:) or plain path."""
    return pafs.FileSystem.from_uri(uri)


def retried(action: Callable, attempts: int = 3, pause: float = 0.2):
    """Result of action(); on an I/O or data error it is called again, and the last error is raised."""
    for left in range(attempts - 1, -1, -1):
        try:
            return action()
        except (OSError, ValueError, EOFError):
            if not left:
                raise
            time.sleep(pause)


def parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(taken: list[str], *names: str) -> list[str]:
    """names, each with as many underscores before it as make it differ from the names taken, in any case."""
    low = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in low:
            name = f"_{name}"
        out.append(name)
        low.add(name.lower())
    return out


def bounded_broadcast(df: DataFrame, rows: int, most: int = BROADCAST_ROWS, text_bytes: int | None = 0) -> DataFrame:
    """df, marked for broadcast only if its counted rows, and counted bytes where it holds texts, are few; beyond that
    the join shuffles both sides."""
    return F.broadcast(df) if rows <= most and (text_bytes or 0) <= BROADCAST_BYTES else df


def salted_join(many: DataFrame, one: DataFrame, on: str, spread: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """many joined with a side that has one slim row for a key; the rows of a hot key are dealt over `salts` tasks."""
    (salt,) = fresh([*many.columns, *one.columns], "salt")
    copies = one.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(copies, [on, salt], how).drop(salt)


def dealt(plan: DataFrame, rows: int | None, most: int = 20_000) -> DataFrame:
    """plan, which has `rows` slim rows, with a task for each of them up to `most`; a given number is not coalesced."""
    return plan.repartition(max(1, min(rows or 0, most)))


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Let this session hand Python Arrow batches of about `most` bytes (one row at least), where Spark's own bound
    is larger: a batch is held by the JVM outside its heap and by the worker at once, in every running task."""
    now = int(re.sub(r"\D", "", spark.conf.get(BATCH_SETTING)) or 0)
    if not 0 < now <= most:
        spark.conf.set(BATCH_SETTING, str(most))


def give_back() -> None:
    """Return free memory of this process to the system, so that idle workers hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def thrifty(work: Callable) -> Callable:
    """A mapInArrow function that gives free memory back after each batch and at its end."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                give_back()

        yield from work(passed())
        give_back()

    return run


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets.astype(np.int64)


def sized_slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes each (one row at least)."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
        yield low, min(high, n)
        low = high


def binary_array(flat: bytes, offsets: np.ndarray) -> pa.Array:
    """Binary column over one buffer, cut at offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(flat)])


def in_batches(rows: Iterator[tuple], schema: pa.Schema, most_rows: int = 5000, size: Callable = lambda row: 0, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Tuples gathered to record batches of bounded rows and bytes."""
    held, held_bytes = [], 0
    for row in rows:
        held.append(row)
        held_bytes += size(row)
        if len(held) >= most_rows or held_bytes >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, held_bytes = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

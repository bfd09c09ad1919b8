"""The operation log: byte offsets, replay from an offset, truncation, retention by bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Operations, or sums of such ranges, that one window takes.
WIDTH = 4096


def _before(sums: DataFrame, shard: str, size: str, depth: int) -> DataFrame:
    """(shard, _before): the bytes of all shards below. Sums of WIDTH shards are summed first, `depth` times over, so
    the one window that is not partitioned has a row for WIDTH ** (depth + 1) operations."""
    if not depth:
        order = Window.orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
        return sums.select(shard, F.coalesce(F.sum(size).over(order), F.lit(0)).alias("_before"))
    upper = f"{shard}_{depth}"
    held = sums.withColumn(upper, F.floor(F.col(shard) / WIDTH))
    above = _before(held.groupBy(upper).agg(F.sum(size).alias(size)), upper, size, depth - 1)
    order = Window.partitionBy(upper).orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    inner = held.withColumn("_inner", F.coalesce(F.sum(size).over(order), F.lit(0)))
    return inner.join(above, upper).select(shard, (F.col("_before") + F.col("_inner")).alias("_before"))


def offsets(log: DataFrame, size: str = "size", shard: str = "_shard", width: int = WIDTH) -> DataFrame:
    """start and end byte offset of each operation: sums of seq ranges of `width` and of ranges of these, then within them."""
    held = log.withColumn(shard, F.floor(F.col("seq") / width))
    before = _before(held.groupBy(shard).agg(F.sum(size).alias("_bytes")), shard, "_bytes", 1)
    inner = F.sum(size).over(Window.partitionBy(shard).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    out = held.withColumn("_upto", inner).join(before, shard)
    return out.withColumn("end", F.col("_before") + F.col("_upto")).withColumn("start", F.col("end") - F.col(size)).drop(shard, "_before", "_upto")


def replay(log: DataFrame, offset: int, limit: int, size: str = "size") -> DataFrame:
    """Operations that start at or after a byte offset and end within `limit` bytes of it."""
    return offsets(log, size).where((F.col("start") >= offset) & (F.col("end") <= offset + limit))


def truncated(log: DataFrame, offset: int, size: str = "size") -> DataFrame:
    """The log without the operations that end at or before a byte offset, as after a flush of these."""
    return offsets(log, size).where(F.col("end") > offset)


def retained(log: DataFrame, capacity: int, size: str = "size") -> DataFrame:
    """The newest whole operations that fit in `capacity` bytes of a ring."""
    total = log.agg(F.sum(size).alias("_total"))
    return offsets(log, size).join(F.broadcast(total), how="cross").where(F.col("start") >= F.col("_total") - capacity).drop("_total")  # one row

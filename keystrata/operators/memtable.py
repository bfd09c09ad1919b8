"""Write buffers: freezing by cumulative size, sizes, and resolved segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resolve import latest


def entry_bytes(key: str = "key", value: str = "value") -> Column:
    return (F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


#: Sequence numbers of one range: more than the operations of a few buffers, and few enough that a task holds their sizes.
RANGE = 1 << 22
STATE = "number long, held long, count long, first long"


def _ordered(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sequence numbers of a range in order, and the bytes up to and with each."""
    seqs = rows.column("seq").to_numpy()
    at = np.argsort(seqs, kind="stable")
    return seqs[at], np.cumsum(rows.column("size").to_numpy()[at])


def _steps(limit: int):
    """What a range makes of the open buffer that it is given, for any bytes that this may hold: rows (range, low, and
    the state after it) that count from `low` held bytes to the next row's. Number 0: no buffer closes."""

    def steps(rows: pa.Table) -> pa.Table:
        seqs, upto = _ordered(rows)
        # the first operation to close a buffer, for falling held bytes, then one after the other, for all at once
        place = np.arange(np.searchsorted(upto, 1), min(np.searchsorted(upto, limit) + 1, len(upto)))
        low = np.maximum(limit - upto[place], 0)
        differs = np.diff(low, prepend=limit) != 0
        place, low = place[differs], low[differs]
        number = np.ones(len(place), np.int64)
        while len(more := np.flatnonzero((then := np.searchsorted(upto, upto[place] + limit)) < len(upto))):
            place[more] = then[more]
            number[more] += 1
        if upto[-1] < limit:
            low, number, place = np.append(low, 0), np.append(number, 0), np.append(place, -1)
        differs = np.append((np.diff(place) != 0) | (np.diff(number) != 0), True)  # the lowest of equal ones is the last
        low, number, place = low[differs], number[differs], place[differs]
        rest = place + 1 < len(seqs)
        return pa.table({
            "range": pa.array(np.full(len(place), rows.column("range")[0].as_py()), pa.int64()),
            "low": pa.array(low, pa.int64()),
            "number": pa.array(number, pa.int64()),
            "held": pa.array(upto[-1] - np.where(place < 0, 0, upto[place])),
            "count": pa.array(len(seqs) - 1 - place),
            "first": pa.array(seqs[np.minimum(place + 1, len(seqs) - 1)], pa.int64(), mask=~rest),
        })

    return steps


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state at the begin of each range, from the steps of all ranges in order (by range, then low)."""
    state, span, chosen = (0, 0, 0, None), None, None

    def after():
        number, held, count, first = chosen
        if number:
            return state[0] + number, held, count, first
        return state[0], state[1] + held, state[2] + count, first if state[3] is None else state[3]

    for batch in batches:
        entered = []
        ranges, lows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        bounds = np.append(np.flatnonzero(np.diff(ranges, prepend=-1 if not len(ranges) else ranges[0] - 1)), len(ranges))
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            if ranges[low] != span:
                state, span = after() if chosen else state, ranges[low]
                entered.append((int(span), *state))
            at = low + int(np.searchsorted(lows[low:high], state[1], side="right")) - 1
            if at >= low:  # a range may go on in the next batch
                chosen = tuple(batch.column(c)[at].as_py() for c in range(2, 6))
        if entered:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*entered, strict=True)], names=["range", "number", "held", "count", "first"])


def _closed(limit: int):
    """The buffers that close in a range, given the state at its begin."""

    def closed(rows: pa.Table, entered: pa.Table) -> pa.Table:
        seqs, upto = _ordered(rows)
        number, held, count, first = (entered.column(c)[0].as_py() for c in ("number", "held", "count", "first"))
        at, found = 0, []
        while at < len(seqs):
            base = int(upto[at - 1]) if at else 0
            end = int(np.searchsorted(upto, base + limit - held))
            if end == len(seqs):
                break
            found.append((number, int(seqs[at]) if first is None else first, int(seqs[end]), count + end - at + 1, held + int(upto[end]) - base))
            number, held, count, first, at = number + 1, 0, 0, None, end + 1
        names = ["memtable", "first_seq", "last_seq", "n_ops", "n_bytes"]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 5)], names=names)

    return closed


def freeze_points(ops: DataFrame, limit: int, key: str = "key", value: str = "value", width: int = RANGE) -> DataFrame:
    """(memtable, first_seq, last_seq, n_ops, n_bytes) of closed buffers: an operation that brings the bytes since
    the last freeze to limit or more closes its buffer.

    The fill level carries over from one operation to the next, but a range of `width` sequence numbers can tell
    beforehand what it makes of any fill level, and few different ones come out of it. So ranges are worked through
    side by side, once for these steps and once for the buffers; only the steps, at most as many a range as it has
    operations in its first `limit` bytes, go through one task in order. Sequence numbers are unique and not null.
    """
    if limit < 1:
        raise ValueError("the limit is a positive number of bytes")
    sizes = ops.select(F.floor(F.col("seq") / width).cast("long").alias("range"), F.col("seq").cast("long").alias("seq"), entry_bytes(key, value).alias("size"))
    steps = sizes.groupBy("range").applyInArrow(_steps(limit), f"range long, low long, {STATE}")
    entered = steps.repartition(1).sortWithinPartitions("range", "low").mapInArrow(_entered, f"range long, {STATE}")
    schema = "memtable long, first_seq long, last_seq long, n_ops long, n_bytes long"
    return sizes.groupBy("range").cogroup(entered.groupBy("range")).applyInArrow(_closed(limit), schema)


def assigned(ops: DataFrame, points: DataFrame) -> DataFrame:
    """Operations of closed buffers with their memtable: a join of ranges that are cut to coarse seq buckets first."""
    width = 1024
    spans = points.select("memtable", "first_seq", "last_seq", F.explode(F.sequence(F.floor(F.col("first_seq") / width), F.floor(F.col("last_seq") / width))).alias("_slot"))
    slotted = ops.withColumn("_slot", F.floor(F.col("seq") / width))
    joined = slotted.join(spans, "_slot").where("seq between first_seq and last_seq")
    return joined.select(*ops.columns, "memtable")


def flushed(ops: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """What flushing each memtable writes: the latest operation of each key, tombstones included."""
    both = F.struct("memtable", key).alias("_key")
    out = latest(ops.select(both, "seq", value), "_key", value)
    return out.select("_key.*", "seq", value)

"""Least-recently-used caching as a query over a trace of accesses."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def lru_hits(trace: DataFrame, capacity: int, item: str = "item", at: str = "seq", group: str = "grp") -> DataFrame:
    """at, item, hit: whether an access finds its item in a cache of `capacity` items, one cache for each group.

    What a cache holds depends on all accesses of its group before, so a group is one sorted stream; groups are
    dealt over tasks, and a task holds the items of one cache, not the accesses.
    """

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, OrderedDict()
        for batch in batches:
            hits = []
            for g, i in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if g != own:
                    own, held = g, OrderedDict()
                hits.append(i in held)
                held[i] = None
                held.move_to_end(i)
                if len(held) > capacity:
                    held.popitem(last=False)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(hits, pa.bool_())], names=[at, item, "hit"])

    kinds = dict(trace.dtypes)
    ordered = trace.select(group, at, item).repartition(group).sortWithinPartitions(group, at)
    return ordered.mapInArrow(follow, f"{at} {kinds[at]}, {item} {kinds[item]}, hit boolean")

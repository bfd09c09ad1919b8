"""Global positions of sorted rows without a task that sees them all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise


def _number(names: list[str]):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n))], names=[*batch.schema.names, *names])
            seen += n

    return number


def numbered(df: DataFrame, by: list[str], name: str) -> tuple[DataFrame, str, str, dict[int, int]]:
    """df sorted over range partitions and written to the shared folder with two columns more, their names (the part,
    the row in the part), and the number of rows before each part. Only one count per partition reaches the driver."""
    part, place = fresh(df.columns, "part", "place")
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {part} int, {place} long"
    table = materialise(ordered.mapInArrow(_number([part, place]), schema), name)
    before, total = {}, 0
    for k, n in sorted(table.groupBy(part).agg(F.count("*")).collect()):
        before[k] = total
        total += n
    return table, part, place, before

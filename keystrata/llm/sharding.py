"""Sharding by minimax contiguous partition.

Groups of equal texts stay together. In the order of the groups' digests, the smallest shard capacity is found
for which a greedy pass needs no more than the given number of shards. Where a single group is as large as that
capacity it is alone in its shard in every such partition; it is set apart, and the search goes on over the
segments between with the shards that remain. Then the cuts of the greedy pass are made, and shards that it left
over halve the largest shards of several groups. The binary search runs on the driver over a bounded table of group
boundaries; where the boundaries that it knows don't decide, Spark is asked for boundaries in the open intervals
only, until they do. The result is that of a binary search over all groups.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Boundaries asked for in one round, which bounds what the driver holds of the groups.
POINTS = 8192


class Boundaries:
    """What is known of the ends of groups, as numbers of bytes from the start.

    ends: known ends, ascending; solid[i]: no other end lies between ends[i] and ends[i + 1].
    segments: (start, end) of what is left between the groups set apart, ascending.
    """

    def __init__(self, total: int):
        self.ends, self.solid, self.total = [0, total], [False], total
        self.segments = [(0, total)]

    def set_apart(self, start: int, end: int) -> None:
        """Take the group from start to end out of the segments."""
        known = dict(zip(self.ends, [*self.solid, False], strict=True))
        known.setdefault(end, False)
        known[start] = True
        self.ends = sorted(known)
        self.solid = [known[e] for e in self.ends[:-1]]
        split = [piece for a, b in self.segments for piece in ([(a, start), (end, b)] if a <= start and end <= b else [(a, b)])]
        self.segments = [(a, b) for a, b in split if a < b]

    def add(self, found: list[tuple[int, int, int]]) -> None:
        """found: (first end, last end, number of ends) of disjoint buckets that hold all ends of an open interval."""
        known = dict.fromkeys(self.ends, False)
        for low, end, solid in zip(self.ends, self.ends[1:], self.solid, strict=False):
            known[low] = solid
        opened = [(a, b) for a, b, s in zip(self.ends, self.ends[1:], self.solid, strict=False) if not s]
        found = sorted(found)
        firsts = [f[0] for f in found]
        for a, b in opened:
            inside = found[bisect_right(firsts, a) : bisect_right(firsts, b)]
            if not inside:
                continue
            known[a] = True  # the next known end follows directly
            for k, (first, last, n) in enumerate(inside):
                known[first] = known.get(first, False)
                if first != last:
                    known[first] = n == 2
                if last != b:
                    known[last] = True
        self.ends = sorted(known)
        self.solid = [known[e] for e in self.ends[:-1]]

    def last_end(self, limit: int) -> tuple[int, int]:
        """Lower and upper bound of the last group end that is at most `limit`."""
        if limit >= self.total:
            return self.total, self.total
        i = bisect_right(self.ends, limit) - 1
        return self.ends[i], self.ends[i] if self.solid[i] or self.ends[i] == limit else limit

    def cuts(self, capacity: int, shards: int, upper: bool) -> list[int]:
        """Where the greedy pass over the segments stands after each of `shards` steps; the total once it is through."""
        starts = [a for a, _ in self.segments]
        out = starts[:1]
        for _ in range(shards):
            k = bisect_right(starts, out[-1]) - 1
            if out[-1] >= self.segments[-1][1]:
                out.append(self.total)
                continue
            end = min(self.last_end(out[-1] + capacity)[upper], self.segments[k][1])
            through = end == self.segments[k][1]
            out.append(end if not through else starts[k + 1] if k + 1 < len(starts) else self.total)
        return out

    def capacity(self, shards: int, upper: bool) -> int:
        """The smallest capacity for which the greedy pass gets to the end, by the lower or upper bounds."""
        low, high = max(1, -(-sum(b - a for a, b in self.segments) // shards)), self.total
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, upper)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def open_windows(self, shards: int) -> tuple[int, list[tuple[int, int]]]:
        """The capacity by the lower bounds, and the undecided intervals that can hold a cut; none when it is exact."""
        sure, least = self.capacity(shards, False), self.capacity(shards, True)
        windows = []
        for low, high in zip(self.cuts(least, shards, False), self.cuts(sure, shards, True), strict=True):
            i = max(0, bisect_right(self.ends, low) - 1)
            while i < len(self.solid) and self.ends[i] <= high:
                if not self.solid[i]:
                    windows.append((self.ends[i], self.ends[i + 1]))
                i += 1
        if sure == least and self.cuts(sure, shards, False) == self.cuts(sure, shards, True):
            return sure, []
        return sure, sorted(set(windows))


def _ends_between(ends: DataFrame, windows: list[tuple[int, int]], limits: list[int]) -> list[tuple[int, int, int]]:
    """(first end, last end, number of ends) in each bucket between limits that has any in the windows, their ends included."""
    limits = np.unique(np.asarray(limits, np.int64))

    def bucket(batches: Iterator[pa.RecordBatch], limits=limits, low=np.asarray([w[0] for w in windows]), high=np.asarray([w[1] for w in windows])) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            end = batch.column("end").to_numpy()
            at = np.searchsorted(low, end, side="left") - 1
            inside = (at >= 0) & (end <= high[np.maximum(at, 0)])
            end = end[inside]
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(limits, end, side="left")), pa.array(end)], names=["bucket", "end"])

    near = ends.where(F.col("end").between(int(limits[0]), int(limits[-1]))).select("end")
    found = near.mapInArrow(bucket, "bucket long, end long").groupBy("bucket").agg(F.min("end"), F.max("end"), F.count("*")).collect()
    return [(r[1], r[2], r[3]) for r in found]


def minimax_cuts(ends: DataFrame, total: int, shards: int, points: int = POINTS, known: Boundaries | None = None) -> tuple[int, list[int]]:
    """(capacity, cut positions) for the group ends in column `end` of a table that is cheap to scan, over the segments of `known`.

    Each round sends at most `points` bucket limits to Spark and gets three numbers for each bucket back.
    """
    known = known or Boundaries(total)
    while total:
        capacity, windows = known.open_windows(shards)
        if not windows:
            return capacity, known.cuts(capacity, shards, False)[1:]
        width = sum(b - a for a, b in windows)
        limits: list[int] = []
        for a, b in windows:
            n = max(1, min(b - a, points * (b - a) // max(1, width)))
            limits += [a + (b - a) * k // n for k in range(n + 1)]
        known.add(_ends_between(ends, windows, limits))
    return 0, [0] * shards


def halved(ends: DataFrame, pieces: list[tuple[int, int]], spare: int) -> list[tuple[int, int]]:
    """The pieces (start, end), of which the largest of several groups are cut at the group end nearest their middle, `spare` times."""
    middle: dict[tuple[int, int], int | None] = {}  # None: a single group
    while spare:
        asked = sorted(p for p in pieces if p not in middle)
        if asked:
            found = _ends_between(ends, asked, [x for a, b in asked for x in (a, (a + b) // 2, b)])
            inner = sorted({e for first, last, _ in found for e in (first, last)})
            for a, b in asked:
                own = inner[bisect_right(inner, a) : bisect_left(inner, b)]
                middle[a, b] = min(own, key=lambda e: abs(2 * e - a - b), default=None)
        while spare:
            a, b = max((p for p in pieces if middle.get(p, 0) is not None), key=lambda p: (p[1] - p[0], -p[0]), default=(0, 0))
            if a == b:
                return sorted(pieces)  # fewer groups than shards
            if (a, b) not in middle:
                break
            pieces = [p for p in pieces if p != (a, b)] + [(a, middle[a, b]), (middle[a, b], b)]
            spare -= 1
    return sorted(pieces)


def balanced_cuts(ends: DataFrame, largest: list[tuple[int, int]], total: int, shards: int, points: int = POINTS) -> list[int]:
    """Ends of the shards; largest: (bytes, end) of as many of the largest groups as there are shards, in falling order."""
    known, alone, pieces = Boundaries(total), [], []
    while known.segments and total:
        left = shards - len(alone)
        capacity, cuts = minimax_cuts(ends, total, left, points, known)
        full = [(end - size, end) for size, end in largest if size == capacity and (end - size, end) not in alone]
        if full:
            alone += full
            for start, end in full:
                known.set_apart(start, end)
            continue
        starts = [known.segments[0][0], *cuts]
        segment = [b for _, b in known.segments]
        # a step that went through its segment ends there, not at the next segment's start
        pieces = [(a, min(b, segment[bisect_right(segment, a)])) for a, b in zip(starts, starts[1:], strict=False) if a < segment[-1]]
        break
    pieces = halved(ends, sorted([*pieces, *alone]), shards - len(alone) - len(pieces)) if total else []
    return [b for _, b in pieces] + [total] * (shards - len(pieces))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the part, the row in the part, the bytes up to and with the row, and whether the next row of the part is of another group."""
    part, rows, total, held = TaskContext.get().partitionId(), 0, 0, None

    def made(batch, after):
        nonlocal rows, total
        size = batch.column("size").to_numpy()
        digest = batch.column("digest")
        shifted = pa.concat_arrays([digest.slice(1), pa.array([after], digest.type)])
        last = pc.fill_null(pc.not_equal(digest, shifted), True)
        upto = total + np.cumsum(size)
        n = batch.num_rows
        out = pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(rows, rows + n)), pa.array(upto), last],
            names=[*batch.schema.names, "part", "place", "upto", "last"],
        )
        rows, total = rows + n, int(upto[-1])
        return out

    for batch in batches:
        if batch.num_rows:
            if held is not None:
                yield made(held, batch.column("digest")[0].as_py())
            held = batch
    if held is not None:
        yield made(held, None)


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, points: int = POINTS) -> DataFrame:
    """Shard of every row of docs, so that the largest shard is as small as whole groups of equal texts allow.

    The same holds for the other shards once groups as large as the largest shard have theirs to themselves.

    Returns doc_id, size (UTF-8 bytes of the text plus `overhead`), text_crc32, shard, slot (gapless from 0 in
    the shard) and group_digest. Null text: no bytes, and all null texts are one group, apart from empty ones.
    Null ids come first in their group; repeated rows keep a slot each. Fewer groups than shards leave shards
    empty, otherwise all are used; an empty table gives no rows. Other columns are not read. Groups follow in the order of the SHA-256 of their text, so hot groups are spread over
    range partitions, and only one row per partition, the largest groups, one for each shard, and `points` boundaries
    a round reach the driver.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("")).alias("digest"),
    )
    by = ["digest", "doc_id"]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = materialise(ordered.mapInArrow(_sums, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", part int, place long, upto long, last boolean"), "shard-rows")

    parts = sorted(placed.groupBy("part").agg(F.count("*"), F.max("upto"), F.min("digest"), F.max("digest")).collect())
    if not parts:
        return placed.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.col("digest").alias("group_digest"))
    before, rows_so_far, bytes_so_far = [], 0, 0
    for k, (part, n, size, _, last) in enumerate(parts):
        split = k + 1 < len(parts) and parts[k + 1][3] == last  # the group goes on in the next part
        before.append((part, rows_so_far, bytes_so_far, n - 1 if split else -1))
        rows_so_far, bytes_so_far = rows_so_far + n, bytes_so_far + size
    offsets = spark.createDataFrame(before, "part int, rows_before long, bytes_before long, open_place long")
    placed_at = placed.join(F.broadcast(offsets), "part")  # one row per partition
    end = (F.col("bytes_before") + F.col("upto")).alias("end")
    ends = materialise(placed_at.where(F.col("last") & (F.col("place") != F.col("open_place"))).select(end, (F.col("rows_before") + F.col("place") + 1).alias("rows")), "shard-ends")
    groups = placed_at.groupBy("digest").agg(F.sum("size").alias("bytes"), F.max(end).alias("end"))
    largest = [tuple(r) for r in groups.select("bytes", "end").orderBy(F.desc("bytes"), "end").limit(shards).collect()]
    cuts = balanced_cuts(ends, largest, bytes_so_far, shards, points)
    rows_at = dict(ends.where(F.col("end").isin([c for c in set(cuts) if c])).collect()) | {0: 0}
    discard(spark, ends)

    started = [0, *cuts[:-1]]
    first_rows = F.array(*[F.lit(rows_at[c]) for c in started]).cast("array<long>")
    start = F.col("bytes_before") + F.col("upto") - F.col("size")
    # of shards that start at one place all but the last are empty
    shard = sum((start >= F.lit(c)).cast("int") for c in started[1:]) if shards > 1 else F.lit(0)
    return placed_at.select(
        "doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), (F.col("rows_before") + F.col("place")).alias("row"), F.col("digest").alias("group_digest"),
    ).select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.get(first_rows, F.col("shard"))).alias("slot"), "group_digest")

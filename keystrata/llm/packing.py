"""Packing of token pieces into sequences: Martello-Toth dominance reduction, then best fit.

Piece lengths are whole numbers up to the capacity, so the instance is the histogram of lengths. The plan is
made on the driver over that histogram (at most `capacity` entries however many pieces there are) as bins of one
kind with a multiplicity; Spark then gives every piece its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, thrifty
from .ordering import numbered
from .tokenise import encoder

CAPACITY = 2048
#: Pieces that a worker remembers here, if not told otherwise.
REMEMBERED = 500_000
#: Bytes of ids in a batch of pieces, about.
HELD_BYTES = 8 << 20


def largest_pair(lengths: list[int], counts: dict[int, int], room: int) -> int:
    """Largest sum of two available pieces that is at most room; 0 if no two fit."""
    best, low, high = 0, 0, bisect_right(lengths, room) - 1
    while low <= high:
        total = lengths[low] + lengths[high]
        if total > room:
            high -= 1
        elif low == high:
            return max(best, total) if counts[lengths[low]] > 1 else best
        else:
            best = max(best, total)
            if counts[lengths[high]] > 1 and 2 * lengths[high] <= room:
                best = max(best, 2 * lengths[high])
            low += 1
    return best


def reduce_dominated(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix sets that some best packing has, and take them out of counts: (lengths of the bin, number of bins).

    For the largest piece j with room r beside it, and k the largest piece that fits: {j} if nothing fits; {j, k}
    if k fills the room; {j, k} if nothing fits beside both and no two pieces that fit in the room together are
    larger than k (with room for three pieces no pair is fixed). Each such set can take the place of whatever
    shares a bin with j, without more bins. Pieces for which no set is proven stay.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    lengths = sorted(counts)
    for j in sorted(counts, reverse=True):
        while counts.get(j):
            room, own = capacity - j, counts[j]
            at = bisect_right(lengths, room)
            while at and (counts.get(lengths[at - 1], 0) == 0 or (lengths[at - 1] == j and own < 2)):
                if counts.get(lengths[at - 1], 0) == 0:
                    lengths.pop(at - 1)
                at -= 1
            if not at:
                fixed.append(((j,), own))
                counts[j] = 0
                break
            k = lengths[at - 1]
            smallest = next(x for x in lengths if counts.get(x) and (x != j or own > 1))
            if k < room:
                if k + smallest <= room:
                    break
                rest = {x: counts[x] - (x == j) for x in lengths[:at] if counts.get(x)}
                rest = {x: n for x, n in rest.items() if n > 0}
                fits = sorted(rest)
                three = sum(sorted(x for x in fits[:3] for _ in range(min(3, rest[x])))[:3]) if sum(min(3, rest[x]) for x in fits[:3]) >= 3 else room + 1
                if three <= room or largest_pair(fits, rest, room) > k:
                    break
            n = own // 2 if k == j else min(own, counts[k])
            fixed.append(((j, k), n))
            counts[j] -= n
            counts[k] -= n
    for x in [x for x, n in counts.items() if not n]:
        del counts[x]
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit over the lengths in falling order, many pieces and bins of one kind at a time."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by room left
    rooms: list[int] = []

    def put(content: tuple[int, ...], n: int) -> None:
        if n:
            room = capacity - sum(content)
            if room not in bins:
                bins[room] = []
                insort(rooms, room)
            bins[room].append((content, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_right(rooms, length - 1)
            if at == len(rooms):
                each = capacity // length
                put((length,) * each, left // each)
                put((length,) * (left % each), 1 if left % each else 0)
                break
            room = rooms[at]
            content, n = bins[room].pop()
            if not bins[room]:
                del bins[room]
                rooms.pop(at)
            each = room // length  # a bin that took a piece stays the best fit while it has room
            full = min(n, left // each)
            put(content + (length,) * each, full)
            left -= full * each
            n -= full
            if n and left < each:
                put(content + (length,) * left, 1 if left else 0)
                n -= left > 0
                left = 0
            put(content, n)
    return [kind for kinds in bins.values() for kind in kinds]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bins for a histogram of lengths: (lengths in the bin, number of such bins)."""
    counts = {int(k): int(n) for k, n in histogram.items() if n}
    return reduce_dominated(counts, capacity) + best_fit(counts, capacity)


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY, keeps_space: bool = False, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of at most `capacity` ids of every text with end_id behind it: doc_id, piece, start, length, ids_crc32
    and, if asked for, token_ids (binary, little-endian unsigned 32-bit). Null and empty texts: the end id only. Null
    ids are kept as null, repeated rows are cut as often as they stand, an empty table gives no rows, and other
    columns of docs are not read. A worker remembers the ids of at most `remembered` white-space pieces; further ones are encoded each time."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["token_ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    step, end = 4 * capacity, struct.pack("<I", end_id)

    def made(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    @thrifty
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, keeps_space, remembered)
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            held = 0
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.all_ids(batch.column(1)), strict=True):
                ids += end
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    for column, value in zip(columns, (doc_id, at // step, at // 4, len(piece) // 4, zlib.crc32(piece), piece), strict=False):
                        column.append(value)
                held += len(ids) * with_ids
                if held >= HELD_BYTES:
                    yield made(columns)
                    columns, held = [[] for _ in names], 0
            yield made(columns)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", token_ids binary" * with_ids)


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces with columns sequence_id and offset (tokens before it in its sequence, gapless from 0).

    pieces needs a column `length` from 1 to capacity and the columns of `order`, which break ties; further columns
    are kept, whatever their names, but sequence_id and offset are replaced where pieces has them. Other lengths and
    null ones raise. Repeated rows are packed as often as they stand, null ids like any. An empty table gives no
    rows. Pieces are sorted by length over range partitions; the driver gets a count per partition and the histogram
    of lengths.
    """
    pieces = pieces.drop("sequence_id", "offset")
    by = ["length", *order]
    # written first: sampling for the ranges would make the pieces, and so the tokens, a second time
    written = materialise(pieces, "pieces")
    rows, part_name, place_name, before = numbered(written, by, "pack-pieces")
    discard(pieces.sparkSession, written)
    histogram = dict(rows.groupBy("length").agg(F.count("*")).collect())
    if any(k is None or not 1 <= k <= capacity for k in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    first, total = {}, 0
    for length in sorted(histogram):
        first[length] = total
        total += histogram[length]

    # spans of ranks (over all pieces in order) that lie in bins of one kind at one offset
    spans, next_rank, sequence = [], dict(first), 0
    for content, n in plan(histogram, capacity):
        offset = 0
        for length in content:
            spans.append((next_rank[length], sequence, offset))
            next_rank[length] += n
            offset += length
        sequence += n
    spans.sort()
    start, bins, offsets = (np.asarray(c, np.int64) for c in zip(*spans, strict=True)) if spans else (np.zeros(1, np.int64),) * 3
    rows_before = np.zeros(max(before, default=0) + 1, np.int64)
    for part, n in before.items():
        rows_before[part] = n

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rank = rows_before[batch.column(part_name).to_numpy()] + batch.column(place_name).to_numpy()
                at = np.searchsorted(start, rank, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-2], pa.array(bins[at] + rank - start[at]), pa.array(offsets[at])],
                    names=[*batch.schema.names[:-2], "sequence_id", "offset"],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return rows.mapInArrow(place, schema)

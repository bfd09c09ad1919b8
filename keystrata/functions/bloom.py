"""Bloom filters: sizing, building, encoding and probing, with seeded 32-bit Murmur3."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bits_for(n: int, false_positive: float) -> int:
    """Bits for n items: -n ln f / ln(2)^2, cut to a whole number."""
    return int(-n * math.log(false_positive) / math.log(2) ** 2)


def hashes_for(bits: int, n: int) -> int:
    return int(bits * math.log(2) / n)


def bits_column(n: Column, false_positive: float) -> Column:
    return F.floor(-n * F.lit(math.log(false_positive)) / F.lit(math.log(2) ** 2)).cast("long")


def murmur3(data: bytes, seed: int) -> int:
    """32-bit Murmur3 of the public definition."""
    c1, c2, mask = 0xCC9E2D51, 0x1B873593, 0xFFFFFFFF
    h, tail = seed, len(data) & ~3
    rotl = lambda x, r: ((x << r) | (x >> (32 - r))) & mask
    for i in range(0, tail, 4):
        h = (rotl(h ^ rotl(int.from_bytes(data[i : i + 4], "little") * c1 & mask, 15) * c2 & mask, 13) * 5 + 0xE6546B64) & mask
    if len(data) > tail:
        h ^= rotl(int.from_bytes(data[tail:], "little") * c1 & mask, 15) * c2 & mask
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


def murmur3_all(keys: list[bytes], seeds: range) -> np.ndarray:
    """murmur3 of each key (row) for each seed (column), computed for keys of one length at once."""
    out = np.zeros((len(keys), len(seeds)), np.uint32)
    lengths = np.fromiter(map(len, keys), np.int64, len(keys))
    c1, c2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)
    rotl = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        padded = b"".join(keys[i] + bytes(-n % 4) for i in rows.tolist())
        blocks = np.frombuffer(padded, "<u4").reshape(len(rows), -(-n // 4)).astype(np.uint32)
        h = np.tile(np.asarray(seeds, np.uint32), (len(rows), 1))
        for k in range(blocks.shape[1]):
            h ^= (rotl(blocks[:, k] * c1, 15) * c2)[:, None]
            if 4 * k + 4 <= n:
                h = rotl(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(n)
        h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        out[rows] = h ^ h >> np.uint32(16)
    return out


class Bits:
    """A bit array with a byte form: bit i is bit i % 8 of byte i // 8."""

    def __init__(self, n: int, data: bytes | None = None):
        self.n, self.data = n, np.zeros(-(-n // 8), np.uint8) if data is None else np.frombuffer(data, np.uint8).copy()

    def _check(self, i: int) -> None:
        if not 0 <= i < self.n:
            raise IndexError(i)

    def get(self, i: int) -> bool:
        self._check(i)
        return bool(self.data[i >> 3] >> (i & 7) & 1)

    def set(self, i: int) -> None:
        self._check(i)
        self.data[i >> 3] |= 1 << (i & 7)

    def unset(self, i: int) -> None:
        self._check(i)
        self.data[i >> 3] &= ~(1 << (i & 7)) & 0xFF

    def toggle(self, i: int) -> None:
        self._check(i)
        self.data[i >> 3] ^= 1 << (i & 7)

    def clear(self) -> None:
        self.data[:] = 0

    def encode(self) -> bytes:
        return self.data.tobytes()


class Bloom:
    """Filter for n items; encode() and decode() round-trip."""

    def __init__(self, n: int, false_positive: float = 0.01, data: bytes | None = None):
        self.bits = Bits(max(8, bits_for(max(1, n), false_positive)), data)
        self.n, self.false_positive = n, false_positive
        self.hashes = max(1, hashes_for(self.bits.n, max(1, n)))

    def places(self, key: bytes) -> list[int]:
        return [murmur3(key, seed) % self.bits.n for seed in range(self.hashes)]

    def all_places(self, keys: list[bytes]) -> np.ndarray:
        return murmur3_all(keys, range(self.hashes)).astype(np.int64) % self.bits.n

    def insert_all(self, keys: list[bytes]) -> None:
        at = self.all_places(keys).reshape(-1)
        np.bitwise_or.at(self.bits.data, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def contains_all(self, keys: list[bytes]) -> np.ndarray:
        at = self.all_places(keys)
        return (self.bits.data[at >> 3] >> (at & 7) & 1).all(axis=1)

    def insert(self, key: bytes) -> None:
        for i in self.places(key):
            self.bits.set(i)

    def contains(self, key: bytes) -> bool:
        return all(self.bits.get(i) for i in self.places(key))

    def encode(self) -> bytes:
        return self.bits.encode()

    @classmethod
    def decode(cls, n: int, false_positive: float, data: bytes) -> Bloom:
        return cls(n, false_positive, data)


def _stretches(batch: pa.RecordBatch, run: str) -> Iterator[tuple[object, pa.RecordBatch]]:
    """The rows of each run of a batch that is sorted by run."""
    names, low = batch.column(run).to_pylist(), 0
    for high in range(1, len(names) + 1):
        if high == len(names) or names[high] != names[low]:
            yield names[low], batch.slice(low, high - low)
            low = high


def _binary(column: pa.Array) -> list[bytes]:
    return [x.encode() if isinstance(x, str) else x for x in column.to_pylist()]


def build_filters(entries: DataFrame, run: str = "run", key: str = "k", false_positive: float = 0.01) -> DataFrame:
    """(run, n, filter): each task sets the bits of its keys, and the bits of a run are joined by `or`. A task holds
    the filter of one run, as its rows are sorted by run."""
    sizes = entries.groupBy(run).agg(F.count("*").alias("n"))
    sized = entries.select(run, F.col(key).cast("binary").alias("k")).join(sizes, run).sortWithinPartitions(run)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, made = None, None

        def part() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([own]), pa.array([made.n], pa.int64()), pa.array([made.encode()])], names=[run, "n", "part"])

        for batch in batches:
            for name, rows in _stretches(batch, run):
                if made is None or name != own:
                    if made is not None:
                        yield part()
                    own, made = name, Bloom(rows.column("n")[0].as_py(), false_positive)
                made.insert_all(_binary(rows.column("k")))
        if made is not None:
            yield part()

    def joined(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(p, np.uint8) for p in table.column("part").to_pylist()]
        return pa.table({run: table.column(run)[:1], "n": table.column("n")[:1], "filter": pa.array([np.bitwise_or.reduce(parts).tobytes()])})

    kind = dict(entries.dtypes)[run]
    parts = sized.mapInArrow(build, f"{run} {kind}, n long, part binary")
    return parts.groupBy(run).applyInArrow(joined, f"{run} {kind}, n long, filter binary")


def probe(filters: DataFrame, keys: DataFrame, run: str = "run", key: str = "k", false_positive: float = 0.01) -> DataFrame:
    """(run, key, maybe) for the rows (run, key) of keys."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, None
        for batch in batches:
            found = []
            for name, rows in _stretches(batch, run):
                if held is None or name != own:
                    own, held = name, Bloom.decode(rows.column("n")[0].as_py(), false_positive, rows.column("filter")[0].as_py())
                found.append(held.contains_all(_binary(rows.column(key))))
            yield pa.RecordBatch.from_arrays([batch.column(run), batch.column(key), pa.array(np.concatenate(found) if found else [], pa.bool_())], names=[run, key, "maybe"])

    kinds = dict(keys.dtypes)
    return keys.join(filters, run).sortWithinPartitions(run).mapInArrow(ask, f"{run} {kinds[run]}, {key} {kinds[key]}, maybe boolean")

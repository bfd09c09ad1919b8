"""Blocks of sorted runs: cutting with shared prefixes, block index, checksums."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ENTRY_OVERHEAD


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def block_layout(runs: DataFrame, block_bytes: int, run: str = "run", key: str = "k", value: str = "v") -> DataFrame:
    """run, key, block, overlap (bytes shared with the block's first key) for each entry of key-sorted runs.

    An entry goes to the next block if the block has entries and its offsets (two bytes each, and two), data, the
    entry's key and value and six bytes exceed block_bytes. A run is bounded by the run size, so a task holds it.
    """

    def cut(entries: pd.DataFrame) -> pd.DataFrame:
        entries = entries.sort_values(key, key=lambda s: s.map(lambda x: x.encode() if isinstance(x, str) else x), kind="stable")
        blocks, overlaps, block, n, data, first = [], [], 0, 0, 0, b""
        for k, v in zip(entries[key], entries[value], strict=True):
            k = k.encode() if isinstance(k, str) else bytes(k)
            size = len(v.encode() if isinstance(v, str) else bytes(v or b""))
            if n and 2 + 2 * n + data + len(k) + size + ENTRY_OVERHEAD > block_bytes:
                block, n, data = block + 1, 0, 0
            overlap = common_prefix(first, k) if n else 0
            first = first if n else k
            data += ENTRY_OVERHEAD + len(k) - overlap + size
            n += 1
            blocks.append(block), overlaps.append(overlap)
        return entries[[run, key]].assign(block=blocks, overlap=overlaps)

    kinds = dict(runs.dtypes)
    return runs.select(run, key, value).groupBy(run).applyInPandas(cut, f"{run} {kinds[run]}, {key} {kinds[key]}, block int, overlap int")


def block_index(layout: DataFrame, run: str = "run", key: str = "k") -> DataFrame:
    return layout.groupBy(run, "block").agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count("*").alias("n"))


def locate(index: DataFrame, keys: DataFrame, run: str = "run", key: str = "k") -> DataFrame:
    """The block of each run that may hold each key: the last one whose first key is not above it, if its last key isn't below."""
    joined = keys.join(index, run).where(F.col(key).between(F.col("first_key"), F.col("last_key")))
    return joined.select(run, key, "block")


def block_checksums(entries: DataFrame, layout: DataFrame, run: str = "run", key: str = "k", value: str = "v") -> DataFrame:
    """CRC-32 of each block's entries in key order, each as the length of its key, ":", the key, and the same for its
    value, so that other entries have other bytes; a block is bounded by its size."""
    rows = layout.join(entries, [run, key]).groupBy(run, "block").agg(F.array_sort(F.collect_list(F.struct(key, value))).alias("e"))
    framed = lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(":"), x.cast("string"))
    data = F.concat_ws("", F.transform("e", lambda x: F.concat(framed(x[key]), framed(x[value]))))
    return rows.select(run, "block", F.crc32(data).alias("crc"))



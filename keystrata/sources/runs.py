"""Sorted runs as Parquet: written by key ranges, read with pushed-down key predicates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ENTRY_OVERHEAD, OPS, Options, Run


#: A task of write_runs() writes about so many bytes, in so many runs at most, or one larger run.
TASK_BYTES, MOST_RUNS = 4 << 20, 64


def run_bytes() -> F.Column:
    return F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + ENTRY_OVERHEAD)


def write_runs(state: DataFrame, root: str, next_id: int, level: int, options: Options, tier: int = 0, most_bytes: int | None = None) -> list[Run]:
    """Write resolved rows (unique keys) as disjoint key-sorted runs of options.target_run_bytes or less, about.

    The rows are persisted until they are written, as their own bytes and not those of the inputs give the number of
    runs: a log has many operations of a key. One folder per write and one file per run; a task sorts a range and
    cuts it by rows into several runs where these are small. Statistics of the files, a row each, come back.
    most_bytes: what the rows can have at most; persisted rows keep the partitions of their shuffle, which are many
    and nearly empty where the inputs are small.
    """
    state = (state if most_bytes is None else state.coalesce(max(1, -(-most_bytes // TASK_BYTES)))).persist()
    try:
        n_rows, n_bytes = state.agg(F.count("*"), run_bytes()).first()
        return _write(state, f"{root}/runs/{uuid.uuid4().hex}", n_rows, n_bytes, next_id, level, options, tier) if n_rows else []
    finally:
        state.unpersist()


def _write(state: DataFrame, folder: str, n_rows: int, n_bytes: int, next_id: int, level: int, options: Options, tier: int) -> list[Run]:
    spark = state.sparkSession
    target = options.target_run_bytes
    rows = max(1, n_rows * target // n_bytes)
    a_task = max(1, min(MOST_RUNS, TASK_BYTES // target))
    writer = state.repartitionByRange(-(-n_bytes // (a_task * target)), "key").sortWithinPartitions("key").write
    if a_task > 1 and n_bytes > target:
        writer = writer.option("maxRecordsPerFile", rows)
    writer = writer.option("parquet.block.size", options.row_group_bytes).option("parquet.page.size", max(1024, options.block_bytes))
    writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", options.bloom_false_positive)
    # without a number of keys each filter has 1 MB; twice the rows, as ranges are about equal only
    writer = writer.option("parquet.bloom.filter.expected.ndv#key", 2 * min(rows, n_rows))
    # a dictionary would keep the bloom filter from being written; version 2 shares key prefixes
    writer.option("parquet.enable.dictionary#key", "false").option("parquet.writer.version", "v2").parquet(folder)
    stats = (
        spark.read.schema(OPS).parquet(folder).groupBy(F.col("_metadata.file_path").alias("path"))
        .agg(F.hex(F.min("key")).alias("first"), F.hex(F.max("key")).alias("last"), F.count("*").alias("n"), run_bytes().alias("b"), F.max("seq").alias("seq"))
        .collect()
    )
    return [Run(next_id + i, level, s["path"], s["first"], s["last"], s["n"], s["b"], s["seq"], tier) for i, s in enumerate(sorted(stats, key=lambda s: s["first"]))]


def read_runs(spark: SparkSession, runs: list[Run]) -> DataFrame:
    if not runs:
        return spark.createDataFrame([], OPS)
    return spark.read.schema(OPS).parquet(*[r.path for r in runs])


def run_index(entries: DataFrame, run: str = "run", key: str = "k", value: str = "v") -> DataFrame:
    """first_key, last_key, n_rows and n_bytes of each run."""
    size = F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + ENTRY_OVERHEAD
    return entries.groupBy(run).agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count("*").alias("n_rows"), F.sum(size).alias("n_bytes"))

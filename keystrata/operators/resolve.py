"""Merging of operations and runs: one row per key, the latest wins, tombstones are dropped last."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Bound


def is_tombstone(value: Column) -> Column:
    return value.isNull() | (F.octet_length(value) == 0)


def latest(ops: DataFrame, key: str = "key", value: str = "value", order: str = "seq") -> DataFrame:
    """The row of each key with the largest order; partial aggregation before the shuffle, so hot keys cost a row a task."""
    top = F.max_by(F.struct(*[c for c in ops.columns if c != key]), order)
    return ops.groupBy(key).agg(top.alias("_top")).select(key, "_top.*")


def visible(state: DataFrame, value: str = "value") -> DataFrame:
    """Resolved state without deleted keys."""
    return state.where(~is_tombstone(F.col(value)))


def within(ops: DataFrame, lower: Bound, upper: Bound, key: str = "key") -> DataFrame:
    return ops.where(lower.above(F.col(key)) & upper.below(F.col(key)))


def scan(ops: DataFrame, lower: Bound = Bound(), upper: Bound = Bound(), key: str = "key", value: str = "value", order: str = "seq") -> DataFrame:
    """Live rows of a key range in key order; the range reaches the scan."""
    return visible(latest(within(ops, lower, upper, key), key, value, order), value).orderBy(key)


def get(ops: DataFrame, wanted, key: str = "key", value: str = "value", order: str = "seq") -> DataFrame:
    """The live row of one key, or none."""
    return visible(latest(ops.where(F.col(key) == F.lit(wanted)), key, value, order), value)


def multi_get(ops: DataFrame, keys: DataFrame, key: str = "key", value: str = "value", order: str = "seq") -> DataFrame:
    """Live rows of the keys in a DataFrame with column `key`."""
    return visible(latest(ops.join(keys.select(key), key, "left_semi"), key, value, order), value)


def merge_runs(runs: list[DataFrame], key: str = "key") -> DataFrame:
    """K-way merge: the row of the last run that has a key; tombstones are kept. Runs have unique keys."""
    ranked = reduce(DataFrame.unionByName, [r.withColumn("_rank", F.lit(i)) for i, r in enumerate(runs)])
    return latest(ranked, key, order="_rank").drop("_rank")


def kth_versions(runs: DataFrame, key: str = "key", rank: str = "rank") -> DataFrame:
    """All versions of a key numbered from the newest (1)."""
    return runs.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(rank))))


def shadow(above: DataFrame, below: DataFrame, key: str = "key") -> DataFrame:
    """Two-way merge of resolved inputs: rows of `above`, and those of `below` whose key it lacks."""
    return above.unionByName(below.join(above.select(key), key, "left_anti"))


def concat_runs(runs: list[DataFrame], start=None, key: str = "key") -> DataFrame:
    """Runs with disjoint ranges after each other, from a key on."""
    whole = reduce(DataFrame.unionByName, runs)
    return whole if start is None else whole.where(F.col(key) >= F.lit(start))


def disjoint(index: DataFrame) -> DataFrame:
    """Neighbouring runs of a level (columns run, first_key, last_key) that overlap; none in a sound level. The index has a row per run."""
    order = Window.partitionBy("level").orderBy("first_key")
    return index.withColumn("before", F.lag("last_key").over(order)).where("before >= first_key")

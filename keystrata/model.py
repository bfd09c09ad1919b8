"""Records, bounds and options."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An operation: an empty value deletes the key; the largest seq of a key is its latest operation.
OPS = T.StructType([T.StructField("seq", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())])

#: Bytes of an entry besides its key and value in the reference block layout.
ENTRY_OVERHEAD = 6


@dataclass(frozen=True)
class Bound:
    """One end of a key range: kind is "included", "excluded" or "unbounded"."""

    kind: str = "unbounded"
    key: object = None

    @classmethod
    def included(cls, key) -> Bound:
        return cls("included", key)

    @classmethod
    def excluded(cls, key) -> Bound:
        return cls("excluded", key)

    def above(self, column: Column) -> Column:
        """Rows that satisfy this as a lower bound."""
        return {"unbounded": F.lit(True), "included": column >= F.lit(self.key), "excluded": column > F.lit(self.key)}[self.kind]

    def below(self, column: Column) -> Column:
        """Rows that satisfy this as an upper bound."""
        return {"unbounded": F.lit(True), "included": column <= F.lit(self.key), "excluded": column < F.lit(self.key)}[self.kind]

    def admits_run(self, first, last, lower: bool) -> bool:
        """Whether a run with these end keys can hold a key within the bound."""
        if self.kind == "unbounded":
            return True
        if lower:
            return last >= self.key if self.kind == "included" else last > self.key
        return first <= self.key if self.kind == "included" else first < self.key


@dataclass(frozen=True)
class Simple:
    """Levels merged by their numbers of files."""

    size_ratio_percent: int = 50
    level0_trigger: int = 4
    max_levels: int = 3


@dataclass(frozen=True)
class Tiered:
    """Whole tiers merged by space amplification, size ratio or number."""

    num_tiers: int = 4
    max_size_amplification_percent: int = 200
    size_ratio: int = 50
    min_merge_width: int = 2
    max_merge_width: int | None = None


@dataclass(frozen=True)
class Leveled:
    """Levels with target sizes, in which overlapping runs are merged."""

    level_size_multiplier: int = 2
    level0_trigger: int = 4
    max_levels: int = 4
    base_level_size_mb: int = 1


@dataclass(frozen=True)
class Options:
    """compaction None: runs are merged by force_full_compaction() only."""

    target_run_bytes: int = 64 << 20
    block_bytes: int = 4096
    memtable_limit: int = 4
    compaction: Simple | Tiered | Leveled | None = None
    row_group_bytes: int = 8 << 20
    bloom_false_positive: float = 0.01
    keep_versions: int = 8


@dataclass(frozen=True)
class Run:
    """A key-sorted run of one Parquet folder. tier: recency of a tier, larger is newer."""

    run_id: int
    level: int
    path: str
    first_key: str
    last_key: str
    n_rows: int
    n_bytes: int
    max_seq: int
    tier: int = 0

    @property
    def first(self) -> bytes:
        return bytes.fromhex(self.first_key)

    @property
    def last(self) -> bytes:
        return bytes.fromhex(self.last_key)


@dataclass
class Task:
    """What a planner asks for: merge the inputs into `target`; tombstones go if bottom."""

    inputs: list[int]
    target: int
    bottom: bool
    reason: str = ""
    extra: dict = field(default_factory=dict)

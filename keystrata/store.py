"""A key-value store on Spark: get, put, delete, batches, scans, flush and compaction over a versioned manifest."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from copy import deepcopy

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .model import OPS, Bound, Options, Run, Task, Tiered
from .operators import resolve
from .operators.memtable import entry_bytes
from .plans import compaction
from .sources.manifest import Manifest, ManifestLog
from .sources.runs import read_runs, write_runs


def _bytes(data: str | bytes) -> bytes:
    return data.encode() if isinstance(data, str) else bytes(data)


class Store:
    """Open with Store.open(spark, "file:///...", options). One writer; readers see one manifest version.

    put() and delete() gather in the driver until sync(), a read, a batch or a flush; write_batch() with a
    DataFrame goes to the log without passing through the driver. Data is durable once in the log. What a failed
    call was given stays in the buffer, and the state changes with the commit of its manifest only.
    """

    def __init__(self, spark: SparkSession, root: str, options: Options):
        self.spark, self.root, self.options = spark, root.rstrip("/"), options
        self.log = ManifestLog(self.root)
        self.state: Manifest = self.log.load() or Manifest()
        self.buffer: list[tuple[bytes, bytes]] = []

    @classmethod
    def open(cls, spark: SparkSession, root: str, options: Options = Options()) -> Store:
        return cls(spark, root, options)

    def close(self) -> None:
        """Flush what is pending."""
        self.force_flush()

    # writing

    def put(self, key, value) -> None:
        self._check_key(key)
        self.buffer.append((_bytes(key), _bytes(value)))

    def delete(self, key) -> None:
        self.put(key, b"")

    @staticmethod
    def _check_key(key) -> None:
        if not key:
            raise ValueError("a key must have bytes")

    def write_batch(self, batch: DataFrame | Iterable[tuple], batch_id: int | None = None, stream: str = "") -> None:
        """One commit of ordered operations: ("put", key, value) and ("delete", key) tuples, or a DataFrame with
        columns seq (order in the batch), key, value. A batch_id that is not above the last one taken in from the
        same stream is skipped; ids are those of a DataFrame's batches, and rise within a stream."""
        if batch_id is not None and batch_id <= self.state.batches.get(stream, -1):
            return
        if not isinstance(batch, DataFrame):
            rows = list(batch)
            for row in rows:
                self._check_key(row[1])
            self.buffer += [(_bytes(r[1]), _bytes(r[2]) if r[0] == "put" else b"") for r in rows]
            self.sync()
            return
        self.sync()
        self._append(batch.select(F.col("seq").cast("long").alias("seq"), F.col("key").cast("binary").alias("key"), F.coalesce(F.col("value").cast("binary"), F.lit("").cast("binary")).alias("value")), batch_id, stream)

    def sync(self) -> None:
        """Write buffered operations to the log."""
        if self.buffer:
            n = len(self.buffer)
            self._append(self.spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(self.buffer)], OPS), buffered=n)

    def _append(self, ops: DataFrame, batch_id: int | None = None, stream: str = "", buffered: int = 0) -> None:
        path = f"{self.root}/log/{uuid.uuid4().hex}"
        state, seen = deepcopy(self.state), Observation()
        facts = [F.min("seq").alias("first"), F.max("seq").alias("last"), F.sum(entry_bytes()).alias("n_bytes"), F.count_if(F.col("key").isNull() | (F.octet_length("key") == 0)).alias("bad")]
        # a flush reads a segment in tasks of whole row groups: with the default size few tasks would do it all
        ops.withColumn("seq", F.col("seq") + state.next_seq).observe(seen, *facts).write.option("parquet.block.size", self.options.row_group_bytes).parquet(path)
        found = seen.get
        if found["bad"]:
            raise ValueError("a key must have bytes")
        if found["last"] is not None:
            last = state.segments[-1] if state.segments else None
            held = (last["n_bytes"] if last and not last["closed"] else 0) + found["n_bytes"]
            if last and not last["closed"] and held >= self.options.target_run_bytes:
                for s in state.segments:
                    s["closed"] = True
            state.segments.append({"path": path, "first_seq": found["first"], "last_seq": found["last"], "n_bytes": found["n_bytes"], "closed": found["n_bytes"] >= self.options.target_run_bytes})
            state.next_seq = found["last"] + 1
        if batch_id is not None:
            state.batches[stream] = batch_id
        self.state = self.log.commit(state)
        del self.buffer[:buffered]
        if sum(s["closed"] for s in self.state.segments) >= self.options.memtable_limit:
            self.force_flush()

    # reading

    def pending(self) -> DataFrame:
        paths = [s["path"] for s in self.state.segments]
        return self.spark.read.schema(OPS).parquet(*paths) if paths else self.spark.createDataFrame([], OPS)

    def _ops(self, lower: Bound, upper: Bound) -> DataFrame:
        """Operations of a range: pending ones and those of runs that the range can meet."""
        self.sync()
        runs = [r for r in self.state.runs if lower.admits_run(r.first, r.last, True) and upper.admits_run(r.first, r.last, False)]
        return self.pending().unionByName(read_runs(self.spark, runs))

    def scan(self, lower: Bound = Bound(), upper: Bound = Bound()) -> DataFrame:
        """Live (key, value) rows of a range in key order."""
        lower, upper = (Bound(b.kind, None if b.key is None else _bytes(b.key)) for b in (lower, upper))
        return resolve.scan(self._ops(lower, upper), lower, upper).select("key", "value")

    def get(self, key) -> bytes | None:
        at = Bound.included(_bytes(key))
        row = resolve.get(self._ops(at, at), _bytes(key)).select("value").first()
        return None if row is None else bytes(row[0])

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """Live (key, value) rows of the keys (column key); runs outside the keys' range are not read."""
        wanted = keys.select(F.col("key").cast("binary").alias("key")).distinct()
        low, high = wanted.agg(F.min("key"), F.max("key")).first()
        bounds = (Bound(), Bound()) if low is None else (Bound.included(bytes(low)), Bound.included(bytes(high)))
        return resolve.multi_get(resolve.within(self._ops(*bounds), *bounds), wanted).select("key", "value")

    def level_stats(self) -> dict[int, tuple[int, int]]:
        return self.state.level_stats()

    # maintenance

    def force_flush(self) -> None:
        """Write all pending operations as a sorted run, tombstones included, and compact as the policy asks."""
        self.sync()
        if not self.state.segments:
            return
        state = deepcopy(self.state)
        tier = max((r.tier for r in state.runs), default=-1) + 1 if isinstance(self.options.compaction, Tiered) else 0
        made = write_runs(resolve.latest(self.pending()), self.root, state.next_run, 0, self.options, tier, sum(s["n_bytes"] for s in state.segments))
        state.runs += made
        state.next_run += len(made)
        state.flushed_seq = state.next_seq - 1
        state.segments = []
        self.state = self.log.commit(state)
        self.compact()
        self.vacuum()

    def compact(self, most: int = 16) -> list[Task]:
        """Run the policy's tasks until it asks for none."""
        done = []
        while len(done) < most and (task := compaction.plan(self.state.runs, self.options.compaction)):
            self._execute(task)
            done.append(task)
        return done

    def _execute(self, task: Task) -> None:
        state = deepcopy(self.state)
        chosen = [r for r in state.runs if r.run_id in set(task.inputs)]
        if compaction.moves(chosen, task):
            output: list[Run] = chosen
        else:
            merged = resolve.latest(read_runs(self.spark, chosen))
            merged = resolve.visible(merged) if task.bottom else merged
            output = write_runs(merged, self.root, state.next_run, task.target, self.options, most_bytes=sum(r.n_bytes for r in chosen))
            state.next_run += len(output)
        state.runs = compaction.apply(state.runs, task, output, self.options.compaction)
        self.state = self.log.commit(state)

    def force_full_compaction(self) -> None:
        """Merge all runs into level 1; only without a policy."""
        if self.options.compaction is not None:
            raise ValueError("full compaction needs a store without a compaction policy")
        task = compaction.plan_full(self.state.runs)
        if task:
            self._execute(task)

    def vacuum(self) -> None:
        """Delete files that no kept manifest version names."""
        runs, segments = self.log.vacuum(self.options.keep_versions)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in [r.path for r in runs] + [s["path"] for s in segments]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)

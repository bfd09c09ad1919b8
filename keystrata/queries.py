"""Queries over the driver's tables for each operator, and their DuckDB SQL."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.bloom import bits_column, build_filters, probe
from .model import Bound, Leveled, Options, Run, Simple, Tiered
from .operators import blocks, cache, memtable, resolve
from .plans import compaction
from .sources import oplog, runs
from .sources.manifest import Manifest
from .store import Store
from .streaming.ingest import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Operations of `events`: an error deletes the user's key, other events put a value.
OPS_SQL = "SELECT event_id AS seq, concat('key', printf('%05d', user_id)) AS k, CASE WHEN event_type = 'error' THEN '' ELSE concat(event_type, ':', props) END AS v FROM events"
LATEST_SQL = "SELECT k, arg_max(v, seq) AS v FROM ops GROUP BY k HAVING arg_max(v, seq) <> ''"
#: Bytes after which a memtable is frozen, and bytes of a block, in the queries.
FREEZE, BLOCK = 4096, 256
RUN_OPS = 1000
SEGMENTS = 8


def query(oracle: str | None = None, ops: bool = True):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = f"WITH RECURSIVE ops AS ({OPS_SQL}){oracle}" if ops else oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    value = F.when(F.col("event_type") == "error", "").otherwise(F.concat("event_type", F.lit(":"), "props"))
    # '%05d': padding takes a fraction of the time of formatting, which stays for signed ids and nulls
    digits = F.col("user_id").cast("string")
    padded = F.concat(F.lit("key"), F.lpad(digits, F.greatest(F.lit(5), F.length(digits)), F.lit("0")))
    key = F.when(F.col("user_id") >= 0, padded).otherwise(F.format_string("key%05d", "user_id"))
    return events.select(F.col("event_id").alias("seq"), key.alias("k"), value.alias("v"))


def latest(ops: DataFrame) -> DataFrame:
    return resolve.latest(ops, "k", "v")


def live(ops: DataFrame) -> DataFrame:
    return resolve.visible(latest(ops), "v").select("k", "v")


def _scan(name: str, lower: Bound, upper: Bound) -> None:
    sign = {"included": "=", "excluded": "", "unbounded": ""}
    parts = [f"k >{sign[lower.kind]} '{lower.key}'"] * (lower.kind != "unbounded") + [f"k <{sign[upper.kind]} '{upper.key}'"] * (upper.kind != "unbounded")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return resolve.scan(event_ops(spark, sf_dir), lower, upper, "k", "v").select("k", "v")

    run.__name__ = name
    query(f" SELECT k, arg_max(v, seq) AS v FROM ops WHERE {' AND '.join(parts)} GROUP BY k HAVING arg_max(v, seq) <> ''")(run)


@query(" SELECT k, arg_max(v, seq) AS v FROM ops WHERE k = 'key00007' GROUP BY k HAVING arg_max(v, seq) <> ''")
def q01_get(spark, sf_dir):
    return resolve.get(event_ops(spark, sf_dir), "key00007", "k", "v").select("k", "v")


@query(f", want AS (SELECT DISTINCT concat('key', printf('%05d', c_custkey)) AS k FROM customer WHERE c_nationkey < 5) SELECT * FROM ({LATEST_SQL}) x WHERE EXISTS (SELECT 1 FROM want w WHERE w.k = x.k)")
def q02_multi_get(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.format_string("key%05d", "c_custkey").alias("k"))
    return resolve.multi_get(event_ops(spark, sf_dir), keys, "k", "v").select("k", "v")


@query(" SELECT k, max(seq) AS seq FROM ops GROUP BY k HAVING arg_max(v, seq) = ''")
def q03_get_tombstone(spark, sf_dir):
    return latest(event_ops(spark, sf_dir)).where(resolve.is_tombstone(F.col("v"))).select("k", "seq")


@query(f" {LATEST_SQL}")
def q04_scan_full(spark, sf_dir):
    return resolve.scan(event_ops(spark, sf_dir), key="k", value="v").select("k", "v")


_scan("q05_scan_ii", Bound.included("key00003"), Bound.included("key00011"))
_scan("q06_scan_ie", Bound.included("key00003"), Bound.excluded("key00011"))
_scan("q07_scan_ei", Bound.excluded("key00003"), Bound.included("key00011"))
_scan("q08_scan_ee", Bound.excluded("key00003"), Bound.excluded("key00011"))
_scan("q09_scan_lower_only", Bound.included("key00009"), Bound())
_scan("q10_scan_upper_only", Bound(), Bound.excluded("key00009"))
_scan("q11_scan_absent_bound", Bound.included("key00003x"), Bound.excluded("key00009x"))


@query(", more AS (SELECT seq, k, v FROM ops UNION ALL SELECT 1000000000 + c_custkey, concat('key', printf('%05d', c_custkey)), concat('put:', c_mktsegment) FROM customer) SELECT k, arg_max(v, seq) AS v FROM more GROUP BY k HAVING arg_max(v, seq) <> ''")
def q12_put_upsert(spark, sf_dir):
    puts = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000000000).alias("seq"), F.format_string("key%05d", "c_custkey").alias("k"), F.concat(F.lit("put:"), "c_mktsegment").alias("v"))
    return live(event_ops(spark, sf_dir).unionByName(puts))


@query(", more AS (SELECT seq, k, v FROM ops UNION ALL SELECT 1000000000 + c_custkey, concat('key', printf('%05d', c_custkey)), '' FROM customer WHERE c_custkey % 2 = 0) SELECT k, arg_max(v, seq) AS v FROM more GROUP BY k HAVING arg_max(v, seq) <> ''")
def q13_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select((F.col("c_custkey") + 1000000000).alias("seq"), F.format_string("key%05d", "c_custkey").alias("k"), F.lit("").alias("v"))
    return live(event_ops(spark, sf_dir).unionByName(gone))


#: A batch of ordered operations, later ones on the same key winning.
BATCH = [("key00001", "a"), ("key00002", "b"), ("key00001", ""), ("key99999", "c"), ("key00002", "d"), ("key99998", "e"), ("key99998", "")]


@query(f", more AS (SELECT seq, k, v FROM ops UNION ALL SELECT * FROM (VALUES {', '.join(f'({2000000000 + i}, {k!r}, {v!r})' for i, (k, v) in enumerate(BATCH))})) SELECT k, arg_max(v, seq) AS v FROM more GROUP BY k HAVING arg_max(v, seq) <> ''")
def q14_write_batch(spark, sf_dir):
    batch = spark.createDataFrame([(2000000000 + i, k, v) for i, (k, v) in enumerate(BATCH)], "seq long, k string, v string")
    return live(event_ops(spark, sf_dir).unionByName(batch))


FREEZE_SQL = f""", c AS (SELECT seq, k, v, row_number() OVER (ORDER BY seq) AS n, strlen(k) + strlen(v) AS sz FROM ops),
r AS (SELECT n, seq, sz AS acc, 0 AS mt FROM c WHERE n = 1 UNION ALL
SELECT c.n, c.seq, CASE WHEN r.acc >= {FREEZE} THEN c.sz ELSE r.acc + c.sz END, CASE WHEN r.acc >= {FREEZE} THEN r.mt + 1 ELSE r.mt END FROM r JOIN c ON c.n = r.n + 1),
p AS (SELECT CAST(mt AS BIGINT) AS memtable, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_ops, CAST(max(acc) AS BIGINT) AS n_bytes FROM r GROUP BY mt HAVING max(acc) >= {FREEZE})"""


def _points(spark, sf_dir):
    return memtable.freeze_points(event_ops(spark, sf_dir), FREEZE, "k", "v")


@query(f"{FREEZE_SQL} SELECT memtable, last_seq FROM p")
def q15_memtable_freeze(spark, sf_dir):
    return _points(spark, sf_dir).select("memtable", "last_seq")


@query(f"{FREEZE_SQL} SELECT memtable, n_ops, n_bytes FROM p")
def q16_memtable_sizes(spark, sf_dir):
    return _points(spark, sf_dir).select("memtable", "n_ops", "n_bytes")


@query(f"{FREEZE_SQL} SELECT p.memtable, o.k, max(o.seq) AS seq, arg_max(o.v, o.seq) AS v FROM ops o JOIN p ON o.seq BETWEEN p.first_seq AND p.last_seq GROUP BY p.memtable, o.k")
def q17_flush_runs(spark, sf_dir):
    ops = event_ops(spark, sf_dir)
    return memtable.flushed(memtable.assigned(ops, _points(spark, sf_dir)), "k", "v").select("memtable", "k", "seq", "v")


RUNS_SQL = f", runs AS (SELECT CAST(floor(seq / {RUN_OPS}) AS BIGINT) AS run, k, max(seq) AS seq, arg_max(v, seq) AS v FROM ops GROUP BY 1, 2)"


def event_runs(spark, sf_dir) -> DataFrame:
    """Resolved runs of RUN_OPS operations, tombstones included; a larger run is newer."""
    ops = event_ops(spark, sf_dir).withColumn("run", F.floor(F.col("seq") / RUN_OPS))
    return ops.groupBy("run", "k").agg(F.max("seq").alias("seq"), F.max_by("v", "seq").alias("v"))


@query(f"{RUNS_SQL} SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY run DESC) AS n FROM runs) WHERE n = 1")
def q18_kway_merge(spark, sf_dir):
    return resolve.latest(event_runs(spark, sf_dir), "k", "v", order="run").select("k", "v")


@query(f"{RUNS_SQL}, a AS (SELECT k, v FROM runs WHERE run = 1), b AS (SELECT k, v FROM runs WHERE run = 0) SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.k = b.k)")
def q19_two_way_merge(spark, sf_dir):
    both = event_runs(spark, sf_dir)
    return resolve.shadow(both.where("run = 1").select("k", "v"), both.where("run = 0").select("k", "v"), "k")


@query(f" SELECT k, v FROM ({LATEST_SQL}) WHERE k >= 'key00004'")
def q20_concat_runs(spark, sf_dir):
    state = live(event_ops(spark, sf_dir))
    cuts = ["key00006", "key00010"]
    parts = [state.where(F.col("k") < cuts[0]), state.where(F.col("k").between(cuts[0], cuts[1] + "￿")), state.where(F.col("k") > cuts[1] + "￿")]
    return resolve.concat_runs(parts, "key00004", "k")


INDEX_SQL = f"{RUNS_SQL}, ix AS (SELECT run, min(k) AS first_key, max(k) AS last_key, count(*) AS n_rows, CAST(sum(strlen(k) + strlen(v) + 6) AS BIGINT) AS n_bytes FROM runs GROUP BY run)"


def _index(spark, sf_dir):
    return runs.run_index(event_runs(spark, sf_dir))


def _runs(index: DataFrame) -> list[Run]:
    """The rows of an index, one for each run, as the planners and the pruning take them."""
    return [Run(r.run, r["level"] if "level" in index.columns else 0, "", r.first_key.encode().hex(), r.last_key.encode().hex(), r.n_rows, r.n_bytes, 0) for r in index.collect()]


@query(f"{INDEX_SQL} SELECT * FROM ix")
def q21_run_index(spark, sf_dir):
    return _index(spark, sf_dir)


@query(f"{INDEX_SQL} SELECT run FROM ix WHERE first_key < 'key00002' AND last_key > 'key00000'")
def q22_range_prune(spark, sf_dir):
    lower, upper = Bound.excluded(b"key00000"), Bound.excluded(b"key00002")
    chosen = [r.run_id for r in _runs(_index(spark, sf_dir)) if lower.admits_run(r.first, r.last, True) and upper.admits_run(r.first, r.last, False)]
    return spark.createDataFrame([(i,) for i in chosen], "run long")


@query(f"{INDEX_SQL} SELECT run FROM ix WHERE 'key00001' BETWEEN first_key AND last_key")
def q23_point_prune(spark, sf_dir):
    at = Bound.included(b"key00001")
    chosen = [r.run_id for r in _runs(_index(spark, sf_dir)) if at.admits_run(r.first, r.last, True) and at.admits_run(r.first, r.last, False)]
    return spark.createDataFrame([(i,) for i in chosen], "run long")


LAYOUT_SQL = f"""{RUNS_SQL}, s AS (SELECT run, k, v, row_number() OVER (PARTITION BY run ORDER BY k) AS n, strlen(k) AS kl, strlen(v) AS vl FROM runs),
b AS (SELECT run, k, n, 0 AS block, 1 AS cnt, 6 + kl + vl AS data, k AS first_key, 0 AS overlap FROM s WHERE n = 1 UNION ALL
SELECT s.run, s.k, s.n, b.block + x.cut, CASE WHEN x.cut = 1 THEN 1 ELSE b.cnt + 1 END, CASE WHEN x.cut = 1 THEN 6 + s.kl + s.vl ELSE b.data + 6 + s.kl + s.vl - x.o END, CASE WHEN x.cut = 1 THEN s.k ELSE b.first_key END, CASE WHEN x.cut = 1 THEN 0 ELSE x.o END
FROM b JOIN s ON s.run = b.run AND s.n = b.n + 1, LATERAL (SELECT CASE WHEN 2 + 2 * b.cnt + b.data + s.kl + s.vl + 6 > {BLOCK} THEN 1 ELSE 0 END AS cut, (SELECT coalesce(max(i), 0) FROM range(1, 64) t(i) WHERE i <= least(strlen(b.first_key), s.kl) AND b.first_key[1:i] = s.k[1:i]) AS o) x)"""


def _layout(spark, sf_dir):
    return blocks.block_layout(event_runs(spark, sf_dir), BLOCK)


@query(f"{LAYOUT_SQL} SELECT run, k, block FROM b")
def q24_block_layout(spark, sf_dir):
    return _layout(spark, sf_dir).select("run", "k", "block")


@query(f"{LAYOUT_SQL}, ix AS (SELECT run, block, min(k) AS first_key, max(k) AS last_key FROM b GROUP BY run, block), w AS (SELECT DISTINCT run, 'key00007' AS k FROM b) SELECT w.run, w.k, ix.block FROM w JOIN ix ON ix.run = w.run AND w.k BETWEEN first_key AND last_key")
def q25_block_index(spark, sf_dir):
    layout = _layout(spark, sf_dir)
    return blocks.locate(blocks.block_index(layout), layout.select("run").distinct().withColumn("k", F.lit("key00007")))


@query(f"{LAYOUT_SQL} SELECT run, k, overlap FROM b")
def q26_prefix_overlap(spark, sf_dir):
    return _layout(spark, sf_dir).select("run", "k", "overlap")


@query(f"{RUNS_SQL} SELECT run, count(*) AS n, count(*) AS present, true AS few_false FROM runs GROUP BY run")
def q27_bloom_probe(spark, sf_dir):
    """Keys of each run that its filter admits (all), and whether it admits few of as many absent keys (1 % is aimed at)."""
    entries = event_runs(spark, sf_dir)
    keys = entries.select("run", "k").unionByName(entries.select("run", F.concat("k", F.lit("/absent")).alias("k")))
    absent = F.col("k").endswith("/absent")
    found = probe(build_filters(entries), keys).groupBy("run").agg(F.count_if(~absent).alias("n"), F.count_if(~absent & F.col("maybe")).alias("present"), F.count_if(absent & F.col("maybe")).alias("false"))
    return found.select("run", "n", "present", (F.col("false") <= 2 + 0.03 * F.col("n")).alias("few_false"))


@query(f"{INDEX_SQL} SELECT run, CAST(floor(-n_rows * {math.log(0.02)!r} / {math.log(2) ** 2!r}) AS BIGINT) AS bits, CAST(floor(floor(-n_rows * {math.log(0.02)!r} / {math.log(2) ** 2!r}) * {math.log(2)!r} / n_rows) AS BIGINT) AS hashes FROM ix")
def q28_bloom_sizing(spark, sf_dir):
    bits = bits_column(F.col("n_rows"), 0.02)
    return _index(spark, sf_dir).select("run", bits.alias("bits"), F.floor(bits * F.lit(math.log(2)) / F.col("n_rows")).cast("long").alias("hashes"))


CRC_SQL = f"""{LAYOUT_SQL}, bits AS (SELECT i, 0 AS step, i AS c FROM range(256) t(i) UNION ALL
SELECT i, step + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
data AS (SELECT b.run, b.block, string_agg(concat(strlen(b.k), ':', b.k, strlen(r.v), ':', r.v), '' ORDER BY b.k) AS d FROM b JOIN runs r ON r.run = b.run AND r.k = b.k GROUP BY b.run, b.block),
bytes AS (SELECT run, block, list_transform(range(CAST(strlen(d) AS BIGINT)), lambda i: CAST(ascii(d[i + 1]) AS BIGINT)) AS e FROM data)
SELECT run, block, xor(list_reduce(list_prepend(4294967295, e), lambda c, x: xor(c // 256, t[(xor(c, x) % 256) + 1])), 4294967295) AS crc FROM bytes, crc"""


@query(CRC_SQL)
def q29_crc(spark, sf_dir):
    entries = event_runs(spark, sf_dir)
    return blocks.block_checksums(entries, blocks.block_layout(entries, BLOCK))


@query(""", t AS (SELECT user_id % 4 AS grp, event_id AS seq, user_id % 97 AS item FROM events),
n AS (SELECT *, lag(seq) OVER (PARTITION BY grp, item ORDER BY seq) AS last FROM t)
SELECT seq, item, last IS NOT NULL AND (SELECT count(DISTINCT b.item) FROM t b WHERE b.grp = n.grp AND b.seq > n.last AND b.seq < n.seq) < 16 AS hit FROM n""")
def q30_lru_trace(spark, sf_dir):
    trace = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("grp"), F.col("event_id").alias("seq"), (F.col("user_id") % 97).alias("item"))
    return cache.lru_hits(trace, 16).select("seq", "item", "hit")


LOG_SQL = ", l AS (SELECT seq, k, v, CAST(sum(strlen(k) + strlen(v) + 8) OVER (ORDER BY seq) AS BIGINT) AS \"end\", strlen(k) + strlen(v) + 8 AS size FROM ops)"


def _log(spark, sf_dir):
    return event_ops(spark, sf_dir).withColumn("size", (F.octet_length("k") + F.octet_length("v") + 8).cast("long"))


@query(f'{LOG_SQL} SELECT seq, k, v FROM l WHERE "end" - size >= 20000 AND "end" <= 20000 + 30000')
def q31_wal_replay(spark, sf_dir):
    return oplog.replay(_log(spark, sf_dir), 20000, 30000).select("seq", "k", "v")


@query(f'{LOG_SQL} SELECT min("end" - size)::BIGINT AS start_offset, max("end") AS end_offset, count(*) AS n FROM l WHERE "end" - size >= (SELECT max("end") FROM l) - 50000')
def q32_wal_ring_retention(spark, sf_dir):
    return oplog.retained(_log(spark, sf_dir), 50000).agg(F.min("start").alias("start_offset"), F.max("end").alias("end_offset"), F.count("*").alias("n"))


@query(f'{LOG_SQL} SELECT count(*) AS n, min("end" - size)::BIGINT AS start_offset, max("end") AS end_offset FROM l WHERE "end" > 20000')
def q45_wal_truncate(spark, sf_dir):
    return oplog.truncated(_log(spark, sf_dir), 20000).agg(F.count("*").alias("n"), F.min("start").alias("start_offset"), F.max("end").alias("end_offset"))


def _root(spark: SparkSession) -> str:
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or 'file:///tmp/checkpoints/keystrata').rstrip('/')}/store-{uuid.uuid4().hex}"


def filled_store(spark: SparkSession, sf_dir: str, options: Options) -> Store:
    """All event operations, written and flushed in SEGMENTS batches."""
    store = Store.open(spark, _root(spark), options)
    ops = event_ops(spark, sf_dir)
    n = ops.agg(F.max("seq")).first()[0] + 1
    for i in range(SEGMENTS):
        low, high = n * i // SEGMENTS, n * (i + 1) // SEGMENTS
        store.write_batch(ops.where((F.col("seq") >= low) & (F.col("seq") < high)).select((F.col("seq") - low).alias("seq"), F.col("k").alias("key"), F.col("v").alias("value")))
        store.force_flush()
    return store


def _text(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


@query(f" {LATEST_SQL}")
def q33_full_compaction(spark, sf_dir):
    store = filled_store(spark, sf_dir, Options())
    store.force_full_compaction()
    return _text(store.scan())


@query(f" {LATEST_SQL}")
def q34_simple_compaction(spark, sf_dir):
    return _text(filled_store(spark, sf_dir, Options(compaction=Simple(level0_trigger=2))).scan())


@query(f" {LATEST_SQL}")
def q35_tiered_compaction(spark, sf_dir):
    return _text(filled_store(spark, sf_dir, Options(compaction=Tiered(num_tiers=3))).scan())


@query(f" {LATEST_SQL}")
def q36_leveled_compaction(spark, sf_dir):
    return _text(filled_store(spark, sf_dir, Options(target_run_bytes=1 << 16, compaction=Leveled(level0_trigger=2))).scan())


LEVELS_SQL = f"{INDEX_SQL}, lv AS (SELECT run, CAST(run % 3 AS BIGINT) AS level, first_key, last_key, n_rows, n_bytes FROM ix)"


def _levels(spark, sf_dir):
    return _index(spark, sf_dir).withColumn("level", F.col("run") % 3)


@query(f"{LEVELS_SQL} SELECT level, count(*) AS files, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, min(first_key) AS first_key, max(last_key) AS last_key FROM lv GROUP BY level")
def q37_level_stats(spark, sf_dir):
    held = _runs(_levels(spark, sf_dir))
    ends = {n: (min(r.first for r in held if r.level == n).decode(), max(r.last for r in held if r.level == n).decode()) for n in {r.level for r in held}}
    rows = [(n, files, size, *ends[n]) for n, (files, size) in Manifest(runs=held).level_stats().items()]
    return spark.createDataFrame(rows, "level long, files long, n_bytes long, first_key string, last_key string")


@query(", s AS (SELECT k, arg_max(v, seq) AS v FROM ops GROUP BY k) SELECT count(*) AS with_tombstones, count(*) FILTER (WHERE v <> '') AS at_bottom FROM s")
def q38_tombstone_gc(spark, sf_dir):
    return latest(event_ops(spark, sf_dir)).agg(F.count("*").alias("with_tombstones"), F.count_if(~resolve.is_tombstone(F.col("v"))).alias("at_bottom"))


@query(f"{LEVELS_SQL}, u AS (SELECT min(first_key) AS f, max(last_key) AS l FROM lv WHERE level = 0 AND run = 0) SELECT run FROM lv, u WHERE level = 1 AND first_key <= l AND last_key >= f")
def q39_overlap_runs(spark, sf_dir):
    held = _runs(_levels(spark, sf_dir))
    chosen = compaction.overlapping([r for r in held if r.run_id == 0], [r for r in held if r.level == 1])
    return spark.createDataFrame([(r.run_id,) for r in chosen], "run long")


@query(f"{LEVELS_SQL}, st AS (SELECT level + 1 AS level, CAST(sum(n_bytes) AS BIGINT) AS real FROM lv GROUP BY level) SELECT level, real / (1000.0 * level)::DOUBLE AS priority FROM st WHERE real / (1000.0 * level)::DOUBLE > 1.0 ORDER BY priority DESC, level DESC LIMIT 1")
def q40_priority(spark, sf_dir):
    sizes = dict(_levels(spark, sf_dir).groupBy("level").agg(F.sum("n_bytes")).collect())  # a row per level
    depth = max(sizes, default=-1) + 1
    found = compaction.priorities([sizes.get(i, 0) for i in range(depth)], [1000 * (i + 1) for i in range(depth)])[:1]
    return spark.createDataFrame([(level, float(p)) for p, level in found], "level long, priority double")


@query(f" {LATEST_SQL}")
def q41_stream_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    value = F.when(F.col("event_type") == "error", "").otherwise(F.concat("event_type", F.lit(":"), "props"))
    ops = stream.select(F.col("event_id").alias("seq"), F.format_string("key%05d", "user_id").alias("key"), value.alias("value"))
    root = _root(spark)
    store = Store.open(spark, root, Options())
    ingest(ops, store, f"{root}/checkpoint").awaitTermination()
    return _text(store.scan())


@query(" SELECT printf('%08d', o_orderkey) AS k, arg_max(o_orderstatus, o_orderkey) AS v FROM orders GROUP BY 1")
def q42_orders_kv(spark, sf_dir):
    ops = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.format_string("%08d", "o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    return resolve.scan(ops, key="k", value="v").select("k", "v")


@query(", x AS (SELECT printf('%08d-%02d', l_orderkey, l_linenumber) AS k, l_returnflag AS v, printf('%012d-%012d-%.2f-%.2f-%s', l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag) AS seq FROM lineitem) SELECT k, arg_max(v, seq) AS v FROM x GROUP BY k")
def q43_lineitem_kv(spark, sf_dir):
    ops = table(spark, sf_dir, "lineitem").select(
        F.format_string("%012d-%012d-%.2f-%.2f-%s", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag").alias("seq"),
        F.format_string("%08d-%02d", "l_orderkey", "l_linenumber").alias("k"), F.col("l_returnflag").alias("v"),
    )
    return resolve.scan(ops, key="k", value="v").select("k", "v")


@query(f"{RUNS_SQL} SELECT k, run, row_number() OVER (PARTITION BY k ORDER BY run DESC) AS version FROM runs")
def q44_key_versions(spark, sf_dir):
    return resolve.kth_versions(event_runs(spark, sf_dir), "k", "run").select("k", "run", F.col("version").cast("long").alias("version"))


def outcome(spark: SparkSession, sf_dir: str, options: Options) -> DataFrame:
    """level, tier, n_rows, tombstones and overlaps (runs of a level below 0 that meet another) of the runs that a policy leaves."""
    store = filled_store(spark, sf_dir, options)
    if options.compaction is None:
        store.force_full_compaction()
    places = sorted({(r.level, r.tier) for r in store.state.runs})
    held = [runs.read_runs(spark, [r for r in store.state.runs if (r.level, r.tier) == at]).select(F.lit(at[0]).cast("long").alias("level"), F.lit(at[1]).cast("long").alias("tier"), "value") for at in places]
    rows = held[0] if held else spark.createDataFrame([], "level long, tier long, value binary")
    for more in held[1:]:
        rows = rows.unionByName(more)
    index = spark.createDataFrame([(r.level, r.first_key, r.last_key) for r in store.state.runs if r.level], "level long, first_key string, last_key string")
    overlaps = resolve.disjoint(index).count()
    return rows.groupBy("level", "tier").agg(F.count("*").alias("n_rows"), F.count_if(resolve.is_tombstone(F.col("value"))).alias("tombstones")).withColumn("overlaps", F.lit(overlaps).cast("long"))


#: seg: the batch of each operation in filled_store().
SEG_SQL = f", m AS (SELECT max(seq) + 1 AS n FROM ops), sg AS (SELECT o.*, (SELECT CAST(max(i) AS BIGINT) FROM range({SEGMENTS}) t(i) WHERE o.seq >= m.n * i // {SEGMENTS}) AS seg FROM ops o, m)"


def _outcome_sql(parts: list[tuple[int, int, int, int, bool]]) -> str:
    """Rows of (level, tier, first segment, last segment, whether tombstones are gone)."""
    state = "SELECT k, arg_max(v, seq) AS v FROM sg WHERE seg BETWEEN {} AND {} GROUP BY k"
    one = "SELECT CAST({} AS BIGINT) AS level, CAST({} AS BIGINT) AS tier, count(*){} AS n_rows, {} AS tombstones, CAST(0 AS BIGINT) AS overlaps FROM ({})"
    live = " FILTER (WHERE v <> '')"
    return SEG_SQL + " " + " UNION ALL ".join(one.format(lv, tier, live if gone else "", "CAST(0 AS BIGINT)" if gone else "count(*) FILTER (WHERE v = '')", state.format(a, b)) for lv, tier, a, b, gone in parts)


@query(_outcome_sql([(1, 0, 0, 7, True)]))
def q46_full_outcome(spark, sf_dir):
    return outcome(spark, sf_dir, Options())


@query(_outcome_sql([(3, 0, 0, 1, True), (2, 0, 2, 3, False), (1, 0, 4, 7, False)]))
def q47_simple_outcome(spark, sf_dir):
    """Pairs of flushed runs go to level 1, from there to level 3 first, to level 2 next, and the last two stay in level 1."""
    return outcome(spark, sf_dir, Options(compaction=Simple(level0_trigger=2)))


@query(_outcome_sql([(0, 6, 0, 6, True), (0, 7, 7, 7, False)]))
def q48_tiered_outcome(spark, sf_dir):
    """Three tiers are merged to the newest of them whenever there are three; the last flush is alone."""
    return outcome(spark, sf_dir, Options(compaction=Tiered(num_tiers=3)))


@query(_outcome_sql([(4, 0, 0, 7, True)]))
def q49_leveled_outcome(spark, sf_dir):
    """All below the base size, so every second flush goes to the last level."""
    return outcome(spark, sf_dir, Options(target_run_bytes=1 << 16, compaction=Leveled(level0_trigger=2)))


@query(", x AS (SELECT k, v FROM (VALUES ('key00001', 'one'), ('key00003', 'three'), ('key00004', 'later'), ('key99999', 'new')) t(k, v)), s AS (SELECT k, arg_max(v, seq) AS v FROM ops GROUP BY k HAVING arg_max(v, seq) <> '') SELECT k, v FROM x UNION ALL SELECT k, v FROM s WHERE k NOT IN (SELECT k FROM x) AND k NOT IN ('key00002')")
def q50_store_session(spark, sf_dir):
    """put, delete and write_batch over the event log, sync, reopening and multi_get of all keys."""
    root = _root(spark)
    store = Store.open(spark, root)
    ops = event_ops(spark, sf_dir).select("seq", F.col("k").alias("key"), F.col("v").alias("value"))
    store.write_batch(ops, 7, "events")
    store.write_batch(ops, 7, "events")  # repeated: skipped
    store.put("key00001", "one")
    store.delete("key00002")
    store.put("key00003", "three")
    store.sync()
    store = Store.open(spark, root)
    store.write_batch([("put", "key00004", "first"), ("put", "key99999", "new"), ("delete", "key00004"), ("put", "key00004", "later")])
    store = Store.open(spark, root)
    return _text(store.multi_get(store.scan().select("key")))


@query(f", s AS ({LATEST_SQL}) SELECT k, v, true AS flushed FROM s")
def q51_auto_flush(spark, sf_dir):
    """Batches beyond the buffer limit are flushed without being asked: runs are there, and few segments wait."""
    store = Store.open(spark, _root(spark), Options(target_run_bytes=1024, memtable_limit=2))
    ops = event_ops(spark, sf_dir)
    n = ops.agg(F.max("seq")).first()[0] + 1
    for i in range(4):
        low, high = n * i // 4, n * (i + 1) // 4
        store.write_batch(ops.where((F.col("seq") >= low) & (F.col("seq") < high)).select((F.col("seq") - low).alias("seq"), F.col("k").alias("key"), F.col("v").alias("value")))
    return _text(store.scan()).withColumn("flushed", F.lit(len(store.state.runs) > 0 and sum(s["closed"] for s in store.state.segments) < 2))

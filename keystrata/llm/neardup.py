"""Near-duplicate documents: MinHash with banding, signature verification, exact confirmation, components.

Documents with one shingle set are a class, and only its smallest id takes part in the search. In each bucket of
a band the members are compared with the bucket's smallest member (the hub); links that hold join components.
Where the members of a bucket are then still in several components, those outside its largest component are
compared with all members of other components, both sides in blocks: by signatures first, and only members that
agree with one of another component bring their texts to their block. So no link between components is lost, and
pairs within a group are not listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, discard, materialise, salted_join, thrifty
from .components import connected_components
from .tokenise import release
from .words import mix, shingle_sets, shingles, text_slices, words

BANDS, ROWS, WIDTH = 30, 5, 5
#: Members of a block that a task compares with another, and shingles of their texts, about.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20

_seeds = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Universal hashing a * x + b over 32 bits.
MULTIPLY = (_seeds[: BANDS * ROWS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
ADD = (_seeds[BANDS * ROWS :] >> np.uint64(32)).astype(np.uint32)


def signatures(grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One row of BANDS * ROWS minima for each text that has shingles."""
    begin = begin[np.concatenate([[True], np.diff(begin) > 0])] if len(begin) > 1 else begin
    out = np.empty((len(begin) - 1, BANDS * ROWS), np.uint32)
    for low in range(0, len(begin) - 1, 256):
        starts = begin[low : low + 257]
        x = (grams[starts[0] : starts[-1]] >> np.uint64(32)).astype(np.uint32)
        hashed, at = np.empty_like(x), starts[:-1] - starts[0]
        for i in range(BANDS * ROWS):
            np.multiply(x, MULTIPLY[i], out=hashed)
            hashed += ADD[i]
            out[low : low + 256, i] = np.minimum.reduceat(hashed, at)
    return out


@thrifty
def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: size of the shingle set, a digest of the set, the signature (null without shingles)."""
    import hashlib

    release()
    for batch in batches:
        for low, high, data, offsets in text_slices(batch.column(1)):
            grams, begin = shingles(*words(data, offsets), WIDTH)
            signed = signatures(grams, begin)
            sizes, digests, held, k = [], [], [], 0
            for i in range(high - low):
                if begin[i] == begin[i + 1]:
                    sizes.append(0), digests.append(None), held.append(None)
                    continue
                own = np.unique(grams[begin[i] : begin[i + 1]])
                sizes.append(len(own)), digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest()), held.append(signed[k].tobytes())
                k += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(held, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "signature"],
            )


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |intersection| >= percent * |union| of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def least_agreement(percent: int) -> int:
    """Equal minima that a pair with exactly this similarity falls short of about three times in a million."""
    p, n = percent / 100, BANDS * ROWS
    return int(n * p - 4.5 * (n * p * (1 - p)) ** 0.5)


def _agreeing(percent: int):
    least = least_agreement(percent)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("signature", "hub_signature"))
                chosen = pa.array((a == b).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column("id").filter(chosen), batch.column("hub").filter(chosen)], names=["id", "hub"])

    return keep


def _confirmed(percent: int):
    @thrifty
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, bool)
            for low in range(0, batch.num_rows, 200):
                own, hubs = batch.column("text").slice(low, 200), batch.column("hub_text").slice(low, 200)
                sets = [s for _, _, data, offsets in text_slices(own) for s in shingle_sets(data, offsets, WIDTH)]
                hub_sets = [s for _, _, data, offsets in text_slices(hubs) for s in shingle_sets(data, offsets, WIDTH)]
                found[low : low + 200] = [_similar(a, b, percent) for a, b in zip(sets, hub_sets, strict=True)]
            chosen = pa.array(found)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(chosen), batch.column("hub").filter(chosen)], names=["u", "v"])

    return keep


def _agreeing_members(percent: int):
    """Of two blocks of a bucket, the asking and the listed members that agree in size and signature with one of the
    other side and another component; no texts are needed."""
    least = least_agreement(percent)

    def choose(table: pa.Table) -> pa.Table:
        comps, sizes = table.column("component").to_numpy(), table.column("n_shingles").to_numpy()
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        signed = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(len(comps), -1)
        chosen, listed = np.zeros(len(comps), bool), np.flatnonzero(~asks)
        for i in np.flatnonzero(asks):
            near = 100 * np.minimum(sizes[listed], sizes[i]) >= percent * np.maximum(sizes[listed], sizes[i])
            those = listed[near & (comps[listed] != comps[i])]
            those = those[(signed[those] == signed[i]).sum(axis=1) >= least]
            chosen[those] = True
            chosen[i] = len(those) > 0
        return table.select(["id", "component", "asks", "bucket", "block", "asking_block"]).filter(pa.array(chosen))

    return choose


def _compare_blocks(percent: int):
    """Links between the asking and the listed members of two blocks of a bucket; the texts are hashed once each."""
    least = least_agreement(percent)

    def compare(table: pa.Table) -> pa.Table:
        ids, comps = table.column("id").to_numpy(), table.column("component").to_numpy()
        sizes, asks = table.column("n_shingles").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)
        signed = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(len(ids), -1)
        texts, sets = table.column("text").combine_chunks(), {}

        def members(i: int) -> np.ndarray:
            if i not in sets:
                (sets[i],) = (s for _, _, data, offsets in text_slices(texts.slice(i, 1)) for s in shingle_sets(data, offsets, WIDTH))
            return sets[i]

        parent = {c: c for c in comps.tolist()}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        links = []
        listed = np.flatnonzero(~asks)
        for i in np.flatnonzero(asks):
            agreeing = (signed[listed] == signed[i]).sum(axis=1) >= least
            near = 100 * np.minimum(sizes[listed], sizes[i]) >= percent * np.maximum(sizes[listed], sizes[i])
            for j in listed[agreeing & near & (comps[listed] != comps[i])].tolist():
                a, b = root(int(comps[i])), root(int(comps[j]))
                if a != b and _similar(members(i), members(j), percent):
                    links.append((int(ids[i]), int(ids[j])))
                    parent[max(a, b)] = min(a, b)
        return pa.table({"u": pa.array([x[0] for x in links], pa.int64()), "v": pa.array([x[1] for x in links], pa.int64())})

    return compare


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs.

    Documents whose sets of five-word shingles have at least percent / 100 of their union in common are linked;
    component_id is the smallest id that links reach. Null and empty texts, and those of white space alone, have
    no shingles and no links. Rows that repeat an id are one node, whose links are pooled. A null id takes part
    only through equal sets: such rows get their class's component, or null. Texts with fewer than five words
    have one shingle of all words. An empty table gives no rows. Other columns are not read.

    Banding misses a pair of similarity 0.85 with probability 2e-8 and one of 0.8 with 7e-6.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = materialise(texts.mapInArrow(_describe, "doc_id long, n_shingles long, digest binary, signature binary"), "signatures")
    classes = described.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    slim = described.select("doc_id", "n_shingles", "digest")
    chosen = classes.where("class_id is not null").select("digest", F.col("class_id").alias("doc_id"))
    members = materialise(described.join(chosen, ["digest", "doc_id"], "left_semi").select(F.col("doc_id").alias("id"), "n_shingles", "signature").distinct(), "representatives")

    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    key = F.xxhash64("band", F.expr(f"substring(signature, band * {4 * ROWS} + 1, {4 * ROWS})"))
    bands = members.select("id", "signature", band).select("id", "band", key.alias("bucket"))
    buckets = materialise(bands.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1"), "buckets")
    in_buckets = materialise(bands.join(buckets, "bucket"), "bucket-members")
    pairs = in_buckets.where("id <> hub").select("id", "hub").distinct()

    hubs = buckets.select(F.col("hub").alias("id")).distinct()
    hub_side = members.join(hubs, "id", "left_semi").select(F.col("id").alias("hub"), F.col("n_shingles").alias("hub_n"), F.col("signature").alias("hub_signature"))
    sized = salted_join(pairs.join(members, "id"), hub_side, "hub", "id", salts=8).where(f"100 * least(n_shingles, hub_n) >= {percent} * greatest(n_shingles, hub_n)")
    candidates = materialise(sized.select("id", "hub", "signature", "hub_signature").mapInArrow(_agreeing(percent), "id long, hub long"), "candidates")

    def needed(ids: DataFrame) -> DataFrame:
        """Texts of these ids; the ids are broadcast if they are few."""
        return texts.join(bounded_broadcast(ids, ids.count()), "doc_id", "left_semi")

    ids = materialise(candidates.select(F.col("id").alias("doc_id")).union(candidates.select("hub")).distinct(), "candidate-ids")
    near_texts = needed(ids)
    paired = candidates.join(near_texts.withColumnRenamed("doc_id", "id"), "id").join(near_texts.select(F.col("doc_id").alias("hub"), F.col("text").alias("hub_text")), "hub")
    links = materialise(paired.select("id", "hub", "text", "hub_text").mapInArrow(_confirmed(percent), "u long, v long"), "confirmed")

    component = materialise(connected_components(links), "components")
    own = F.coalesce("component", "id").alias("component")
    placed = in_buckets.where("n > 2").join(component.withColumnRenamed("node", "id"), "id", "left").select("id", "band", "bucket", "hub", own)
    # the hub was compared with all, so a bucket is settled when its other members are in one component
    counted = placed.where("id <> hub").groupBy("bucket", "component").agg(F.count("*").alias("n"))
    open_buckets = counted.groupBy("bucket").agg(F.max_by("component", "n").alias("largest"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    waiting = materialise(salted_join(placed.where("id <> hub"), open_buckets, "bucket", "id").select("id", "band", "bucket", "component", (F.col("component") != F.col("largest")).alias("asks")), "open-buckets")
    if waiting.count():
        own_bucket = F.xxhash64("band", F.expr(f"substring(signature, band * {4 * ROWS} + 1, {4 * ROWS})")) == F.col("bucket")
        waiting = waiting.distinct().join(members, "id").where(own_bucket)
        sums = waiting.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        dealt = salted_join(waiting, sums, "bucket", "id").withColumn("own", F.pmod(F.xxhash64("id", "signature"), F.col("blocks")).cast("int"))
        every, slim_columns = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), ["id", "n_shingles", "signature", "component", "asks", "bucket"]
        listed = dealt.withColumn("asks", F.lit(False)).select(*slim_columns, F.col("own").alias("block"), every.alias("asking_block"))
        asking = dealt.where("asks").select(*slim_columns, every.alias("block"), F.col("own").alias("asking_block"))
        groups = ["bucket", "block", "asking_block"]
        # dealt by all three, else the join by bucket would leave all blocks of a bucket to one task
        agreeing = listed.union(asking).repartition(*groups).groupBy(*groups).applyInArrow(_agreeing_members(percent), "id long, component long, asks boolean, bucket long, block int, asking_block int")
        agreeing = materialise(agreeing.distinct(), "agreeing-members")
        agreeing_ids = materialise(agreeing.select(F.col("id").alias("doc_id")).distinct(), "agreeing-ids")
        whole = members.join(needed(agreeing_ids).withColumnRenamed("doc_id", "id"), "id")
        more = agreeing.join(whole, "id").groupBy(*groups).applyInArrow(_compare_blocks(percent), "u long, v long")
        links = materialise(links.union(more), "all-links")
        component = materialise(connected_components(links), "all-components")

    # a document without copies and links is its own component, so only the other classes are looked up
    reached = classes.join(component.withColumnRenamed("node", "class_id"), "class_id", "left").where("copies > 1 or component is not null")
    reached = reached.select("digest", F.coalesce("component", "class_id").alias("reached"))
    found = salted_join(slim.where("digest is not null"), reached, "digest", "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("reached", "doc_id").alias("component_id"))
    alone = slim.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    by_class = found.union(alone)
    discard(spark, buckets, candidates)
    return by_class.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, all columns, whose document is kept; rows that repeat a kept id all stay, rows without an id too."""
    dropped = near_duplicates(docs, percent, id_col, text_col).where("not kept and doc_id is not null").select(F.col("doc_id").alias(id_col))
    dropped = materialise(dropped.distinct(), "near-duplicates")
    return docs.join(bounded_broadcast(dropped, dropped.count()), id_col, "left_anti")

"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

A short item inside a long document has a tiny Jaccard similarity with it, so minima of the document say nothing
about the item. The signature is therefore taken of the item: the shingle that is least under a hash function is
a uniform draw from the item's set, and lies in the document with a probability equal to the containment. Items
are partitioned by the number of their shingles; each partition has its own number of hash functions, and a
document that holds a drawn shingle becomes a candidate. Candidates are verified by counting the item's shingles
that the document contains, compared as strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, discard, materialise

WIDTH = 5
#: (largest number of shingles, hash functions) of the partitions; items beyond the last have its functions.
PARTITIONS = ((4, 4), (16, 16), (64, 24), (256, 32), (1 << 62, 40))


def words_of(text: Column) -> Column:
    """Words of a text between white space (0x20, 0x09-0x0D), A-Z lowered."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, r"[\x20\x09-\x0D]+"), "")


def shingle_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, w0..w4) for each five consecutive words; texts with fewer words give none."""
    held = rows.select(key, words_of(F.col(text)).alias("w")).where(F.size("w") >= WIDTH)
    n = F.size("w") - (WIDTH - 1)
    columns = [F.slice("w", F.lit(j + 1), n).alias(f"w{j}") for j in range(WIDTH)]
    return held.select(key, F.explode(F.arrays_zip(*columns)).alias("s")).select(key, *[F.col(f"s.w{j}").alias(f"w{j}") for j in range(WIDTH)])


def _hash() -> Column:
    return F.xxhash64(*[f"w{j}" for j in range(WIDTH)])


def _string() -> Column:
    return F.concat_ws(" ", *[f"w{j}" for j in range(WIDTH)])


def contaminated(docs: DataFrame, items: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, doc_id, item_shingles, shared: documents that contain percent / 100 of an item's five-word shingles.

    Null, empty and short texts (fewer than five words) on either side match nothing. Repeated shingles count
    once. Rows that repeat a doc_id or item_id are taken together as one text's set; rows without an id are left
    out. Empty tables give no rows. Other columns are not read. Item shingles and candidates are broadcast only
    when their counted rows are few; beyond that the joins shuffle. A draw of H shingles misses an item with the
    least containment with probability (1 - percent / 100) ** H, below 3e-11 for sixteen.
    """
    spark = docs.sparkSession
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    sets = materialise(shingle_rows(items, "item_id", "text").select("item_id", _string().alias("shingle"), _hash().alias("code")).distinct(), "item-shingles")
    sizes = sets.groupBy("item_id").agg(F.count("*").alias("item_shingles"))

    functions = F.lit(PARTITIONS[-1][1])
    for most, n in reversed(PARTITIONS[:-1]):
        functions = F.when(F.col("item_shingles") <= most, n).otherwise(functions)
    hashed = sets.join(sizes, "item_id").select("item_id", "code", F.explode(F.sequence(F.lit(1), functions)).alias("f"))
    drawn = hashed.groupBy("item_id", "f").agg(F.min_by("code", F.xxhash64("f", "code")).alias("code"))
    signature = materialise(drawn.select("code", "item_id").distinct(), "item-signatures")
    hits = shingle_rows(docs, "doc_id", "text").select("doc_id", _hash().alias("code")).join(bounded_broadcast(signature, signature.count()), "code")
    candidates = materialise(hits.select("item_id", "doc_id").distinct(), "contaminated")

    few = candidates.select("doc_id").distinct()
    suspects = docs.join(bounded_broadcast(few, few.count()), "doc_id", "left_semi")
    own = shingle_rows(suspects, "doc_id", "text").select("doc_id", _string().alias("shingle"))
    rows, text_bytes = sets.agg(F.count("*"), F.sum(F.octet_length("shingle"))).first()
    shared = own.join(bounded_broadcast(sets.select("item_id", "shingle"), rows, text_bytes=text_bytes), "shingle")
    counted = shared.distinct().groupBy("item_id", "doc_id").agg(F.count("*").alias("shared")).join(candidates, ["item_id", "doc_id"], "left_semi")
    found = counted.join(sizes, "item_id").where(f"100 * shared >= {percent} * item_shingles")
    out = materialise(found.select("item_id", "doc_id", "item_shingles", "shared"), "contained")
    discard(spark, signature, candidates, sets)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, with all columns, that contain no item; rows without an id stay."""
    bad = contaminated(docs, items, percent, id_col, text_col).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(bounded_broadcast(bad, bad.count()), id_col, "left_anti")


#: The exact result in DuckDB SQL.
ORACLE = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) i FROM d)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) i FROM b)),
n AS (SELECT item_id, count(*) item_shingles FROM bs GROUP BY item_id)
SELECT item_id, doc_id, item_shingles, count(*) AS shared FROM bs JOIN ds USING (s) JOIN n USING (item_id)
GROUP BY item_id, doc_id, item_shingles HAVING 100 * count(*) >= 80 * item_shingles
"""

"""Repeated passages by sparse suffix arrays.

Suffixes are kept only where a text's own words select them: at the minimiser of each window of SPAN word GRAMs. They
are sorted by the words that follow (the first GRAM words by their common hash, then word by word), and neighbours in
the order are compared: a suffix that shares less than SUFFIX words with both neighbours lies in no repeated passage
and is dropped. A match of neighbours is extended left and right over the widest stretch of words for whose passages
of MINIMUM words the suffix is the selected one. Suffixes with equal words are ordered by these stretches, so those
whose whole stretch matches are neighbours too, and all but the first repeat it whole. Where the stretches of a match
differ, its first suffix of each stretch stands for the others, and how far it extends is told passage by passage:
those of MINIMUM words in its stretch are sorted in turn, and one that equals its neighbour before repeats it. Any
repeated passage contains a selected suffix that it shares with its copies, so none is missed, and no pairs are
listed. Stretches and passages are equal when 128 bits of hash over their words are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_array, discard, fresh, materialise, thrifty
from .tokenise import release
from .words import mix, powers, text_slices, words

#: Words of a passage, of a selecting window and of a gram in it.
MINIMUM, SPAN, GRAM = 50, 32, 8
#: Words that follow a selected suffix in each of its passages at least, by which suffixes are sorted.
SUFFIX = MINIMUM - SPAN + 1

_BASES = [np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E6C63D0876A9A47)]
_INVERSES = [np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES]


def stretch_hashes(hashes: np.ndarray, low: np.ndarray, high: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the words from low[i] to before high[i], by the first or second base."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(len(hashes), _BASES[which]))])
    back = powers(len(hashes) + 1, _INVERSES[which])
    return mix((sums[high] - sums[low]) * back[low] + (high - low).astype(np.uint64))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words."""
    low = np.arange(max(0, len(hashes) - width + 1))
    return stretch_hashes(hashes, low, low + width)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value in each run of `width` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, best, span = np.arange(len(values)), values, 1
    while span * 2 <= width:  # runs of powers of two
        left, right = best[:-span], best[span:]
        later = right < left
        at, best, span = np.where(later, at[span:], at[:-span]), np.where(later, right, left), span * 2
    gap = width - span
    left, right = best[:n], best[gap : gap + n]
    return np.where(right < left, at[gap : gap + n], at[:n])


def selected(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, low, high): the selected suffixes of texts given as in words(), and the stretch of the passages in which
    each is selected. SUFFIX words follow a selected suffix in each of its passages."""
    counts = np.maximum(np.diff(first) - MINIMUM + 1, 0)
    passages = np.repeat(first[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    if not len(passages):
        return passages, passages, passages
    chosen = sliding_least(window_hashes(hashes, GRAM), SPAN)[passages]
    begin = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
    return chosen[begin], passages[begin], passages[np.append(begin[1:], len(chosen)) - 1] + MINIMUM


SUFFIX_SCHEMA = "gram long, following binary, stretch long, stretch2 long, doc_id long, text_key long, at long, start_word long, end_word long"
ORDER = ["gram", "following", "stretch", "stretch2", "doc_id", "text_key", "at"]


@thrifty
def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The selected suffixes of texts with the words that follow, the stretch of their passages and its hashes."""
    release()
    names = [c.split()[0] for c in SUFFIX_SCHEMA.split(", ")]
    for batch in batches:
        for low, high, data, offsets in text_slices(batch.column(2), 2 << 20):
            hashes, first = words(data, offsets)
            at, begin, end = selected(hashes, first)
            if not len(at):
                continue
            owner = np.searchsorted(first, at, side="right") - 1
            doc_id, text_key = (batch.column(c).slice(low, high - low).to_numpy()[owner] for c in (0, 1))
            following = (hashes[(at + GRAM)[:, None] + np.arange(SUFFIX - GRAM)] >> np.uint64(32)).astype(">u4")
            left = mix((at - begin).astype(np.uint64))
            columns = [stretch_hashes(hashes, begin, end) ^ left, stretch_hashes(hashes, begin, end, 1), doc_id, text_key, at - first[owner], begin - first[owner], end - first[owner]]
            flat = binary_array(following.tobytes(), np.arange(len(at) + 1) * following.shape[1] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(window_hashes(hashes, GRAM)[at].view(np.int64)), flat, *(pa.array(c.view(np.int64)) for c in columns)], names=names)


def _words_of(column: pa.Array) -> np.ndarray:
    """Fixed-width binary values as rows of word codes."""
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(">u4").reshape(len(column), -1)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of suffixes in order that match a neighbour: repeated whole (earlier_doc_id is that of the first of
    them) or to be told passage by passage (null).

    The first stretch of a part and the last first one may match in another part, so these are told by passages too.
    """
    names = ["doc_id", "text_key", "start_word", "end_word", "earlier_doc_id"]
    last, waiting, first_doc = None, None, 0

    def stretches(values: list, firsts: list | np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in values), pa.array(firsts, pa.int64())], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        following = _words_of(batch.column("following"))
        keys = [batch.column(c).to_numpy() for c in ("gram", "stretch", "stretch2", "doc_id", "text_key", "at")]
        where = [batch.column(c).to_numpy() for c in names[:4]]
        if last is not None:
            following, keys = np.concatenate([last[0], following]), [np.concatenate([a, b]) for a, b in zip(last[1], keys, strict=True)]
        last = following[-1:], [k[-1:] for k in keys]
        gram, stretch, stretch2, *own = ([k[1:] == k[:-1] for k in keys])
        common = np.where(gram, GRAM + np.cumprod(following[1:] == following[:-1], axis=1).sum(axis=1), 0)
        match = common >= SUFFIX
        whole = match & stretch & stretch2
        again = np.logical_and.reduce([whole, *own])
        if len(match) < batch.num_rows:  # the part's first row
            match, whole, again = (np.concatenate([[False], x]) for x in (match, whole, again))
            head = True
        else:
            head = False
        kept = ~again
        match, whole, where = match[kept], whole[kept], [w[kept] for w in where]
        firsts = np.flatnonzero(~whole)
        if len(firsts):
            if waiting is not None and (waiting[1] or match[firsts[0]]):
                yield stretches([[v] for v in waiting[0]], [None])
            told = match[firsts]
            told[0] |= head
            told[:-1] |= match[firsts[1:]]
            waiting = [int(w[firsts[-1]]) for w in where], bool(told[-1])
            listed = firsts[:-1][told[:-1]]
            if len(listed):
                yield stretches([w[listed] for w in where], [None] * len(listed))
        place = np.maximum.accumulate(np.where(whole, -1, np.arange(len(whole)))) if len(whole) else firsts
        docs = np.where(place >= 0, where[0][place], first_doc)
        if len(docs):
            first_doc = int(docs[-1])
        if whole.any():
            yield stretches([w[whole] for w in where], docs[whole])
    if waiting is not None:
        yield stretches([[v] for v in waiting[0]], [None])


@thrifty
def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages in the stretches of a text that are to be told one by one."""
    for batch in batches:
        spans = batch.column(3)
        for low, high, data, offsets in text_slices(batch.column(2), 1 << 20):
            hashes, first = words(data, offsets)
            held = spans.slice(low, high - low)
            owner = np.repeat(np.arange(high - low), held.value_lengths().to_numpy())
            begin, end = (held.flatten().field(k).to_numpy() + first[owner] for k in (0, 1))
            counts = end - begin - MINIMUM + 1
            at = np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            owner = np.repeat(owner, counts)
            doc_id, text_key = (batch.column(c).slice(low, high - low).to_numpy()[owner] for c in (0, 1))
            columns = [stretch_hashes(hashes, at, at + MINIMUM), stretch_hashes(hashes, at, at + MINIMUM, 1), doc_id, text_key, at - first[owner]]
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["code", "code2", "doc_id", "text_key", "at"])


def _with_neighbours(keys: list[str], own: list[str]):
    """Drops repeated rows, which are neighbours, and adds same_before (equal keys of the neighbour in the part; null
    at its beginning), first_doc_id (of the first row with the keys; null if that may lie in an earlier part), last
    (the part's last row) and part."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, last, first = TaskContext.get().partitionId(), None, None, None

        def made(batch: pa.RecordBatch, ends: bool) -> pa.RecordBatch:
            tail = np.zeros(batch.num_rows, bool)
            tail[-1] = ends
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(tail), pa.array(np.full(batch.num_rows, part, np.int32))], names=[*batch.schema.names, "last", "part"])

        for batch in batches:
            if not batch.num_rows:
                continue
            values = [batch.column(k).to_numpy() for k in (*keys, *own)]
            joined = values if last is None else [np.concatenate([a, b]) for a, b in zip(last, values, strict=True)]
            last = [v[-1:] for v in values]
            equal = [v[1:] == v[:-1] for v in joined]
            same, again = np.logical_and.reduce(equal[: len(keys)]), np.logical_and.reduce(equal)
            opening = len(same) < batch.num_rows
            if opening:
                same, again = np.concatenate([[False], same]), np.concatenate([[False], again])
            kept = ~again
            batch, same, doc_ids = batch.filter(pa.array(kept)), same[kept], values[len(keys)][kept]
            if not batch.num_rows:
                continue
            begins = ~same
            unknown = np.zeros(len(same), bool)
            if opening:
                begins[0] = False
                unknown[0] = True
            begin = np.maximum.accumulate(np.where(begins, np.arange(len(same)), -1))
            firsts = pa.array(np.where(begin >= 0, doc_ids[begin], 0 if first is None else first), pa.int64(), mask=(begin < 0) & (first is None))
            first = firsts[-1].as_py()
            batch = pa.RecordBatch.from_arrays([*batch.columns, pa.array(same, mask=unknown), firsts], names=[*batch.schema.names, "same_before", "first_doc_id"])
            if held is not None:
                yield made(held, False)
            held = batch
        if held is not None:
            yield made(held, True)

    return mark


def compared(rows: DataFrame, keys: list[str], own: list[str], name: str) -> DataFrame:
    """Distinct rows sorted by keys and own (of which the first is doc_id), with same_before (whether the neighbour
    before has the same keys) and first_doc_id (of the first row with these keys).

    Sorted by ranges, so equal keys may span tasks; the rows at the ends of the parts, two a part, are compared on
    the driver.
    """
    by = [*keys, *own]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", same_before boolean, first_doc_id long, last boolean, part int"
    table = materialise(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_with_neighbours(keys, own), schema), name)
    key = F.struct(*keys)
    heads = {r[0]: r[1:] for r in table.where("same_before is null").select("part", key, "doc_id").collect()}
    tails = {r[0]: r[1:] for r in table.where("last").select("part", key, "first_doc_id").collect()}
    parts, ends, carried = sorted(heads), [], None
    for k, p in enumerate(parts):
        head = k > 0 and tails[parts[k - 1]][0] == heads[p][0]
        carried = carried if head else heads[p][1]
        ends.append((p, head, carried))
        carried = tails[p][1] if tails[p][1] is not None else carried
    ends = rows.sparkSession.createDataFrame(ends, "part int, head boolean, carried long")
    filled = {"same_before": "head", "first_doc_id": "carried"}
    out = table.join(F.broadcast(ends), "part").withColumns({k: F.coalesce(k, v) for k, v in filled.items()}).drop(*filled.values(), "part", "last")  # a row a part
    out._scratch_path = table._scratch_path
    return out


def _joined(table: pa.Table) -> pa.Table:
    """Spans of one text: stretches and passages that overlap or meet are one; each has the document of its first."""
    order = np.argsort(table.column("start_word").to_numpy(), kind="stable")
    start, end, earlier = (table.column(c).to_numpy()[order] for c in ("start_word", "end_word", "earlier_doc_id"))
    upto = np.maximum.accumulate(end)
    breaks = np.flatnonzero(start[1:] > upto[:-1])
    low, high = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(start) - 1]])
    ids = [pa.array([table.column(c)[0].as_py()] * len(low), pa.int64()) for c in ("doc_id", "text_key")]
    return pa.table({"doc_id": ids[0], "text_key": ids[1], "start_word": start[low], "end_word": upto[high], "earlier_doc_id": earlier[low]})


def _spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (64-bit hash of the text), start_word, end_word, earlier_doc_id."""
    spark = docs.sparkSession
    text = F.col(text_col)
    texts = docs.where(F.col(id_col).isNotNull() & text.isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    suffixes = materialise(texts.mapInArrow(_suffixes, SUFFIX_SCHEMA), "suffixes")
    ordered = suffixes.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    matches = materialise(ordered.mapInArrow(_neighbours, "doc_id long, text_key long, start_word long, end_word long, earlier_doc_id long"), "suffix-matches")
    discard(spark, suffixes)
    told = matches.where("earlier_doc_id is null").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    told = materialise(told, "passage-places")
    near = texts.join(told, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "spans")
    passages = materialise(near.mapInArrow(_passages, "code long, code2 long, doc_id long, text_key long, at long"), "passages")
    order = compared(passages, ["code", "code2"], ["doc_id", "text_key", "at"], "passage-order")
    discard(spark, passages, told)
    later = order.where("same_before").select("doc_id", "text_key", F.col("at").alias("start_word"), (F.col("at") + MINIMUM).alias("end_word"), F.col("first_doc_id").alias("earlier_doc_id"))
    found = matches.where("earlier_doc_id is not null").unionByName(later)
    return found.groupBy("doc_id", "text_key").applyInArrow(_joined, "doc_id long, text_key long, start_word long, end_word long, earlier_doc_id long")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start_word, end_word, earlier_doc_id: maximal runs of words, 50 at least, that occur earlier.

    Earlier means in a document with a smaller id, or further ahead in the same document; the first occurrence is
    kept and not listed. earlier_doc_id is a document that holds the span's first 50 words earlier. Words lie between
    white space (0x20, 0x09-0x0D), A-Z as a-z. Null, empty and shorter texts have no spans; texts of any length are
    taken whole; rows without an id are left out; rows that repeat an id and a text are one document; rows with one
    id and other texts are documents of their own, in the order of a hash of their texts, and each has its spans. An
    empty table gives no rows. Other columns are not read.
    """
    return _spans(docs, id_col, text_col).drop("text_key")


def _cut(spans_name: str, left_name: str):
    @thrifty
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without their spans, and whether words are left."""
        for batch in batches:
            texts, left = [], []
            for text, spans in zip(batch.column("text"), batch.column(spans_name).to_pylist(), strict=True):
                value = text.as_py()
                if spans:
                    raw = value.encode()
                    _, _, starts, ends = words(np.frombuffer(raw, np.uint8), np.asarray([0, len(raw)]), spans=True)
                    kept, at = [], 0
                    for span in sorted(spans, key=lambda s: s["start_word"]):
                        low, high = int(starts[span["start_word"]]), int(ends[span["end_word"] - 1])
                        kept.append(raw[at : max(at, low)])
                        at = max(at, high)
                    raw = b"".join([*kept, raw[at:]])
                    value = raw.decode().strip(" \t\n\r\x0b\x0c")
                    left.append(bool(value))
                else:
                    left.append(True)
                texts.append(value)
            names = [f for f in batch.schema.names if f != spans_name]
            columns = [pa.array(texts, pa.string()) if f == "text" else batch.column(f) for f in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(left, pa.bool_())], names=[*names, left_name])

    return cut


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs (columns doc_id, text and others of any names) without the words of repeated passages; n_chars, where docs
    has it, follows the text.

    Documents of which nothing is left go; all others stay, those without repeats unchanged, nulls, empty texts and
    rows without an id too. Rows that repeat an id and a text are cut alike; of rows with one id and other texts each
    is cut by its own spans. An empty table gives no rows.
    """
    spans_name, left_name, key_name, id_name = fresh(docs.columns, "spans", "words_left", "span_key", "span_id")
    spans = _spans(docs).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start_word", "end_word")).alias(spans_name))
    spans = materialise(spans.select(F.col("doc_id").alias(id_name), F.col("text_key").alias(key_name), spans_name), "spans")
    joined = docs.join(spans, (F.col("doc_id").cast("long") == F.col(id_name)) & (F.xxhash64("text") == F.col(key_name)), "left").select(*docs.columns, spans_name)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", {left_name} boolean"
    out = joined.mapInArrow(_cut(spans_name, left_name), schema).where(left_name).drop(left_name)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out

"""Toxicity by a classifier chain.

Categories are predicted one after the other: toxic in each frequent language, then toxic at all. Each link is an
L1-regularised logistic model over hashed words and word beginnings, and takes the probabilities of the links
before it as further features. In training those are out-of-fold predictions, so that a link meets inputs as good
as those it will get. The models are sparse, so a text's length hardly moves its score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import thrifty
from .tokenise import release

#: Labelled documents that a chain is fitted on, at most (those with the least hash of their id).
SAMPLE_ROWS = 8_000
BUCKETS = 1 << 20
FOLDS = 3
LANGUAGES = 8
#: Distinct words that a worker remembers, if not told otherwise.
REMEMBERED = 250_000
#: Characters of the longest word that is remembered; longer ones are looked at each time.
LONGEST = 256


def bare(word: str) -> str:
    """The word without other characters than letters at its ends."""
    low, high = 0, len(word)
    while low < high and not word[low].isalpha():
        low += 1
    while high > low and not word[high - 1].isalpha():
        high -= 1
    return word[low:high]


def word_features(word: str) -> tuple[int, ...]:
    """Buckets of a lower-cased word and of its first four and five letters."""
    word = bare(word)
    if not word:
        return ()
    names = [f"w {word}"] + [f"p {word[:n]}" for n in (4, 5) if len(word) > n]
    return tuple(zlib.crc32(n.encode()) % BUCKETS for n in names)


def text_features(text: str) -> np.ndarray:
    return np.unique(np.fromiter((f for w in set(text.lower().split()) for f in word_features(w)), np.int32))


@dataclass
class Link:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    before: np.ndarray  # weights of the earlier links' probabilities


@dataclass
class Chain:
    """categories: their names in order. threshold: least probability of the last one to be called toxic."""

    categories: list[str]
    links: list[Link]
    threshold: float

    def probabilities(self, buckets: set[int]) -> np.ndarray:
        if not hasattr(self, "_table"):
            self._table = [dict(zip(x.buckets.tolist(), x.weights.tolist(), strict=True)) for x in self.links]
        out = np.zeros(len(self.links))
        for k, (link, table) in enumerate(zip(self.links, self._table, strict=True)):
            z = link.bias + math.fsum(table.get(b, 0.0) for b in buckets) + float(link.before @ out[:k])
            out[k] = 1 / (1 + np.exp(-max(-40.0, min(40.0, z))))
        return out

    def used(self) -> set[int]:
        return {int(b) for x in self.links for b in x.buckets}


def _fit(flat: np.ndarray, first: np.ndarray, extra: np.ndarray, y: np.ndarray, penalty: float, steps: int = 80, screen: float = 5.0) -> Link:
    """L1-regularised logistic regression by accelerated proximal steps, on buckets that differ between the classes."""
    n, counts = len(y), np.diff(first)
    row = np.repeat(np.arange(n), counts)
    rate = y.mean() if n else 0.0
    if not 0 < rate < 1:
        return Link(np.zeros(0, np.int32), np.zeros(0), 8.0 if rate else -8.0, np.zeros(extra.shape[1]))
    seen = np.bincount(flat, minlength=BUCKETS)
    positive = np.bincount(flat[y[row] > 0], minlength=BUCKETS)
    with np.errstate(invalid="ignore", divide="ignore"):
        score = (positive - rate * seen) / np.sqrt(rate * (1 - rate) * seen)
    chosen = np.flatnonzero((seen >= 3) & (np.abs(score) >= screen))
    slot = np.full(BUCKETS, -1, np.int64)
    slot[chosen] = np.arange(len(chosen))
    keep = slot[flat] >= 0
    row, column = row[keep], slot[flat[keep]]
    width, depth = len(chosen), extra.shape[1]
    w, bias = np.zeros(width + depth), np.log(rate / (1 - rate))
    # step from a bound of the curvature: power iteration on X'X / 4n
    v = np.ones(width + depth)
    for _ in range(12):
        u = np.bincount(row, v[column], n) + extra @ v[width:]
        v = np.concatenate([np.bincount(column, u[row], width), extra.T @ u])
        size = np.linalg.norm(v)
        if not size:
            break
        v /= size
    curve = max(0.25, (size if width + depth else 1.0) / (4 * n) + 0.25)
    step, z, zb, t = 1 / curve, w.copy(), bias, 1.0
    for _ in range(steps):
        margin = zb + np.bincount(row, z[column], n) + extra @ z[width:]
        residual = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y
        gradient = np.concatenate([np.bincount(column, residual[row], width), extra.T @ residual]) / n
        new = z - step * gradient
        new[:width] = np.sign(new[:width]) * np.maximum(np.abs(new[:width]) - step * penalty, 0)
        new_bias = zb - step * residual.mean()
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, zb = new + (t - 1) / t_next * (new - w), new_bias + (t - 1) / t_next * (new_bias - bias)
        w, bias, t = new, new_bias, t_next
    used = np.flatnonzero(w[:width])
    return Link(chosen[used].astype(np.int32), w[used], float(bias), w[width:])


def _predict(link: Link, flat: np.ndarray, first: np.ndarray, extra: np.ndarray) -> np.ndarray:
    table = np.zeros(BUCKETS)
    table[link.buckets] = link.weights
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    z = link.bias + np.bincount(row, table[flat], len(first) - 1) + extra @ link.before
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_rows(features: list[np.ndarray], toxic: np.ndarray, language: list[str | None], penalty: float = 3e-4) -> Chain:
    """A chain from feature sets, labels and languages of a bounded sample."""
    flat = np.concatenate(features) if features else np.zeros(0, np.int32)
    first = np.concatenate([[0], np.cumsum([len(f) for f in features])]).astype(np.int64)
    toxic = np.asarray(toxic, float)
    frequent = [k for k in dict.fromkeys(sorted(set(filter(None, language)), key=lambda k: (-language.count(k), k)))][:LANGUAGES]
    targets = [(f"toxic_{k}", toxic * np.asarray([x == k for x in language])) for k in frequent] + [("toxic", toxic)]
    n = len(toxic)
    fold = (np.arange(n) * 2654435761 % (1 << 32)) % FOLDS
    earlier, links, threshold = np.zeros((n, 0)), [], 0.5
    for _, y in targets:
        held_out = np.zeros(n)
        for k in range(FOLDS):
            outside, inside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            cut = lambda rows: (np.concatenate([flat[first[i] : first[i + 1]] for i in rows] or [flat[:0]]), np.concatenate([[0], np.cumsum(np.diff(first)[rows])]).astype(np.int64))
            link = _fit(*cut(outside), earlier[outside], y[outside], penalty)
            held_out[inside] = _predict(link, *cut(inside), earlier[inside])
        links.append(_fit(flat, first, earlier, y, penalty))
        earlier = np.column_stack([earlier, held_out])
    if 0 < toxic.sum() < n:
        order = np.argsort(-earlier[:, -1], kind="stable")
        hits = np.cumsum(toxic[order])
        score = 5 * hits / (np.arange(1, n + 1) + 4 * toxic.sum())  # a missed toxic text weighs more than a clean one called
        best = int(np.argmax(score))
        below = earlier[order[best + 1], -1] if best + 1 < n else 0.0
        threshold = float(np.clip((earlier[order[best], -1] + below) / 2, 0.02, 0.98))
    return Chain([name for name, _ in targets], links, threshold)


@thrifty
def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        sets = [text_features(x.as_py() or "") for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("lang"), pa.array(sets, pa.list_(pa.int32()))], names=["doc_id", "toxic", "lang", "features"])


def fit_chain(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, penalty: float = 3e-4) -> Chain:
    """Fit on at most sample_rows labelled documents; their feature sets, not their texts, reach the driver.

    Labels that are null, and labels without a document, are left out; of labels that repeat an id the largest
    counts, of documents that repeat one the last in the order of texts. The sample is in the order of its ids, so
    the chain does not depend on partitions. Categories are the LANGUAGES most frequent languages of the sample,
    ties by name, and toxic; other languages are judged by the last alone. Without labels nothing is called toxic.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("text", lang.alias("lang")).alias("text")).join(F.broadcast(sample), "doc_id")  # sample_rows at most
    rows = rows.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).select("doc_id", "toxic", "text.lang", "text.text")
    table = rows.mapInArrow(_featurise, "doc_id long, toxic int, lang string, features array<int>").toArrow().sort_by("doc_id")
    features = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.int32) if x.is_valid else np.zeros(0, np.int32) for x in table.column("features").combine_chunks()] if table.num_rows else []
    if not features:
        return Chain(["toxic"], [Link(np.zeros(0, np.int32), np.zeros(0), -8.0, np.zeros(0))], 0.5)
    return fit_rows(features, table.column("toxic").to_numpy(), table.column("lang").to_pylist(), penalty)


class _Scorer:
    """Probabilities of texts; the features that a model uses are looked up once for each word that is remembered."""

    def __init__(self, chain: Chain, remembered: int = REMEMBERED):
        self.chain, self.used, self.seen, self.hits, self.remembered = chain, chain.used(), set(), {}, remembered
        self.none = chain.probabilities(set())

    def __call__(self, text: str) -> np.ndarray:
        found, buckets = set(text.lower().split()), set()
        for word in found - self.seen:
            features = [f for f in word_features(word) if f in self.used]
            buckets.update(features)
            if len(word) <= LONGEST and len(self.seen) < self.remembered:
                self.seen.add(word)
                if features:
                    self.hits[word] = features
        for word in self.hits.keys() & found:
            buckets.update(self.hits[word])
        return self.chain.probabilities(buckets) if buckets else self.none


def toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, a probability p_<category> for each link, and toxic (the last one reaches the threshold, ties included).

    One row for each row of docs, whole texts of any length; other columns are not read. Null and empty texts have the models' base rate, and are not toxic where that
    is below the threshold; null ids and repeated rows are scored like any. No shuffle.
    """
    names = [f"p_{c}" for c in chain.categories]

    @thrifty
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scorer = _Scorer(chain)
        for batch in batches:
            p = np.asarray([scorer(x.as_py() or "") for x in batch.column("text")]).reshape(batch.num_rows, len(names))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(p[:, k]) for k in range(len(names))), pa.array(p[:, -1] >= chain.threshold)], names=["doc_id", *names, "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, " + ", ".join(f"`{n}` double" for n in names) + ", toxic boolean")


def without_toxic(docs: DataFrame, chain: Chain, remembered: int = REMEMBERED) -> DataFrame:
    """Rows of docs, all columns whatever their names, that the chain does not call toxic (null and empty texts as in
    toxicity(), repeated rows alike); a worker remembers `remembered` words at most."""

    @thrifty
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scorer = _Scorer(chain, remembered)
        for batch in batches:
            yield batch.filter(pa.array([bool(scorer(x.as_py() or "")[-1] < chain.threshold) for x in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)

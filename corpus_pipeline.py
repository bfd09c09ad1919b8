"""The corpus pipeline: toxicity, near-dedup, repeated passages, decontamination, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keystrata.llm.common import BATCH_SETTING, bound_batches, materialise, parquet
from keystrata.llm.decontam import decontaminate
from keystrata.llm.neardup import without_near_duplicates
from keystrata.llm.packing import pack, token_pieces
from keystrata.llm.substrings import without_repeats
from keystrata.llm.toxicity import fit_chain, without_toxic

#: Words, and pieces for packing, that a Python worker remembers: few, as the stages share their executors' memory.
REMEMBERED = 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a chain fitted on the table labels does not call toxic."""
    bound_batches(spark)
    return without_toxic(docs, fit_chain(docs, parquet(spark, sf_dir, "labels")), remembered=REMEMBERED)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of similarity 0.8 or more."""
    bound_batches(spark)
    return without_near_duplicates(docs, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that occur earlier."""
    bound_batches(spark)
    return without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate(docs, parquet(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, their ids included, with their sequence and offset."""
    bound_batches(spark)
    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True, remembered=REMEMBERED))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The chain of classifiers has no SQL form; the stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again. The session's bound of
    Arrow batches, which the stages lower, is set back at the end."""
    docs, before = parquet(spark, sf_dir, "documents"), spark.conf.get(BATCH_SETTING)
    try:
        for name, stage in STAGES:
            docs = materialise(stage(spark, docs, sf_dir), name)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return docs

"""Queries of the training-data operators over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parquet, scratch
from .decontam import ORACLE as DECONTAM_ORACLE
from .decontam import contaminated
from .licenses import license_notices
from .neardup import near_duplicates
from .media import media_features, read_archives, write_archives
from .packing import pack, token_pieces
from .sharding import shard_documents
from .substrings import repeated_passages
from .tokens import read_token_files, write_token_files
from .toxicity import fit_chain, toxicity
from .warc import read_warc, write_warc


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(parquet(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "benchmark"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(parquet(spark, sf_dir, "documents"), scratch(spark, "token-files"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, manifest, with_ids=False)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(parquet(spark, sf_dir, "documents"), percent=85)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(parquet(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_warc(spark, manifest).drop("url")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_notices(parquet(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(parquet(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op8_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(parquet(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents")
    return toxicity(docs, fit_chain(docs, parquet(spark, sf_dir, "labels")))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "media")
    manifest = write_archives(parquet(spark, sf_dir, "documents"), folder)
    return media_features(read_archives(spark, folder, manifest))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_token_files": op3_token_files,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_warc": op5_warc,
    "op6_licenses": op6_licenses,
    "op7_packing": op7_packing,
    "op8_suffix_arrays": op8_suffix_arrays,
    "op9_toxicity": op9_toxicity,
    "op10_media": op10_media,
}

ORACLES: dict[str, str] = {"op2_decontamination": DECONTAM_ORACLE}

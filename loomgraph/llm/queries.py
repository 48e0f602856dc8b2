"""The queries of this subpackage, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import chat, inner_product, lattice, licenses, packing, resampling, sharding, simhash, syncmers, toxicity
from loomgraph.session import read_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edit_report(read_table(spark, sf_dir, "documents"))


def op2_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.sample_segmentations(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), k=4)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(read_table(spark, sf_dir, "documents"), shards=8)


def op4_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read_table(spark, sf_dir, "conversations"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, _ = resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_product.top_k(read_table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_syncmers": op1_syncmers,
        "op2_segmentations": op2_segmentations,
        "op3_sharding": op3_sharding,
        "op4_chats": op4_chats,
        "op5_quality": op5_quality,
        "op6_simhash": op6_simhash,
        "op7_licenses": op7_licenses,
        "op8_toxicity": op8_toxicity,
        "op9_inner_product": op9_inner_product,
        "op10_packing": op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_licenses": licenses.oracle(), "op9_inner_product": inner_product.oracle()}

"""A training-corpus pipeline: quality, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last keep the columns of
documents, and any others, whatever their names. The last returns one row per packed piece.
Texts are read whole at any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import neardup, packing, resampling, toxicity
from loomgraph.llm.queries import tokenizer_path
from loomgraph.session import discard, materialize, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps.

    Null texts count as empty, and an empty text weighs 0. Rows equal in id and text, and rows
    whose keys tie with the last kept one, stay or go together; a null id is weighed by its
    text. Without documents labelled good all stay. An empty table gives none.
    """
    return resampling.keep_sample(docs, read_table(spark, sf_dir, "labels"))


def civility(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the recurrent network does not call toxic.

    Null texts count as empty, and are one window without words. Repeated rows stay or go
    together; a score of exactly 0.5 goes. Without labels of both classes all stay. An empty
    table gives none.
    """
    return toxicity.keep_civil(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest id, of each group linked by a shingle similarity of 0.8 and more.

    SimHash links over five-word shingles come first, then the pairs they cannot see; all are
    held against the shingles. Null, empty and blank texts are copies of each other. Of rows
    that repeat the surviving id one stays; rows with a null id all stay. An empty table gives none.
    """
    return neardup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in token sequences.

    Null and empty texts are their closing id alone; repeated rows are packed each, and rows
    with a null id too. An empty table gives no pieces.
    """
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("toxicity", civility), ("near_dedup", near_dedup), ("packing", pack)]

#: The classifiers and the tokenizer are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has written goes once the next one is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""Incremental ingest as Structured Streaming jobs that stop when they have caught up.

A checkpoint takes the place of a last-run marker: what it has seen is not read again,
and a run that breaks off is resumed. Every batch is written idempotently, so a batch
that runs twice leaves one result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.functions.text import chunk_documents
from loomgraph.operators.writes import Store
from loomgraph.session import discard, materialize

DOCUMENT = "doc_id string, text string"


def drain(frame: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run a stream over what is there, batch by batch, and wait for its end."""
    query = frame.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def documents(spark: SparkSession, path: str, schema: str = DOCUMENT, files_per_batch: int = 1000) -> DataFrame:
    """The documents of new files, with the time their file was written."""
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return read.select("*", F.col("_metadata.file_modification_time").alias("arrived"), F.col("_metadata.file_name").alias("file"))


def ingest_chunks(spark: SparkSession, path: str, store: Store, checkpoint: str, table: str = "chunk", files_per_batch: int = 1000) -> StreamingQuery:
    """Chunk new documents into a stored table; a document that comes again replaces its chunks.

    Of versions of a document within a batch the one that arrived last counts. Empty
    documents clear. Only buckets with documents of the batch are written anew.
    """

    def each(batch: DataFrame, _: int) -> None:
        latest = materialize(batch.groupBy("doc_id").agg(F.max_by("text", F.struct("arrived", "file", "text")).alias("text")), "ingest-latest")
        store.replace_buckets(table, chunk_documents(latest, "doc_id", "text"), latest)
        discard(latest)

    return drain(documents(spark, path, files_per_batch=files_per_batch), checkpoint, each)


def best_entities(spark: SparkSession, path: str, store: Store, checkpoint: str, table: str = "entity") -> StreamingQuery:
    """Keep for each id the surest version seen so far; of equals the first stored stays."""
    schema = "id string, label string, entity_type string, confidence double"

    def each(batch: DataFrame, number: int) -> None:
        fresh = batch.withColumn("_new", F.lit(1))
        every = fresh if not store.version(table) else store.read(table).withColumn("_new", F.lit(0)).unionByName(fresh)
        rank = F.struct("confidence", (-F.col("_new")).alias("o"), "label", "entity_type")
        best = every.groupBy("id").agg(F.max_by(F.struct("label", "entity_type", "confidence"), rank).alias("b")).select("id", "b.label", "b.entity_type", "b.confidence")
        store.write(table, best)

    return drain(spark.readStream.schema(schema).parquet(path), checkpoint, each)


def daily_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events of each type and day, on a stream or a table; `late` is how long a stream waits for stragglers."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks take no zoneless times
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")

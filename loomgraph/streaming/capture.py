"""Thoughts captured as they come: extracted, stored, embedded, cut into passages, and linked to what is near."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import chunk_documents, short_hash
from loomgraph.operators import extraction, writes
from loomgraph.operators import retrieval as rt
from loomgraph.operators.ontology import Ontology
from loomgraph.plans.texts import link_entities
from loomgraph.session import materialize
from loomgraph.streaming.ingest import drain

ENTITY = "id string, label string, entity_type string, description string, confidence double, provenance string, updated_at long, embedding array<double>"
EDGE = "src string, dst string, edge_type string, confidence double, evidence string, created_at long"


def with_thought_ids(thoughts: DataFrame) -> DataFrame:
    """(doc_id, text) of thoughts (text, tags array): tags stand before the text, and the id hashes both."""
    line = F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0, F.concat(F.lit("Tags: "), F.array_join("tags", ", "), F.lit("\n\n"))).otherwise("")
    text = F.concat(line, F.coalesce("text", F.lit("")))
    return thoughts.select(short_hash(text, "mcp_").alias("doc_id"), text.alias("text")).distinct()


def capture(store: writes.Store, thoughts: DataFrame, extract: extraction.Extractor = extraction.co_occurrence, embedder: rt.Embedder = rt.hash_embed, ontology: Ontology | None = None, now: int = 0, near: int = 10, least: float = 0.35) -> DataFrame:
    """Store what thoughts (text, tags) say in the tables entity, edge and chunk; (a, b, similarity) of new entities and unlinked ones near to them.

    A thought without entities stores nothing but its passages. Running it again changes nothing.
    """
    ontology = ontology or Ontology()
    spark = thoughts.sparkSession
    docs = materialize(with_thought_ids(thoughts), "capture-docs")
    found = materialize(extract(docs), "capture-found")
    named = extraction.canonical_types(extraction.entities(found), ontology)
    best = named.groupBy("id").agg(F.max_by(F.struct("label", "entity_type", "description", "confidence"), F.struct("confidence", "label")).alias("b")).select("id", "b.*")
    said = best.withColumn("_said", F.concat_ws(": ", "label", F.when(F.col("description") != "", F.col("description"))))
    new = embedder(said, "_said").drop("_said").withColumn("embedding", F.col("embedding").cast("array<double>")).withColumn("provenance", F.lit("thought")).withColumn("updated_at", F.lit(now).cast("long"))
    new = materialize(new.select(*[c.split()[0] for c in ENTITY.replace("array<double>", "array").split(", ")]), "capture-entities")
    stored = store.read("entity") if store.version("entity") else spark.createDataFrame([], ENTITY)
    store.write("entity", writes.upsert_entities(stored, new, now))
    entities = store.read("entity")
    links = extraction.edges(found).select("src", "dst", "edge_type", "confidence", "evidence", F.lit(now).cast("long").alias("created_at"))
    before = store.read("edge") if store.version("edge") else spark.createDataFrame([], EDGE)
    store.write("edge", writes.upsert_edges(before, links, entities, ontology))
    pieces = chunk_documents(docs, "doc_id", "text")
    surfaces = extraction.entities(found).select(F.col("id").alias("entity_id"), "doc_id", F.col("label").alias("surface"))
    linked = link_entities(pieces, surfaces).groupBy(F.col("chunk_id").alias("id")).agg(writes.entity_ids_text(F.collect_list("entity_id")).alias("entity_ids"))
    rows = embedder(pieces.join(linked, "id", "left").withColumn("entity_ids", F.coalesce("entity_ids", F.lit("[]"))), "body")
    store.replace_buckets("chunk", rows.withColumn("embedding", F.col("embedding").cast("array<double>")), docs)
    seeds = entities.join(new.select("id"), "id", "left_semi")
    return rt.hidden_pairs(entities, store.read("edge"), seeds, k=near, least=least, top=None)


def capture_stream(spark: SparkSession, path: str, store: writes.Store, checkpoint: str, each: Callable[[DataFrame], None] | None = None, **options):
    """Capture thoughts from Parquet files (text, tags) as they arrive; `each` is handed the hidden links of a batch."""

    def run(batch: DataFrame, _: int) -> None:
        hidden = capture(store, batch, **options)
        if each:
            each(hidden)

    return drain(spark.readStream.schema("text string, tags array<string>").parquet(path), checkpoint, run)

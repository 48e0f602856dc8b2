"""Writes as plans: upserts with gates, per-document replacement, versioned tables."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import chunk_documents, slugify
from loomgraph.operators.ontology import Ontology, grade_violations


def upsert_entities(stored: DataFrame, incoming: DataFrame, now: int, order: str = "updated_at") -> DataFrame:
    """Stored rows stay as first written, but for updated_at where they come again; new ids are added.

    Of incoming rows with one id the last by `order` counts, of equally late ones one by a hash.
    """
    last = Window.partitionBy("id").orderBy(F.desc(order), F.xxhash64(*[c for c in incoming.columns if "map<" not in dict(incoming.dtypes)[c]]))  # equals in any one order
    new = incoming.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
    seen = new.select("id", F.lit(True).alias("_again"))
    kept = stored.join(seen, "id", "left").withColumn("updated_at", F.when(F.col("_again"), F.lit(now)).otherwise(F.col("updated_at")).cast("long")).drop("_again")
    fresh = new.join(stored.select("id"), "id", "left_anti").withColumn("updated_at", F.lit(now).cast("long"))
    return kept.unionByName(fresh)


def upsert_edges(stored: DataFrame, incoming: DataFrame, entities: DataFrame, ontology: Ontology, grades: bool = False) -> DataFrame:
    """Stored edges and those incoming that pass: known type, both ends there, and with `grades` an allowed pair.

    One edge per (src, dst, edge_type), the first written.
    """
    ids = entities.select("id").distinct()  # grows with the graph: what Spark takes for small is built on the driver and held by every task
    good = incoming.where(ontology.known_edge(F.col("edge_type"))).join(ids.withColumnRenamed("id", "src").hint("merge"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst").hint("merge"), "dst", "left_semi")
    if grades:
        bad = grade_violations(good, entities, ontology).select(F.col("focus").alias("_key")).distinct()
        good = good.withColumn("_key", F.concat("src", F.lit(" -["), "edge_type", F.lit("]-> "), "dst")).join(bad, "_key", "left_anti").drop("_key")
    key = ["src", "dst", "edge_type"]
    first = Window.partitionBy(*key).orderBy("created_at", "confidence")
    new = good.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r").join(stored.select(*key).hint("merge"), key, "left_anti")
    return stored.unionByName(new.select(*stored.columns))


def upsert_mentions(mentions: DataFrame, entities: DataFrame, documents: DataFrame, order: str | None = None) -> DataFrame:
    """One mention per (entity_id, doc_id), the first; both ends must be there.

    First is by the column `order`, or without one the surest, then by its source.
    """
    known = mentions.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").join(documents.select("doc_id"), "doc_id", "left_semi")
    first = [F.asc(order)] if order else []
    rank = Window.partitionBy("entity_id", "doc_id").orderBy(*first, F.desc("confidence"), "source_url")
    return known.withColumn("_r", F.row_number().over(rank)).where("_r = 1").select("entity_id", "doc_id", "confidence", "source_url")


def add_documents(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored documents and those incoming whose id is new; of equal incoming ids the first by path."""
    rank = Window.partitionBy("id").orderBy("path")
    new = incoming.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r").join(stored.select("id"), "id", "left_anti")
    return stored.unionByName(new.select(*stored.columns))


def set_column(stored: DataFrame, changes: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Stored rows with `column` overwritten where changes (key, column) name them: vectors, entity ids."""
    new = changes.select(key, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    return stored.join(new, key, "left").withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).select(*stored.columns)


def set_embedding(entities: DataFrame, vectors: DataFrame, width: int | None = None) -> DataFrame:
    """Entities with the vectors of (id, embedding); a vector of another width than `width` raises."""
    if width is not None:
        vectors = vectors.withColumn("embedding", F.when(F.size("embedding") == width, F.col("embedding")).otherwise(F.raise_error(F.lit(f"an embedding has not {width} numbers"))))
    return set_column(entities, vectors, "embedding")


def entity_ids_text(ids: Column) -> Column:
    """An array of ids as JSON text, sorted and without repeats."""
    return F.to_json(F.array_sort(F.array_distinct(ids)))


def entity_ids_array(text: Column) -> Column:
    """The ids of such a text; an empty array for null, blank or unreadable text."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def set_entity_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks with the entity ids of (id, entity_ids array) in place of theirs, as sorted JSON text."""
    return set_column(chunks, ids.select("id", entity_ids_text(F.col("entity_ids")).alias("entity_ids")), "entity_ids")


def upsert_chunks(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored chunks but for those that come again, and the incoming ones."""
    return stored.join(incoming.select("id"), "id", "left_anti").unionByName(incoming.select(*stored.columns))


def delete_by_doc(chunks: DataFrame, doc_ids: DataFrame) -> tuple[DataFrame, int]:
    """Chunks without those of the documents, and how many those were."""
    gone = chunks.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").count()
    return chunks.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti"), gone


def ingest_document_chunks(stored: DataFrame, docs: DataFrame, embedder=None) -> DataFrame:
    """Stored chunks with those of docs (doc_id, source_uri, title, text, sensitivity) in place of theirs.

    embedder adds `embedding` to the pieces; without one, vectors are null.
    """
    pieces = chunk_documents(docs, "doc_id", "text", uri_col="source_uri").join(docs.select("doc_id", "source_uri", "title", "sensitivity"), "doc_id")
    made = embedder(pieces, "body") if embedder else pieces.withColumn("embedding", F.lit(None).cast("array<double>"))
    made = made.withColumn("entity_ids", F.lit("[]")).withColumn("embedding", F.col("embedding").cast("array<double>"))
    return replace_by_doc(stored, made.select(*stored.columns), docs.select("doc_id"))


#: Columns of stored chunks.
CHUNK_COLUMNS = "id string, doc_id string, source_uri string, title string, body string, chunk_index int, entity_ids string, embedding array<double>, sensitivity string"


def safe_to_delete(ids: DataFrame, edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, edges, mentions, safe) of entities that shall go: safe if neither an edge nor a mention names them."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("edges"))
    told = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("mentions"))
    found = ids.select("id").distinct().join(ends, "id", "left").join(told, "id", "left").fillna(0, ["edges", "mentions"])
    return found.withColumn("safe", (F.col("edges") == 0) & (F.col("mentions") == 0))


def hyperedges(nodes: DataFrame) -> DataFrame:
    """(edge_id, entity_id, rel): the first participant CONNECTS, the others the edge BINDS."""
    each = nodes.select("edge_id", F.posexplode("participants").alias("pos", "entity_id"))
    return each.select("edge_id", "entity_id", F.when(F.col("pos") == 0, "CONNECTS").otherwise("BINDS").alias("rel"))


def replace_by_doc(stored: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """Stored rows of untouched documents and the new rows; a touched document without new rows is cleared."""
    return stored.join(touched.select("doc_id").distinct(), "doc_id", "left_anti").select(*new.columns).unionByName(new)


def dangling(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with an end that is no entity."""
    ids = entities.select("id").distinct()
    a, b = ids.select(F.col("id").alias("src"), F.lit(1).alias("_s")), ids.select(F.col("id").alias("dst"), F.lit(1).alias("_d"))
    return edges.join(a.hint("merge"), "src", "left").join(b.hint("merge"), "dst", "left").where("_s is null or _d is null").drop("_s", "_d")


def keep_linked(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges whose ends are both kept."""
    ids = kept.select("id").distinct()
    return edges.join(ids.select(F.col("id").alias("src")).hint("merge"), "src", "left_semi").join(ids.select(F.col("id").alias("dst")).hint("merge"), "dst", "left_semi")


class Store:
    """Named tables in versioned folders; a table's current version is one small pointer file.

    A write makes a new folder and then repoints, so readers see the old or the new table
    whole. One writer per table. Paths go through Hadoop's file systems.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def version(self, table: str) -> str | None:
        path = self._path(table, "CURRENT")
        fs = path.getFileSystem(self._conf)
        if not fs.exists(path):
            return None
        return self.spark.read.text(str(path)).first()[0]

    def read(self, table: str) -> DataFrame:
        version = self.version(table)
        if version is None:
            raise FileNotFoundError(f"no table {table} in {self.root}")
        if version.startswith("{"):
            parts = json.loads(version)
            schema = self.spark.read.parquet(f"{self.root}/{table}/{parts['schema']}").schema
            paths = [f"{self.root}/{table}/{p}" for p in parts["buckets"].values()]
            return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{table}/{version}")

    def replace_buckets(self, table: str, new: DataFrame, touched: DataFrame, key: str = "doc_id", buckets: int = 64) -> None:
        """Replace the rows of the touched keys by new rows; only the buckets of those keys are written anew.

        A bucketed table's pointer lists a folder for each of its buckets.
        """
        version = self.version(table)
        at = json.loads(version) if version else {"schema": None, "buckets": {}, "count": buckets}
        number = F.pmod(F.xxhash64(F.col(key)), F.lit(at["count"]))
        changed = sorted(r[0] for r in touched.select(number).distinct().collect())  # at most as many as there are buckets
        held = [f"{self.root}/{table}/{at['buckets'][str(b)]}" for b in changed if str(b) in at["buckets"]]
        rows = new
        if held:
            rows = self.spark.read.schema(new.schema).parquet(*held).join(touched.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)
        folder = f"v{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        dealt = rows.withColumn("_bucket", number)
        dealt.repartition(max(1, len(changed)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{table}/{folder}")
        if at["schema"] is None:
            at["schema"] = f"{folder}-schema"
            new.limit(0).write.parquet(f"{self.root}/{table}/{at['schema']}")
        path = self._path(table, folder)
        made = {s.getPath().getName() for s in path.getFileSystem(self._conf).listStatus(path)}
        for b in changed:
            at["buckets"].pop(str(b), None)
            if f"_bucket={b}" in made:
                at["buckets"][str(b)] = f"{folder}/_bucket={b}"
        self._point(table, json.dumps(at))

    def _point(self, table: str, version: str) -> None:
        path = self._path(table, "CURRENT")
        out = path.getFileSystem(self._conf).create(path, True)
        out.write(bytearray(version.encode()))
        out.close()

    def write(self, table: str, df: DataFrame, check=None) -> str:
        """Write a new version, hold it against `check` (a function of the written table), and make it current."""
        version = f"v{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.root}/{table}/{version}")
        if check is not None and not check(self.spark.read.parquet(f"{self.root}/{table}/{version}")):
            raise ValueError(f"version {version} of {table} failed its check; the current one stays")
        self._point(table, version)
        return version

    def versions(self, table: str) -> list[str]:
        path = self._path(table)
        fs = path.getFileSystem(self._conf)
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())


def migrate(store: Store, steps: dict[int, object], target: int) -> int:
    """Run the numbered steps from the stored schema version to the target; a missing step raises."""
    try:
        at = json.loads(store.read("schema_version").first()[0])["version"]
    except FileNotFoundError:
        at = 0
    while at < target:
        if at + 1 not in steps:
            raise LookupError(f"no step to version {at + 1}")
        steps[at + 1](store)
        at += 1
        store.write("schema_version", store.spark.createDataFrame([(json.dumps({"version": at}),)], "value string"))
    return at


def rebuild(source: Store, target: Store, drop: DataFrame, links: dict[str, tuple[str, ...]], entity_table: str = "entity") -> dict[str, int]:
    """Write a store without the entities `drop` (id) and without rows that name them; rows written by table.

    links: of other tables, the columns that hold entity ids; tables without any are copied.
    A target that has tables already is refused, and the source is never changed.
    """
    for table in [entity_table, *links]:
        if target.version(table) is not None:
            raise FileExistsError(f"{target.root} has a table {table} already")
    kept = source.read(entity_table).join(drop.select("id"), "id", "left_anti")
    target.write(entity_table, kept)
    ids = target.read(entity_table).select("id")
    out = {entity_table: ids.count()}
    for table, columns in links.items():
        rows = source.read(table)
        for column in columns:
            rows = rows.join(ids.select(F.col("id").alias(column)), column, "left_semi")
        target.write(table, rows.select(*source.read(table).columns))
        out[table] = target.read(table).count()
    return out


def merge_live(source: Store, target: Store, canonical: DataFrame) -> dict[str, int]:
    """Write a store whose entities are merged by (label, canonical): edges and mentions repointed, vectors carried over.

    Tables: entity (with embedding), edge, mention. A target that has tables is refused.
    """
    from loomgraph.operators import resolve

    for table in ("entity", "edge", "mention"):
        if target.version(table) is not None:
            raise FileExistsError(f"{target.root} has a table {table} already")
    entities = source.read("entity")
    listed = entities.withColumn("doc_id", F.lit(None).cast("string")) if "doc_id" not in entities.columns else entities
    ids = entities.join(canonical.select("label", "canonical"), "label").select("id", slugify(F.col("canonical")).alias("new_id")).distinct()
    merged = resolve.merge_entities(listed, canonical).withColumnRenamed("new_id", "id")
    target.write("entity", merged.join(resolve.merge_vectors(entities, canonical).withColumnRenamed("new_id", "id"), "id", "left"))
    target.write("edge", resolve.rewrite_edges(source.read("edge"), ids))
    target.write("mention", resolve.repoint_mentions(source.read("mention"), ids))
    return {t: target.read(t).count() for t in ("entity", "edge", "mention")}

"""One entry to every kind of search."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import graph
from loomgraph.operators import retrieval as rt
from loomgraph.session import materialize

MODES = ("keyword", "semantic", "hybrid", "hidden", "chunks")


@dataclass
class Searcher:
    """Searches entities (id, label, description, confidence), their edges, and indexed chunks.

    index and chunk_vectors: of the chunks that may be found. embedder: adds `embedding`.
    """

    entities: DataFrame
    edges: DataFrame
    chunks: DataFrame
    index: rt.TextIndex
    chunk_vectors: DataFrame
    embedder: rt.Embedder

    @cached_property
    def _vectors(self) -> DataFrame:
        """(id, embedding) of the entities, embedded once for all modes."""
        named = self.entities.select("id", F.concat_ws(": ", "label", F.when(F.col("description") != "", F.col("description"))).alias("_said"))
        return materialize(self.embedder(named, "_said").select("id", "embedding"), "search-vectors")

    def _asked(self, queries: DataFrame) -> DataFrame:
        return self.embedder(queries, "text").select("query_id", "embedding")

    def keyword(self, queries: DataFrame, limit: int, kind: str | None = None) -> DataFrame:
        """Entities with the text in their label, the surest first. The texts are few: a block of queries against all labels."""
        pool = self.entities if kind is None else self.entities.where(F.col("entity_type") == kind)
        texts = [(r.query_id, r.text) for r in queries.select("query_id", "text").collect()]
        asked = F.array(*[F.struct(F.lit(i).alias("query_id"), F.lit(t or "").alias("t")) for i, t in texts])
        met = pool.select("id", "label", "confidence", F.explode(F.filter(asked, lambda a: F.contains(F.lower(F.col("label")), F.lower(a["t"])))).alias("a"))
        return rt.top_by(met.select("a.query_id", "id", F.col("confidence").alias("score")), "score", limit)

    def semantic(self, queries: DataFrame, limit: int) -> DataFrame:
        found = rt.vector_search(self._vectors, self._asked(queries), limit)
        return found.select("query_id", "id", F.col("similarity").alias("score"), "rank")

    def hybrid(self, queries: DataFrame, limit: int, kind: str | None = None) -> DataFrame:
        fused = rt.fuse(self.keyword(queries, 2 * limit, kind), self.semantic(queries, 2 * limit), limit)
        return fused.select("query_id", "id", "score", "rank")

    def hidden(self, queries: DataFrame, limit: int) -> DataFrame:
        """What is near to the entity nearest to the text, and not linked to it."""
        seeds = materialize(self.semantic(queries, 1).select("query_id", F.col("id").alias("seed")), "search-seeds")
        start = materialize(self._vectors.join(F.broadcast(seeds.select(F.col("seed").alias("id")).distinct()), "id"), "search-start")  # a row a query
        near = materialize(rt.hidden_pairs(self._vectors, self.edges, start, top=None), "search-near")
        ends = near.select(F.col("a").alias("seed"), F.col("b").alias("id"), "similarity").unionByName(near.select(F.col("b").alias("seed"), F.col("a").alias("id"), "similarity"))
        return rt.top_by(ends.join(seeds, "seed").select("query_id", "id", F.col("similarity").alias("score")), "score", limit)

    def passages(self, queries: DataFrame, limit: int) -> DataFrame:
        fused = rt.fuse(rt.bm25(self.index, queries), rt.vector_search(self.chunk_vectors, self._asked(queries), rt.LEG), limit)
        return fused.select("query_id", "id", "score", "rank")

    def search(self, queries: DataFrame, mode: str, limit: int = 10, kind: str | None = None) -> DataFrame:
        """(query_id, id, score, rank) of queries (query_id, text) in one of MODES; entities, or chunks in mode chunks."""
        if mode == "keyword":
            return self.keyword(queries, limit, kind)
        if mode == "hybrid":
            return self.hybrid(queries, limit, kind)
        by_mode = {"semantic": self.semantic, "hidden": self.hidden, "chunks": self.passages}
        if mode not in by_mode:
            raise ValueError(f"no mode {mode}; there are {', '.join(MODES)}")
        return by_mode[mode](queries, limit)

    def path(self, source: str, target: str, hops: int = 4, limit: int = 5) -> DataFrame:
        """The surest paths from entities whose label holds `source` to those whose label holds `target`; hops 1 to 6."""
        named = lambda t: self.entities.where(F.col("label").contains(t)).select("id")
        return graph.paths(self.edges, named(source), named(target), max(1, min(6, hops)), limit)

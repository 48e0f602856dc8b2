"""Exact top-k by inner product: norm-sorted vectors, rotated partial sums, residual bounds.

Every component x becomes floor(1024 x), and scores are exact integers. An orthogonal
rotation (right singular vectors of the whole table, from its d x d second moments) puts
most of the length into the first coordinates. Vectors go by descending length. For a
query q with k-th best score t so far, a vector c is left out if |q||c| < t, and else
if its partial sum over the first coordinates plus |q_rest||c_rest| is below t
(Cauchy-Schwarz). What is left is scored in whole numbers. Bounds carry a margin over the
rounding error of doubles, so nothing that could reach t is lost.

Queries go in blocks of a fixed size, each broadcast to one pass over the vectors.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.session import materialize, scratch_root, ship_package

SCALE = 1024
#: Queries in a block, longest vectors that give each query its first threshold, and coordinates of the partial sums.
QUERY_BLOCK, HEAD, LEADING = 16_384, 4_096, 16
#: Rows of a range of lengths.
RANGE_ROWS = 20_000
#: Candidates scored at once against a block of queries, and queries at once.
STEP, QUERY_STEP = 512, 1024


def quantize(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<bigint>, norm double), longest first when sorted; vectors null or not finite are left out."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return (
        vectors.where(x.isNotNull() & finite)
        .select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * SCALE)).alias("v"))
        .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))))
    )


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as whole numbers, shorter ones filled up with zeros."""
    out = np.zeros((len(column), width), np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def second_moments(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            v = matrix(batch.column(0), width).astype(float)
            total += v.T @ v
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "s"])

    return run


def rotation(table: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of the table as columns, largest singular value first."""
    gram = np.zeros((width, width))
    for i, j, s in table.select("v").mapInArrow(second_moments(width), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s")).collect():
        gram[i, j] = s
    values, axes = np.linalg.eigh((gram + gram.T) / 2)
    return axes[:, np.argsort(-values)]


class Search:
    """A block of queries with the k best scores of each so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, axes: np.ndarray, k: int, threshold: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.queries, self.axes, self.k = ids[order], queries[order], axes, k
        self.scores = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.given = np.full(len(ids), -np.inf) if threshold is None else threshold[order]
        turned = self.queries.astype(float) @ axes
        self.lead, self.rest = turned[:, :LEADING], np.linalg.norm(turned[:, LEADING:], axis=1)
        self.norms = np.linalg.norm(self.queries.astype(float), axis=1)

    def threshold(self) -> np.ndarray:
        """A score that the k-th best of each query cannot be below."""
        last = self.scores[:, -1]
        own = np.where(last == np.iinfo(np.int64).min, -np.inf, last.astype(float))
        return np.maximum(own, self.given)

    def add(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> None:
        order = np.argsort(-norms, kind="stable")
        for start in range(0, len(ids), STEP):
            at = order[start : start + STEP]
            turned = vectors[at].astype(float) @ self.axes
            rest = np.linalg.norm(turned[:, LEADING:], axis=1)
            margin = 1e-9 * norms[at[0]]
            for first in range(0, len(self.ids), QUERY_STEP):
                rows = np.arange(first, min(first + QUERY_STEP, len(self.ids)))
                least = self.threshold()[rows]
                rows = rows[self.norms[rows] * (norms[at[0]] + margin) >= least]
                if len(rows):
                    self._block(rows, at, ids, vectors, turned, rest, margin)

    def _block(self, rows, at, ids, vectors, turned, rest, margin) -> None:
        least = self.threshold()[rows]
        bound = self.lead[rows] @ turned[:, :LEADING].T + self.rest[rows, None] * rest + self.norms[rows, None] * margin
        q, c = np.nonzero((bound >= least[:, None]) & (self.ids[rows, None] != ids[at]))
        if not len(q):
            return
        score = np.einsum("ij,ij->i", self.queries[rows[q]], vectors[at[c]])
        touched, where = np.unique(q, return_inverse=True)
        of = rows[touched]
        all_q = np.concatenate([where, np.repeat(np.arange(len(of)), self.k)])
        all_s = np.concatenate([score, self.scores[of].ravel()])
        all_i = np.concatenate([ids[at[c]], self.found[of].ravel()])
        order = np.lexsort((all_i, -all_s.astype(float), all_q)) if abs(all_s[all_s > np.iinfo(np.int64).min]).max(initial=0) < 1 << 53 else np.lexsort((all_i, ~all_s, all_q))
        all_q = all_q[order]
        place = np.arange(len(all_q)) - np.searchsorted(all_q, all_q)
        keep = place < self.k
        self.scores[of[all_q[keep]], place[keep]] = all_s[order][keep]
        self.found[of[all_q[keep]], place[keep]] = all_i[order][keep]

    def rows(self) -> pa.RecordBatch:
        q, p = np.nonzero(self.scores > np.iinfo(np.int64).min)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.found[q, p]), pa.array(self.scores[q, p])], names=["query_id", "vec_id", "score"])


def search_batches(block, width: int):
    """A function that finds a task's best candidates of every query in the broadcast block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*block.value)
        for batch in batches:
            search.add(batch.column(0).to_numpy(), matrix(batch.column(1), width), batch.column(2).to_numpy())
        yield search.rows()

    return run


def top_k(vectors: DataFrame, is_query: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query.

    is_query: SQL condition on the id. Ties go to the smaller id; a query's own id is no
    candidate of it. Vectors null, or holding null or non-finite components, take no
    part; shorter vectors count as filled up with zeros. Of repeated ids, every row is a
    candidate, and the smallest vector is the query. Scores must fit in a long. Other
    columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    # a last key for the ranges, so that no group of equal rows is one task
    table = quantize(vectors, id_col, vector_col).where("id is not null").withColumn("salt", F.xxhash64(F.spark_partition_id()))
    table = materialize(table, "topk-vectors")
    n, width, asked = table.agg(F.count("*"), F.max(F.size("v")), F.count(F.when(F.expr(is_query.replace(id_col, "id")), 1))).first()
    if not n or not width or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    axes = rotation(table, width)
    table = materialize(table.repartitionByRange(max(2, math.ceil(n / RANGE_ROWS)), F.desc("norm"), "id", "salt").drop("salt").sortWithinPartitions(F.desc("norm")), "topk-sorted")
    head = table.orderBy(F.desc("norm"), "id").limit(HEAD).toArrow()
    head_rows = (head.column("id").to_numpy(), matrix(head.column("v").combine_chunks(), width), head.column("norm").to_numpy())
    queries = table.where(is_query.replace(id_col, "id")).groupBy("id").agg(F.min("v").alias("v"))
    blocks = math.ceil(asked / QUERY_BLOCK)
    queries = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    found = f"{scratch_root(spark)}/topk-found-{uuid.uuid4().hex}"
    for number in range(blocks):
        rows = queries.where(F.col("block") == number).select("id", "v").toArrow()
        if not rows.num_rows:
            continue
        ids, asked_rows = rows.column("id").to_numpy(), matrix(rows.column("v").combine_chunks(), width)
        first = Search(ids, asked_rows, axes, k)
        first.add(*head_rows)
        least = first.threshold()[np.argsort(np.argsort(ids, kind="stable"), kind="stable")]
        block = spark.sparkContext.broadcast((ids, asked_rows, axes, k, least))
        floor = float(np.min(least / np.maximum(np.linalg.norm(asked_rows.astype(float), axis=1), 1e-300)))
        near = table.where(F.col("norm") >= F.lit(floor * (1 - 1e-9))) if np.isfinite(floor) and floor > 0 else table
        part = near.mapInArrow(search_batches(block, width), out)
        part.write.mode("append").parquet(found)  # k rows for each query and task
        block.destroy()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return spark.read.schema(out).parquet(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle() -> str:
    """DuckDB SQL for the 10 best of every vec_id divisible by 100 over `embeddings`."""
    return """
        with whole as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
            from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select q.vec_id as query_id, c.vec_id,
                   coalesce(list_sum(list_transform(range(1, 1 + least(len(q.v), len(c.v))), lambda i: q.v[i] * c.v[i])), 0)::bigint as score
            from whole q join whole c on q.vec_id <> c.vec_id
            where q.vec_id % 100 = 0
        )
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
        from scored qualify rank <= 10"""

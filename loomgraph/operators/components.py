"""Connected components of an edge list, without collecting edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every node that has an edge with the smallest node id it can reach.

    Alternates two contractions until nothing moves. In the first, every node hands
    its larger neighbours to its smallest neighbour; in the second, every node hands
    its smaller neighbours (and itself) over. Both keep connectivity, and each node
    ends as a leaf of a star centred on the minimum. Every round is a pair of
    aggregations whose output is written to the shared folder. A node with very many
    neighbours needs only the minimum of them, taken by a partial aggregation and
    joined back, so no adjacency list is ever built. These are merge joins at every size:
    a file's bytes say little of the rows in it, and a broadcast is built on the driver.

    Null endpoints and self-loops are ignored. Returns (node, component).
    """
    pairs = (
        edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    pairs = materialize(pairs, "cc-edges")
    before = None
    for _ in range(max_rounds):
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # here a > b holds throughout: a was larger than u, and m is at most u
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest.hint("merge"), "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        old, pairs = pairs, materialize(small, "cc-round")
        discard(old)
        state = pairs.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == before or not state.n:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

"""Counts and health figures of a graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(column, n, pct): rows of each value and their share of all."""
    by = df.groupBy(column).agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"))  # one row
    return by.join(F.broadcast(total)).select(column, "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("pct"))


def band(value: Column, *steps: tuple[Column, str], other: str) -> Column:
    out = None
    for test, name in steps:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(other)


def ontology_health(entities: DataFrame, edges: DataFrame, node_types: Sequence[str], edge_types: Sequence[str]) -> DataFrame:
    """icr and ipr: shares of declared node and edge types in use; ci: the largest type's share; with bands."""
    by = entities.groupBy("entity_type").agg(F.count("*").alias("n"))
    nodes = by.agg(
        F.count_if(F.col("entity_type").isin(*node_types)).alias("used"), F.max("n").alias("most"), F.sum("n").alias("all"), F.max_by("entity_type", F.struct("n", "entity_type")).alias("dominant")
    )
    links = edges.where(F.col("edge_type").isin(*edge_types)).agg(F.countDistinct("edge_type").alias("used_edges"))
    row = nodes.join(F.broadcast(links)).select(
        (F.col("used") / len(node_types)).alias("icr"), (F.col("used_edges") / len(edge_types)).alias("ipr"), (F.col("most") / F.col("all")).alias("ci"), "dominant"
    )
    icr, ci = F.col("icr"), F.col("ci")
    return row.select(
        F.round("icr", 4).alias("icr"), F.round("ipr", 4).alias("ipr"), F.round("ci", 4).alias("ci"), "dominant",
        band(icr, (icr >= 0.8, "good"), (icr >= 0.5, "fair"), other="poor").alias("coverage_band"),
        band(ci, (ci < 0.3, "good"), (ci < 0.5, "fair"), other="poor").alias("concentration_band"),
    )


def graph_health(entities: DataFrame, edges: DataFrame) -> DataFrame:
    linked = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("hit", F.lit(1))
    counts = entities.join(linked, "id", "left").agg(F.count("*").alias("entities"), F.count_if(F.col("hit").isNull()).alias("orphans"))
    orphans = F.col("orphans")
    return counts.select(
        "entities", "orphans",
        F.coalesce(F.round(100.0 * (F.col("entities") - orphans) / F.nullif("entities", F.lit(0)), 1), F.lit(100.0)).alias("connected_pct"),
        band(orphans, (orphans >= 500, "critical"), (orphans >= 50, "warning"), other="ok").alias("orphan_status"),
    )


def write_log_health(log: DataFrame, rejected: Column, now: Column) -> DataFrame:
    counts = log.agg(F.count("*").alias("rows_"), F.count_if(rejected).alias("rejected"), F.max("ts").alias("last"))
    rate = F.coalesce(F.col("rejected") / F.nullif("rows_", F.lit(0)), F.lit(0.0))
    return counts.select(
        "rows_", "rejected", F.round(rate, 6).alias("rejection_rate"),
        F.floor((F.unix_timestamp(now) - F.unix_timestamp("last")) / 3600).alias("hours_since"),
        band(rate, (rate >= 0.20, "critical"), (rate >= 0.15, "warning"), other="ok").alias("status"),
    )


def queue_depth(queue: DataFrame) -> DataFrame:
    """(pending, queue_status): lines that wait, and how that is to be seen."""
    n = F.col("pending")
    return queue.agg(F.count("*").alias("pending")).select("pending", band(n, (n >= 5000, "critical"), (n >= 1000, "warning"), other="ok").alias("queue_status"))


def poll(entities: DataFrame, edges: DataFrame, log: DataFrame, rejected: Column, queue: DataFrame, now: Column) -> tuple[DataFrame, int]:
    """(check, status) of every health figure, and the exit code of a poll: 0 ok, 1 warning, 2 critical."""
    graph = graph_health(entities, edges)
    connected = F.col("connected_pct")
    hours = F.col("hours_since")
    checks = graph.select(F.lit("orphans").alias("check"), F.col("orphan_status").alias("status"))
    checks = checks.union(graph.select(F.lit("connected"), band(connected, (connected < 90, "critical"), (connected < 95, "warning"), other="ok")))
    written = write_log_health(log, rejected, now)
    checks = checks.union(written.select(F.lit("rejections"), "status"))
    checks = checks.union(written.select(F.lit("enrichment"), band(hours, (hours >= 72, "critical"), (hours >= 24, "warning"), other="ok")))
    checks = checks.union(queue_depth(queue).select(F.lit("queue"), "queue_status"))
    worst = max(({"ok": 0, "warning": 1, "critical": 2}[r.status] for r in checks.collect()), default=0)  # five rows
    return checks, worst


def prune_summary(entities: DataFrame, top: int = 20) -> DataFrame:
    """Counts by type, by provenance, and by the `top` most frequent sources."""
    by = lambda name, column: entities.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "value", "n")
    return by("type", "entity_type").union(by("provenance", "provenance")).union(by("source", "source_url").orderBy(F.desc("n"), "value").limit(top))


def expand(entities: DataFrame, edges: DataFrame, connects: DataFrame, binds: DataFrame, seed: str) -> DataFrame:
    """(id, label, way) of a seed's neighbours: 1 out, 2 in, 3 and 4 over hyperedges; the first way counts."""
    c, i = connects.withColumnRenamed("entity_id", "c"), binds.withColumnRenamed("entity_id", "i")
    over = c.join(i, "edge_id")
    found = (
        edges.where(F.col("src") == seed).select(F.col("dst").alias("id"), F.lit(1).alias("way"))
        .union(edges.where(F.col("dst") == seed).select("src", F.lit(2)))
        .union(over.where(F.col("c") == seed).select("i", F.lit(3)))
        .union(over.where(F.col("i") == seed).select("c", F.lit(4)))
    )
    return found.groupBy("id").agg(F.min("way").alias("way")).join(entities.select("id", "label"), "id").select("id", "label", "way")

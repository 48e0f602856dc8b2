"""Ontologies: what types there are, what may link what, and gates that reject the rest."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Node types, edge types, aliases of node types, constrained edges.
NODE_TYPES = ("concept", "person", "source", "project", "insight", "question", "practice", "place", "method", "tool")
EDGE_TYPES = ("LEARNED_FROM", "INSPIRED_BY", "CONFLICTS_WITH", "SUPPORTS", "PART_OF", "PRACTICED_IN", "ASKED_ABOUT", "ANSWERS", "IMPLEMENTS", "REQUIRES")
ALIASES = {
    "concepts": "concept", "idea": "concept", "topic": "concept", "people": "person", "author": "person", "book": "source", "article": "source",
    "podcast": "source", "course": "source", "projects": "project", "idea_original": "insight", "questions": "question", "habit": "practice",
    "location": "place", "technique": "method", "software": "tool", "app": "tool",
}
CONSTRAINED = {
    "PRACTICED_IN": (("practice", "method", "tool"), NODE_TYPES),
    "ASKED_ABOUT": (("question",), NODE_TYPES),
    "ANSWERS": (NODE_TYPES, ("question",)),
    "IMPLEMENTS": (("tool", "method"), NODE_TYPES),
}
STRUCTURAL = "ASSOCIATED_WITH"
EVIDENCED, LEAST_EVIDENCE = ("SUPPORTS", "CONFLICTS_WITH"), 10


@dataclass(frozen=True)
class Ontology:
    """Types, aliases, and for constrained edges the (source type, target type) pairs allowed."""

    node_types: tuple[str, ...] = NODE_TYPES
    edge_types: tuple[str, ...] = EDGE_TYPES
    aliases: dict[str, str] = field(default_factory=lambda: dict(ALIASES))
    edge_aliases: dict[str, str] = field(default_factory=dict)
    grades: dict[str, tuple[tuple[str, str], ...]] = field(default_factory=lambda: {k: tuple(product(*v)) for k, v in CONSTRAINED.items()})

    @staticmethod
    def from_spec(spec: dict) -> Ontology:
        """From a parsed YAML document: entity_types and edge_types as lists of {id, ...}.

        direction 'a | b -> c' allows every pair, '*' is any type, '* -> *' no constraint;
        same_type allows equal types. Pairs of undeclared types are dropped, and an edge
        left without pairs is unconstrained. aliases: {from: to} or a list of {from, to}.
        """
        nodes = tuple(t["id"] for t in spec.get("entity_types") or [])
        edges, grades = [], {}
        for edge in spec.get("edge_types") or []:
            edges.append(edge["id"])
            pairs: list[tuple[str, str]] = []
            direction = edge.get("direction")
            if direction:
                left, _, right = (x.strip() for x in direction.partition("->"))
                sides = [nodes if side == "*" else tuple(t.strip() for t in side.split("|")) for side in (left, right)]
                if (left, right) != ("*", "*"):
                    pairs = [p for p in product(*sides) if p[0] in nodes and p[1] in nodes]
            if edge.get("same_type"):
                pairs = [(t, t) for t in nodes] if not pairs else [p for p in pairs if p[0] == p[1]]
            if pairs:
                grades[edge["id"]] = tuple(pairs)
        given = spec.get("aliases") or {}
        if isinstance(given, list):
            given = {a["from"]: a["to"] for a in given}
        aliases = {k: v for k, v in given.items() if isinstance(v, str)}
        return Ontology(nodes, tuple(edges), aliases, {}, grades)

    @staticmethod
    def from_yaml(path: str) -> Ontology:
        import yaml

        with open(path, encoding="utf-8") as f:
            return Ontology.from_spec(yaml.safe_load(f))

    def grade_table(self, spark: SparkSession) -> DataFrame:
        rows = [(e, s, t) for e, pairs in self.grades.items() for s, t in pairs]
        return spark.createDataFrame(rows, "edge_type string, src_type string, dst_type string")

    def normal_node_type(self, raw: Column) -> Column:
        """The declared type that a raw one names, by alias or case; null if none."""
        lower = F.lower(F.trim(raw))
        table = F.create_map(*[F.lit(x) for pair in ({t: t for t in self.node_types} | self.aliases).items() for x in pair])
        return F.coalesce(F.try_element_at(table, F.trim(raw)), F.try_element_at(table, lower))

    def normal_edge_type(self, raw: Column) -> Column:
        """Alias, else upper case; unknown types stay for the gate to reject."""
        if not self.edge_aliases:
            return F.upper(F.trim(raw))
        table = F.create_map(*[F.lit(x) for pair in self.edge_aliases.items() for x in pair])
        return F.coalesce(F.try_element_at(table, F.trim(raw)), F.try_element_at(table, F.upper(F.trim(raw))), F.upper(F.trim(raw)))

    def known_edge(self, kind: Column) -> Column:
        return kind.isin(*self.edge_types, STRUCTURAL)


def edge_key(src: str = "src", dst: str = "dst", kind: str = "edge_type") -> Column:
    return F.concat(F.col(src), F.lit(" -["), F.col(kind), F.lit("]-> "), F.col(dst))


def _violation(df: DataFrame, focus: Column, path: str, value: Column, component: str, severity: str = "sh:Violation") -> DataFrame:
    return df.select(focus.alias("focus"), F.lit(path).alias("path"), value.alias("value"), F.lit(component).alias("component"), F.lit(severity).alias("severity"))


def entity_violations(entities: DataFrame, ontology: Ontology) -> DataFrame:
    bad = entities.where(~F.coalesce(F.col("entity_type").isin(*ontology.node_types), F.lit(False)))
    return _violation(bad, F.col("id"), "entity_type", F.col("entity_type"), "sh:InConstraintComponent")


def edge_violations(edges: DataFrame, ontology: Ontology) -> DataFrame:
    bad = edges.where(~F.coalesce(ontology.known_edge(F.col("edge_type")), F.lit(False)))
    return _violation(bad, edge_key(), "edge_type", F.col("edge_type"), "sh:InConstraintComponent")


def with_types(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with src_type and dst_type, null where the endpoint is unknown."""
    types = entities.groupBy("id").agg(F.min("entity_type").alias("t"))
    return edges.join(types.select(F.col("id").alias("src"), F.col("t").alias("src_type")).hint("merge"), "src", "left").join(types.select(F.col("id").alias("dst"), F.col("t").alias("dst_type")).hint("merge"), "dst", "left")


def grade_violations(edges: DataFrame, entities: DataFrame, ontology: Ontology) -> DataFrame:
    """Edges of constrained types whose endpoints' types are both known and not an allowed pair."""
    spark = edges.sparkSession
    typed = with_types(edges.where(F.col("edge_type").isin(*ontology.grades)), entities).where("src_type is not null and dst_type is not null")
    bad = typed.join(ontology.grade_table(spark), ["edge_type", "src_type", "dst_type"], "left_anti")
    return _violation(bad, edge_key(), "grade", F.concat("src_type", F.lit(" -> "), "dst_type"), "sh:ClassConstraintComponent")


def evidence_warnings(edges: DataFrame) -> DataFrame:
    thin = edges.where(F.col("edge_type").isin(*EVIDENCED) & (F.length(F.trim(F.coalesce("evidence", F.lit("")))) < LEAST_EVIDENCE))
    return _violation(thin, edge_key(), "evidence", F.coalesce("evidence", F.lit("")), "sh:MinLengthConstraintComponent", "sh:Warning")


def report(entities: DataFrame, edges: DataFrame, ontology: Ontology) -> DataFrame:
    """All violations and warnings."""
    return (
        entity_violations(entities, ontology)
        .unionByName(edge_violations(edges, ontology))
        .unionByName(grade_violations(edges, entities, ontology))
        .unionByName(evidence_warnings(edges))
    )

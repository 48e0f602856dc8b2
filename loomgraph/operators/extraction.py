"""Triplets from model answers: JSON repair, validation item by item, ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import short_hash, slugify
from loomgraph.operators.ontology import Ontology

SCHEMA = """struct<entities: array<struct<name: string, label: string, entity_type: string, type: string, confidence: string, description: string>>,
  edges: array<struct<source: string, target: string, edge_type: string, type: string, confidence: string, evidence: string>>, _error: string>"""


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value made once, however often it stands there; a filter that is pushed down copies columns, not this."""
    return F.element_at(F.transform(F.array(value), then), 1)


def parse(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Adds `result` (parsed, with empty arrays for none) and `error`.

    Tried in turn: the answer, what a code fence holds, and from the first brace to the last.
    """
    fenced = lambda raw: F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braced = lambda raw: F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    read = lambda c: F.from_json(F.when(c.startswith("{"), c), SCHEMA, {"mode": "PERMISSIVE"})
    usable = lambda shape: _let(shape, lambda c: _let(read(c), lambda r: F.when(r["entities"].isNotNull() | r["edges"].isNotNull() | r["_error"].isNotNull(), r)))
    found = _let(F.trim(F.coalesce(F.col(column), F.lit(""))), lambda raw: F.coalesce(usable(raw), usable(fenced(raw)), usable(braced(raw))))
    empty = lambda name: F.coalesce(F.col("_r")[name], F.from_json(F.lit("[]"), SCHEMA.split(f"{name}: ")[1].split(">>")[0] + ">>"))
    made = answers.withColumn("_r", found)
    return made.withColumn("result", F.struct(empty("entities").alias("entities"), empty("edges").alias("edges"))).withColumn(
        "error", F.when(F.col("_r").isNull(), "unreadable").otherwise(F.col("_r._error"))
    ).drop("_r")


def clamp(raw: Column) -> Column:
    """A confidence between 0 and 1; 0.5 for what is no number; null for NaN, whose item is dropped."""
    value = F.coalesce(raw.try_cast("double"), F.lit(0.5))
    return F.when(~F.isnan(value), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def entities(parsed: DataFrame) -> DataFrame:
    """Valid entities, one row each; those without a name are dropped."""
    each = parsed.select("doc_id", F.explode("result.entities").alias("e"))
    name = F.trim(F.coalesce("e.name", "e.label", F.lit("")))
    return each.select(
        "doc_id", name.alias("label"), slugify(name).alias("id"), F.lower(F.coalesce("e.entity_type", "e.type", F.lit("concept"))).alias("entity_type"),
        clamp(F.col("e.confidence")).alias("confidence"), F.coalesce("e.description", F.lit("")).alias("description"),
    ).where("label <> '' and confidence is not null")


def edges(parsed: DataFrame) -> DataFrame:
    """Valid edges with ids for ends; those without an end are dropped."""
    each = parsed.select("doc_id", F.explode("result.edges").alias("e")).select(
        "doc_id", F.col("e.source").alias("source"), F.col("e.target").alias("target"), F.upper(F.coalesce("e.edge_type", "e.type", F.lit("ASSOCIATED_WITH"))).alias("edge_type"),
        clamp(F.col("e.confidence")).alias("confidence"), F.coalesce("e.evidence", F.lit("")).alias("evidence"),
    )
    return resolve_edges(each.where("confidence is not null"))


def resolve_edges(said: DataFrame) -> DataFrame:
    """Edges named by labels, between ids."""
    named = said.where("trim(coalesce(source, '')) <> '' and trim(coalesce(target, '')) <> ''")
    return named.withColumn("src", slugify(F.col("source"))).withColumn("dst", slugify(F.col("target"))).drop("source", "target")


def co_occurrence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """An offline extractor: capitalised words as concepts, neighbours among them as links. Adds `result` as parse does."""
    words = F.array_distinct(F.regexp_extract_all(text_col, F.lit(r"\b\p{Lu}\p{Ll}{3,}\b"), F.lit(0)))
    ents = F.transform(words, lambda w: F.struct(w.alias("name"), w.alias("label"), F.lit("concept").alias("entity_type"), F.lit(None).cast("string").alias("type"), F.lit("0.5").alias("confidence"), F.lit("").alias("description")))
    pairs = F.arrays_zip(F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0))).alias("a"), F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(0))).alias("b"))
    links = F.transform(pairs, lambda p: F.struct(p["a"].alias("source"), p["b"].alias("target"), F.lit("ASSOCIATED_WITH").alias("edge_type"), F.lit(None).cast("string").alias("type"), F.lit("0.5").alias("confidence"), F.lit("").alias("evidence")))
    long = docs.where(F.length(F.trim(F.coalesce(text_col, F.lit("")))) >= 20).withColumn("_w", words)
    return long.select(id_col, F.struct(ents.alias("entities"), links.alias("edges")).alias("result"), F.lit(None).cast("string").alias("error"))


LEAST_CHARS, MOST_CHARS = 20, 4000

#: An extractor makes (doc_id, result, error) of (doc_id, text); a model's answers go through `parse`.
Extractor = Callable[[DataFrame], DataFrame]


def answers_extractor(ask: Callable[[str], str], ontology: Ontology | None = None) -> Extractor:
    """An extractor over a function from prompt to answer, as a model's client would be; an exception is an error row.

    Texts under LEAST_CHARS are skipped, and a prompt holds the first MOST_CHARS, as models take no more.
    """
    head = prompt_fragment(ontology or Ontology())

    def run(batches):
        for batch in batches:
            said, wrong = [], []
            for text in batch["text"]:
                try:
                    said.append(ask(f"{head}\n\n{(text or '')[:MOST_CHARS]}"))
                    wrong.append(None)
                except Exception as e:  # a call that fails costs one document only
                    said.append(None)
                    wrong.append(f"{type(e).__name__}: {e}")
            yield batch[["doc_id"]].assign(answer=said, failed=wrong)

    def extract(docs: DataFrame) -> DataFrame:
        long = docs.where(F.length(F.trim(F.coalesce("text", F.lit("")))) >= LEAST_CHARS).select("doc_id", "text")
        kind = docs.schema["doc_id"].dataType.simpleString()
        made = parse(long.mapInPandas(run, f"doc_id {kind}, answer string, failed string"))
        return made.select("doc_id", "result", F.coalesce("failed", "error").alias("error"))

    return extract


def prompt_fragment(ontology: Ontology) -> str:
    """What a model is told of the types: entity types, edge types, and which ends the constrained ones take."""
    lines = [f"Entity types: {', '.join(ontology.node_types)}", f"Edge types: {', '.join(ontology.edge_types)}"]
    for edge, pairs in sorted(ontology.grades.items()):
        left, right = ({p[i] for p in pairs} for i in (0, 1))
        name = lambda side: "any" if side == set(ontology.node_types) else " | ".join(sorted(side))
        lines.append(f"{edge}: {name(left)} -> {name(right)}")
    return "\n".join(lines)


def canonical_types(found: DataFrame, ontology: Ontology, column: str = "entity_type", other: str = "concept") -> DataFrame:
    """Entity types as the ontology names them, by alias or case; unknown ones become `other`."""
    return found.withColumn(column, F.coalesce(ontology.normal_node_type(F.col(column)), F.lit(other)))


def note_graph(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and ASSOCIATED_WITH edges of notes (doc_id, title, tags, wikilinks): the note to its tags (0.8) and links (0.9)."""
    tag = notes.select("doc_id", "title", F.explode("tags").alias("label")).withColumn("id", F.concat(F.lit("tag_"), slugify(F.col("label")))).withColumn("provenance", F.lit("obsidian_tag")).withColumn("confidence", F.lit(0.8))
    link = notes.select("doc_id", "title", F.explode("wikilinks").alias("label")).withColumn("id", short_hash(F.col("label"), "wikilink_")).withColumn("provenance", F.lit("wikilink")).withColumn("confidence", F.lit(0.9))
    every = tag.unionByName(link)
    note = F.concat(F.lit("note_"), F.col("doc_id").cast("string"))
    named = every.groupBy("id").agg(F.min("label").alias("label"), F.max("confidence").alias("confidence"), F.min("provenance").alias("provenance"))
    own = notes.select(note.alias("id"), F.col("title").alias("label"), F.lit(1.0).alias("confidence"), F.lit("note").alias("provenance"))
    edges = every.select(note.alias("src"), F.col("id").alias("dst"), F.lit("ASSOCIATED_WITH").alias("edge_type"), "confidence", "provenance").distinct()
    return named.unionByName(own).withColumn("entity_type", F.lit("concept")), edges


def connect_orphans(entities: DataFrame, edges: DataFrame, ask: Callable[[DataFrame], DataFrame], ontology: Ontology, most: int = 20) -> DataFrame:
    """New edges for entities without any, as a supplied extractor proposes them from the entities of the same source.

    ask takes (source_url, orphans array, candidates array) and gives (source_url, src, dst,
    edge_type, evidence), at most `most` names a side reach it. Proposals pass the gates: known
    type, an orphan at one end, both ends among the names. They get confidence 0.6 and provenance
    orphan_connect.
    """
    linked = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("linked", F.lit(True))
    known = entities.where("source_url <> ''").join(linked, "id", "left")
    by_source = known.groupBy("source_url").agg(
        F.slice(F.array_sort(F.collect_list(F.when(F.col("linked").isNull(), F.col("id")))), 1, most).alias("orphans"),
        F.slice(F.array_sort(F.collect_list("id")), 1, most).alias("candidates"),
    ).where(F.size("orphans") > 0)
    said = ask(by_source).join(by_source, "source_url")
    good = said.where(ontology.known_edge(F.col("edge_type")) & (F.col("src") != F.col("dst")))
    one = F.array_contains("orphans", F.col("src")) | F.array_contains("orphans", F.col("dst"))
    inside = F.array_contains(F.array_union("orphans", "candidates"), F.col("src")) & F.array_contains(F.array_union("orphans", "candidates"), F.col("dst"))
    return good.where(one & inside).select("src", "dst", "edge_type", F.lit(0.6).alias("confidence"), "evidence", F.lit("orphan_connect").alias("provenance")).distinct()


def as_answers(docs: DataFrame) -> DataFrame:
    """Documents dressed as model answers: plain, fenced, with chatter around, and broken."""
    word = lambda w, n: F.coalesce(F.try_element_at(w, F.lit(n)), F.lit(""))
    body = lambda w: F.format_string('{"entities": [{"name": "%s", "type": "Person", "confidence": 1.7}, {"label": "%s", "confidence": "high"}], "edges": [{"source": "%s", "target": "%s", "type": "supports"}]}', word(w, 1), word(w, 2), word(w, 1), word(w, 2))
    k = F.col("doc_id") % 4
    dress = lambda body: F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here it is: "), body, F.lit(" Done."))).otherwise("no answer")
    dressed = _let(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)), lambda w: _let(body(w), dress))
    return docs.select("doc_id", dressed.alias("answer"))

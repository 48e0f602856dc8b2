"""Scans, filters, joins, aggregates, gates and writes over the graph's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import graph, health, writes
from loomgraph.operators import ontology as onto
from loomgraph.plans.catalog import query
from loomgraph.plans.testbed import EPOCH, Bed

ONTOLOGY = onto.Ontology()
CUTOFF = EPOCH + 1000 * 3600


def _ends(*names: str) -> str:
    return " union ".join(f"select {c} as id from {t}" for t, c in (n.split(".") for n in names))


# --- filters and top-k -----------------------------------------------------------------


@query("entity_by_label", "select id, label, confidence from entity where contains(label, '7') or contains(label, 'EU') order by confidence desc, id limit 25")
def _(b: Bed) -> DataFrame:
    return b.entity.where(F.col("label").contains("7") | F.col("label").contains("EU")).orderBy(F.desc("confidence"), "id").limit(25).select("id", "label", "confidence")


@query("entity_by_type", "select id, label, entity_type from entity where entity_type = 'source' order by label, id limit 50")
def _(b: Bed) -> DataFrame:
    return b.entity.where("entity_type = 'source'").orderBy("label", "id").limit(50).select("id", "label", "entity_type")


@query("entity_by_label_and_type", "select id, label from entity where contains(label, '1') and entity_type = 'person' order by confidence desc, id limit 20")
def _(b: Bed) -> DataFrame:
    return b.entity.where(F.col("label").contains("1") & (F.col("entity_type") == "person")).orderBy(F.desc("confidence"), "id").limit(20).select("id", "label")


@query("chunk_sensitivity_filter", "select sensitivity, count(*) as chunks, count(distinct doc_id) as docs from chunk where sensitivity in ('public') group by sensitivity")
def _(b: Bed) -> DataFrame:
    return b.chunk.where(F.col("sensitivity").isin("public")).groupBy("sensitivity").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"))


@query("chunk_by_id", "select c.id, c.doc_id, chunk_index, c.body from chunk c join doc d on d.doc_id = c.doc_id where d.doc_id = '7' and chunk_index = 0")
def _(b: Bed) -> DataFrame:
    source = b.doc.where("doc_id = '7'").select(text.chunk_id(F.col("source_uri"), F.lit(0)).alias("id"))
    return b.chunk.join(source, "id", "left_semi").select("id", "doc_id", "chunk_index", "body")


@query("new_documents", "select d.doc_id, d.source_uri from doc d where not exists (select 1 from mention m where cast(m.doc_id as varchar) = d.doc_id)")
def _(b: Bed) -> DataFrame:
    known = b.mention.select(F.col("doc_id").cast("string").alias("doc_id"))
    return b.doc.join(known, "doc_id", "left_anti").select("doc_id", "source_uri")


@query("recent_notes", "select event_id, user_id, event_type from events where ts > timestamp '2024-01-29 00:00:00'")
def _(b: Bed) -> DataFrame:
    return b.events.where(F.col("ts") > F.lit("2024-01-29 00:00:00").cast("timestamp")).select("event_id", "user_id", "event_type")


@query("edges_scan", "select src, dst, edge_type, confidence from edge where confidence >= 0.9")
def _(b: Bed) -> DataFrame:
    return b.edge.where(F.col("confidence") >= 0.9).select("src", "dst", "edge_type", "confidence")


_UNION = """select 'RELATES_TO' as rel, src, dst from edge union all select 'MENTIONED_IN', entity_id, cast(doc_id as varchar) from mention
    union all select 'CONNECTS', entity_id, edge_id from connects union all select 'BINDS', edge_id, entity_id from binds"""


def all_links(b: Bed) -> DataFrame:
    """The four relation tables under one schema."""
    parts = [
        b.edge.select(F.lit("RELATES_TO").alias("rel"), "src", "dst"),
        b.mention.select(F.lit("MENTIONED_IN").alias("rel"), F.col("entity_id").alias("src"), F.col("doc_id").cast("string").alias("dst")),
        b.connects.select(F.lit("CONNECTS").alias("rel"), F.col("entity_id").alias("src"), F.col("edge_id").alias("dst")),
        b.binds.select(F.lit("BINDS").alias("rel"), F.col("edge_id").alias("src"), F.col("entity_id").alias("dst")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("entity_edges_union", f"select rel, count(*) as n, count(distinct src) as sources, count(distinct dst) as targets from ({_UNION}) u group by rel")
def _(b: Bed) -> DataFrame:
    return all_links(b).groupBy("rel").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


# --- joins -----------------------------------------------------------------------------


def labelled(b: Bed, edges: DataFrame) -> DataFrame:
    """Edges with both ends' labels; edges of unknown ends drop out. Merge joins: the entities grow with the graph."""
    name = b.entity.select("id", "label")
    return edges.join(name.select(F.col("id").alias("src"), F.col("label").alias("src_label")).hint("merge"), "src").join(name.select(F.col("id").alias("dst"), F.col("label").alias("dst_label")).hint("merge"), "dst")


_LABELLED = "from edge r join entity a on a.id = r.src join entity b on b.id = r.dst"


@query("conflicting_beliefs", f"select a.label as belief_a, b.label as belief_b, r.evidence, r.created_at {_LABELLED} where r.edge_type = 'CONFLICTS_WITH' order by r.created_at desc, r.src limit 20")
def _(b: Bed) -> DataFrame:
    found = labelled(b, b.edge.where("edge_type = 'CONFLICTS_WITH'"))
    return found.orderBy(F.desc("created_at"), "src").limit(20).select(F.col("src_label").alias("belief_a"), F.col("dst_label").alias("belief_b"), "evidence", "created_at")


@query(
    "find_contradictions",
    f"""with ids as (select id from entity where entity_type = 'tool' order by id limit 200)
    select distinct a.label as src_label, b.label as dst_label {_LABELLED} where r.edge_type = 'CONFLICTS_WITH' and r.src in (select id from ids)
    order by src_label, dst_label limit 10""",
)
def _(b: Bed) -> DataFrame:
    ids = b.entity.where("entity_type = 'tool'").orderBy("id").limit(200).select(F.col("id").alias("src"))
    found = labelled(b, b.edge.where("edge_type = 'CONFLICTS_WITH'").join(ids, "src", "left_semi"))
    return found.select("src_label", "dst_label").dropDuplicates().orderBy("src_label", "dst_label").limit(10)


@query("open_questions", "select id, label from entity q where entity_type = 'question' and not exists (select 1 from edge e where e.edge_type = 'ANSWERS' and e.dst = q.id)")
def _(b: Bed) -> DataFrame:
    answered = b.edge.where("edge_type = 'ANSWERS'").select(F.col("dst").alias("id"))
    return b.entity.where("entity_type = 'question'").join(answered, "id", "left_anti").select("id", "label")


@query("insights_with_sources", f"select a.label as insight, b.label as source, r.edge_type {_LABELLED} where a.entity_type = 'insight' and r.edge_type in ('INSPIRED_BY', 'LEARNED_FROM')")
def _(b: Bed) -> DataFrame:
    insight = b.entity.where("entity_type = 'insight'").select(F.col("id").alias("src"))
    found = labelled(b, b.edge.where(F.col("edge_type").isin("INSPIRED_BY", "LEARNED_FROM")).join(insight.hint("merge"), "src", "left_semi"))
    return found.select(F.col("src_label").alias("insight"), F.col("dst_label").alias("source"), "edge_type")


@query(
    "underdeveloped_ideas",
    f"""select id, label from entity e where created_at < {CUTOFF} and not exists (select 1 from edge r where r.src = e.id) and not exists (select 1 from edge r where r.dst = e.id)
    and not exists (select 1 from mention m where m.entity_id = e.id)""",
)
def _(b: Bed) -> DataFrame:
    linked = b.edge.select(F.explode(F.array("src", "dst")).alias("id"))
    old = b.entity.where(F.col("created_at") < CUTOFF)
    return old.join(linked, "id", "left_anti").join(b.mention.select(F.col("entity_id").alias("id")), "id", "left_anti").select("id", "label")


@query(
    "edge_node_traversal",
    """select c.entity_id as src, n.id as edge_id, i.entity_id as dst, n.weight from connects c join edge_node n on n.id = c.edge_id join binds i on i.edge_id = n.id
    where n.semantic_type = 'similar' order by n.weight desc, src, edge_id, dst limit 100""",
)
def _(b: Bed) -> DataFrame:
    node = b.edge_node.where("semantic_type = 'similar'").select(F.col("id").alias("edge_id"), "weight")
    found = b.connects.join(node, "edge_id").join(b.binds.withColumnRenamed("entity_id", "dst"), "edge_id")
    return found.select(F.col("entity_id").alias("src"), "edge_id", "dst", "weight").orderBy(F.desc("weight"), "src", "edge_id", "dst").limit(100)


_EXPAND_SEED = "part_60"


@query(
    "entity_expand",
    f"""with all_ as (select dst as id, 1 as way from edge where src = '{_EXPAND_SEED}' union all select src, 2 from edge where dst = '{_EXPAND_SEED}'
      union all select i.entity_id, 3 from connects c join binds i using (edge_id) where c.entity_id = '{_EXPAND_SEED}'
      union all select c.entity_id, 4 from connects c join binds i using (edge_id) where i.entity_id = '{_EXPAND_SEED}')
    select e.id, e.label, cast(min(way) as integer) as way from all_ join entity e using (id) group by e.id, e.label""",
)
def _(b: Bed) -> DataFrame:
    return health.expand(b.entity, b.edge, b.connects, b.binds, _EXPAND_SEED)


@query("entity_degree", "select e.id, count(x.id) as degree from entity e left join (select src as id from edge union all select dst from edge) x on x.id = e.id group by e.id")
def _(b: Bed) -> DataFrame:
    return graph.degrees(b.entity, b.edge)


@query("passage_pivots", "select cast(m.doc_id as varchar) as doc_id, count(*) as entities, string_agg(e.label, '|' order by e.label, e.id) as labels from mention m join entity e on e.id = m.entity_id group by m.doc_id")
def _(b: Bed) -> DataFrame:
    found = b.mention.join(b.entity.select(F.col("id").alias("entity_id"), "label"), "entity_id")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "entity_id"))), lambda s: s["label"]), "|")
    return found.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.count("*").alias("entities"), names.alias("labels"))


@query(
    "orphans_by_doc",
    """with linked as (select src as id from edge union select dst from edge)
    select source_url, count(*) filter (where l.id is null) as orphans, count(l.id) as candidates,
      coalesce(string_agg(e.id, ',' order by e.id) filter (where l.id is null), '') as orphan_ids
    from entity e left join linked l on l.id = e.id where source_url <> '' group by source_url having count(*) filter (where l.id is null) > 0""",
)
def _(b: Bed) -> DataFrame:
    linked = b.edge.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("linked", F.lit(True))
    found = b.entity.where("source_url <> ''").join(linked, "id", "left")
    orphan = F.col("linked").isNull()
    return (
        found.groupBy("source_url")
        .agg(F.count_if(orphan).alias("orphans"), F.count("linked").alias("candidates"), F.array_join(F.array_sort(F.collect_list(F.when(orphan, F.col("id")))), ",").alias("orphan_ids"))
        .where("orphans > 0")
    )


@query("degree_gaps", """with deg as (select r.src, count(*) as deg from edge r join entity e on e.id = r.src group by r.src having count(*) >= 3 order by deg desc, r.src limit 20),
    ranked as (select src, deg, row_number() over (order by deg desc, src) as pos from deg)
    select a.src, b.src as dst, a.deg + b.deg as score from ranked a join ranked b on a.pos < b.pos where not exists (select 1 from edge e where e.src = a.src and e.dst = b.src)""")
def _(b: Bed) -> DataFrame:
    return graph.degree_gaps(b.entity, b.edge)


@query("orphan_edges", "select src, dst, edge_type from edge r where not exists (select 1 from entity e where e.id = r.src) or not exists (select 1 from entity e where e.id = r.dst)")
def _(b: Bed) -> DataFrame:
    return writes.dangling(b.edge, b.entity).select("src", "dst", "edge_type")


# --- aggregates ------------------------------------------------------------------------


@query(
    "graph_counts",
    """select 'entities' as what, count(*) as n from entity union all select 'edges', count(*) from edge union all select 'documents', count(*) from documents
    union all select 'edge_nodes', count(*) from edge_node union all select 'communities', count(distinct community_id) from community""",
)
def _(b: Bed) -> DataFrame:
    one = lambda name, df, agg=None: df.agg((F.count("*") if agg is None else agg).alias("n")).select(F.lit(name).alias("what"), "n")
    return one("entities", b.entity).union(one("edges", b.edge)).union(one("documents", b.documents)).union(one("edge_nodes", b.edge_node)).union(one("communities", b.community, F.countDistinct("community_id")))


_SHARE = "select {c}, n, round(100.0 * n / sum(n) over (), 2)::double as pct from (select {c}, count(*) as n from {t} group by {c})"


@query("type_distribution", _SHARE.format(c="entity_type", t="entity"))
def _(b: Bed) -> DataFrame:
    return health.distribution(b.entity, "entity_type")


@query("edge_type_distribution", _SHARE.format(c="edge_type", t="edge"))
def _(b: Bed) -> DataFrame:
    return health.distribution(b.edge, "edge_type")


@query("new_entities_since", f"select entity_type, count(*) as n from entity where created_at > {CUTOFF} group by entity_type")
def _(b: Bed) -> DataFrame:
    return b.entity.where(F.col("created_at") > CUTOFF).groupBy("entity_type").agg(F.count("*").alias("n"))


_HEALTH = """with by_type as (select entity_type, count(*) as n from entity group by 1),
    x as (select (select count(*) from by_type where entity_type in (select node_type from node_type)) / 10.0 as icr,
      (select count(distinct edge_type) from edge where edge_type in (select edge_kind from edge_kind)) / 10.0 as ipr,
      (select max(n) from by_type)::double / (select sum(n) from by_type) as ci,
      (select entity_type from by_type order by n desc, entity_type desc limit 1) as dominant)
    select round(icr, 4)::double as icr, round(ipr, 4)::double as ipr, round(ci, 4) as ci, dominant,
      case when icr >= 0.8 then 'good' when icr >= 0.5 then 'fair' else 'poor' end as coverage_band,
      case when ci < 0.3 then 'good' when ci < 0.5 then 'fair' else 'poor' end as concentration_band from x"""


@query("ontology_health", _HEALTH)
def _(b: Bed) -> DataFrame:
    return health.ontology_health(b.entity, b.edge, ONTOLOGY.node_types, ONTOLOGY.edge_types)


@query("unpopulated_types", "select node_type from node_type except select entity_type from entity")
def _(b: Bed) -> DataFrame:
    return b.node_type.join(b.entity.select(F.col("entity_type").alias("node_type")), "node_type", "left_anti")


@query("chunk_stats", "select sensitivity, count(*) as total, count(*) filter (where chunk_index % 3 <> 0) as embedded, count(*) filter (where chunk_index % 3 = 0) as unembedded from chunk group by sensitivity")
def _(b: Bed) -> DataFrame:
    made = b.chunk.withColumn("embedded_at", F.when(F.col("chunk_index") % 3 != 0, F.lit(1)))
    return made.groupBy("sensitivity").agg(F.count("*").alias("total"), F.count("embedded_at").alias("embedded"), F.count_if(F.col("embedded_at").isNull()).alias("unembedded"))


@query(
    "graph_health",
    """with linked as (select src as id from edge union select dst from edge), x as (select count(*) as entities, count(*) filter (where id not in (select id from linked)) as orphans from entity)
    select entities, orphans, round(100.0 * (entities - orphans) / entities, 1)::double as connected_pct,
      case when orphans >= 500 then 'critical' when orphans >= 50 then 'warning' else 'ok' end as orphan_status from x""",
)
def _(b: Bed) -> DataFrame:
    return health.graph_health(b.entity, b.edge)


@query(
    "write_log_health",
    """select count(*) as rows_, count(*) filter (where event_type = 'error') as rejected, round(count(*) filter (where event_type = 'error')::double / count(*), 6) as rejection_rate,
      floor(epoch(timestamp '2024-02-01 00:00:00' - max(ts)) / 3600)::bigint as hours_since,
      case when count(*) filter (where event_type = 'error')::double / count(*) >= 0.20 then 'critical' when count(*) filter (where event_type = 'error')::double / count(*) >= 0.15 then 'warning' else 'ok' end as status
    from events""",
)
def _(b: Bed) -> DataFrame:
    return health.write_log_health(b.events, F.col("event_type") == "error", F.lit("2024-02-01 00:00:00").cast("timestamp"))


@query(
    "prune_summary",
    """select 'type' as part, entity_type as value, count(*) as n from entity group by entity_type union all select 'provenance', provenance, count(*) from entity group by provenance
    union all (select 'source', source_url, count(*) as n from entity group by source_url order by n desc, source_url limit 20)""",
)
def _(b: Bed) -> DataFrame:
    return health.prune_summary(b.entity)


@query("graph_view", """with deg as (select id, count(*) as degree from (select src as id from edge union all select dst from edge) group by id),
    top as (select e.id from entity e left join deg d using (id) order by coalesce(d.degree, 0) desc, e.id limit 500)
    select src, dst, edge_type from edge where src in (select id from top) and dst in (select id from top)""")
def _(b: Bed) -> DataFrame:
    top = graph.degrees(b.entity, b.edge).orderBy(F.desc("degree"), "id").limit(500)
    keep = b.edge.join(top.select(F.col("id").alias("src")), "src", "left_semi").join(top.select(F.col("id").alias("dst")), "dst", "left_semi")
    return keep.select("src", "dst", "edge_type")


# --- gates -----------------------------------------------------------------------------

_KEY = "src || ' -[' || edge_type || ']-> ' || dst"
_ENTITY_BAD = "select id as focus, 'entity_type' as path, entity_type as value, 'sh:InConstraintComponent' as component, 'sh:Violation' as severity from entity where entity_type not in (select node_type from node_type)"
_EDGE_BAD = f"select {_KEY} as focus, 'edge_type' as path, edge_type as value, 'sh:InConstraintComponent' as component, 'sh:Violation' as severity from edge where edge_type not in (select edge_kind from edge_kind union all select 'ASSOCIATED_WITH')"
_GRADE_BAD = f"""select {_KEY} as focus, 'grade' as path, a.entity_type || ' -> ' || b.entity_type as value, 'sh:ClassConstraintComponent' as component, 'sh:Violation' as severity
    from edge r join entity a on a.id = r.src join entity b on b.id = r.dst where not case edge_type
      when 'PRACTICED_IN' then a.entity_type in ('practice', 'method', 'tool') and b.entity_type in (select node_type from node_type)
      when 'ASKED_ABOUT' then a.entity_type = 'question' and b.entity_type in (select node_type from node_type)
      when 'ANSWERS' then a.entity_type in (select node_type from node_type) and b.entity_type = 'question'
      when 'IMPLEMENTS' then a.entity_type in ('tool', 'method') and b.entity_type in (select node_type from node_type) else true end"""
_THIN = f"select {_KEY} as focus, 'evidence' as path, evidence as value, 'sh:MinLengthConstraintComponent' as component, 'sh:Warning' as severity from edge where edge_type in ('SUPPORTS', 'CONFLICTS_WITH') and length(trim(evidence)) < 10"


@query("entity_violations", _ENTITY_BAD)
def _(b: Bed) -> DataFrame:
    return onto.entity_violations(b.entity, ONTOLOGY)


@query("edge_violations", _EDGE_BAD)
def _(b: Bed) -> DataFrame:
    return onto.edge_violations(b.edge, ONTOLOGY)


@query("grade_violations", _GRADE_BAD)
def _(b: Bed) -> DataFrame:
    return onto.grade_violations(b.edge, b.entity, ONTOLOGY)


@query("evidence_warnings", _THIN)
def _(b: Bed) -> DataFrame:
    return onto.evidence_warnings(b.edge)


@query("shacl_report", f"""select component, severity, count(*) as n, (select count(*) = 0 from ({_ENTITY_BAD} union all {_EDGE_BAD} union all {_GRADE_BAD})) as conforms from ({_ENTITY_BAD} union all {_EDGE_BAD} union all {_GRADE_BAD} union all {_THIN}) v group by component, severity""")
def _(b: Bed) -> DataFrame:
    found = onto.report(b.entity, b.edge, ONTOLOGY)
    whole = found.agg(F.coalesce(F.bool_and(F.col("severity") != "sh:Violation"), F.lit(True)).alias("conforms"))
    return found.groupBy("component", "severity").agg(F.count("*").alias("n")).join(F.broadcast(whole))  # one row


# --- writes ----------------------------------------------------------------------------


@query(
    "upsert_entities",
    """with incoming as (select id, entity_type, label || ' v2' as label, confidence, created_at + 5 as moment from entity where created_at % 7 = 0 and entity_type in (select node_type from node_type)
        union all select 'new_' || id, entity_type, label, confidence, created_at from entity where entity_type = 'source'),
      stored as (select id, entity_type, label, confidence, created_at as moment from entity where entity_type in (select node_type from node_type))
    select id, entity_type, label, confidence, case when id in (select id from incoming) then 1800000000 else moment end as updated_at from stored
    union all select id, entity_type, label, confidence, 1800000000 from incoming where id not in (select id from stored)""",
)
def _(b: Bed) -> DataFrame:
    names = ["id", "entity_type", "label", "confidence"]
    stored = onto_valid(b).select(*names, F.col("created_at").alias("updated_at"))
    changed = onto_valid(b).where("created_at % 7 = 0").select("id", "entity_type", F.concat("label", F.lit(" v2")).alias("label"), "confidence", (F.col("created_at") + 5).alias("updated_at"))
    fresh = b.entity.where("entity_type = 'source'").select(F.concat(F.lit("new_"), "id").alias("id"), "entity_type", "label", "confidence", F.col("created_at").alias("updated_at"))
    return writes.upsert_entities(stored, changed.unionByName(fresh), now=1_800_000_000)


def onto_valid(b: Bed) -> DataFrame:
    return b.entity.where(F.col("entity_type").isin(*ONTOLOGY.node_types))


@query(
    "upsert_edges",
    """with ok as (select r.* from edge r join entity a on a.id = r.src join entity b on b.id = r.dst where r.edge_type in (select edge_kind from edge_kind))
    select src, dst, edge_type, confidence from ok qualify row_number() over (partition by src, dst, edge_type order by created_at, confidence) = 1""",
)
def _(b: Bed) -> DataFrame:
    return writes.upsert_edges(b.edge.limit(0), b.edge, b.entity, ONTOLOGY).select("src", "dst", "edge_type", "confidence")


@query("upsert_mentions", "select entity_id, doc_id, max(m.confidence) as confidence from (select * from mention union all select entity_id, doc_id, 0.95, source_url from mention) m join entity e on e.id = m.entity_id join documents d using (doc_id) group by entity_id, doc_id")
def _(b: Bed) -> DataFrame:
    twice = b.mention.unionByName(b.mention.withColumn("confidence", F.lit(0.95)))
    return writes.upsert_mentions(twice, b.entity, b.documents).select("entity_id", "doc_id", "confidence")


@query(
    "hyperedges",
    """with p as (select edge_id, entity_id, row_number() over (partition by edge_id order by entity_id) as pos from binds)
    select edge_id, entity_id, case when pos = 1 then 'CONNECTS' else 'BINDS' end as rel from p""",
)
def _(b: Bed) -> DataFrame:
    nodes = b.binds.groupBy("edge_id").agg(F.array_sort(F.collect_list("entity_id")).alias("participants"))
    return writes.hyperedges(nodes)


@query(
    "replace_by_doc",
    """select id, doc_id, body from chunk where cast(doc_id as bigint) % 5 <> 0 union all
    select doc_id || ':0', doc_id, lower(substr(body, 1, 40)) from doc where cast(doc_id as bigint) % 5 = 0 and cast(doc_id as bigint) % 10 <> 0""",
)
def _(b: Bed) -> DataFrame:
    touched = b.doc.where("cast(doc_id as bigint) % 5 = 0").select("doc_id")
    new = b.doc.where("cast(doc_id as bigint) % 5 = 0 and cast(doc_id as bigint) % 10 <> 0").select(F.concat("doc_id", F.lit(":0")).alias("id"), "doc_id", F.lower(F.substring("body", 1, 40)).alias("body"))
    return writes.replace_by_doc(b.chunk.select("id", "doc_id", "body"), new, touched)


@query("ingest_chunks", "select doc_id, count(*) as chunks, cast(sum(length(body)) as bigint) as chars, min(chunk_index) as first_, max(chunk_index) as last_ from chunk group by doc_id")
def _(b: Bed) -> DataFrame:
    return b.chunk.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("body")).alias("chars"), F.min("chunk_index").alias("first_"), F.max("chunk_index").alias("last_"))


@query("community_size", "select community_id, count(*) as members from community group by community_id")
def _(b: Bed) -> DataFrame:
    return b.community.groupBy("community_id").agg(F.count("*").alias("members"))


@query("event_days", "select event_type, cast(date_trunc('day', ts) as date) as day, count(*) as n from events group by 1, 2")
def _(b: Bed) -> DataFrame:
    return b.events.groupBy("event_type", F.to_date(F.window("ts", "1 day")["start"]).alias("day")).agg(F.count("*").alias("n"))


@query("latest_ingest", "select event_type, max(ts) as last_ts, count(*) as n from events group by event_type")
def _(b: Bed) -> DataFrame:
    return b.events.groupBy("event_type").agg(F.max("ts").cast("timestamp_ntz").alias("last_ts"), F.count("*").alias("n"))


@query("document_chunk_writes", """with old as (select id, doc_id, body, chunk_index from chunk where chunk_index < 2), again as (select id, doc_id, lower(body) as body, chunk_index from chunk where chunk_index = 1)
    select * from old where id not in (select id from again) union all select * from again""")
def _(b: Bed) -> DataFrame:
    old = b.chunk.where("chunk_index < 2").select("id", "doc_id", "body", "chunk_index")
    again = b.chunk.where("chunk_index = 1").select("id", "doc_id", F.lower("body").alias("body"), "chunk_index")
    return writes.upsert_chunks(old, again)


@query("set_entity_ids", """with ids as (select cast(doc_id as varchar) as doc_id, '["' || array_to_string(list_sort(list(distinct entity_id)), '","') || '"]' as entity_ids from mention group by doc_id)
    select c.id, coalesce(i.entity_ids, '[]') as entity_ids from chunk c left join ids i on i.doc_id = c.doc_id and c.chunk_index = 0""")
def _(b: Bed) -> DataFrame:
    said = b.mention.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.collect_list("entity_id").alias("entity_ids"))
    first = b.chunk.where("chunk_index = 0").select("id", "doc_id").join(said, "doc_id").select("id", "entity_ids")
    return writes.set_entity_ids(b.chunk.select("id", F.lit("[]").alias("entity_ids")), first)


@query("set_embedding", "select id, case when community_id % 2 = 0 then -embedding[1] else embedding[1] end::double as first_ from vector")
def _(b: Bed) -> DataFrame:
    held = b.vector.select("id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    turned = b.vector.where("community_id % 2 = 0").select("id", F.transform("embedding", lambda x: -x.cast("double")).alias("embedding"))
    return writes.set_embedding(held, turned, 64).select("id", F.element_at("embedding", 1).alias("first_"))


@query("add_documents", "select 'doc/' || doc_id as id, min(lang) as title from documents group by doc_id union all select 'doc/x' || doc_id, min(lang) from documents where doc_id % 2 = 0 group by doc_id")
def _(b: Bed) -> DataFrame:
    row = lambda key: b.documents.select(F.concat(F.lit(key), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("path"), F.col("lang").alias("title"))
    stored = row("doc/").dropDuplicates(["id"])
    new = row("doc/").union(b.documents.where("doc_id % 2 = 0").select(F.concat(F.lit("doc/x"), F.col("doc_id").cast("string")), "source", "lang"))
    return writes.add_documents(stored, new).select("id", "title")


@query("safe_to_delete", """with ends as (select id, count(*) as n from (select src as id from edge union all select dst from edge) group by id), told as (select entity_id as id, count(*) as n from mention group by entity_id)
    select e.id, coalesce(x.n, 0) as edges, coalesce(t.n, 0) as mentions, coalesce(x.n, 0) + coalesce(t.n, 0) = 0 as safe from entity e left join ends x using (id) left join told t using (id)""")
def _(b: Bed) -> DataFrame:
    return writes.safe_to_delete(b.entity, b.edge, b.mention)


@query("queue_health", """select count(*) as pending, case when count(*) >= 5000 then 'critical' when count(*) >= 1000 then 'warning' else 'ok' end as queue_status from events where event_type = 'view'""")
def _(b: Bed) -> DataFrame:
    return health.queue_depth(b.events.where("event_type = 'view'"))

"""Traversal and structure plans."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import graph, report, retrieval
from loomgraph.plans.catalog import query
from loomgraph.plans.testbed import Bed


@query("simple_graph", """select a, b, edge_type, weight from (select least(src, dst) as a, greatest(src, dst) as b, edge_type, weight, created_at, src from edge where src <> dst)
    qualify row_number() over (partition by a, b order by created_at desc, edge_type desc, src desc) = 1""")
def _(b: Bed) -> DataFrame:
    return graph.simple_graph(b.edge)


_STEP = "step as (select src, dst, confidence as c, edge_type as kind from edge qualify row_number() over (partition by src, dst order by confidence desc, edge_type) = 1)"


@query("find_path", f"""with recursive {_STEP}, walk(start, here, nodes, types, hops, conf) as (select id, id, [id], []::varchar[], 0, 1.0::double from entity where entity_type = 'person' and contains(label, '77')
      union all select w.start, s.dst, list_append(w.nodes, s.dst), list_append(w.types, s.kind), w.hops + 1, w.conf * s.c from walk w join step s on s.src = w.here where w.hops < 4 and not list_contains(w.nodes, s.dst))
    select start, here as end_, array_to_string(nodes, '>') as nodes, array_to_string(types, '>') as types, hops, round(conf, 4) as confidence from walk where hops > 0 and here in (select id from entity where entity_type = 'place')
    order by confidence desc, hops, walk.nodes limit 5""")
def _(b: Bed) -> DataFrame:
    starts = b.entity.where(F.col("label").contains("77") & (F.col("entity_type") == "person"))
    found = graph.paths(b.edge, starts, b.entity.where("entity_type = 'place'"), 4, limit=5)
    return found.select("start", F.col("end").alias("end_"), F.array_join("nodes", ">").alias("nodes"), F.array_join("types", ">").alias("types"), "hops", "confidence")


_LINK = "link as (select distinct a, b from (select src as a, dst as b from edge union all select dst, src from edge) where a <> b)"


@query("shortest_path", f"""with recursive {_LINK}, walk(here, nodes, hops) as (select 'customer_2', ['customer_2'], 0 union all select l.b, list_append(w.nodes, l.b), w.hops + 1 from walk w join link l on l.a = w.here where w.hops < 4 and not list_contains(w.nodes, l.b)),
    best as (select nodes from walk where here = 'region_1' order by hops, nodes limit 1)
    select cast(i - 1 as integer) as step, nodes[i] as node from best, range(1, 10) as r(i) where i <= len(nodes)""")
def _(b: Bed) -> DataFrame:
    return graph.shortest_path(b.edge, "customer_2", "region_1")


@query("neighborhood", f"""with {_LINK}, one as (select b as id from link where a = 'brand_brand_11'), two as (select l.b as id from one o join link l on l.a = o.id),
    every as (select 'brand_brand_11' as id, 0 as d union all select id, 1 from one union all select id, 2 from two) select id, cast(min(d) as integer) as distance from every group by id""")
def _(b: Bed) -> DataFrame:
    seed = b.entity.where("id = 'brand_brand_11'")
    return graph.neighborhood(b.edge, seed, 2).select("id", "distance")


_NEAR_BRAND = f"""{_LINK}, one as (select b as id from link where a = 'brand_brand_11'), two as (select l.b as id from one o join link l on l.a = o.id), near as (select 'brand_brand_11' as id union select id from one union select id from two)"""


@query("neighborhood_edges", f"with {_NEAR_BRAND} select src, dst, edge_type from edge where src in (select id from near) and dst in (select id from near)")
def _(b: Bed) -> DataFrame:
    found = graph.neighborhood(b.edge, b.entity.where("id = 'brand_brand_11'"), 2)
    return graph.neighborhood_edges(b.edge, found).select("src", "dst", "edge_type")


@query("neighborhood_by_type", """with link as (select distinct a, b from (select src as a, dst as b from edge where edge_type = 'PART_OF' union all select dst, src from edge where edge_type = 'PART_OF') where a <> b),
    one as (select b as id from link where a = 'nation_3'), two as (select l.b as id from one o join link l on l.a = o.id),
    every as (select 'nation_3' as id, 0 as d union all select id, 1 from one union all select id, 2 from two) select id, cast(min(d) as integer) as distance from every group by id""")
def _(b: Bed) -> DataFrame:
    return graph.neighborhood(b.edge, b.entity.where("id = 'nation_3'"), 2, ["PART_OF"]).select("id", "distance")


_FROM, _TO = ("part_11", "part_67"), ("question_27", "question_7", "region_1")


@query("verify_path", f"""with step as (select a as node, b as other, edge_type, thin from (
        select src as a, dst as b, edge_type, cast(length(coalesce(evidence, '')) < 10 as integer) + cast(edge_type = 'CONFLICTS_WITH' as integer) as thin from edge
        union all select dst, src, edge_type, cast(length(coalesce(evidence, '')) < 10 as integer) + cast(edge_type = 'CONFLICTS_WITH' as integer) from edge)),
    goal as (select unnest({list(_TO)}) as id),
    one as (select [s.id, t.other] as nodes, [t.edge_type] as types, t.thin as against, t.other as here, 1 as hops from entity s join step t on t.node = s.id where s.id in {_FROM} and t.other <> s.id),
    two as (select list_append(o.nodes, t.other) as nodes, list_append(o.types, t.edge_type) as types, o.against + t.thin as against, t.other as here, 2 as hops from one o join step t on t.node = o.here
        where o.here not in (select id from goal) and not list_contains(o.nodes, t.other)),
    three as (select list_append(o.nodes, t.other) as nodes, list_append(o.types, t.edge_type) as types, o.against + t.thin as against, t.other as here, 3 as hops from two o join step t on t.node = o.here
        where o.here not in (select id from goal) and t.other in (select id from goal) and not list_contains(o.nodes, t.other)),
    every as (select * from one union all select * from two union all select * from three)
    select array_to_string(nodes, '>') as nodes, array_to_string(types, '>') as types, hops, against as contradictions, cast(len(list_filter(types, lambda k: k = 'SUPPORTS')) as integer) as supports, against = 0 as verified
    from every where here in (select id from goal) qualify row_number() over (partition by every.nodes[1], here order by hops, every.nodes, every.types) <= 10""")
def _(b: Bed) -> DataFrame:
    found = graph.verify_paths(b.edge, b.entity.where(F.col("id").isin(*_FROM)), b.entity.where(F.col("id").isin(*_TO)))
    return found.withColumn("nodes", F.array_join("nodes", ">")).withColumn("types", F.array_join("types", ">"))


_KNOWN = """link as (select t.src as a, t.dst as b from edge t where t.src in (select id from entity) and t.dst in (select id from entity)
      union select t.dst, t.src from edge t where t.src in (select id from entity) and t.dst in (select id from entity)),
    cc(id, component) using key (id) as (select id, id from entity union
      select l.b, min(x.component) from cc x join link l on l.a = x.id join recurring.cc y on y.id = l.b where x.component < y.component group by l.b)"""


@query("components", f"with recursive {_KNOWN} select id, component from cc")
def _(b: Bed) -> DataFrame:
    return graph.components(b.entity, b.edge)


@query("largest_components", f"with recursive {_KNOWN} select component, count(*) as n from cc group by component order by n desc, component limit 5")
def _(b: Bed) -> DataFrame:
    return graph.components(b.entity, b.edge).groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(5)


@query("bridges")
def _(b: Bed) -> DataFrame:
    return graph.bridges(b.edge)


@query("community_gaps", """with size as (select community_id as c, count(*) as n from community group by 1 having count(*) >= 3),
    cross_ as (select least(x.community_id, y.community_id) as a, greatest(x.community_id, y.community_id) as b, count(*) as links from edge r join community x on x.entity_id = r.src join community y on y.entity_id = r.dst where x.community_id <> y.community_id group by 1, 2),
    deg as (select id, count(*) as d from (select src as id from edge union all select dst from edge) group by id),
    top as (select c, string_agg(label, ', ' order by r) as names from (select m.community_id as c, e.label, row_number() over (partition by m.community_id order by coalesce(d.d, 0) desc, m.entity_id) as r from community m join entity e on e.id = m.entity_id left join deg d on d.id = m.entity_id) where r <= 3 group by c)
    select a.c as a, b.c as b, a.n as size_a, b.n as size_b, coalesce(x.links, 0) as links, case when coalesce(x.links, 0) = 0 then 'HIGH' else 'MEDIUM' end as severity, ta.names as names_a, tb.names as names_b
    from size a join size b on a.c < b.c left join cross_ x on x.a = a.c and x.b = b.c join top ta on ta.c = a.c join top tb on tb.c = b.c where coalesce(x.links, 0) <= 2""")
def _(b: Bed) -> DataFrame:
    members = b.community.select(F.col("entity_id").alias("id"), F.col("community_id").alias("community"))
    return graph.community_gaps(members, b.edge, b.entity)


@query("communities")
def _(b: Bed) -> DataFrame:
    return graph.louvain_communities(b.entity, b.edge)


def _summaries(b: Bed, least: int = 3) -> DataFrame:
    """(community, size, top_entities, summary) of communities of at least `least` members."""
    members = graph.louvain_communities(b.entity, b.edge)
    ranked = members.join(graph.degrees(b.entity, b.edge), "id").join(b.entity.select("id", "label", "entity_type", "description"), "id")
    item = F.struct((-F.col("degree")).alias("d"), "id", "label", "entity_type", "description")
    size = members.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    from pyspark.sql import Window

    order = Window.partitionBy("community").orderBy(F.desc("degree"), "id")
    top = ranked.withColumn("r", F.row_number().over(order)).where("r <= 5").groupBy("community").agg(F.array_sort(F.collect_list(item)).alias("top"))
    text = F.array_join(F.transform("top", lambda t: F.concat(t["label"], F.lit(" ("), t["entity_type"], F.lit("): "), t["description"])), ". ")
    return size.join(top, "community").select(
        F.concat(F.lit("community_"), "community").alias("id"), "community", "size", F.transform("top", lambda t: t["label"]).alias("top_entities"),
        F.concat(F.lit("Community of "), F.col("size").cast("string"), F.lit(" related concepts. "), text).alias("summary"),
    )


@query("community_summaries")
def _(b: Bed) -> DataFrame:
    return _summaries(b)


@query("community_members")
def _(b: Bed) -> DataFrame:
    members = graph.louvain_communities(b.entity, b.edge)
    return members.join(b.entity.select("id", "label", "entity_type"), "id")


@query("betweenness")
def _(b: Bed) -> DataFrame:
    scores = graph.betweenness(b.edge)
    return scores.join(graph.degrees(b.entity, b.edge), "id").withColumn("surprising", (F.col("betweenness") > 0.05) & (F.col("degree") < 10)).orderBy(F.desc("betweenness"), "id").limit(20)


@query("skeleton")
def _(b: Bed) -> DataFrame:
    return graph.skeleton(b.edge)


@query("homology")
def _(b: Bed) -> DataFrame:
    found = graph.homology(b.edge, b.entity)
    return b.spark.createDataFrame([(found["h0"], found["h1"], json.dumps(found["persistent"]))], "h0 int, h1 int, persistent string")


@query("community_list")
def _(b: Bed) -> DataFrame:
    """Stored summaries by size, the largest first, then by id."""
    return _summaries(b).orderBy(F.desc("size"), "id").select("id", "size", F.array_join("top_entities", ", ").alias("top_entities"))


def _topology(b: Bed) -> report.Topology:
    return report.Topology(b.entity, b.edge)


@query("topology_report")
def _(b: Bed) -> DataFrame:
    return _topology(b).rows()


@query("briefing")
def _(b: Bed) -> DataFrame:
    """The daily reflection as (place, section, line) rows."""
    from loomgraph.plans.relational import CUTOFF
    from loomgraph.plans.searches import _vector_links

    hidden = retrieval.hidden_pairs(b.vector, _vector_links(b), least=0.4, top=50)
    return report.briefing(_topology(b), hidden, b.mention.select(F.col("entity_id").alias("id")), now=CUTOFF + 86_400, prune_days=30)

"""Retrieval plans: BM25, vectors, fusion, expansion, hidden links, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import snippet
from loomgraph.functions.words import STOPWORDS
from loomgraph.operators import graph, search
from loomgraph.operators import retrieval as rt
from loomgraph.plans.catalog import query
from loomgraph.plans.testbed import Bed
from loomgraph.session import materialize

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TERMS = "list_filter(regexp_extract_all(lower(strip_accents({0})), '[a-z]+'), lambda t: t not in (" + _STOP + "))"
_BM25 = f"""asked_term as (select distinct query_id, unnest({_TERMS.format("text")}) as term from asked),
    words as (select id, {_TERMS.format("concat_ws(' ', body, title)")} as w from chunk where sensitivity = 'public'),
    corpus as (select count(*)::double as n, avg(len(w)) as mean from words),
    tf as (select term, id, any_value(len) as len, count(*) as tf from (select id, len(w) as len, unnest(w) as term from words) where term in (select term from asked_term) group by term, id),
    df as (select term, count(*) as df from tf group by term),
    scored as (select query_id, id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 9) as score
      from tf join df using (term) join asked_term using (term), corpus group by query_id, id),
    bm as (select query_id, id, score, cast(row_number() over (partition by query_id order by score desc, id) as integer) as rank from scored qualify rank <= 50)"""


def public_chunks(b: Bed) -> DataFrame:
    return b.chunk.where("sensitivity = 'public'")


@query("bm25_topk", f"with {_BM25} select query_id, id, round(score, 6) as score, rank from bm")
def _(b: Bed) -> DataFrame:
    return rt.bm25(b.public_index, b.asked).withColumn("score", F.round("score", 6))


@query("bm25_stemmed")
def _(b: Bed) -> DataFrame:
    """As bm25_topk, over Porter stems."""
    return rt.bm25(b.stemmed_index, b.asked).withColumn("score", F.round("score", 6))


_COS = "list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0)"


def _cosine(a: str, b: str) -> str:
    return "round(coalesce(" + _COS.format(a=f"{a}::double[]", b=f"{b}::double[]") + ", 0), 9)"


_NEAR = f"""near as (select q.id as query_id, v.id, {_cosine("q.embedding", "v.embedding")} as similarity from vector q, vector v),
    knn as (select query_id, id, similarity, cast(row_number() over (partition by query_id order by similarity desc, id) as integer) as rank from near qualify rank <= 50)"""


@query("vector_topk", f"with {_NEAR} select query_id, id, round(similarity, 6) as similarity, rank from knn where rank <= 10")
def _(b: Bed) -> DataFrame:
    asked = b.vector.select(F.col("id").alias("query_id"), "embedding")
    return rt.vector_search(b.vector, asked, 10).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query("entity_vector_search", f"with {_NEAR} select id, round(similarity, 6) as similarity, round(1 - similarity, 6) as distance, rank from knn where query_id = 'vec_3' and rank <= 20")
def _(b: Bed) -> DataFrame:
    found = rt.vector_search(b.vector, b.vector.where("id = 'vec_3'").select(F.col("id").alias("query_id"), "embedding"), 20)
    return found.select("id", F.round("similarity", 6).alias("similarity"), F.round("distance", 6).alias("distance"), "rank")


_LETTERS = ", ".join(f"(length({{0}}) - length(replace({{0}}, '{chr(97 + i)}', '')))::double" for i in range(26))
_HYBRID = f"""{_BM25},
    cv as (select id, [{_LETTERS.format("lower(body)")}] as e from chunk where sensitivity = 'public'),
    qv as (select query_id, [{_LETTERS.format("lower(text)")}] as e from asked),
    leg as (select query_id, id, cast(row_number() over (partition by query_id order by similarity desc, id) as integer) as rank
      from (select q.query_id, c.id, round(coalesce({_COS.format(a="q.e", b="c.e")}, 0), 9) as similarity from qv q, cv c) qualify rank <= 50),
    fused as (select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.id, b.id) as id, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9)::double as score,
      case when a.id is not null and b.id is not null then 'both' when a.id is not null then 'keyword' else 'semantic' end as match
      from bm a full outer join leg b on a.query_id = b.query_id and a.id = b.id),
    hybrid as (select *, cast(row_number() over (partition by query_id order by score desc, id) as integer) as rank from fused qualify rank <= 12)"""


def _with_chunk(b: Bed, top: DataFrame, *columns: str) -> DataFrame:
    """The found rows with columns of their chunks; they are few (a dozen a query) and go to the chunks, which stay where they are."""
    return b.chunk.select("id", *columns).join(F.broadcast(materialize(top, "searches-found")), "id")


def hybrid(b: Bed, limit: int = 12) -> DataFrame:
    """Both legs over public chunks only, fused; every public chunk stands in both."""
    asked = rt.letter_embed(b.asked, "text").select("query_id", "embedding")
    return rt.fuse(rt.bm25(b.public_index, b.asked), rt.vector_search(b.chunk_vectors, asked, rt.LEG), limit)


@query("hybrid_rrf", f"with {_HYBRID} select query_id, id, score, match, rank from hybrid")
def _(b: Bed) -> DataFrame:
    return hybrid(b)


@query("passage_search", f"""with {_HYBRID}, piv as (select cast(m.doc_id as varchar) as doc_id, count(*) as n, array_to_string((list(e.label order by e.label, e.id))[1:8], '|') as shown from mention m join entity e on e.id = m.entity_id group by m.doc_id)
    select query_id, rank, h.id, substr(trim(regexp_replace(c.body, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 1, 240) as snippet, coalesce(p.shown, '') as entities, greatest(coalesce(p.n, 0) - 8, 0) as more
    from hybrid h join chunk c on c.id = h.id left join piv p on p.doc_id = c.doc_id""")
def _(b: Bed) -> DataFrame:
    names = b.mention.join(b.entity.select(F.col("id").alias("entity_id"), "label"), "entity_id").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("label", "entity_id"))).alias("all"))
    top = _with_chunk(b, hybrid(b), "doc_id", "body").join(names, "doc_id", "left")
    return top.select(
        "query_id", "rank", "id", snippet(F.col("body")).alias("snippet"),
        F.coalesce(F.array_join(F.transform(F.slice("all", 1, 8), lambda s: s["label"]), "|"), F.lit("")).alias("entities"),
        F.greatest(F.coalesce(F.size("all"), F.lit(0)) - 8, F.lit(0)).cast("long").alias("more"),
    )


_EXPECTED = "[lower(substr(a.text, 1, 30)), lower(substr(a.text, 31, 30)), lower(substr(a.text, 61, 30))]"


@query("recall_at_k", f"""with {_HYBRID}, top as (select query_id, string_agg(lower(c.body) || ' ' || lower(c.source_uri), ' ' order by h.rank) as seen from hybrid h join chunk c on c.id = h.id where h.rank <= 5 group by query_id),
    hit as (select a.query_id, len(list_filter({_EXPECTED}, lambda x: x <> '')) as n, len(list_filter({_EXPECTED}, lambda x: x <> '' and contains(coalesce(t.seen, ''), x))) as met from asked a left join top t using (query_id))
    select cast(query_id % 3 as varchar) as category, count(*) as queries, round(avg(case when met >= greatest(1, n // 2) then 1 else 0 end), 6) as recall from hit group by query_id % 3
    union all select 'all', count(*), round(avg(case when met >= greatest(1, n // 2) then 1 else 0 end), 6) from hit""")
def _(b: Bed) -> DataFrame:
    top = _with_chunk(b, hybrid(b).where("rank <= 5"), "body", "source_uri")
    part = lambda i: F.lower(F.substring("text", 30 * i + 1, 30))
    asked = b.asked.select("query_id", (F.col("query_id") % 3).cast("string").alias("category"), F.array(part(0), part(1), part(2)).alias("expected"))
    return rt.recall_at_k(asked, top.select("query_id", "rank", "body", F.col("source_uri").alias("path")))


_ENTITY_LEGS = f"""{_NEAR}, kw as (select 1 as query_id, 'vec_' || cast(row_number() over (order by confidence desc, id) * 3 as varchar) as id, cast(row_number() over (order by confidence desc, id) as integer) as rank
      from entity where contains(label, '7') order by rank limit 24),
    sem as (select 1 as query_id, id, rank from knn where query_id = 'vec_9' and rank <= 24)"""


def _entity_legs(b: Bed) -> tuple[DataFrame, DataFrame]:
    hit = b.entity.where(F.col("label").contains("7")).select(F.lit(1).alias("query_id"), "id", "confidence")
    ranked = rt.top_by(hit, "confidence", 24)
    keyword = ranked.select("query_id", F.concat(F.lit("vec_"), (F.col("rank") * 3).cast("string")).alias("id"), "rank")
    semantic = rt.vector_search(b.vector, b.vector.where("id = 'vec_9'").select(F.lit(1).alias("query_id"), "embedding"), 24)
    return keyword, semantic


@query("entity_hybrid_rrf", f"""with {_ENTITY_LEGS}, fused as (select coalesce(a.id, b.id) as id, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 4)::double as score,
      round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) as full_,
      case when a.id is not null and b.id is not null then 'both' when a.id is not null then 'keyword' else 'semantic' end as match from kw a full outer join sem b on a.id = b.id)
    select id, score, match from fused order by full_ desc, id limit 12""")
def _(b: Bed) -> DataFrame:
    return rt.fuse(*_entity_legs(b), 12).select("id", F.round("score", 4).alias("score"), "match")


@query("memory_search_merge", f"""with {_ENTITY_LEGS}, every as (select id, rank, 0 as leg from kw where rank <= 10 union all select id, rank, 1 from sem where rank <= 10)
    select id, cast(leg as integer) as leg, rank from every qualify row_number() over (partition by id order by leg, rank) = 1""")
def _(b: Bed) -> DataFrame:
    keyword, semantic = _entity_legs(b)
    return rt.first_wins(keyword.where("rank <= 10"), semantic.where("rank <= 10")).select("id", "leg", "rank")


@query("memory_search_expand", """with recursive seed as (select id from entity where contains(label, '7') and entity_type = 'person' order by confidence desc, id limit 5),
    link as (select distinct a, b from (select src as a, dst as b from edge union all select dst, src from edge) where a <> b),
    one as (select distinct s.id as seed, l.b as id from seed s join link l on l.a = s.id where l.b <> s.id),
    two as (select distinct o.seed, l.b as id from one o join link l on l.a = o.id where l.b <> o.seed),
    every as (select seed, id, min(d) as distance from (select seed, id, 1 as d from one union all select seed, id, 2 from two) group by seed, id)
    select seed, id, cast(distance as integer) as distance from every qualify row_number() over (partition by seed order by distance, id) <= 10""")
def _(b: Bed) -> DataFrame:
    seeds = b.entity.where(F.col("label").contains("7") & (F.col("entity_type") == "person")).orderBy(F.desc("confidence"), "id").limit(5).select("id")
    near = graph.neighborhood(b.edge, seeds, 2).where("distance > 0")
    return rt.top_by(near, "distance", 10, group="seed", ascending=True).select("seed", "id", "distance")


@query("community_search", f"""with centre as (select community_id, list(m order by i) as embedding from (select community_id, i, avg(embedding[i]::double) as m from vector, range(1, 65) as r(i) group by community_id, i) group by community_id)
    select community_id, round({_cosine("c.embedding", "q.embedding")}, 6) as similarity from centre c, (select embedding from vector where id = 'vec_5') q order by similarity desc, community_id limit 5""")
def _(b: Bed) -> DataFrame:
    each = b.vector.select("community_id", F.posexplode("embedding").alias("i", "x")).groupBy("community_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = each.groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))
    asked = b.vector.where("id = 'vec_5'").select(F.lit(1).alias("query_id"), "embedding")
    found = rt.vector_search(centre.select(F.col("community_id").alias("id"), "embedding"), asked, 5)
    return found.select(F.col("id").alias("community_id"), F.round("similarity", 6).alias("similarity"))


_LINKED = "linked as (select least(src, dst) as a, greatest(src, dst) as b from (select 'vec_' || cast(vec_id as varchar) as src, 'vec_' || cast(vec_id + 1 as varchar) as dst from embeddings) l)"


def _vector_links(b: Bed) -> DataFrame:
    vec = lambda c: F.concat(F.lit("vec_"), c.cast("string"))
    return b.embeddings.select(vec(F.col("vec_id")).alias("src"), vec(F.col("vec_id") + 1).alias("dst"))


def _hidden_sql(where: str, k: int, least: float, top: int | None) -> str:
    return f"""with {_NEAR}, {_LINKED}, pair as (select least(query_id, id) as a, greatest(query_id, id) as b, max(similarity) as similarity from knn where rank <= {k} and similarity >= {least} and query_id <> id and {where} group by 1, 2)
    select a, b, round(similarity, 4) as similarity from pair p where not exists (select 1 from linked l where l.a = p.a and l.b = p.b) order by similarity desc, a, b""" + (f" limit {top}" if top else "")


@query("hidden_connections", _hidden_sql("true", 20, 0.4, 20))
def _(b: Bed) -> DataFrame:
    return rt.hidden_pairs(b.vector, _vector_links(b), least=0.4)


@query("hidden_for_entity", _hidden_sql("query_id = 'vec_12'", 20, 0.2, None))
def _(b: Bed) -> DataFrame:
    return rt.hidden_pairs(b.vector, _vector_links(b), b.vector.where("id = 'vec_12'"), least=0.2, top=None)


@query("conflict_expand", "select a.entity_type, b.entity_type as other_type, count(*) as n from edge r join entity a on a.id = r.src join entity b on b.id = r.dst where r.edge_type = 'CONFLICTS_WITH' group by 1, 2")
def _(b: Bed) -> DataFrame:
    kind = b.entity.select("id", "entity_type")
    found = b.edge.where("edge_type = 'CONFLICTS_WITH'").select("src", "dst")
    return (
        found.join(kind.withColumnRenamed("id", "src").hint("merge"), "src").join(kind.select(F.col("id").alias("dst"), F.col("entity_type").alias("other_type")).hint("merge"), "dst")
        .groupBy("entity_type", "other_type").agg(F.count("*").alias("n"))
    )


@query("search_modes")
def _(b: Bed) -> DataFrame:
    """One question in each mode of the search."""
    texts = b.asked.orderBy("query_id").limit(3)
    engine = search.Searcher(b.entity, b.edge, b.chunk, b.public_index, b.chunk_vectors, rt.letter_embed)
    out = None
    for mode in search.MODES:
        one = engine.search(texts, mode, limit=5).select(F.lit(mode).alias("mode"), "query_id", F.col("id").cast("string").alias("id"), "score", "rank")
        out = one if out is None else out.unionByName(one)
    return out

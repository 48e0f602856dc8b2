"""Text plans: chunks, notes, slugs, snippets, links between passages and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as tx
from loomgraph.plans.catalog import query
from loomgraph.operators.ontology import Ontology
from loomgraph.plans.testbed import Bed


@query("chunk_documents", "select id, doc_id, chunk_index, body from chunk")
def _(b: Bed) -> DataFrame:
    return tx.chunk_documents(b.doc, "doc_id", "body", uri_col="source_uri")


@query("html_to_text", r"select page_id, url, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) as text from pages")
def _(b: Bed) -> DataFrame:
    return b.pages.select("page_id", "url", tx.strip_markup(F.col("html")).alias("text"))


@query("snippets", r"select id, substr(trim(regexp_replace(body, '[ \t\n\x0B\f\r]+', ' ', 'g')), 1, 240) as snippet from chunk where chunk_index = 0")
def _(b: Bed) -> DataFrame:
    return b.chunk.where("chunk_index = 0").select("id", tx.snippet(F.col("body")).alias("snippet"))


@query("slugify", "select id, case when coalesce(label, '') = '' then 'unknown' else substr(trim(regexp_replace(lower(trim(label)), '[^a-z0-9]+', '_', 'g'), '_'), 1, 128) end as slug from entity")
def _(b: Bed) -> DataFrame:
    return b.entity.select("id", tx.slugify(F.col("label")).alias("slug"))


def _notes(b: Bed) -> DataFrame:
    """Documents written up as notes: a head with tags, links and inline tags in the body."""
    head = F.concat(F.lit("---\nTitle: \"Note "), F.col("doc_id"), F.lit("\"\ntags: [#"), F.col("lang"), F.lit(", "), F.col("source"), F.lit("]\nstatus: draft\n---\n"))
    body = F.concat(F.coalesce("text", F.lit("")), F.lit(" [["), F.col("source"), F.lit("]] and [[n"), F.col("doc_id"), F.lit("|shown]] #Topic/"), F.col("lang"), F.lit(" a#b"))
    return b.documents.select("doc_id", F.concat(head, body).alias("text"), "lang", "source", F.col("text").alias("raw"))


_NOTE = """(select doc_id, lang, source, '---' || chr(10) || 'Title: "Note ' || doc_id || '"' || chr(10) || 'tags: [#' || lang || ', ' || source || ']' || chr(10) || 'status: draft' || chr(10) || '---' || chr(10)
    || coalesce(text, '') || ' [[' || source || ']] and [[n' || doc_id || '|shown]] #Topic/' || lang || ' a#b' as text from documents) note"""


@query("frontmatter", f"select doc_id, regexp_extract(text, 'Title: \"(.*)\"', 1) as title, regexp_extract(text, 'status: (\\w+)', 1) as status, cast(len(list_filter(string_split(regexp_extract(text, '^---([^-]*)---', 1), chr(10)), lambda x: contains(x, ':'))) as integer) as keys, trim(substr(text, instr(substr(text, 4), '---') + 6), chr(10) || chr(13) || chr(9) || ' ') as body from {_NOTE}")
def _(b: Bed) -> DataFrame:
    found = _notes(b).withColumn("f", tx.frontmatter(F.col("text")))
    one = lambda k: F.element_at(F.col("f")[k], 1)
    return found.select("doc_id", one("title").alias("title"), one("status").alias("status"), F.size("f").alias("keys"), tx.note_body(F.col("text")).alias("body"))


@query("wikilinks", rf"select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\[\[([^\]|]+)(?:\|[^\]]+)?\]\]', 1))), ',') as links from {_NOTE}")
def _(b: Bed) -> DataFrame:
    return _notes(b).select("doc_id", F.array_join(tx.wikilinks(F.col("text")), ",").alias("links"))


@query(
    "tags",
    rf"""select doc_id, array_to_string(list_sort(list_distinct(list_concat([lang, source], regexp_extract_all(text, '(?:^|[\s\x0B])#([a-zA-Z][a-zA-Z0-9_/-]*)', 1)))), ',') as tags from {_NOTE}""",
)
def _(b: Bed) -> DataFrame:
    return _notes(b).select("doc_id", F.array_join(tx.tags(F.col("text")), ",").alias("tags"))


@query(
    "note_entities",
    rf"""with tag as (select distinct unnest(list_concat([lang, source], regexp_extract_all(text, '(?:^|[\s\x0B])#([a-zA-Z][a-zA-Z0-9_/-]*)', 1))) as t, doc_id from {_NOTE}),
      link as (select distinct unnest(regexp_extract_all(text, '\[\[([^\]|]+)(?:\|[^\]]+)?\]\]', 1)) as t, doc_id from {_NOTE})
    select 'tag_' || trim(regexp_replace(lower(t), '[^a-z0-9]+', '_', 'g'), '_') as id, t as label, 'obsidian_tag' as provenance, count(*) as notes from tag group by t
    union all select 'wikilink_' || substr(sha256(t), 1, 16), t, 'wikilink', count(*) from link group by t""",
)
def _(b: Bed) -> DataFrame:
    notes = _notes(b)
    tag = notes.select("doc_id", F.explode(tx.tags(F.col("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("notes"))
    link = notes.select("doc_id", F.explode(tx.wikilinks(F.col("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("notes"))
    return tag.select(F.concat(F.lit("tag_"), tx.slugify(F.col("t"))).alias("id"), F.col("t").alias("label"), F.lit("obsidian_tag").alias("provenance"), "notes").union(
        link.select(tx.short_hash(F.col("t"), "wikilink_"), "t", F.lit("wikilink"), "notes")
    )


@query(
    "normalize_types",
    """with raw as (select distinct case k when 0 then upper(entity_type) when 1 then ' ' || entity_type || ' ' when 2 then entity_type || 's' when 3 then 'Author' when 4 then 'software' else 'gadget' end as raw
      from entity, range(6) as r(k))
    select raw, case lower(trim(raw)) when 'concepts' then 'concept' when 'projects' then 'project' when 'questions' then 'question' when 'author' then 'person' when 'software' then 'tool'
      else (select node_type from node_type where node_type = lower(trim(raw))) end as node_type, upper(trim(raw)) as edge_type from raw""",
)
def _(b: Bed) -> DataFrame:
    t = F.col("entity_type")
    raw = b.entity.select(F.explode(F.array(F.upper(t), F.concat(F.lit(" "), t, F.lit(" ")), F.concat(t, F.lit("s")), F.lit("Author"), F.lit("software"), F.lit("gadget"))).alias("raw")).distinct()
    return raw.select("raw", Ontology().normal_node_type(F.col("raw")).alias("node_type"), Ontology().normal_edge_type(F.col("raw")).alias("edge_type"))


@query(
    "er_keys",
    r"""with n as (select distinct label, trim(regexp_replace(replace(lower(strip_accents(label)), '''', ''), '[^a-z0-9]+', ' ', 'g')) as norm from entity where entity_type <> 'question')
    select label, norm, len(string_split(norm, ' ')) as tokens, regexp_matches(norm, '^[a-z]{2,6}$') as acronym from n""",
)
def _(b: Bed) -> DataFrame:
    keys = tx.with_label_keys(b.entity.where("entity_type <> 'question'").select("label").distinct())
    return keys.select("label", "norm", F.size("toks").cast("long").alias("tokens"), "acronym")


def link_entities(chunks: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(chunk_id, entity_id): entities of the chunk's own document with a surface in it as a whole word.

    surfaces: (entity_id, doc_id, surface). The join is on the document; surfaces under
    three characters do not count.
    """
    long = surfaces.withColumn("surface", F.trim("surface")).where(F.length("surface") >= 3)
    met = chunks.select(F.col("id").alias("chunk_id"), "doc_id", "body").join(long, "doc_id")
    return met.where(tx.mentions_word(F.col("body"), F.col("surface"))).select("chunk_id", "entity_id").distinct()


@query(
    "link_entities",
    r"""with s as (select cast(doc_id as varchar) as doc_id, 'w' || cast(w as varchar) as entity_id, lower(regexp_extract_all(text, '[A-Za-z]{3,}')[w]) as surface from documents, unnest([1, 5, 9]) as u(w))
    select distinct c.id as chunk_id, s.entity_id from chunk c join s using (doc_id) where s.surface is not null and s.surface <> '' and contains(lower(c.body), s.surface) and regexp_matches(lower(c.body), '(?:^|[^\p{L}\p{N}\p{M}_])' || s.surface || '(?:$|[^\p{L}\p{N}\p{M}_])')""",
)
def _(b: Bed) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))
    picked = b.documents.select(F.col("doc_id").cast("string").alias("doc_id"), words.alias("w"), F.explode(F.array(F.lit(1), F.lit(5), F.lit(9))).alias("k"))
    surfaces = picked.select(F.concat(F.lit("w"), F.col("k").cast("string")).alias("entity_id"), "doc_id", F.lower(F.try_element_at("w", F.col("k"))).alias("surface")).where("surface is not null")
    return link_entities(b.chunk, surfaces)


@query("entity_mentions", "select entity_id, count(*) as documents, min(doc_id) as first_doc, max(doc_id) as last_doc from mention group by entity_id")
def _(b: Bed) -> DataFrame:
    listed = b.mention.groupBy("entity_id").agg(F.collect_set("doc_id").alias("doc_ids"))  # as extraction hands them over
    each = listed.select("entity_id", F.explode("doc_ids").alias("doc_id"))
    return each.groupBy("entity_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


#: Words that stand for each kind of link when a vault is looked through.
PATTERNS = {"LEARNED_FROM": ("that", "from"), "PART_OF": ("of", "in"), "SUPPORTS": ("for", "with"), "CONFLICTS_WITH": ("not", "nicht")}


@query(
    "pattern_scan",
    "select * from ("
    + " union all ".join(f"select '{k}' as edge_type, " + " + ".join(f"cast(sum((length(text) - length(replace(lower(text), '{w}', ''))) / {len(w)}) as bigint)" for w in ws) + " as hits from (select lower(text) as text from documents)" for k, ws in PATTERNS.items())
    + ") where hits > 0",
)
def _(b: Bed) -> DataFrame:
    text = F.lower("text")
    count = lambda w: F.sum(((F.length(text) - F.length(F.replace(text, F.lit(w)))) / len(w)).cast("long"))
    totals = b.documents.agg(*[sum((count(w) for w in ws[1:]), count(ws[0])).alias(k) for k, ws in PATTERNS.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("edge_type"), F.col(k).alias("hits")) for k in PATTERNS]))
    return totals.select(rows.alias("r")).select("r.*").where("hits > 0")


@query("thought_passages", "select 'mcp_' || substr(sha256(text), 1, 16) as doc_id, count(*) as turns, max(length(text)) as chars from conversations where role = 'user' group by text")
def _(b: Bed) -> DataFrame:
    return b.conversations.where("role = 'user'").groupBy("text").agg(F.count("*").alias("turns"), F.max(F.length("text")).alias("chars")).select(tx.short_hash(F.col("text"), "mcp_").alias("doc_id"), "turns", "chars")


@query("document_ids", "select doc_id, substr(sha256(source || '/' || doc_id), 1, 16) as note_id from documents")
def _(b: Bed) -> DataFrame:
    return b.documents.select("doc_id", tx.short_hash(F.concat_ws("/", "source", "doc_id")).alias("note_id"))

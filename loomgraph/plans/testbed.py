"""A knowledge graph derived from the benchmark tables, by the same SQL in Spark and DuckDB.

Each table is a template over base tables and earlier templates, in the dialect that both
engines share. Spark resolves the braces to DataFrames; `with_tables` renders a query's
templates as common table expressions for DuckDB.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from loomgraph.session import bound_tasks, materialize, read_table, spread_shuffles

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
EPOCH = 1_700_000_000

_ENTITY = """select {id} as id, {kind} as entity_type, {label} as label, {description} as description,
  cast(({key} % 50 + 50) / 100e0 as double) as confidence, {url} as source_url, {provenance} as provenance,
  cast(1700000000 + {key} * 3600 as bigint) as created_at from {source}"""


def _entity(id: str, kind: str, label: str, key: str, source: str, description: str = "''", url: str = "''", provenance: str = "'import'") -> str:
    return _ENTITY.format(id=id, kind=kind, label=label, key=key, source=source, description=description, url=url, provenance=provenance)


def _edge(src: str, dst: str, kind: str, key: str, source: str, evidence: str = "''") -> str:
    return f"""select {src} as src, {dst} as dst, '{kind}' as edge_type, cast(({key} % 9 + 1) / 10e0 as double) as weight,
      cast(({key} % 40 + 60) / 100e0 as double) as confidence, {evidence} as evidence,
      cast(1700000000 + {key} * 60 as bigint) as created_at from {source}"""


def _id(prefix: str, key: str) -> str:
    return f"'{prefix}_' || cast({key} as string)"


TYPE_ID = "'type_' || lower(replace(p_type, ' ', '_'))"
BRAND_ID = "'brand_' || lower(replace(p_brand, '#', '_'))"

TABLES: dict[str, str] = {
    "entity": " union all ".join(
        [
            _entity(_id("region", "r_regionkey"), "'place'", "r_name", "r_regionkey", "{region}"),
            _entity(_id("nation", "n_nationkey"), "'place'", "n_name", "n_nationkey", "{nation}"),
            _entity(_id("customer", "c_custkey"), "'person'", "c_name", "c_custkey", "{customer}", url="'doc/' || cast(c_custkey % 37 as string)"),
            _entity(_id("supplier", "s_suppkey"), "'source'", "s_name", "s_suppkey", "{supplier}", url="'doc/' || cast(s_suppkey % 37 as string)"),
            _entity(
                _id("part", "p_partkey"), "case when p_partkey % 97 = 0 then 'widget' when p_partkey % 23 = 0 then 'insight' else 'tool' end", "p_name", "p_partkey", "{part}",
                description="p_brand || ' ' || p_type", url="'doc/' || cast(p_partkey % 37 as string)", provenance="case when p_partkey % 10 = 0 then 'obsidian_tag' else 'llm' end",
            ),
            _entity(TYPE_ID, "'concept'", "p_type", "length(p_type)", "(select distinct p_type from {part}) t"),
            _entity(BRAND_ID, "'project'", "p_brand", "length(p_brand)", "(select distinct p_brand from {part}) b"),
            _entity(_id("question", "item_id"), "'question'", "substr(text, 1, 60)", "item_id", "{benchmark}"),
        ]
    ),
    "edge": " union all ".join(
        [
            _edge(_id("nation", "n_nationkey"), _id("region", "n_regionkey"), "PART_OF", "n_nationkey", "{nation}"),
            _edge(_id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "PART_OF", "s_suppkey", "{supplier}"),
            _edge(_id("customer", "c_custkey"), _id("nation", "c_nationkey"), "PART_OF", "c_custkey", "{customer} where c_custkey % 2 = 0"),
            _edge(_id("part", "p_partkey"), TYPE_ID, "IMPLEMENTS", "p_partkey", "{part} where p_partkey % 4 <> 3"),
            _edge(_id("part", "p_partkey"), BRAND_ID, "INSPIRED_BY", "p_partkey", "{part} where p_partkey % 5 = 0"),
            _edge(_id("part", "p_partkey"), _id("part", "p_partkey + 2"), "SUPPORTS", "p_partkey", "{part} where p_partkey % 11 = 0", "substr(p_name, 1, 4 + p_partkey % 9)"),
            _edge(_id("part", "p_partkey"), _id("part", "p_partkey + 1"), "CONFLICTS_WITH", "p_partkey", "{part} where p_partkey % 13 = 0", "p_name"),
            _edge(_id("part", "p_partkey"), _id("supplier", "p_partkey % 50 + 1"), "LEARNED_FROM", "p_partkey", "{part} where p_partkey % 23 = 0"),
            _edge(_id("part", "p_partkey"), _id("question", "p_partkey % 40"), "ANSWERS", "p_partkey", "{part} where p_partkey % 60 = 7"),
            _edge(_id("part", "p_partkey"), TYPE_ID, "ASKED_ABOUT", "p_partkey", "{part} where p_partkey % 101 = 1"),
            _edge(_id("part", "p_partkey"), _id("part", "p_partkey + 100000000"), "SUPPORTS", "p_partkey", "{part} where p_partkey % 500 = 3"),
            _edge(_id("part", "p_partkey"), TYPE_ID, "BOGUS", "p_partkey", "{part} where p_partkey % 211 = 5"),
            _edge(_id("part", "l_partkey"), _id("supplier", "l_suppkey"), "REQUIRES", "l_partkey", "(select distinct l_partkey, l_suppkey from {lineitem}) r"),
        ]
    ),
    "mention": """select 'part_' || cast(p_partkey as string) as entity_id, d.doc_id, cast(0.9e0 as double) as confidence, d.source as source_url
        from {part} join {documents} d on d.doc_id = p_partkey % 1000""",
    "edge_node": """select 'order_' || cast(o_orderkey as string) as id,
        case o_orderstatus when 'O' then 'similar' when 'F' then 'contains' else 'leads_to' end as semantic_type,
        o_orderpriority as label, cast(o_orderkey % 10 / 10e0 as double) as weight from {orders}""",
    "connects": "select 'customer_' || cast(o_custkey as string) as entity_id, 'order_' || cast(o_orderkey as string) as edge_id from {orders}",
    "binds": "select distinct 'order_' || cast(l_orderkey as string) as edge_id, 'part_' || cast(l_partkey as string) as entity_id from {lineitem}",
    "node_type": "select * from (values ('concept'), ('person'), ('source'), ('project'), ('insight'), ('question'), ('practice'), ('place'), ('method'), ('tool')) as t(node_type)",
    "edge_kind": """select * from (values ('LEARNED_FROM'), ('INSPIRED_BY'), ('CONFLICTS_WITH'), ('SUPPORTS'), ('PART_OF'), ('PRACTICED_IN'),
        ('ASKED_ABOUT'), ('ANSWERS'), ('IMPLEMENTS'), ('REQUIRES')) as t(edge_kind)""",
    "rel": "select src, dst, edge_type, confidence, evidence from {edge} where edge_type <> 'BOGUS'",
    "community": """select e.src as entity_id, cast(substr(e.dst, 8) as int) as community_id from {edge} e where e.edge_type = 'PART_OF' and e.dst like 'nation_%'""",
    "doc": """select cast(d.doc_id as string) as doc_id, d.text as body, d.lang as title, d.source || '/' || cast(d.doc_id as string) as source_uri,
        case when l.toxic = 1 then 'private' else 'public' end as sensitivity from {documents} d left join {labels} l on d.doc_id = l.doc_id""",
    "vector": "select 'vec_' || cast(vec_id as string) as id, embedding, label as community_id from {embeddings}",
    "asked": "select item_id as query_id, text from {benchmark}",
}


#: Tables that are written before they are used: the graph itself.
STORED = ("entity", "edge")
_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


class Bed:
    """The tables as DataFrames, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}
        bound_tasks(spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in TABLES and name not in BASE):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                self._made[name] = read_table(self.spark, self.sf_dir, name)
            else:
                used = {t: getattr(self, t) for t in re.findall(r"\{(\w+)\}", TABLES[name])}
                made = self.spark.sql(TABLES[name], **used)
                self._made[name] = self._stored(name, made) if name in STORED else made
        return self._made[name]

    def _stored(self, name: str, made: DataFrame) -> DataFrame:
        """The table as written once per application, as a graph's tables are."""
        spread_shuffles(self.spark, self._base_bytes(TABLES["entity"] + TABLES["edge"]))
        stamp = str(sorted(f for t in sorted(set(re.findall(r"\{(\w+)\}", TABLES[name]))) for f in getattr(self, t).inputFiles())) if name not in BASE else ""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name + stamp)
        if key not in _WRITTEN:
            _WRITTEN[key] = materialize(made, f"bed-{name}")
        return _WRITTEN[key]

    def _base_bytes(self, sql: str) -> int:
        """Bytes of the files of the base tables that templates name."""
        tables = [getattr(self, t) for t in sorted(set(re.findall(r"\{(\w+)\}", sql)) & set(BASE))]
        return sum(int(str(t._jdf.queryExecution().analyzed().stats().sizeInBytes())) for t in tables if t.inputFiles())

    @cached_property
    def chunk(self) -> DataFrame:
        from loomgraph.functions.text import chunk_documents

        return chunk_documents(self.doc, "doc_id", "body", uri_col="source_uri", keep=("title", "source_uri", "sensitivity"))

    def _once(self, name: str, make):
        """What a store keeps beside its tables, made once per application and input files."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name + str(sorted(self.documents.inputFiles())))
        if key not in _WRITTEN:
            _WRITTEN[key] = make()
        return _WRITTEN[key]

    @cached_property
    def public_index(self):
        """The text index over public chunks, body and title, without stop words."""
        from loomgraph.functions.words import STOPWORDS
        from loomgraph.operators.retrieval import text_index

        public = self.chunk.where("sensitivity = 'public'")
        return self._once("index", lambda: text_index(public, text_cols=("body", "title"), stopwords=STOPWORDS))

    @cached_property
    def stemmed_index(self):
        from loomgraph.functions.words import STOPWORDS
        from loomgraph.operators.retrieval import text_index

        public = self.chunk.where("sensitivity = 'public'")
        return self._once("stems", lambda: text_index(public, text_cols=("body", "title"), stopwords=STOPWORDS, stemmed=True))

    @cached_property
    def chunk_vectors(self) -> DataFrame:
        """(id, embedding) of public chunks."""
        from loomgraph.operators.retrieval import letter_embed

        public = self.chunk.where("sensitivity = 'public'")
        return self._once("vectors", lambda: materialize(letter_embed(public, "body").select("id", "embedding"), "bed-chunk-vectors"))


#: DuckDB's chunk table; Spark builds its own with the chunking operator.
_SHA = "sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(d.source_uri || ':' || cast(i as string)))"
CHUNK = rf"""select substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as id,
    doc_id, chunk_index, body, title, source_uri, sensitivity from (
    select {_SHA} as h, d.doc_id, cast(i as int) as chunk_index, substr(d.body, i * 800 + 1, 1000) as body, d.title, d.source_uri, d.sensitivity
    from {{doc}} d, unnest(range(cast(ceil(length(d.body) / 800.0) as int))) as r(i) where not regexp_full_match(d.body, '[\s\x0B\x1c-\x1f\x85\pZ]*')) hashed"""


def with_tables(sql: str) -> str:
    """A DuckDB query with the derived tables it names as common table expressions."""
    every = TABLES | {"chunk": CHUNK}
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in every.items():
            if name not in needed and re.search(rf"\b(?:from|join)\s+{name}\b|\{{{name}\}}", text):
                need(body)
                if name not in needed:
                    needed.append(name)

    need(sql)
    tables = [f"{n} as ({re.sub(r'[{](\w+)[}]', r'\1', every[n])})" for n in needed]
    body = sql.strip()
    if not tables:
        return body
    recursive = re.match(r"with\s+(recursive\s+)?", body, re.I)
    if recursive:
        return f"with {recursive[1] or ''}{', '.join(tables)}, {body[recursive.end() :]}"
    return f"with {', '.join(tables)} {body}"

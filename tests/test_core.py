"""Graph, text, resolution and write operators on small fixtures."""

import unicodedata
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import text as tx
from loomgraph.functions import words
from loomgraph.operators import extraction, graph, kernels, resolve, retrieval, writes
from loomgraph.operators.components import connected_components
from loomgraph.operators.ontology import Ontology
from loomgraph.sources.files import html_to_text, scan_vault


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, "SUPPORTS", 1.0, 0.9, "", 1) for a, b in pairs], "src string, dst string, edge_type string, weight double, confidence double, evidence string, created_at long")


def nodes_of(spark, names):
    return spark.createDataFrame([(n, n.upper(), "concept") for n in names], "id string, label string, entity_type string")


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_uuid5(spark):
    assert one(spark, "doc/1:0", tx.uuid5_dns) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "doc/1:0"))


@pytest.mark.parametrize(("label", "slug"), [("", "unknown"), (None, "unknown"), (" Hill's  Pet-Food_ ", "hill_s_pet_food"), ("日本", ""), ("a" * 200, "a" * 128)])
def test_slug(spark, label, slug):
    assert one(spark, label, tx.slugify) == slug


def test_accent_table():
    assert all(unicodedata.normalize("NFKD", a)[0] == p for a, p in zip(words._MARKED, words._BARE, strict=True))


def test_chunk_counts(spark):
    df = spark.createDataFrame([("a", "x" * 2500), ("b", ""), ("c", "  "), ("d", None), ("e", "y" * 801)], "doc_id string, t string")
    got = {r.doc_id: r["count"] for r in tx.chunk_documents(df, "doc_id", "t").groupBy("doc_id").count().collect()}
    assert got == {"a": 4, "e": 2}
    with pytest.raises(ValueError):
        tx.chunk_documents(df, "doc_id", "t", 10, 10)


def test_note_parts(spark):
    note = '---\nTitle: "A: b"\nTags: [#x, y]\n---\nBody [[L|shown]] and [[L]] #in/line a#no'
    row = spark.createDataFrame([(note,)], "t string").select(tx.frontmatter(F.col("t")).alias("f"), tx.note_body(F.col("t")).alias("b"), tx.tags(F.col("t")).alias("g"), tx.wikilinks(F.col("t")).alias("w")).first()
    assert row.f == {"title": ["A: b"], "tags": ["#x", "y"]} and row.b.startswith("Body") and row.g == ["in/line", "x", "y"] and row.w == ["L"]
    assert one(spark, "--- no end", tx.note_body) == "--- no end"


def test_whole_words(spark):
    said = lambda body, s: spark.createDataFrame([(body, s)], "b string, s string").select(tx.mentions_word(F.col("b"), F.col("s")).alias("y")).first().y
    assert said("the AI wins", "ai") and not said("rain", "ai") and not said("éai", "ai") and said("c++ (x)", "c++")


@settings(max_examples=12, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=20))
def test_components_are_the_plain_ones(spark, pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(list(pairs), "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root}


def test_paths(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("d", "a")])
    got = {">".join(r.nodes) for r in graph.paths(e, nodes_of(spark, "a"), nodes_of(spark, "d"), 4).collect()}
    assert got == {"a>b>c>d", "a>c>d"}
    assert [r.node for r in graph.shortest_path(e, "b", "d").orderBy("step").collect()] == ["b", "a", "d"]
    assert graph.shortest_path(e, "b", "zz").count() == 0
    near = {r.id: r.distance for r in graph.neighborhood(edges_of(spark, [("a", "b"), ("b", "c"), ("c", "d")]), nodes_of(spark, "a"), 2).collect()}
    assert near == {"a": 0, "b": 1, "c": 2}


def test_structure(spark):
    star = edges_of(spark, [("m", x) for x in "abcde"])
    best = graph.betweenness(star).orderBy(F.desc("betweenness")).first()
    assert (best.id, best.betweenness) == ("m", 1.0)
    both = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "x"), ("x", "y")])
    assert sorted(map(tuple, graph.bridges(both).collect())) == [("c", "x"), ("x", "y")]
    k = edges_of(spark, [(f"n{i:02}", f"n{j:02}") for i in range(20) for j in range(i)])
    assert graph.skeleton(k, 50).count() == 50 and graph.skeleton(star, 50).count() == 5
    two = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x")])
    members = graph.label_communities(nodes_of(spark, "abcxyz"), two)
    assert members.select("community").distinct().count() == 2 and graph.modularity(members, two) == pytest.approx(0.5)
    joined = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("c", "x"), ("q", "q2")])
    found = {r.id: r.community for r in graph.louvain_communities(nodes_of(spark, ["alone", "q", "q2", *"abcxyz"]), joined).collect()}
    assert found == {**dict.fromkeys("abc", "a"), **dict.fromkeys("xyz", "x"), "q": "q", "q2": "q", "alone": "alone"}
    gaps = graph.community_gaps(members, two, nodes_of(spark, "abcxyz")).collect()
    assert len(gaps) == 1 and gaps[0].severity == "HIGH"


def test_homology():
    ring = np.array([[min(abs(i - j), 6 - abs(i - j)) for j in range(6)] for i in range(6)], float)
    assert kernels.rips(ring)["h1"] == 1 and kernels.rips(np.ones((5, 5)) - np.eye(5))["h1"] == 0
    line = np.abs(np.subtract.outer(np.arange(5.0), np.arange(5.0)))
    assert kernels.rips(line)["h1"] == 0


@pytest.mark.parametrize(
    ("a", "b", "rule"),
    [
        (("Fédération x", "concept"), ("federation X", "concept"), "normalized-equal"),
        (("tin cups", "concept"), ("tin cup", "concept"), "plural"),
        (("NRB", "concept"), ("Northern Rivers Board", "source"), "acronym"),
        (("HSO", "concept"), ("Royal Harbour and Sea Office HSO", "source"), "acronym-subseq"),
        (("Tarn's Clock Works", "source"), ("Tarn's Clock Works Ltd.", "source"), "legal-suffix"),
        (("Ilvane", "concept"), ("Prof. Mara Ilvane", "person"), "surname"),
        (("ttl", "concept"), ("tall trees lane", "concept"), None),
        (("Ilvane", "concept"), ("Mara Ilvane", "place"), None),
        (("glacis", "concept"), ("glaci", "concept"), None),
    ],
)
def test_matchers(spark, a, b, rule):
    keys = resolve.label_keys(spark.createDataFrame([a, b], "label string, entity_type string"))
    pair = spark.createDataFrame([tuple(sorted((a[0], b[0])))], "l string, r string")
    assert [r.rule for r in resolve.matches(pair, keys).collect()] == ([rule] if rule else [])


def test_candidates_hold_every_match(spark):
    """Rule keys meet every pair that a rule joins and that shares a token or an acronym with its initials."""
    from itertools import combinations

    labels = ["common word1", "common word2", "Common Word1", "common words1", "common word1 inc", "word1", "CW", "cw common", "Ann Word1", "Dr Ann Word1", "the", "The", "of the", "Fédé x", "fede X", "fe\u0301de\u0301 x", "ﬁne x", "fine x"]
    rows = [(x, "person" if "Ann" in x else "concept") for x in labels]
    keys = resolve.label_keys(spark.createDataFrame(rows, "label string, entity_type string"))
    pairs = spark.createDataFrame([tuple(sorted(p)) for p in combinations(sorted(set(labels)), 2)], "l string, r string")
    want = {(r.l, r.r) for r in resolve.matches(pairs, keys).collect()}
    known = {r.label: r for r in keys.collect()}
    kept = lambda x: set(known[x].toks) - set(tx.STOPWORDS)
    blocked = {(a, b) for a, b in want if kept(a) & kept(b) or any(known[s].acronym and known[s].norm == known[g].initials for s, g in ((a, b), (b, a)))}
    got = {(r.l, r.r) for r in resolve.matches(resolve.candidates(keys), keys).collect()}
    assert got == blocked and ("fine x", "ﬁne x") in got and len(got) > 8


def test_bcubed(spark):
    make = lambda groups: spark.createDataFrame([(x, str(i)) for i, g in enumerate(groups) for x in g], "item string, cluster string")
    gold = make(["abc", "de"])
    assert tuple(resolve.bcubed(gold, gold).first()) == (1, 1, 1)
    assert tuple(resolve.bcubed(make("abcde"), gold).first()) == (1, 0.4, round(4 / 7, 6))
    assert tuple(resolve.bcubed(make(["abcde"]), gold).first())[:2] == (0.52, 1)


def test_extraction(spark):
    docs = spark.createDataFrame([(i, "Alpha beta gamma") for i in range(4)], "doc_id long, text string")
    parsed = extraction.parse(extraction.as_answers(docs))
    ents = extraction.entities(parsed).collect()
    assert len(ents) == 6 and {e.confidence for e in ents} == {1.0, 0.5} and {e.entity_type for e in ents} == {"person", "concept"}
    assert parsed.where("doc_id = 3").first().error == "unreadable" and extraction.edges(parsed).count() == 3
    assert len(extraction.co_occurrence(docs.withColumn("text", F.lit("Some Words stand Together here"))).first().result.edges) == 2


def test_ontology():
    o = Ontology.from_spec({"entity_types": [{"id": "a"}, {"id": "b"}], "edge_types": [{"id": "E", "direction": "a | zz -> b"}, {"id": "F", "direction": "* -> *"}, {"id": "G", "same_type": True}, {"id": "H", "direction": "zz -> b"}], "aliases": [{"from": "x", "to": "a"}]})
    assert o.grades == {"E": (("a", "b"),), "G": (("a", "a"), ("b", "b"))} and o.aliases == {"x": "a"}


def test_store(spark, tmp_path):
    store = writes.Store(spark, f"file://{tmp_path}")
    store.write("t", nodes_of(spark, "abc"))
    with pytest.raises(ValueError):
        store.write("t", nodes_of(spark, "a"), check=lambda df: df.count() > 1)
    assert store.read("t").count() == 3 and len(store.versions("t")) == 2
    assert writes.migrate(store, {1: lambda s: None, 2: lambda s: None}, 2) == 2
    with pytest.raises(LookupError):
        writes.migrate(store, {}, 3)


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("d", [0.0, 0.0]), ("e", None)], "id string, embedding array<float>")
    got = retrieval.vector_search(v, v.where("id = 'a'").select(F.col("id").alias("query_id"), "embedding"), 2).orderBy("rank").collect()
    assert [r.id for r in got] == ["a", "b"] and got[0].distance == 0
    none = spark.createDataFrame([], "src string, dst string")
    assert [tuple(r)[:2] for r in retrieval.hidden_pairs(v, none, least=0.5).collect()] == [("a", "b")]
    linked = spark.createDataFrame([("b", "a")], "src string, dst string")
    assert retrieval.hidden_pairs(v, linked, least=0.5).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "sub" / "n.md").write_bytes(b"---\ntags: t\n---\nhi \xff [[x]]")
    (tmp_path / ".git" / "no.md").write_text("no")
    row = scan_vault(spark, str(tmp_path)).collect()
    assert [r.relative_path for r in row] == ["sub/n.md"] and row[0].tags == ["t"] and row[0].wikilinks == ["x"]
    pages = spark.createDataFrame([(1, "<p>a<b>b</b></p>"), (2, None)], "id long, html string")
    assert {r.id: r.text for r in html_to_text(pages, "id", "html").collect()} == {1: "a b", 2: ""}


def test_streams(spark, tmp_path):
    from loomgraph.streaming import ingest

    store = writes.Store(spark, f"file://{tmp_path}/store")
    put = lambda rows: spark.createDataFrame(rows, ingest.DOCUMENT).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    put([("a", "x" * 900), ("b", "y" * 100)])
    ingest.ingest_chunks(spark, f"file://{tmp_path}/in", store, f"file://{tmp_path}/cp")
    assert store.read("chunk").count() == 3
    put([("a", "z" * 10), ("b", "")])
    ingest.ingest_chunks(spark, f"file://{tmp_path}/in", store, f"file://{tmp_path}/cp")
    assert [(r.doc_id, len(r.body)) for r in store.read("chunk").collect()] == [("a", 10)]
    ents = [("i", "A", "tool", 0.5), ("i", "B", "tool", 0.9), ("j", "C", "tool", 0.1)]
    spark.createDataFrame(ents, "id string, label string, entity_type string, confidence double").write.parquet(f"file://{tmp_path}/ents")
    ingest.best_entities(spark, f"file://{tmp_path}/ents", store, f"file://{tmp_path}/cp2")
    assert {(r.id, r.label) for r in store.read("entity").collect()} == {("i", "B"), ("j", "C")}


def test_stream_equals_batch(spark, tmp_path):
    from loomgraph.streaming import ingest
    from tests.conftest import SF

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(f"file://{tmp_path}/ev")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/ev")
    q = ingest.daily_counts(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, ingest.daily_counts(events).collect()))


def test_entry_registers_everything():
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 90

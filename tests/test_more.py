"""Kernels against plain versions, identity, text index, stems, search, writes, capture, reports."""

import random
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as tx
from loomgraph.functions import words
from loomgraph.operators import extraction, graph, health, kernels, report, resolve, retrieval, search, writes
from loomgraph.operators.ontology import Ontology
from tests.test_core import edges_of, nodes_of


def random_pairs(rng, n, m):
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


def adjacency(n, pairs):
    return kernels.Adjacency(n, np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int))


def parts(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return len({find(x) for x in range(n)})


def test_bridges_are_those_whose_removal_parts():
    rng = random.Random(4)
    for _ in range(40):
        n = rng.randint(2, 12)
        pairs = random_pairs(rng, n, rng.randint(1, 14))
        want = [i for i in range(len(pairs)) if parts(n, pairs[:i] + pairs[i + 1 :]) > parts(n, pairs)]
        assert kernels.bridges(adjacency(n, pairs)).tolist() == want


def test_dependencies_count_all_shortest_paths():
    rng = random.Random(5)
    n = 9
    pairs = random_pairs(rng, n, 14)
    near = {x: [b if a == x else a for a, b in pairs if x in (a, b)] for x in range(n)}

    def paths(s, t):
        todo, found = [[s]], []
        while todo and not found:
            found = [p for p in todo if p[-1] == t]
            todo = [[*p, w] for p in todo for w in near[p[-1]] if w not in p]
        return found if s != t else []

    nodes, edges = Counter(), Counter()
    for s in range(n):
        for t in range(n):
            ways = paths(s, t)
            for p in ways:
                for x in p[1:-1]:
                    nodes[x] += 1 / len(ways)
                for e in zip(p, p[1:]):
                    edges[tuple(sorted(e))] += 1 / len(ways)
    got = kernels.dependencies(adjacency(n, pairs), np.arange(n))
    assert np.allclose(got, [nodes[x] for x in range(n)])
    got = kernels.dependencies(adjacency(n, pairs), np.arange(n), on_edges=True)
    assert np.allclose(got, [edges[p] for p in pairs])


def plain_rips(d):
    """H1 classes by reducing the whole boundary matrix."""
    n = len(d)
    edges = sorted((d[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    number = {e[1:]: k for k, e in enumerate(edges)}
    triangles = sorted((max(d[i, j], d[i, k], d[j, k]), i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n))
    low, out = {}, []
    for length, i, j, k in triangles:
        column = {number[i, j], number[i, k], number[j, k]}
        while column and max(column) in low:
            column ^= low[max(column)]
        if column:
            low[max(column)] = column
            if length > edges[max(column)][0]:
                out.append((float(edges[max(column)][0]), float(length)))
    return sorted(out)


def test_homology_is_the_plain_one():
    rng = np.random.default_rng(6)
    for _ in range(25):
        n = int(rng.integers(3, 10))
        m = rng.choice([rng.random((n, n)), rng.integers(1, 5, (n, n)) / 2])
        m = (m + m.T) / 2
        np.fill_diagonal(m, 0)
        got = kernels.rips(m, persistent=-1)
        assert got["h1"] == len(plain_rips(m)) and sorted(got["persistent"]) == sorted(sorted(plain_rips(m), key=lambda c: (c[0] - c[1], c))[:10])
    d = np.random.default_rng(1).random((500, 2))
    assert kernels.rips(np.hypot(*(d[:, None] - d).transpose(2, 0, 1)))["h0"] == 500


def test_louvain_gains_on_label_propagation(spark):
    rng = random.Random(7)
    pairs = [(f"g{g}n{a}", f"g{g}n{b}") for g in range(4) for a in range(8) for b in range(a) if rng.random() < 0.6] + [(f"g{g}n0", f"g{(g + 1) % 4}n0") for g in range(4)]
    edges = edges_of(spark, pairs)
    nodes = nodes_of(spark, sorted({x for p in pairs for x in p}))
    best, other = graph.louvain_communities(nodes, edges), graph.label_communities(nodes, edges)
    assert graph.modularity(best, edges) >= graph.modularity(other, edges) - 1e-9
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, graph.louvain_communities(nodes, edges.repartition(5)).collect()))


def test_chunk_ids_and_blanks(spark):
    docs = spark.createDataFrame([("a", "x" * 2500, "u/1"), ("b", "\n\t \u3000\u00a0", "u/2"), ("c", "", "u/3"), ("d", None, "u/4")], "doc_id string, text string, uri string")
    got = {(r.doc_id, r.chunk_index): r.id for r in tx.chunk_documents(docs, "doc_id", "text", uri_col="uri").collect()}
    assert got == {("a", i): str(uuid.uuid5(uuid.NAMESPACE_DNS, f"u/1:{i}")) for i in range(4)}


def test_normal_forms(spark):
    given = ["Fe\u0301de\u0301ration", "Việt Nam", "ＦＵＬＬ", "ﬁne", "O'Neil & Co."]
    rows = spark.createDataFrame([(x,) for x in given], "t string").select("t", tx.normalize_label(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == ["federation", "viet nam", "full", "fine", "oneil co"]


def test_stems():
    pairs = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop",
        "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "digitizer": "digit", "triplicate": "triplic", "hopefulness": "hope",
        "goodness": "good", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll", "is": "is",
    }
    assert {w: words.porter(w) for w in pairs} == pairs


def test_index_folds_and_stems(spark):
    chunks = spark.createDataFrame([("1", "Élève straße hopping", "Title one"), ("2", "the cats", "two"), ("3", "", "hop")], "id string, body string, title string")
    asked = spark.createDataFrame([(1, "eleve"), (2, "HOPS the"), (3, "title")], "query_id long, text string")
    plain = retrieval.text_index(chunks, text_cols=("body", "title"), stopwords=words.STOPWORDS)
    assert [(r.query_id, r.id) for r in retrieval.bm25(plain, asked).collect()] == [(1, "1"), (3, "1")]
    stems = retrieval.text_index(chunks, text_cols=("body", "title"), stopwords=words.STOPWORDS, stemmed=True)
    assert {(r.query_id, r.id) for r in retrieval.bm25(stems, asked).collect()} == {(1, "1"), (2, "1"), (2, "3"), (3, "1")}
    only = retrieval.bm25(stems, asked, among=spark.createDataFrame([("3",)], "id string")).collect()
    assert [(r.query_id, r.id, r["rank"]) for r in only] == [(2, "3", 1)]


def test_cells_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    data = [(f"v{i}", (centres[i % 20] + 0.4 * rng.normal(size=16)).tolist()) for i in range(1500)]
    v = spark.createDataFrame(data, "id string, embedding array<double>")
    asked = v.where("id like '%7'").select(F.col("id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.id) for r in retrieval.vector_search(v, asked, 10).collect()}
    near = {(r.query_id, r.id) for r in retrieval.near_cells(retrieval.vector_cells(v, cells=24), asked, 10, probes=6).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_task_wide_best(spark):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, rng.normal(size=4).round(1).tolist()) for i in range(3000)], "id long, embedding array<double>").repartition(3)
    asked = v.where("id < 20").select(F.col("id").alias("query_id"), "embedding")
    rough = retrieval.similarities(v, asked, k=3)
    assert rough.count() < 20 * 3 * 40
    every = retrieval.top_by(retrieval.similarities(v, asked, least=-1.1), "similarity", 3)
    assert sorted(map(tuple, retrieval.top_by(rough, "similarity", 3).collect())) == sorted(map(tuple, every.collect()))


def test_search_modes(spark):
    entities = spark.createDataFrame([("a", "Red apple", "tool", "", 0.9), ("b", "Red pear", "tool", "", 0.8), ("c", "Zzz", "place", "", 0.1)], "id string, label string, entity_type string, description string, confidence double")
    chunks = spark.createDataFrame([("1", "red apple pie"), ("2", "nothing here")], "id string, body string")
    engine = search.Searcher(entities, edges_of(spark, [("a", "c")]), chunks, retrieval.text_index(chunks), retrieval.letter_embed(chunks, "body"), retrieval.letter_embed)
    asked = spark.createDataFrame([(7, "red"), (8, "red apple")], "query_id long, text string")
    got = {m: {(r.query_id, r.id) for r in engine.search(asked, m, limit=2).collect()} for m in search.MODES}
    assert got["keyword"] == {(7, "a"), (7, "b"), (8, "a")} and (8, "a") in got["semantic"] and (8, "a") in got["hybrid"]
    assert (8, "b") in got["hidden"] and (8, "1") in got["chunks"]
    assert engine.search(asked, "keyword", kind="place").count() == 0
    assert [r.nodes for r in engine.path("apple", "Zzz").collect()] == [["a", "c"]]
    with pytest.raises(ValueError):
        engine.search(asked, "other")


def test_verify_paths(spark):
    rows = [("a", "b", "SUPPORTS", "long evidence here"), ("c", "b", "CONFLICTS_WITH", "x"), ("a", "c", "PART_OF", "long evidence here")]
    edges = spark.createDataFrame([(*r[:3], 0.5, 0.5, r[3], 0) for r in rows], "src string, dst string, edge_type string, weight double, confidence double, evidence string, created_at long")
    got = {tuple(r.nodes): (r.contradictions, r.supports, r.verified) for r in graph.verify_paths(edges, nodes_of(spark, "a"), nodes_of(spark, "b")).collect()}
    assert got == {("a", "b"): (0, 1, True), ("a", "c", "b"): (2, 0, False)}
    assert graph.verify_paths(edges, nodes_of(spark, "a"), nodes_of(spark, "b"), top=1).count() == 1


def gold(spark):
    """An own gold set: clusters of names as people write them."""
    groups = [
        ["Harbour Light Society", "harbour light society", "Harbour Light Societies", "HLS"], ["Ostrava Mill Ltd", "Ostrava Mill"], ["Dr Ilse Quandt", "Ilse Quandt", "Quandt"], ["copper kettle", "copper kettles"],
        ["Fédération du Lac", "Federation du Lac"], ["tidal wheel"], ["National Rope Bureau", "NRB"], ["Pelle Gast", "Gast"], ["salt marsh", "salt-marsh"], ["winter rye"], ["spring rye"], ["Lac Blanc"], ["river gate", "rivergate"],
    ]
    people = {"Dr Ilse Quandt", "Ilse Quandt", "Pelle Gast"}
    return spark.createDataFrame([(x, "person" if x in people else "concept", str(i)) for i, g in enumerate(groups) for x in g], "label string, entity_type string, g string")


def test_resolution_gate(spark):
    given = gold(spark)
    keys = resolve.label_keys(given)
    found = resolve.clusters(keys, resolve.matches(resolve.candidates(keys), keys))
    score = resolve.bcubed(found.select(F.col("label").alias("item"), F.col("canonical").alias("cluster")), given.select(F.col("label").alias("item"), F.col("g").alias("cluster"))).first()
    assert score.precision == 1.0 and score.f1 >= 0.80
    order = resolve.cluster_order(found).orderBy("place").collect()
    assert [r["size"] for r in order] == sorted((r["size"] for r in order), reverse=True)
    assert tuple(resolve.fold_counts(found).first()) == (25, len(order), 25 - len(order))


def store_of(spark, path):
    store = writes.Store(spark, f"file://{path}")
    rows = [("a", "Ink Pot", "tool", "", 0.9, "llm", [1.0]), ("b", "Ink Pots", "tool", "longer", 0.5, "llm", [2.0]), ("c", "Quay", "place", "", 0.4, "llm", None)]
    store.write("entity", spark.createDataFrame(rows, "id string, label string, entity_type string, description string, confidence double, provenance string, embedding array<double>"))
    store.write("edge", spark.createDataFrame([("a", "c", "PART_OF", 0.5, "e"), ("b", "c", "PART_OF", 0.9, "f"), ("a", "b", "SUPPORTS", 0.1, "g")], "src string, dst string, edge_type string, confidence double, evidence string"))
    store.write("mention", spark.createDataFrame([("a", "d1", 0.2, "s"), ("b", "d1", 0.8, "t"), ("c", "d2", 0.1, "s")], "entity_id string, doc_id string, confidence double, source_url string"))
    return store


def test_merge_and_rebuild(spark, tmp_path):
    store = store_of(spark, tmp_path / "one")
    canonical = spark.createDataFrame([("Ink Pot", "Ink Pots"), ("Ink Pots", "Ink Pots"), ("Quay", "Quay")], "label string, canonical string")
    target = writes.Store(spark, f"file://{tmp_path}/two")
    assert writes.merge_live(store, target, canonical) == {"entity": 2, "edge": 1, "mention": 2}
    assert {(r.id, None if r.embedding is None else tuple(r.embedding)) for r in target.read("entity").collect()} == {("ink_pots", (2.0,)), ("quay", None)}
    assert tuple(target.read("edge").select("src", "dst", "confidence").first()) == ("ink_pots", "quay", 0.9)
    assert {(r.entity_id, r.confidence) for r in target.read("mention").collect()} == {("ink_pots", 0.8), ("quay", 0.1)}
    with pytest.raises(FileExistsError):
        writes.merge_live(store, target, canonical)
    three = writes.Store(spark, f"file://{tmp_path}/three")
    counts = writes.rebuild(store, three, nodes_of(spark, "b"), {"edge": ("src", "dst"), "mention": ("entity_id",)})
    assert counts == {"entity": 2, "edge": 1, "mention": 2} and store.read("entity").count() == 3
    with pytest.raises(FileExistsError):
        writes.rebuild(store, three, nodes_of(spark, "b"), {})


def test_small_writes(spark):
    stored = spark.createDataFrame([("1", "a", "u", "t", "old", 0, '["z"]', None, "public")], writes.CHUNK_COLUMNS)
    docs = spark.createDataFrame([("a", "u/a", "T", "new text", "public"), ("b", "u/b", "T", "\n", "public")], "doc_id string, source_uri string, title string, text string, sensitivity string")
    made = writes.ingest_document_chunks(stored, docs, retrieval.letter_embed).collect()
    assert [(r.doc_id, r.body, r.title, len(r.embedding)) for r in made] == [("a", "new text", "T", 26)]
    assert writes.ingest_document_chunks(stored, docs).first().embedding is None
    left, gone = writes.delete_by_doc(stored, docs)
    assert (left.count(), gone) == (0, 1)
    ids = spark.createDataFrame([("1", ["b", "a", "b"])], "id string, entity_ids array<string>")
    assert writes.set_entity_ids(stored, ids).first().entity_ids == '["a","b"]'
    back = spark.createDataFrame([('["a"]',), ("no",), (None,)], "t string").select(writes.entity_ids_array(F.col("t")).alias("x")).collect()
    assert [r.x for r in back] == [["a"], [], []]
    with pytest.raises(Exception, match="numbers"):
        writes.set_embedding(stored.select("id", "embedding"), spark.createDataFrame([("1", [1.0])], "id string, embedding array<double>"), 3).collect()
    safe = writes.safe_to_delete(nodes_of(spark, "ab"), edges_of(spark, [("a", "x")]), spark.createDataFrame([], "entity_id string"))
    assert {(r.id, r.safe) for r in safe.collect()} == {("a", False), ("b", True)}


def test_extractors(spark):
    docs = spark.createDataFrame([(1, "a text that is long enough to ask about"), (2, "short"), (3, "a text that makes the model fail now")], "doc_id long, text string")

    def ask(prompt):
        if "fail" in prompt:
            raise RuntimeError("down")
        return '{"entities": [{"name": "Long Text", "type": "Author"}], "edges": []}' if "Entity types:" in prompt else ""

    rows = {r.doc_id: r for r in extraction.answers_extractor(ask)(docs).collect()}
    assert set(rows) == {1, 3} and rows[1].error is None and rows[3].error == "RuntimeError: down" and rows[3].result.entities == []
    named = extraction.canonical_types(extraction.entities(extraction.answers_extractor(ask)(docs)), Ontology()).collect()
    assert [(r.id, r.entity_type) for r in named] == [("long_text", "person")]
    assert "ANSWERS: any -> question" in extraction.prompt_fragment(Ontology())
    notes = spark.createDataFrame([("n", "N", ["t"], ["W"])], "doc_id string, title string, tags array<string>, wikilinks array<string>")
    found, edges = extraction.note_graph(notes)
    assert found.count() == 3 and {(r.src, r.confidence) for r in edges.collect()} == {("note_n", 0.8), ("note_n", 0.9)}


def test_orphans_are_connected(spark):
    entities = spark.createDataFrame([(x, "d") for x in "abc"] + [("z", "e")], "id string, source_url string")

    def ask(groups):
        out = groups.select("source_url", F.explode(F.array(*[F.struct(F.lit(s).alias("src"), F.lit(d).alias("dst"), F.lit(k).alias("edge_type")) for s, d, k in (("c", "a", "SUPPORTS"), ("a", "b", "SUPPORTS"), ("c", "z", "SUPPORTS"), ("c", "a", "ODD"))])).alias("e"))
        return out.select("source_url", "e.*", F.lit("said").alias("evidence"))

    got = extraction.connect_orphans(entities, edges_of(spark, [("a", "b")]), ask, Ontology()).collect()
    assert [(r.src, r.dst, r.edge_type, r.confidence, r.provenance) for r in got] == [("c", "a", "SUPPORTS", 0.6, "orphan_connect")]


def test_thoughts_are_captured(spark, tmp_path):
    from loomgraph.streaming import capture

    store = writes.Store(spark, f"file://{tmp_path}/store")
    thoughts = spark.createDataFrame([("Some Words about Rivers and Rivers", ["x"]), ("Rivers again with Bridges here", None)], "text string, tags array<string>")
    thoughts.write.parquet(f"file://{tmp_path}/in")
    seen = []
    capture.capture_stream(spark, f"file://{tmp_path}/in", store, f"file://{tmp_path}/cp", each=lambda hidden: seen.append(hidden.columns))
    labels = {r.label for r in store.read("entity").collect()}
    assert {"Words", "Rivers", "Bridges"} <= labels and store.read("edge").count() >= 2 and seen == [["a", "b", "similarity"]]
    chunks = store.read("chunk").collect()
    assert len(chunks) == 2 and any("rivers" in r.entity_ids for r in chunks) and all(r.embedding for r in chunks)
    before = (store.read("entity").count(), store.read("chunk").count())
    capture.capture(store, thoughts)
    assert (store.read("entity").count(), store.read("chunk").count()) == before


def test_reports(spark, tmp_path):
    nodes = spark.createDataFrame([(x, f"Node {x}", "tool", 1000) for x in "abcxyzq"], "id string, label string, entity_type string, created_at long")
    edges = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("c", "x")])
    top = report.Topology(nodes, edges.withColumn("edge_type", F.when(F.col("src") == "c", "CONFLICTS_WITH").otherwise("SUPPORTS")))
    got = {(r.section, r.item): r.value for r in top.rows().collect()}
    assert got["components", "count"] == 2 and got["components", "isolated"] == 1 and got["bridges", "count"] == 1 and got["contradictions", "count"] == 2 and got["communities", "count"] == 3
    hidden = spark.createDataFrame([("a", "z", 0.8)], "a string, b string, similarity double")
    rows = report.briefing(top, hidden, nodes_of(spark, "a"), now=1000 + 100 * 86_400)
    said = report.to_markdown(rows, "Daily reflection")
    for part in ("Conflicting beliefs", "Hidden connections", "Node a ~ Node z, distance 0.200", "Underdeveloped ideas", "- Node q (tool)", "- bridges count: 1"):
        assert part in said
    report.write_text(spark, said, f"file://{tmp_path}/day.md")
    assert (tmp_path / "day.md").read_text() == said
    report.write_json(rows, f"file://{tmp_path}/rows")
    assert spark.read.json(f"file://{tmp_path}/rows").count() == rows.count()


def test_poll(spark):
    log = spark.createDataFrame([("x", "2024-01-01 00:00:00")], "type string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    checks, code = health.poll(nodes_of(spark, "ab"), edges_of(spark, [("a", "b")]), log, F.col("type") == "rejected", log, F.lit("2024-01-02 12:00:00").cast("timestamp"))
    assert {r.check: r.status for r in checks.collect()} == {"orphans": "ok", "connected": "ok", "rejections": "ok", "enrichment": "warning", "queue": "ok"} and code == 1

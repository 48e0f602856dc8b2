"""What an operator hands on or shuffles grows no faster than it must."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from loomgraph import session
from loomgraph.operators import extraction, graph, kernels, resolve, retrieval
from loomgraph.plans import catalog
from loomgraph.plans.testbed import Bed


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_counts_terms_where_texts_stand(spark, monkeypatch):
    written = []
    real = retrieval.materialize
    monkeypatch.setattr(retrieval, "materialize", lambda df, label: (written.append(plan_of(df)), real(df, label))[1])
    chunks = spark.createDataFrame([("1", "hop hop cat"), ("2", "")], "id string, body string")
    for stemmed in (False, True):
        index = retrieval.text_index(chunks, stemmed=stemmed)
        assert (index.count, index.mean) == (2, 1.5)
    assert written and not any("Exchange" in plan for plan in written)


def test_bm25_tasks_hand_on_their_best_only(spark, monkeypatch):
    """Many texts with one term: a task's k best of each query go on, not a row for each text and query."""
    given = []
    real = retrieval.top_by
    monkeypatch.setattr(retrieval, "top_by", lambda df, *a, **k: (given.append(df), real(df, *a, **k))[1])
    chunks = spark.range(6000).select(F.format_string("%05d", "id").alias("id"), F.lit("apple").alias("body")).repartition(3)
    asked = spark.createDataFrame([(q, "apple pear") for q in range(1100)], "query_id long, text string")  # more than a slice
    found = retrieval.bm25(retrieval.text_index(chunks), asked, k=2)
    assert found.groupBy("id").count().orderBy("id").collect() == [("00000", 1100), ("00001", 1100)]
    assert given[0].count() <= 1100 * 2 * 64


def test_equal_vectors_do_not_pile_up(spark):
    v = spark.range(30_000).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding")).repartition(2)
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<double>")
    assert retrieval.similarities(v, asked, k=3).count() <= 3 * 16
    assert [r.id for r in retrieval.vector_search(v, asked, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_chunks_keep_their_documents_columns_without_a_join(spark):
    bed = Bed(spark, "")
    bed._made["doc"] = spark.createDataFrame([("1", "text", "en", "a/1", "public")], "doc_id string, body string, title string, source_uri string, sensitivity string")
    assert "Join" not in plan_of(bed.chunk)
    assert bed.chunk.select("doc_id", "body", "title", "source_uri", "sensitivity").collect() == [("1", "text", "en", "a/1", "public")]


def test_no_component_is_too_large_for_its_kernel(spark, monkeypatch):
    monkeypatch.setattr(graph, "KERNEL_EDGES", 3, raising=False)
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "x"), ("x", "y"), ("y", "z"), ("z", "x")]
    edges = spark.createDataFrame([(a, b, "T", 1.0, 0) for a, b in pairs], "src string, dst string, edge_type string, weight double, created_at long")
    assert graph.bridges(edges).collect() == [("c", "x")]
    found = {r.id: r.community for r in graph.louvain_communities(spark.createDataFrame([(x,) for x in "abcxyz"], "id string"), edges).collect()}
    assert found == dict.fromkeys("abc", "a") | dict.fromkeys("xyz", "x")
    best = {r.id: r.betweenness for r in graph.betweenness(edges).collect()}
    assert best == {"c": 0.6, "x": 0.6, "a": 0.0, "b": 0.0, "y": 0.0, "z": 0.0}
    assert graph.skeleton(edges, 1).select("a", "b").collect() == [("c", "x")]


def test_kernels_in_slices(monkeypatch):
    rng = np.random.default_rng(6)
    a, b = np.triu_indices(40, 1)
    kept = rng.random(len(a)) < 0.06
    a, b = a[kept], b[kept]
    whole = kernels.Adjacency(40, a, b)
    want = kernels.bridges(whole), kernels.dependencies(whole, np.arange(40)), kernels.louvain(40, a, b, np.ones(len(a)), float(len(a)))
    monkeypatch.setattr(kernels, "SLICE", 5)
    monkeypatch.setattr(kernels, "LISTED", 7)
    got = kernels.bridges(whole), kernels.dependencies(whole, np.arange(40)), kernels.louvain(40, a, b, np.ones(len(a)), float(len(a)))
    assert len(want[0]) and all(np.allclose(x, y) for x, y in zip(want, got))


def shuffled(spark, df) -> int:
    """Rows that the plan of a table writes to shuffles."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    total, rest = 0, [df._jdf.queryExecution().executedPlan()]
    while rest:
        node = rest.pop()
        if node.nodeName() == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        rest += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_document_links_shuffle_rows_not_pairs(spark):
    rows = [(f"d{i % 2}", f"m{i:03}", f"m{i:03}", 0.5, "source") for i in range(100)] + [(f"d{i % 2}", f"p{i:03}", f"p{i // 4:03}", 0.5, "tool") for i in range(400)]
    rows += [("d0", "a", "both", 0.7, "source"), ("d1", "b", "both", 0.9, "source"), ("d1", "m", "m001", 0.8, "source"), ("d1", "l", "m001", 0.6, "source"), ("d1", "lz", "both", 0.1, "tool")]
    want: dict = {}
    for d, label, src, sure, kind in rows:
        for e, later, dst, _, _ in rows:
            if kind == "source" and d == e and label < later and src != dst:
                want[src, dst] = max(sure, want.get((src, dst), 0))
    said = spark.createDataFrame(rows, "doc_id string, label string, new_id string, confidence double, entity_type string")
    found = resolve.document_links(said, F.col("entity_type") == "source")
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) > 10_000 and {(a, b): c for a, b, c in got} == want
    assert shuffled(spark, found) < 5 * len(rows)


def test_apply_resolution_makes_no_table_of_pairs(spark):
    from tests.conftest import SF

    assert shuffled(spark, catalog.queries()["apply_resolution"](spark, SF)) < 3000


def test_joins_with_entities_are_merge_joins(spark):
    """The entities grow with the graph; what is broadcast is built on the driver and held by every task."""
    from tests.conftest import SF

    plans = catalog.queries()
    for name in ("orphan_edges", "conflict_expand", "upsert_edges", "resolve_triplets", "insights_with_sources", "conflicting_beliefs", "grade_violations", "components"):
        plan = plan_of(plans[name](spark, SF))
        wide = [line for line in plan.split("\n") if "BroadcastHashJoin" in line and "edge_type" not in line]  # the table of allowed pairs is one of fixed size
        assert not wide, name


def test_more_rows_make_more_tasks(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(k) for k in keys]
    for given, most in (("1g", [session.SCAN_BYTES, session.SHUFFLE_BYTES]), ("8m", None)):
        for k in keys:
            spark.conf.set(k, given)
        Bed(spark, "")
        assert [spark.conf.get(k) for k in keys] == ([str(x) for x in most] if most else ["8m", "8m"])
    for k, v in zip(keys, before):
        spark.conf.set(k, v)


def test_shortest_path_shuffles_fronts_not_edges(spark, monkeypatch):
    rows = []
    real = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: (rows.append(shuffled(spark, df)), real(df, label))[1])
    pairs = [("s", "a"), ("b", "s"), ("a", "z"), ("b", "c"), ("c", "t"), ("z", "t"), ("a", "c"), ("t", "t")] + [(f"x{i}", f"y{j}") for i in range(50) for j in range(60)]
    edges = spark.createDataFrame([(a, b, "T", 1.0, 0) for a, b in pairs], "src string, dst string, edge_type string, weight double, created_at long")
    walk = lambda a, b, hops=4: [r.node for r in graph.shortest_path(edges, a, b, hops).orderBy("step").collect()]
    assert walk("s", "t") == ["s", "a", "c", "t"] and walk("t", "s") == ["t", "c", "a", "s"]
    assert walk("s", "t", 2) == walk("s", "x0") == walk("s", "nowhere") == []
    assert walk("s", "s") == ["s"] and walk("x0", "x1") == ["x0", "y0", "x1"] and walk("x9", "y9") == ["x9", "y9"]
    assert max(rows) < 300
    monkeypatch.setattr(graph, "FRONT", 0)
    assert walk("s", "t") == ["s", "a", "c", "t"]


def test_vector_search_holds_a_bounded_slice(spark, monkeypatch):
    sizes = []
    real = retrieval._scan
    monkeypatch.setattr(retrieval, "_scan", lambda block, k, least: (sizes.append(len(block.value[0]) * k), real(block, k, least))[1])
    v = spark.range(400).select("id", F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 3)).alias("embedding"))
    asked = v.withColumnRenamed("id", "query_id")
    rows = lambda: sorted(map(tuple, retrieval.vector_search(v, asked, 5).collect()))
    whole = rows()
    monkeypatch.setattr(retrieval, "KEPT", 500)
    assert whole == rows() and len(whole) == 2000
    assert sizes[0] == 2000 and sum(sizes[1:]) == 2000 and max(sizes[1:]) <= 1000


def test_an_answer_is_read_once(spark):
    docs = spark.createDataFrame([(i, "one two three") for i in range(4)], "doc_id long, text string")
    made = extraction.entities(extraction.parse(extraction.as_answers(docs)))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 8  # once for each column that a pushed filter or a projection copies
    assert sorted((r.doc_id, r.label) for r in made.collect()) == [(i, w) for i in range(3) for w in ("one", "two")]


def test_components_rounds_take_numbers(spark, monkeypatch):
    given = []
    real = graph.connected_components
    monkeypatch.setattr(graph, "connected_components", lambda df, *a: (given.append(df), real(df, *a))[1])
    edges = spark.createDataFrame([("b", "c"), ("c", "a9"), ("d", "nowhere"), (None, "a9")], "src string, dst string")
    found = graph.components(spark.createDataFrame([(x,) for x in ("a9", "a10", "b", "c", "d", "d", None)], "id string"), edges)
    assert {tuple(r) for r in found.collect()} == {("a9", "a9"), ("a10", "a10"), ("b", "a9"), ("c", "a9"), ("d", "d"), (None, None)}
    assert {kind for _, kind in given[0].dtypes} == {"int"}


def test_label_keys_are_made_once(spark):
    labels = spark.createDataFrame([("Acme", "source"), ("Acme Inc", "source")], "label string, entity_type string")
    assert len(resolve.label_keys(labels).inputFiles())


def test_hidden_pairs_leave_links_where_they_stand(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [1.0, 0.2])], "id string, embedding array<double>")
    links = spark.createDataFrame([("b", "a")] * 3, "src string, dst string")
    found = retrieval.hidden_pairs(v, links, least=0.5)
    assert [(r.a, r.b) for r in found.orderBy("a", "b").collect()] == [("a", "c"), ("b", "c")]
    assert "LeftSemi, BuildRight" in plan_of(found)


def test_entities_are_embedded_once(spark):
    from loomgraph.operators.search import Searcher

    made = []
    embed = lambda df, c: (made.append(c), retrieval.letter_embed(df, c))[1]
    entities = spark.createDataFrame([("1", "apple", "", 1.0, "x"), ("2", "apples", "", 0.5, "x")], "id string, label string, description string, confidence double, entity_type string")
    edges = spark.createDataFrame([("1", "3")], "src string, dst string")
    engine = Searcher(entities, edges, None, None, None, embed)
    asked = spark.createDataFrame([(1, "apple")], "query_id int, text string")
    assert [r.id for r in engine.search(asked, "hidden").collect()] == ["2"]
    assert [r.id for r in engine.search(asked, "hybrid").orderBy("rank").collect()] == ["1", "2"]
    assert made.count("_said") == 1


def test_unit_sums_the_norm_once(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>").select(retrieval.unit("v").alias("u"))
    assert [r.u for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    assert "lambdafunction(CASE WHEN (SQRT" not in plan_of(df)


def test_louvain_is_the_same_from_files(monkeypatch):
    """Edges that stand in files, sorted and contracted in many parts, give the communities that they give in memory."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 200, 900), rng.integers(0, 200, 900)
    a, b = a[a != b], b[a != b]
    weight = rng.integers(1, 10, len(a)) / 10
    found = kernels.louvain(200, a, b, weight, weight.sum())
    for name, value in {"HELD": 64, "LISTED": 16, "SORTED": 40, "DENSE": 5, "SLICE": 50}.items():
        monkeypatch.setattr(kernels, name, value)
    held = []
    real = kernels.Stored.read
    monkeypatch.setattr(kernels.Stored, "read", lambda s, a, b: (held.append(b - a), real(s, a, b))[1])
    assert kernels.louvain(200, a, b, weight, weight.sum()).tolist() == found.tolist()
    assert max(held) < len(a)


def test_louvain_takes_edges_in_packs(spark, monkeypatch):
    monkeypatch.setattr(graph, "PACKED", 2)
    pairs = [(f"{c}{i}", f"{c}{j}") for c in "xyz" for i in range(5) for j in range(i)] + [("x0", "y0")]
    edges = spark.createDataFrame([(a, b, "T", 1.0, 0) for a, b in pairs], "src string, dst string, edge_type string, weight double, created_at long")
    found = graph.louvain_communities(spark.createDataFrame([(f"{c}{i}",) for c in "xyzw" for i in range(5)], "id string"), edges).collect()
    assert {r.id: r.community for r in found} == {f"{c}{i}": f"{c}0" if c != "w" else f"w{i}" for c in "xyzw" for i in range(5)}


def test_shuffles_of_the_graph_begin_with_partitions_in_proportion(spark, monkeypatch):
    """With as few partitions as the session has, what a task holds in making the graph grows with the tables."""
    from loomgraph.plans import testbed
    from tests.conftest import SF

    key, plans, real = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", [], testbed.materialize
    before = spark.conf.get(key, None)
    monkeypatch.setattr(session, "SPREAD_BYTES", 1000, raising=False)
    monkeypatch.setattr(testbed, "_WRITTEN", {})
    monkeypatch.setattr(testbed, "materialize", lambda df, label: (plans.append(plan_of(df)), real(df, label))[1])
    try:
        assert Bed(spark, SF).edge.count()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    found = [int(n) for plan in plans for n in re.findall(r"hashpartitioning\(l_partkey#\d+L?, l_suppkey#\d+L?, (\d+)\)", plan)]
    assert found and min(found) > int(spark.conf.get("spark.sql.shuffle.partitions")) and min(found) > 40


def test_skeleton_holds_no_edges_on_the_driver(spark, monkeypatch):
    """Edges go to a file that executors fetch, and tasks hand on a row for each edge, however many sources there are."""
    rng = np.random.default_rng(11)
    a, b = np.triu_indices(90, 1)
    kept = rng.random(len(a)) < 0.08
    a, b = a[kept], b[kept]
    whole = kernels.Adjacency(90, a, b)
    score = kernels.dependencies(whole, np.arange(90), on_edges=True)
    want = sorted(zip(-np.round(score, 6), a.tolist(), b.tolist()))[:40]
    edges = spark.createDataFrame([(f"{x:02}", f"{y:02}", "T", 1.0, 0) for x, y in zip(a.tolist(), b.tolist())], "src string, dst string, edge_type string, weight double, created_at long")
    rows, real = [], DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda df: (rows.append(df.count()), real(df))[1])
    monkeypatch.setattr(kernels, "SLICE", 50)
    monkeypatch.setattr(graph, "PACKED", 16)
    got = sorted((r.a, r.b) for r in graph.skeleton(edges, 40).collect())
    assert got == sorted((f"{x:02}", f"{y:02}") for _, x, y in want)
    assert sum(rows) == 0

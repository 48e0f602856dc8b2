"""Betweenness counts edges of every type."""

from types import SimpleNamespace

from loomgraph.plans import catalog


def test_betweenness_takes_every_edge_type(spark):
    catalog.queries()
    kinds = ("SUPPORTS", "IMPLEMENTS", "PART_OF", "REQUIRES")
    edges = spark.createDataFrame([(x, "m", kind, 0.5, 0.5, "", 0) for x, kind in zip("abcd", kinds)], "src string, dst string, edge_type string, weight double, confidence double, evidence string, created_at long")
    bed = SimpleNamespace(edge=edges, entity=spark.createDataFrame([(x,) for x in "abcdm"], "id string"))
    best = catalog._PLANS["betweenness"](bed).first()
    assert (best.id, best.betweenness, best.degree) == ("m", 1.0, 4)

"""The pipeline, stage by stage, against plain versions on one machine."""

import zlib
from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from loomgraph.llm import resampling, toxicity
from loomgraph.session import materialize, read_table
from tests.conftest import SF
from tests.llm.test_documents import check_places
from tests.llm.test_neardup import plain_survivors


def test_stages(spark):
    docs = docs_all = read_table(spark, SF, "documents")
    labels = {r.doc_id: r for r in read_table(spark, SF, "labels").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id for r in docs.collect()})

    # quality: all counts in one place, then the k highest perturbed weights
    good = sorted((0, d) for d in texts if d in labels and labels[d].quality == 1)
    assert len(good) <= resampling.TARGET_ROWS
    aside = {r[0] for r in docs_all.select("doc_id").where(F.pmod(F.xxhash64("doc_id", F.lit(resampling.SEED)), F.lit(resampling.ASIDE)) == 0).collect()}
    model = resampling.fit(resampling.count_grams([t.encode() for t in texts.values()]), resampling.count_grams([texts[d].encode() for _, d in good if d not in aside]))
    scored = {d: resampling.perturbed(model, d, t) for d, t in texts.items()}
    lightest = min(scored[d][0] for _, d in good if d in aside) - resampling.SLACK
    k = sum(w >= lightest for w, _ in scored.values())
    assert kept[0] == set(sorted(scored, key=lambda d: -scored[d][1])[:k])
    assert sum(d in labels and labels[d].quality == 1 for d in texts if d not in kept[0]) <= 1 and sum(d in labels and labels[d].quality == 0 for d in kept[0]) <= 1

    # toxicity: the same network over the texts one by one
    learn = sorted((d, texts[d], labels[d].toxic) for d in kept[0] if d in labels and zlib.crc32(str(d).encode()) % 5)
    net = toxicity.train([(t.encode(), y) for _, t, y in learn])
    score = dict(zip(sorted(kept[0]), toxicity.Scorer(net).scores([texts[d].encode() for d in sorted(kept[0])])))
    sure = {d for d in kept[0] if abs(score[d] - 0.5) > 1e-3}
    assert kept[1] & sure == {d for d in sure if score[d] < 0.5}

    # near-duplicates: all pairs of five-word shingles
    assert kept[2] == plain_survivors({d: texts[d] for d in kept[1]})

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == kept[2]
    lengths = defaultdict(int)
    for r in packed:
        lengths[r.doc_id] += r.length
    bins = check_places(packed, 2048)
    assert bins <= -(-sum(lengths.values()) // 2048) + 2
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 4


def test_stages_on_odd_rows(spark):
    """Nulls anywhere, empty and very long texts, ties, repeats, an empty table, and columns with clashing names."""
    plain = read_table(spark, SF, "documents").limit(40).select("doc_id", "text", "lang", "source", "n_chars")
    schema = plain.schema
    odd = [
        (None, None, None, None, None), (None, "a text without an id", "en", None, 3), (900001, None, "en", "s", None), (900002, "", None, "s", 0), (900003, " \n\t ", "en", "s", 5),
        (900004, "word " * 60_000, "en", "s", 300_000), (900005, "x" * 400_000, "en", "s", 400_000), (900006, "the same five words here", "en", "s", 1), (900006, "the same five words here", "en", "s", 1), (900007, "the same five words here", None, None, None),
    ]
    every = plain.unionByName(spark.createDataFrame(odd, schema))
    clash = {c: F.lit(7) for c in ("id", "key", "fp", "count", "rep", "shard", "_text", "component", "length", "log_weight", "piece")}
    docs = materialize(every.withColumns(clash), "odd-docs")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        out = materialize(stage(spark, docs, SF), f"odd-{name}")
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}
            check_places(out.collect(), 2048)
            break
        assert out.columns == docs.columns
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        if name == "near_dedup":
            assert ids.count(900006) == 1 and 900007 not in ids and len([i for i in ids if i in (900001, 900002, 900003)]) <= 1 and None in ids
        assert set(ids) <= {r.doc_id for r in docs.select("doc_id").collect()}

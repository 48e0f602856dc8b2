"""The pipeline's near-duplicate stage: exact five-word Jaccard of 0.8 and more."""

import random

import corpus_pipeline
from loomgraph.llm import neardup
from tests.conftest import SF


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def plain_survivors(texts):
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in sets}


def edited(rng, words, times):
    out = list(words)
    for _ in range(times):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def test_stage_removes_all_pairs_of_four_fifths(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts = []
    for size in (12, 40, 120, 300, 900):
        base = [word() for _ in range(size)]
        texts += [" ".join(edited(rng, base, rng.randint(0, max(2, size // 30)))) for _ in range(14)]
        texts += [" ".join(base[: size * 9 // 10]), " ".join(base[size // 3 :]), " ".join(base).upper()]
    line = " ".join(word() for _ in range(30))
    texts += [" ".join([line, *(word() for _ in range(rng.randint(3, 40)))]) for _ in range(25)]
    texts += [None, "", "  ", "a", "A", "one two", "a b c d e"]
    rng.shuffle(texts)
    given = dict(enumerate(texts))
    docs = spark.createDataFrame(list(given.items()), "doc_id long, text string").repartition(3)
    want = plain_survivors(given)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == want
    assert 40 < len(want) < len(texts) - 20


def test_three_bits_are_not_enough(spark):
    words = [f"w{i}" for i in range(100)]
    near = words[:50] + ["other"] + words[51:]  # 91 of 101 shingles are in both
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:60]))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == [1, 3]


def test_repeated_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.keep_one(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (4, "other words are here"), (7, "other words are here"), (None, None)], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in neardup.keep_one(odd).collect()) == ["4", "None", "None"]

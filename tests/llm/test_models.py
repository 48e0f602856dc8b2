"""Segmentations, chats, quality, toxicity, exact search: against plain versions, and edge cases."""

import itertools
import math
import random
import tracemalloc

import numpy as np
import pytest

from loomgraph.llm import chat, inner_product, lattice, queries, resampling, toxicity
from loomgraph.llm.queries import tokenizer_path
from tests.conftest import SF

MODEL = tokenizer_path("piece_bpe_32k.model")


# --- segmentations ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def lattices():
    return lattice.Lattices(lattice.Pieces(MODEL))


def every(pieces, word):
    if not word:
        return [((), 0.0)]
    out = []
    for j in range(1, len(word) + 1):
        i = pieces.ids.get(word[:j])
        if i is not None:
            out += [((i, *rest), pieces.weight[i] + w) for rest, w in every(pieces, word[j:])]
    if word[0] not in pieces.ids:
        raw = word[0].encode()
        out += [((*(pieces.byte_ids[b] for b in raw), *rest), lattice.BYTE_WEIGHT * len(raw) + w) for rest, w in every(pieces, word[1:])]
    return out


def test_samples_follow_the_model(lattices):
    all_ = every(lattices.pieces, "▁the▁cat")
    z = np.logaddexp.reduce([w for _, w in all_])
    p = {ids: math.exp(w - z) for ids, w in all_}
    n = 4000
    found = lattice.sample(lattices, ["the cat"] * n, [str(i) for i in range(n)], 2)
    first = {}
    for one in found:
        (a, la, ga, qa), (b, lb, gb, qb) = one
        a, b = a.tolist(), b.tolist()
        assert a != b and ga >= gb and abs(math.exp(la) - p[tuple(a)]) < 1e-9 and qa <= 0 and qb <= 0
        first[tuple(a)] = first.get(tuple(a), 0) + 1
    for ids in sorted(p, key=p.get)[-3:]:
        assert abs(first.get(ids, 0) / n - p[ids]) < 0.03
    weights = [sum(math.exp(lp - q) for _, lp, _, q in one) for one in found]
    assert abs(np.mean(weights) - 1) < 0.05  # Horvitz-Thompson


def test_later_samples_follow_the_model(lattices):
    """The third without replacement: the search chooses among the sets beside two segmentations."""
    all_ = every(lattices.pieces, "▁ox")
    z = np.logaddexp.reduce([w for _, w in all_])
    p = {ids: math.exp(w - z) for ids, w in all_}
    assert len(p) >= 4
    n = 4000
    third = {}
    for one in lattice.sample(lattices, ["ox"] * n, [f"t{i}" for i in range(n)], 4):
        found = [tuple(x[0].tolist()) for x in one]
        assert len(set(found)) == 4 and [x[2] for x in one] == sorted((x[2] for x in one), reverse=True)
        third[found[2]] = third.get(found[2], 0) + 1
    for c in p:
        want = sum(p[a] * p[b] / (1 - p[a]) * p[c] / (1 - p[a] - p[b]) for a, b in itertools.permutations(p, 2) if c not in (a, b))
        assert abs(third.get(c, 0) / n - want) < 0.035


def test_segmentations_query_searches_on(spark):
    """Four a text, so that the search chooses among what it has split; the first two are those of two."""
    rows = {}
    for r in queries.op2_segmentations(spark, SF).collect():
        rows.setdefault(r.doc_id, {})[r["sample"]] = r.ids_crc32
    few = {(r.doc_id, r["sample"]): r.ids_crc32 for r in lattice.sample_segmentations(spark.read.parquet(f"{SF}/documents.parquet"), MODEL, k=2).collect()}
    assert max(map(len, rows.values())) == 4 and sum(len(x) == 4 for x in rows.values()) > 0.9 * len(rows)
    assert few == {(d, i): x[i] for d, x in rows.items() for i in x if i < 2}


def test_samples_do_not_depend_on_what_is_kept(lattices):
    texts = ["some words here", "日本 ünd\ttab", "  two  blanks "]
    a = lattice.sample(lattices, texts, ["1", "2", "3"], 3)
    b = lattice.sample(lattice.Lattices(lattices.pieces), texts[::-1], ["3", "2", "1"], 3)
    assert [[x[0].tolist() for x in one] for one in a] == [[x[0].tolist() for x in one] for one in b[::-1]]


def test_words_are_looked_up_once_a_batch(lattices, monkeypatch):
    texts = ["to be or not to be", " to  be ", "", " ", "or", "to be ", "▁ or", "▁", "a\tb\u00a0c  d", "é ☃ \n x"] * 3
    distinct, at, lengths = lattices.pieces.words(texts)
    cut = np.cumsum(lengths).tolist()
    assert [[distinct[i] for i in at[a:b]] for a, b in zip([0, *cut], cut)] == [lattices.pieces.split(t) for t in texts]
    asked, real = [], lattice.Lattices.starts
    monkeypatch.setattr(lattice.Lattices, "starts", lambda self, words: (asked.extend(words), real(self, words))[1])
    lattice.sample(lattices, texts, [str(i) for i in range(len(texts))], 3)
    assert len(asked) == len(set(asked)) == len(distinct)


def test_matches_are_all_pieces_that_begin_at_a_place(lattices):
    pieces = lattices.pieces
    for text in ("▁unbelievable", "▁日本語", "▁Straße\U0010ffff☃é", "x" * 40):
        chars = np.array([ord(c) for c in text])
        got = set(zip(*(x.tolist() for x in pieces.matches(chars, np.arange(len(text), 0, -1)))))
        assert got == {(i, j - i, pieces.ids[text[i:j]]) for i in range(len(text)) for j in range(i + 1, len(text) + 1) if text[i:j] in pieces.ids}


def test_few_segmentations(lattices):
    (one,) = lattice.sample(lattices, [""], ["k"], 3)
    assert len(one) == 1 and len(one[0][0]) == 0 and one[0][3] == 0.0


def test_segmentations_query(spark):
    texts = [None, "", " ", "a b", "a b", "x" * 3000, "mixed ▁ mark", "é ☃ \n"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, "q r", "z")], "doc_id long, text string, sample string")
    got = lattice.sample_segmentations(df, MODEL, k=2, with_ids=True).collect()
    assert {r.doc_id for r in got} == {None, *range(8)}
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(bytes(r.ids))
        assert r.round_trip == (r.doc_id != 6) and r.n_pieces * 4 == len(r.ids)
    assert all(len(set(v)) == len(v) for v in by.values()) and len(by[0]) == 1 and len(by[5]) == 2
    assert lattice.sample_segmentations(df.limit(0), MODEL).count() == 0


# --- chats -----------------------------------------------------------------------------


def cheapest(roles):
    """Least cost by trying every way."""
    best = {chat.START: 0}
    for role in roles:
        new = {}
        for s, c in best.items():
            for t in (1, 2, 3):
                price = 0 if role == t else chat.RELABEL
                if s == t:
                    new[t] = min(new.get(t, 99), c + price + chat.MERGE)
                for n in range(4):
                    for extra in itertools.product((1, 2, 3), repeat=n):
                        path = (s, *extra, t)
                        if all(b in chat.NEXT[a] for a, b in itertools.pairwise(path)):
                            new[t] = min(new.get(t, 99), c + price + chat.INSERT * n)
        best = new
    return min(c + chat.ENDS[s][0] for s, c in best.items())


def test_repair_is_cheapest():
    rng = random.Random(4)
    for _ in range(200):
        roles = [rng.choice((None, 1, 2, 3)) for _ in range(rng.randint(1, 5))]
        price, how, states = chat.repair(roles)
        assert price == cheapest(roles) and len(how) == len(roles) == len(states)


def test_cut_conversations_are_whole(spark, monkeypatch):
    rng = random.Random(6)
    names = ["user", "assistant", "system", "Human", "gpt", "narrator", None]
    turns = [(c, t, rng.choice(names), f"c{c}t{t}" if t % 7 else None, "x") for c in range(6) for t in range(rng.choice((1, 3, 120)))]
    df = spark.createDataFrame(turns + [(None, 0, "user", "n", "x")], "conv_id long, turn long, role string, text string, cost string")
    got = {}
    for r in chat.format_chats(df).collect():
        got.setdefault(r.conv_id, []).append(r)
    assert any(len(v) > 1 for v in got.values())
    for c in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == c), key=lambda t: t[1])
        price, how, states = chat.repair([chat.role_number(t[2]) for t in own])
        text, begun = chat.render([t[3] or "" for t in own], how, states, chat.START, True, states[-1])
        pieces = sorted(got[c], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert sum(p.cost for p in pieces) == price and sum(p.n_turns for p in pieces) == len(own)
        whole = "".join(p.rendered for p in pieces)
        assert whole.count("<|end|>") == sum(p.n_out for p in pieces)
        if len(pieces) == 1:
            assert whole == text and pieces[0].n_out == begun
    assert chat.format_chats(df.limit(0)).count() == 0


# --- quality ---------------------------------------------------------------------------


def corpus(spark, n=120):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(("an", "the", "or", "is", "ti")) for _ in range(rng.randint(1, 3)))
    clean = [" ".join(word() for _ in range(40)) for _ in range(n)]
    junk = [" ".join(word().upper() + "$$$!!" for _ in range(40)) for _ in range(n // 4)]
    docs = [(i, t, "s") for i, t in enumerate(clean + junk)]
    labels = [(i, int(i < n), 0) for i in range(0, len(docs), 2)]
    return spark.createDataFrame(docs + [(900, None, "s"), (901, "", "s"), (None, clean[0], "s"), docs[0]], "doc_id long, text string, key string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = corpus(spark)
    found, model, least = resampling.resample(docs, labels)
    rows = found.collect()
    assert len(rows) == docs.count()
    kept = {r.doc_id for r in rows if r.kept}
    assert len(set(range(120)) - kept) <= 2 and not kept & set(range(120, 150))
    keys = sorted((r.key for r in rows), reverse=True)
    _, lightest = resampling.train(docs, labels)
    k = sum(r.log_weight >= lightest for r in rows)
    assert least == keys[k - 1] and sum(r.kept for r in rows) >= k
    assert sorted(str(r.doc_id) for r in resampling.keep_sample(docs, labels).collect()) == sorted(str(r.doc_id) for r in rows if r.kept)
    some, _, _ = resampling.resample(docs, labels, k=10)
    assert 10 <= some.where("kept").count() <= 11
    raw = resampling.count_grams([(r.text or "").encode() for r in docs.collect()])
    assert (resampling.corpus_counts(docs) == raw).all()


def test_weights_are_the_ratio_of_the_models():
    good, raw = [b"the cat sat", b"the dog"], [b"the cat sat", b"the dog", b"$$ $$ $$", b""]
    p, q = resampling.count_grams(good), resampling.count_grams(raw)
    model = resampling.fit(q, p)
    parts = ((0, resampling.TRIGRAMS, 0.5, 1), (resampling.TRIGRAMS, resampling.TRIGRAMS + resampling.CONTEXTS, 2.0, -1), (resampling.TRIGRAMS + resampling.CONTEXTS, resampling.BUCKETS, 1, 1))

    def log_ratio(bucket):
        for start, stop, smooth, sign in parts:
            if start <= bucket < stop:
                return sign * math.log((p[bucket] + smooth) / (p[start:stop].sum() + smooth * (stop - start)) / ((q[bucket] + smooth) / (q[start:stop].sum() + smooth * (stop - start))))

    for text in (b"the cat sat", b"$$ $$ $$", b"", b"x"):
        three, two, pairs = (list(map(int, g)) for g in resampling.grams(text))
        want = resampling.REFERENCE * (sum(map(log_ratio, three + two)) / (len(three) + resampling.PRIOR) + sum(map(log_ratio, pairs)) / (resampling.WORD_GRAMS * len(pairs) + resampling.PRIOR))
        assert abs(model.log_weight(text) - want) < 1e-9
    assert model.log_weight(b"the cat sat") > 0 > model.log_weight(b"$$ $$ $$")


def test_the_draw_follows_the_weights():
    """Rows of two weights: drawn one at a time, the heavier ones come first as often as their odds say."""
    first = [resampling.gumbel(f"a{i}") + 1.0 > resampling.gumbel(f"b{i}") for i in range(20_000)]
    assert abs(sum(first) / len(first) - math.e / (1 + math.e)) < 0.01


def test_long_labelled_texts_are_learnt_from(spark):
    long = "word " * 60_000
    docs = spark.createDataFrame([(1, long), (2, "x y z"), (2, "x y z"), (3, "q")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    assert resampling.labelled_sample(docs, labels, "quality", {0: 5, 1: 5}) == [(long.encode(), 1), (b"x y z", 0)]


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.choice((-1e9, 3.5, rng.random(), rng.gauss(0, 1e5))) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 77, 499, 500):
        assert resampling.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    assert resampling.kth_largest(df.limit(0), "x", 3) is None


def test_quality_without_labels(spark):
    docs, labels = corpus(spark, 8)
    found, _, _ = resampling.resample(docs, labels.limit(0))
    assert found.where("not kept").count() == 0
    assert resampling.resample(docs.limit(0), labels)[0].count() == 0


# --- toxicity --------------------------------------------------------------------------


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh(rng)
    x, there = rng.normal(size=(toxicity.WINDOW, 3, toxicity.DIM)), np.ones((toxicity.WINDOW, 3))
    there[10:, 1] = 0
    loss = lambda: float((toxicity.forward(net, x, there)[0] * [1.0, -2.0, 0.5]).sum())
    _, kept = toxicity.forward(net, x, there)
    grads, d_x = toxicity.backward(net, kept, np.array([1.0, -2.0, 0.5]))
    for table, grad in [*((net.dense()[k], grads[k]) for k in net.dense()), (x, d_x)]:
        for at in [tuple(rng.integers(0, n) for n in table.shape) for _ in range(4)]:
            old = table[at]
            table[at] = old + 1e-5
            up = loss()
            table[at] = old - 1e-5
            down = loss()
            table[at] = old
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-4


def test_scorer_is_the_network():
    net = toxicity.Network.fresh(np.random.default_rng(1))
    texts = [b"", b"one", b"some words " * 9, " ".join(f"w{i}" for i in range(500)).encode()]
    got = toxicity.Scorer(net).window_logits(texts)
    for text, logits in zip(texts, got):
        c = toxicity.Corpus([text])
        w = c.windows(0).T
        x = c.inputs(net, np.arange(c.blank + 1))[w] if c.blank else np.zeros((*w.shape, toxicity.DIM))
        want, _ = toxicity.forward(net, x, (w != c.blank).astype(float))
        assert len(logits) == len(want) and np.allclose(logits, want, atol=1e-3)


def toxic_corpus(spark, n=240):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(("an", "the", "or", "is", "ti", "ou")) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(30, 90))]
        if i % 4 == 0:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(("vileone", "vilety", "vilest", "grubby"))
        docs.append((i, " ".join(words), 0.1))
        labels.append((i, 1, int(i % 4 == 0)))
    return spark.createDataFrame(docs + [(7000, None, 0.1), (7001, "", 0.1), (None, "x", 0.1), docs[1]], "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_training_words_are_held_flat():
    """The driver trains on some 300 000 distinct words; n-grams as lists took over 500 bytes of it for each."""
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=12)) for _ in range(500)).encode() for _ in range(40)]
    tracemalloc.start()
    c = toxicity.Corpus(texts)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert c.blank > 19_000
    assert held < 100 * c.blank and peak < 350 * c.blank, (held / c.blank, peak / c.blank)
    words = texts[0].split()
    grams, of = c.spans(c.docs[0])
    assert [grams[of == i].tolist() for i in range(3)] == [toxicity.gram_ids(w) for w in words[:3]]
    assert [int(c.ids[i]) for i in c.docs[0]] == [toxicity.word_id(w) for w in words]


def test_toxicity_held_out(spark):
    docs, labels = toxic_corpus(spark)
    got = toxicity.score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 240]
    right = sum(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert len(held) > 20 and right / len(held) > 0.9
    kept = toxicity.keep_civil(docs, labels)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)


def test_toxicity_without_labels(spark):
    docs, labels = toxic_corpus(spark, 8)
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), labels).count() == 0


# --- exact search ----------------------------------------------------------------------


def test_inner_product(spark, monkeypatch):
    monkeypatch.setattr(inner_product, "HEAD", 20)
    monkeypatch.setattr(inner_product, "QUERY_BLOCK", 3)
    rng = random.Random(8)
    data = [(i, [rng.gauss(0, 1) * (3 if i % 17 == 0 else 1) for _ in range(20)], "z") for i in range(300)]
    data += [(300, None, "z"), (301, [1.0] * 19 + [None], "z"), (302, [float("nan")] * 20, "z"), (303, [], "z"), (304, data[5][1], "z"), (310, data[5][1], "z"), (320, [0.0] * 20, "z"), (330, [float("inf")] * 20, "z")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, rank string")
    whole = {r.vec_id: [math.floor(1024 * x) for x in r.embedding] for r in df.collect() if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)}
    want = set()
    for q, a in whole.items():
        if q % 10 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), v) for v, b in whole.items() if v != q)[:10]
            want |= {(q, n + 1, v, -s) for n, (s, v) in enumerate(scored)}
    got = {tuple(r) for r in inner_product.top_k(df, "vec_id % 10 = 0").collect()}
    assert got == want
    few = inner_product.top_k(df.where("vec_id < 3"), "vec_id % 100 = 0").collect()
    assert len(few) == 2 and inner_product.top_k(df.limit(0), "vec_id % 100 = 0").count() == 0

"""Fingerprints, sharding, SimHash, licenses, packing: against plain versions, and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import licenses, packing, sharding, simhash, syncmers
from loomgraph.llm.queries import tokenizer_path
from loomgraph.operators.components import connected_components

DOCS = "doc_id long, text string, lang string, shard int, score double, _size string"


def rows(*texts):
    return [(i, t, "en", 7, 0.5, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [None, "", "   ", "a", "One two", texts[3], texts[3], texts[4].upper(), "x " * 3000, "é" * 5000, "　ü\n\n  b<|endoftext|>  c "]
    base = texts[9].split() + ["tail"] * 40
    for i in range(8):
        near = list(base)
        near[i * 3 % len(near)] = "changed"
        texts.append(" ".join(near))
    data = [(i * 3, t, "en", 7, 0.5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(data + data[-1:], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def text_of(docs):
    return sorted(((r.doc_id, r.text or "") for r in docs.collect()))


# --- syncmers --------------------------------------------------------------------------


def test_edit_report_texts(docs):
    given = text_of(docs)
    got = sorted(map(tuple, syncmers.edit_report(docs).select("doc_id", "n_chars", "edited_sha256").collect()))
    want = []
    for (i, t), (_, nxt) in zip(given, given[1:] + given[:1]):
        k = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()))
    assert got == sorted(want)


def test_fingerprints_brute(spark, docs):
    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def sketch(text, spark_hash):
        import regex

        toks = regex.findall(r"[A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ--[eoEO]]*+[eoEO]|[A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ]+|[^ \t\n\x0B\f\r]", text, flags=regex.V1)
        s = [spark_hash(toks[i : i + 2]) for i in range(len(toks) - 1)]
        at = [i for i in range(len(s) - 4) if min(s[i], s[i + 4]) <= min(s[i + 1 : i + 4])]
        return toks, s, at

    def chain(parts):  # Spark feeds each hash to the next as its seed
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p if isinstance(p, bytes) else p.encode(), seed)
        return signed(seed)

    def fingerprint(text):
        toks, s, at = sketch(text, chain)
        if at:
            hashes = [chain([(s[i + j] & (1 << 64) - 1).to_bytes(8, "little") for j in (0, 2, 4)]) for i in at]
        else:
            hashes = [chain([t]) for t in toks]
        small = sorted({(h & (1 << 64) - 1) >> 33 for h in hashes})[: syncmers.SIZE]
        return "".join(f"{x:08x}" for x in small)

    for r in syncmers.fingerprints(docs).collect():
        assert r.fingerprint == fingerprint(r.text or "")


def test_likeness(docs):
    got = syncmers.edit_report(docs).collect()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = defaultdict(set)
    texts = dict(text_of(docs))
    for r in got:
        by[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values())
    long = [r for r in got if r.n_chars > 100]
    assert sum(r.near_edited for r in long) / len(long) > 0.5


def test_syncmers_are_context_free(spark):
    rng = random.Random(1)
    body = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(200))
    df = spark.createDataFrame([(1, body), (2, "other words before it " + body)], "doc_id long, text string")
    found = syncmers.anchors(df).collect()
    a = {(r["at"], r["hash"]) for r in found if r.doc_id == 1}
    moved = len(syncmers_tokens("other words before it "))
    shifted = {(r["at"] - moved, r["hash"]) for r in found if r.doc_id == 2}
    assert a <= shifted and len(a) > 20
    han = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(3000))
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
    for run in (han, letters, "7" + "".join(rng.choice("0123456789") for _ in range(3000))):
        df = spark.createDataFrame([(1, run), (2, ("說" if run == han else "x") + run)], "doc_id long, text string")
        kept = {i: {r.hash for r in syncmers.anchors(df.where(f"doc_id = {i}")).collect()} for i in (1, 2)}
        assert len(kept[1] & kept[2]) > 0.97 * len(kept[1]) > 100


def syncmers_tokens(text):
    import regex

    return regex.findall(r"[A-Za-z--[eoEO]]*+[eoEO]|[A-Za-z]+|\S", text, flags=regex.V1)


def test_neighbours_by_the_ids_own_order(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE_BYTES", 40)
    monkeypatch.setattr(syncmers, "CHUNK", 3)
    monkeypatch.setattr(syncmers, "MANY", 5)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    big = [(2**53 + i, f"text {i} " + word()) for i in range(60)]
    for kind, rows in (
        ("bigint", big),
        ("string", [(f"o'{word()}\\{i}", word() + " " + word()) for i in range(80)]),
        ("decimal(30,2)", [(Decimal(i) / 4, word() * 3) for i in range(70)]),
        ("bigint", [(7, "same text")] * 40 + [(7, word()) for _ in range(30)] + [(i, word()) for i in range(7)] + [(None, "n"), (None, "n")] + [(None, word()) for _ in range(20)]),
    ):
        df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
        got = sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in syncmers.edit_report(df).collect())
        order = [(r.doc_id, r.text) for r in df.orderBy("doc_id", F.xxhash64("text")).collect()]
        want = []
        for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
            k = len(t) // 4
            want.append((str(i), len(t), hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()))
        assert got == sorted(want)


def test_likenesses_brute(spark, docs):
    given = text_of(docs)
    prints = {r.text or "": r.fingerprint for r in syncmers.fingerprints(docs).collect()}

    def likeness(x, y):
        a, b = ([int(p[i : i + 8], 16) for i in range(0, len(p), 8)] for p in (x, y))
        if a == b:
            return 1.0
        both = sorted({*a, *b})[: syncmers.SIZE]
        return len({*a} & {*b} & {*both}) / len(both) if a and b else 0.0

    want = Counter((i, round(likeness(prints[t], prints[nxt]), 9)) for (i, t), (_, nxt) in zip(given, given[1:] + given[:1]))
    got = syncmers.edit_report(docs).collect()
    assert Counter((r.doc_id, round(r.near_next, 9)) for r in got) == want
    assert all(abs(r.near_edited - likeness(r.fingerprint, r.edited_fingerprint)) < 1e-9 for r in got)


def test_syncmers_edges(spark, none):
    assert syncmers.edit_report(none).count() == 0
    one = syncmers.edit_report(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0
    nulls = syncmers.edit_report(spark.createDataFrame([(None, "q"), (1, None), (2, "")], "doc_id long, text string")).collect()
    assert len(nulls) == 3 and {r.fingerprint for r in nulls if r.n_chars == 0} == {""}


# --- sharding --------------------------------------------------------------------------


def test_shards(docs):
    given = docs.withColumns({c: F.lit(3) for c in ("_first", "_bucket", "_AT", "_crc")})
    got = sharding.shuffle_into_shards(given, 8, bucket_bytes=2000)
    assert got.columns == [*(c for c in given.columns if c != "shard"), "shard", "slot"]
    got = got.collect()
    assert Counter((r.doc_id, r.text, r.lang, r._size, r._first) for r in got) == Counter((r.doc_id, r.text, r.lang, r._size, 3) for r in docs.collect())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[i]) for i in range(8)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.shuffle_into_shards(given.repartition(5), 8, bucket_bytes=2000).collect()
    assert sorted((r.shard, r.slot, r.doc_id) for r in got) == sorted((r.shard, r.slot, r.doc_id) for r in again)
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r.shard))]
    assert order != sorted(order)
    for r in sharding.report(docs, 8).collect():
        assert r.law == "rows" and r.grown_shard is None


def test_shards_against_a_plain_shuffle(spark):
    import numpy as np

    texts = ["", None, "a", "b" * 900, "ü", *(f"text {i}" for i in range(40))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashes = {r.doc_id: (r.b, r.c) for r in df.select("doc_id", F.pmod(F.xxhash64(F.lit(sharding.SEED), "doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))), F.lit(3)).alias("b"), F.lit(0).alias("c")).collect()}
    total = sum(len((t or "").encode()) + 16 for t in texts)
    order = []
    for bucket in range(3):
        rows = sorted(i for i in hashes if hashes[i][0] == bucket)
        places = sharding.fisher_yates(len(rows), np.random.default_rng([sharding.SEED, bucket]))
        order += [i for _, i in sorted(zip(places, rows))]
    got = {r.doc_id: (r.shard, r.slot, r.size, r.text_crc32) for r in sharding_report(df, -(-total // 3))}
    assert got == {i: (p % 8, p // 8, len((texts[i] or "").encode()) + 1, zlib.crc32((texts[i] or "").encode())) for p, i in enumerate(order)}


def sharding_report(df, bucket_bytes):
    old = sharding.shuffle_into_shards.__defaults__
    sharding.shuffle_into_shards.__defaults__ = (*old[:-1], bucket_bytes)
    try:
        return sharding.report(df, 8).collect()
    finally:
        sharding.shuffle_into_shards.__defaults__ = old


def test_crowds_are_split(spark):
    df = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text")).unionByName(
        spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    ).repartition(16)
    total = 16 * 23_000
    found = sharding.shuffle_into_shards(df, 3, bucket_bytes=total // 10)
    rows = found.groupBy("shard").agg(F.count("*"), F.countDistinct("slot"), F.max("slot")).collect()
    assert sum(r[1] for r in rows) == 23_000 and all(r[1] == r[2] == r[3] + 1 for r in rows)
    cols = {"bucket": "b", "crc": "c", "id": "doc_id"}
    marked, counts = sharding.scattered(df.withColumn("c", F.lit(0).cast("long")), cols, 1, 10)
    assert counts.agg(F.max("n")).first()[0] < 12_000 and counts.agg(F.sum("n")).first()[0] == 23_000 == marked.count()


def test_shards_empty(none):
    assert sharding.shuffle_into_shards(none).count() == 0


def test_fisher_yates_is_uniform():
    import numpy as np

    seen = Counter(tuple(sharding.fisher_yates(3, np.random.default_rng(i))) for i in range(6000))
    assert len(seen) == 6 and all(850 < n < 1150 for n in seen.values())


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs.drop("shard"), f"file://{tmp_path}/out", 4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4


# --- SimHash ---------------------------------------------------------------------------


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_simhash(docs):
    prints = {r.doc_id: plain_fingerprint(r.text or "") for r in docs.collect()}
    want = plain_components(prints)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])
    kept = simhash.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns


def test_links_lose_nothing(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    prints = {p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for p in seeds for _ in range(25)}
    signed = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(sorted(prints))]
    want = {(j, i) for p, i in signed for q, j in signed if i < j and bin((p ^ q) & (1 << 64) - 1).count("1") <= 3}
    got = {(r.src, r.dst) for r in simhash.links(spark.createDataFrame(signed, "fp long, rep long")).collect()}
    assert got == want and len(want) > 100


def test_simhash_broadcasts_nothing(spark):
    """Each fingerprint visits up to 34 cells, which the estimate of a table's bytes leaves out."""
    reps = spark.createDataFrame([(i * 0x9E3779B97F4A7C1 % (1 << 62), i) for i in range(50)], "fp long, rep long")
    asked = [simhash.links(reps), simhash.star_links(reps), simhash.near_duplicates(reps.selectExpr("rep AS doc_id", "hex(fp) AS text"))]
    asked.append(connected_components(reps.selectExpr("rep AS src", "rep div 2 AS dst")))
    for df in asked:
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in asked[:3]]
    assert all("strategy=merge" in plan for plan in plans)


def test_simhash_empty(spark, none):
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, None)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    assert got == {(None, 4), (4, 4), (None, None)}


# --- licenses --------------------------------------------------------------------------


def test_licenses_against_sql(spark, docs):
    import duckdb
    import pyarrow as pa

    data = [(r.doc_id, r.text) for r in docs.collect()]
    extra = ["Released under the MIT License.", "the mit license mit license", "Licensed under the Apache License, as published at x y, Version 2.0!", "apache license apache License", None]
    extra += [said(t) for t in licenses.BODIES.values()] + [said(t) + ", but only on Tuesdays" for t in (licenses.BODIES | licenses.NOTICES).values()]
    extra += ["Foo is licensed under CC BY-NC 4.0\nx", "see: All rights reserved", "All rights reserved! (c) me", "Copyright (c) 2020 A. All rights reserved"]
    data += [(10_000 + i, t) for i, t in enumerate(extra)]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([d for d, _ in data], pa.int64()), "text": pa.array([t for _, t in data], pa.string())}))
    df = licenses.scan_licenses(spark.createDataFrame(data, "doc_id long, text string"))
    want = sorted(map(str, con.execute(f"select {', '.join(df.columns)} from ({licenses.oracle()})").fetchall()))
    assert sorted(str(tuple(r)) for r in df.collect()) == want
    by = {r.doc_id: r for r in df.collect()}
    assert [by[10_005 + i].bodies for i in range(len(licenses.BODIES))] == list(licenses.BODIES)
    assert by[10_000].notices == "mit-notice" and by[10_000].score == 0.75


def said(template):
    """A text of the template with its optional regions."""
    return " ".join(re.sub(r"\{\{\w+:\d+\}\}", "THE HOLDERS", template).replace("[[", "").replace("]]", "").split())


def test_altered_licenses_are_no_match():
    scan = licenses.Scanner().scan
    zlib_text, bsd = said(licenses.BODIES["zlib"]), said(licenses.BODIES["bsd"])
    assert scan(zlib_text.upper().encode())["bodies"] == "zlib" and scan((bsd + ".").encode())["bodies"] == "bsd"
    for text in (
        zlib_text[: zlib_text.index("subject to")] + "but only on Tuesdays and for a fee",
        zlib_text + " nor sold",
        zlib_text.replace("must not be misrepresented", "may be misrepresented"),
        bsd[: bsd.index("this software is provided")],
        bsd.replace("are disclaimed", "are granted"),
        "All rights reserved by the crown in 1200",
    ):
        found = scan(text.encode())
        assert (found["labels"], found["score"]) == ("", 0.0)
    assert scan(b"Licensed under the Apache License, Version 2.0 for schools only.")["labels"] == "apache"


def test_automaton():
    a = licenses.Automaton("this [[very [[odd]]]] text by {{who:2}} ends")
    said = lambda t: a.matches(t.encode().split(), 0)
    assert said("this text by ends") and said("this very odd text by a b ends now")
    assert not said("this odd text by ends") and not said("this text by a b c ends") and not said("this very text")
    for bad in ("a [[ b", "a ]] b", "[[a]]"):
        with pytest.raises(ValueError):
            licenses.Automaton(bad)


def test_licenses_empty(none):
    assert licenses.scan_licenses(none).count() == 0


# --- packing ---------------------------------------------------------------------------


def test_packing(docs):
    from tokenizers import Tokenizer

    packing._TOKENIZERS.clear()
    plain = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    cap = 64
    got = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), capacity=cap, with_ids=True).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for r in docs.dropDuplicates(["doc_id"]).collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [0]
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        copies = sum(1 for p in pieces[r.doc_id] if p.piece == 0)
        parts = sorted({(p.piece, p.start, p.length, bytes(p.ids)) for p in pieces[r.doc_id]})
        assert copies in (1, 2) and b"".join(p[3] for p in parts) == raw
        assert all(p[2] == cap for p in parts[1:]) and (len(parts) == 1 or len(ids) > cap)
        assert all(p.ids_crc32 == zlib.crc32(bytes(p.ids)) for p in pieces[r.doc_id])
    check_places(got, cap)


def test_blanks_among_other_white_space():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    plain, ours = Tokenizer.from_file(path), packing.WordCachedTokenizer(path)
    white, rng = [" ", "\n", "\t", "\xa0", "\u3000", "\x85"], random.Random(8)
    texts = ["x \xa0 \xa0", "x\xa0 \xa0y", "", " ", " a", "a ", "\n a", "<|endoftext|> a <|endoftext|>b", "a b a c"]
    texts += ["".join(rng.choice([*white, "a", "foo", "é", "1", "!"]) for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    want = [b"".join(i.to_bytes(4, "little") for i in plain.encode(t, add_special_tokens=False).ids) for t in texts]
    for some in (slice(0, 1), slice(0, 700), slice(700, None), slice(0, None)):  # with few, some and all words kept
        assert ours.encode(texts[some]) == want[some]
    assert ours.encode([]) == []


def check_places(got, cap):
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= cap
    return len(bins)


def test_plan_reaches_the_optimum():
    rng = random.Random(2)

    def best(sizes, cap):
        sizes, out = sorted(sizes, reverse=True), [len(sizes)]

        def go(i, rooms):
            if len(rooms) >= out[0]:
                return
            if i == len(sizes):
                out[0] = len(rooms)
                return
            for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
                go(i + 1, rooms[:k] + [rooms[k] - sizes[i]] + rooms[k + 1 :])
            go(i + 1, rooms + [cap - sizes[i]])

        go(0, [])
        return out[0]

    excess = 0
    for _ in range(150):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 10))]
        plan = packing.Plan(Counter(sizes), 20)
        assert sum(r[2] for r in plan.runs) == len(sizes)
        excess += plan.bins - best(sizes, 20)
    assert excess <= 4


def test_reduction_dominates():
    plan = packing.Plan({12: 3, 8: 3, 15: 1, 5: 1}, 20)
    assert plan.bins == 4 and plan.fixed == 4


def test_packing_empty(none):
    assert packing.pack_documents(none, tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_native_plan_has_no_python(docs):
    plan = syncmers.edit_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert F is not None


def test_words_are_looked_up_once_a_batch(monkeypatch):
    """What a slice of texts costs besides their characters is paid once for two million of them, and words met before 600 000 others are not encoded again."""
    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer, slices = packing.WordCachedTokenizer(path), []
    texts = ["ab cd " * 50_000 + f"end{i}" for i in range(5)]
    monkeypatch.setattr(tokenizer, "_encode", lambda some: (slices.append(len(some)), packing.WordCachedTokenizer._encode(tokenizer, some))[1])
    found = tokenizer.encode(texts)
    assert slices == [5]
    monkeypatch.setattr(packing, "SLICE", 1 << 18)
    assert packing.WordCachedTokenizer(path).encode(texts) == found
    assert packing.KEPT_WORDS >= 600_000

"""Near-duplicates: SimHash links first, then every pair of 4/5 similarity and more.

Texts with at least 4/5 of their five-word shingles in common (of all that either has) are
linked. A SimHash alone can't say so: at that similarity fingerprints differ in ten bits on
average and in up to twenty, where a grid prunes nothing. So the SimHash operator, over
five-word shingles, links what its grid range-join finds; each link is held against the
shingles themselves; and the pairs that it cannot see are met otherwise: if shingles stand
in one order for all texts, two linked texts share one among the first n // 9 + 1 of the
smaller and the first n // 5 + 1 of the larger (n distinct shingles). Any order is right;
common shingles stand last, so that few texts meet in them.

What meets is held against a bound that loses nothing (a shingle that only one of the two
has flips one of about n parity bits) and then against the shingles. Texts that meet in a
shingle are first held against one of them; then only those not yet in one component.
Texts with equal shingles are folded before any of this.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import simhash
from loomgraph.operators.components import connected_components
from loomgraph.session import discard, give_back, materialize, ship_package

SHINGLE = 5
#: Parity bits at least; beyond, twice as many as there are shingles or less, a power of two.
LEAST_BITS = 512
#: Common shingles are those met LEAST times in one of SAMPLE texts, the COMMON most frequent. They decide the order only.
SAMPLE, LEAST, COMMON = 16, 3, 250_000


def shingles(text: bytes) -> np.ndarray:
    """The distinct XXH64 of all shingles, ascending; of all words if they are fewer than a shingle's."""
    return np.unique(simhash.shingle_hashes(text, SHINGLE))


def parity(grams: np.ndarray) -> bytes:
    """Of each class of shingles, whether their number is odd; as many classes as the number of shingles asks for."""
    bits = max(LEAST_BITS, 1 << max(0, len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Shingles that only one of two texts has, at least; parities of more classes are folded to fewer."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b):
        a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def folded(bits: bytes) -> np.ndarray:
    """A parity of LEAST_BITS classes, of any parity."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.int64).reshape(-1, LEAST_BITS // 64), axis=0)


class Order:
    """The order of shingles: by value, but common ones last, the more common the later."""

    def __init__(self, common: np.ndarray):
        self.place = np.argsort(common)
        self.sorted = common[self.place]

    def beginning(self, grams: np.ndarray) -> np.ndarray:
        """The first n // 5 + 1 of distinct ascending shingles."""
        size = len(grams) // 5 + 1
        if not len(grams) or not len(self.sorted):
            return grams[:size]
        at = np.minimum(np.searchsorted(self.sorted, grams), len(self.sorted) - 1)
        common = self.sorted[at] == grams
        rare = grams[~common]
        if len(rare) >= size:
            return rare[:size]
        late = np.flatnonzero(common)
        return np.concatenate([rare, grams[late[np.argsort(self.place[at[late]])]]])[:size]


def _key(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes(), simhash.SEED)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return ((t.as_py() or "").encode() for t in batch.column(1))


def _every_gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in _texts(batch):
            yield pa.RecordBatch.from_arrays([pa.array(shingles(text).view(np.int64))], names=["gram"])


#: Texts whose shingles are handed on at once.
TOGETHER = 64


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(start, TOGETHER)


def _prints(common: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(common)
        for batch in _slices(batches):
            keys, prints, sizes, bits, few, first = [], [], [], [], [], []
            for text in _texts(batch):
                every = simhash.shingle_hashes(text, SHINGLE)
                grams = np.unique(every)
                keys.append(_key(grams))
                prints.append(simhash.majority(every) if len(every) else 0)
                sizes.append(len(grams))
                bits.append(parity(grams))
                few.append(folded(bits[-1]))
                first.append(order.beginning(grams).view(np.int64))
            ends = np.cumsum([0] + [len(f) for f in first]).astype(np.int32)
            flat = np.concatenate(first) if first else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _signed(keys), _signed(prints), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), pa.array(few, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["id", "key", "fp", "n", "bits", "few", "first"],
            )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        found = [shingles(t) for t in _texts(batch)]
        yield pa.RecordBatch.from_arrays([_signed([_key(g) for g in found]), pa.array([g.tobytes() for g in found], pa.binary())], names=["key", "grams"])


def _filtered(test: Callable) -> Callable:
    """The pairs (a, b) for which test(x, y) is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [test(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _alike(x, y) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


#: What the sizes of any two linked texts satisfy.
NEAR_SIZES = "5 * least(na, nb) >= 4 * greatest(na, nb)"


def _verified(pairs: DataFrame, about: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose shingles are alike. about: (key, rep, n, bits)."""
    side = lambda k: about.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}"))
    # so many shingles may differ: (na + nb) / 9; the bound is compared where both parities are at hand
    close = pairs.join(side("a"), "a").join(side("b"), "b").where(NEAR_SIZES).select("a", "b", "bitsa", "bitsb", "na", "nb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = batch.column(4).to_numpy().astype(np.int64) + batch.column(5).to_numpy()
            keep = [9 * apart(x.as_buffer(), y.as_buffer()) <= m for x, y, m in zip(batch.column(2), batch.column(3), most)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = materialize(close.mapInArrow(run, "a long, b long"), "neardup-met")
    keys = met.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    needed = materialize(about.select("key", F.col("rep").alias("id")).join(keys, "key"), "neardup-needed")
    # an id can come back with another text, so keys are computed anew
    sets = texts.join(needed.select("id").distinct(), "id", "left_semi").mapInArrow(_sets, "key long, grams binary")
    sets = materialize(sets.join(needed.select("key"), "key", "left_semi").dropDuplicates(["key"]), "neardup-sets")
    both = met.join(sets.select(F.col("key").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("grams").alias("y")), "b")
    out = materialize(both.select("a", "b", "x", "y").mapInArrow(_filtered(_alike), "a long, b long"), "neardup-links")
    discard(sets)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, component_id) for every row of docs with an id: the smallest id that links reach.

    Null texts and texts without words are copies of each other. Other columns are ignored;
    repeated rows come back repeated; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = texts.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).mapInArrow(_every_gram, "gram long").groupBy("gram").count()
    often = counted.where(F.col("count") >= LEAST).orderBy(F.desc("count"), "gram").limit(COMMON).select("gram").collect()
    common = np.array([r.gram for r in reversed(often)], np.int64).view(np.uint64)
    del often
    give_back()

    prints = materialize(texts.mapInArrow(_prints(common), f"id {kind}, key long, fp long, n int, bits binary, few array<long>, first array<long>"), "neardup-prints")
    # of a group of copies any row's parity and fingerprint will do: they follow from the shingles, but for repeats
    about = materialize(prints.groupBy("key").agg(F.min("id").alias("rep"), F.min("fp").alias("fp"), F.max("n").alias("n"), F.max("bits").alias("bits"), F.max("few").alias("few")), "neardup-reps")

    by_print = about.groupBy("fp").agg(F.min("key").alias("rep"))
    by_print = materialize(by_print, "neardup-fingerprints")
    same = about.select("key", "fp").join(by_print, "fp").where("key <> rep").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    near = simhash.spanning_links(by_print).select(F.col("src").alias("a"), F.col("dst").alias("b"))

    # texts under four shingles are alike only if equal
    begun = prints.where("n >= 4").select("key", "n", F.posexplode("first").alias("at", "gram")).select("gram", "key", "n", F.expr("at <= n div 9").alias("small"))
    one = F.struct("key", "n")
    shared = begun.groupBy("gram").agg(F.min(one).alias("lo"), F.max("key").alias("hi")).where("lo.key < hi")
    blocks = materialize(begun.join(shared.select("gram", F.col("lo.key").alias("pivot"), F.col("lo.n").alias("pn")), "gram").distinct(), "neardup-blocks")

    stars = blocks.where("key <> pivot").where(NEAR_SIZES.replace("na", "n").replace("nb", "pn")).select(F.col("key").alias("a"), F.col("pivot").alias("b"))
    first = same.union(near).union(stars).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    found = _verified(first, about, texts)

    joined = connected_components(found, "a", "b").select(F.col("node").alias("key"), "component")
    known = blocks.select("gram", "key", "n", "small").join(joined, "key", "left").withColumn("component", F.coalesce("component", "key"))
    known = materialize(known, "neardup-known")
    discard(blocks)
    mixed = known.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("gram")
    mixed = materialize(known.join(mixed, "gram", "left_semi"), "neardup-mixed")
    discard(known)
    told = mixed.join(about.select("key", "few"), "key")
    x, y = (told.select("gram", F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("component").alias(f"c{k}"), F.col("small").alias(f"small{k}"), F.col("few").alias(f"few{k}")) for k in "ab")
    apart_by = " + ".join(f"bit_count(fewa[{i}] ^ fewb[{i}])" for i in range(LEAST_BITS // 64))
    met = x.where("smalla").join(y, "gram").where(f"ca <> cb and na <= nb and {NEAR_SIZES} and 9 * ({apart_by}) <= na + nb")
    more = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    every = found.unionByName(_verified(more, about, texts))

    joined = connected_components(every, "a", "b")
    classes = about.select("key", "rep").join(joined, F.col("key") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "key").alias("component"))
    least = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = classes.join(least, "component").select("key", "component_id")
    out = materialize(prints.select("id", "key").join(classes, "key").select(F.col("id").alias(id_col), "component_id"), "neardup-classes")
    for table in (prints, about, by_print, mixed):
        discard(table)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each component the smallest id stays.

    All columns of docs are kept. Of rows that repeat the surviving id one stays. Rows
    without an id cannot be named as a survivor's copy, and all of them stay.
    """
    found = near_duplicates(docs, id_col, text_col)
    ids = materialize(found.where(F.col(id_col) == F.col("component_id")).groupBy(id_col).count(), "neardup-kept")
    # a merge join at every size, so that what is shuffled grows as the texts do and no id list is broadcast
    once = docs.join(ids.where("count = 1").select(id_col).hint("merge"), id_col, "left_semi")
    again = docs.join(ids.where("count > 1").select(id_col), id_col, "left_semi").dropDuplicates([id_col])
    return once.unionByName(again).unionByName(docs.where(F.col(id_col).isNull())).select(*docs.columns)

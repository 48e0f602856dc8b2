"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits. The vector of segment
popcounts maps it to a point of {0,1,2}^32, and the Manhattan distance of two points
never exceeds the Hamming distance of the fingerprints. If the distance over all 32
coordinates is at most 3, it is at most 1 over the first or over the last 16 of them.
So each half is a unit grid: a fingerprint is at home in its own cell and visits the
cells one step above it; a pair within one step meets in a cell. What meets is held
against the full Manhattan bound and then against the exact Hamming distance.

Copies are folded to one representative per fingerprint before any of this, and members
of a crowded cell are first joined to its smallest fingerprint, so that only pairs that
these stars leave apart are made one by one.

Joins are merge joins at every size: Spark's estimate of a table's bytes does not know how
many cells a fingerprint visits, and what it takes for small is built on the driver to be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.components import connected_components
from loomgraph.session import materialize, ship_package

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Shingles whose bits are counted at once; bounds memory on very long texts.
BLOCK = 65536

#: The low bit of each two-bit segment.
LOW = 0x5555555555555555


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), BLOCK):
        part = hashes[start : start + BLOCK].astype("<u8", copy=False)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of all shingles, repeats included; of the whole sequence if words are fewer; none without words.

    bytes.lower and bytes.split touch A-Z and the six ASCII blanks only, as wanted.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = [words] if len(words) < shingle else zip(*(words[i:] for i in range(shingle)))
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(g), SEED) for g in grams), np.uint64, max(1, len(words) - shingle + 1))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits over the XXH64 of all shingles; 0 without words."""
    hashes = shingle_hashes(text, shingle)
    return majority(hashes) if len(hashes) else 0


def fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, fp) where fp holds the 64 bits as a signed long."""
    for batch in batches:
        prints = np.array([fingerprint((t.as_py() or "").encode()) for t in batch.column(1)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, fp) per document. Null texts count as empty (fingerprint zero)."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        fingerprint_batches, f"id {kind}, fp long"
    )


def popcounts() -> F.Column:
    """Popcounts of the 32 two-bit segments, each left in its own two bits."""
    return F.expr(
        f"((fp ^ shiftrightunsigned(fp, 1)) & {LOW}L) | shiftleft(fp & shiftrightunsigned(fp, 1) & {LOW}L, 1)"
    )


def star_links(reps: DataFrame) -> DataFrame:
    """Pairs (src, dst) of representatives within MAX_BITS of the smallest fingerprint of their own cell.

    Not all links, but one for each member of a crowded cell: what they join need not be
    paired one by one.
    """
    home = reps.withColumn("p", popcounts()).select("fp", "rep", F.explode(F.expr("array(p & 4294967295L, 4294967296L + shiftrightunsigned(p, 32))")).alias("cell"))
    centre = home.groupBy("cell").agg(F.min(F.struct(F.col("fp").alias("cfp"), F.col("rep").alias("crep"))).alias("c")).select("cell", "c.*")
    near = home.join(centre.hint("merge"), "cell").where(F.expr(f"fp <> cfp and bit_count(fp ^ cfp) <= {MAX_BITS}"))
    return near.select(F.greatest("rep", "crep").alias("src"), F.least("rep", "crep").alias("dst")).distinct()


def links(reps: DataFrame) -> DataFrame:
    """Pairs (src, dst, bits) of representatives whose fingerprints differ in 1 to MAX_BITS bits.

    reps has (fp, rep), one row per distinct fingerprint. If it has a column `class`, only
    pairs of different classes are made.
    """
    known = "class" if "class" in reps.columns else "fp"
    halves = reps.withColumn("p", popcounts()).select(
        "fp",
        "rep",
        "p",
        F.col(known).alias("k"),
        F.explode(F.expr("array(named_struct('half', 0L, 'v', p & 4294967295L), named_struct('half', 1L, 'v', shiftrightunsigned(p, 32)))")).alias("s"),
    ).select("fp", "rep", "p", "k", F.col("s.half").alias("half"), F.col("s.v").alias("v"))
    cell = lambda v: F.expr(f"half * 4294967296L + {v}")
    home = halves.select("fp", "rep", "p", "k", cell("v").alias("cell"))
    steps = F.expr(
        "filter(array(" + ", ".join(f"if((shiftright(v, {2 * i}) & 3) < 2, v + {1 << 2 * i}L, null)" for i in range(16)) + "), x -> x is not null)"
    )
    visit = halves.select("fp", "rep", "p", "k", "half", F.explode(F.array_append(steps, F.col("v"))).alias("w")).select(
        "fp", "rep", "p", "k", cell("w").alias("cell")
    )
    a, b = home.alias("a"), visit.alias("b")
    step = "abs((shiftrightunsigned(a.p, {0}) & 3) - (shiftrightunsigned(b.p, {0}) & 3))"
    bound = " + ".join(step.format(2 * i) for i in range(32))
    met = a.join(
        b.hint("merge"),
        F.expr("a.cell = b.cell and a.k <> b.k")
        & F.expr(f"{bound} <= {MAX_BITS}")
        & F.expr(f"bit_count(a.fp ^ b.fp) <= {MAX_BITS}"),
    )
    return met.select(
        F.greatest("a.rep", "b.rep").alias("src"), F.least("a.rep", "b.rep").alias("dst"), F.expr("int(bit_count(a.fp ^ b.fp))").alias("bits")
    ).distinct()


def spanning_links(reps: DataFrame) -> DataFrame:
    """Pairs (src, dst) within MAX_BITS that join what all such pairs join.

    First each crowded cell's star, then every pair that the stars left in different
    components: a dense group is not paired one by one.
    """
    stars = materialize(star_links(reps), "simhash-stars")
    joined = connected_components(stars)
    known = reps.join(joined.hint("merge"), reps.rep == joined.node, "left").select("fp", "rep", F.coalesce("component", "rep").alias("class"))
    rest = links(materialize(known, "simhash-known"))
    return stars.unionByName(rest.select("src", "dst"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of docs.

    Null texts and texts without words have fingerprint zero and link like any other.
    Equal texts always share a component; repeated rows come back repeated. Rows with
    a null id get the component of their fingerprint, which is null if no row of it
    has an id. Other columns are ignored.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash-prints")
    reps = materialize(prints.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-reps")
    joined = connected_components(spanning_links(reps))
    classes = reps.join(joined.hint("merge"), reps.rep == joined.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    classes = materialize(classes, "simhash-classes")
    return prints.join(classes.hint("merge"), "fp", "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each component the smallest id stays.

    All columns of docs are kept. Of rows that repeat the surviving id one stays. Rows
    without an id cannot be named as a survivor's copy, and all of them stay.
    """
    found = near_duplicates(docs, id_col, text_col)
    ids = materialize(found.where(F.col(id_col) == F.col("component_id")).groupBy(id_col).count(), "simhash-kept")
    # a merge join at every size, so that what is shuffled grows as the texts do and no id list is broadcast
    once = docs.join(ids.where("count = 1").select(id_col).hint("merge"), id_col, "left_semi")
    again = docs.join(ids.where("count > 1").select(id_col).hint("merge"), id_col, "left_semi").dropDuplicates([id_col])
    return once.unionByName(again).unionByName(docs.where(F.col(id_col).isNull())).select(*docs.columns)

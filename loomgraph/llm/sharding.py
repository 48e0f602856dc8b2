"""Two-pass external shuffle into shards.

Pass one scatters the records uniformly, by a seeded hash, into buckets that fit in
memory. Pass two permutes each bucket with Fisher-Yates. The buckets in order are then
one uniform permutation of the corpus; position p of it goes to shard p mod n, slot
p div n, so shard sizes differ by one record at most and slots have no gaps.

A permutation needs the number of the bucket and of its rows only, so it is drawn apart
from the records, as one array for each bucket. The records stay in Spark's own rows:
they are shuffled once, numbered inside their bucket, and look their place up in the
bucket's array. Permutations and places are pure functions of records and seed, so a
task that runs again gives the same rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import materialize, ship_package

#: Bytes of records that a bucket holds on average.
BUCKET_BYTES = 8 << 20
#: A bucket with this many times the mean number of rows is split; at most MOST_SPLIT of them are.
UNEVEN, MOST_SPLIT = 4, 1024
#: Buckets whose first places are summed up by one task.
SPAN = 4096
SEED = 20


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of range(n): swap each place, from the last, with one at or before it."""
    order = np.arange(n)
    for i, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)).tolist()):
        order[i], order[j] = order[j], order[i]
    return order


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names that are not taken, whatever the case of letters."""
    lower, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in lower:
            name += "_"
        out.append(name)
    return out


def permutations(seed: int):
    """A function that draws the permutation of each (bucket, n, first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                bucket, n, first = (batch.column(i)[at].as_py() for i in range(3))
                order = fisher_yates(n, np.random.default_rng([seed, bucket]))
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([first], pa.int64()), pa.array([order], pa.list_(pa.int64()))], names=["bucket", "first", "places"])

    return run


def scattered(docs: DataFrame, columns: dict[str, str], seed: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """docs with a column of bucket numbers, and the rows (bucket, n) of all buckets.

    A record's bucket is a hash of its id and text. Only equal records can crowd a bucket;
    those of a crowded one spread over several by the input split that they come from.
    """
    at, crc, id_col = columns["bucket"], columns["crc"], columns["id"]
    hashed = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(crc))
    mark = docs.withColumn(at, F.pmod(hashed, F.lit(buckets)))
    counts = mark.groupBy(F.col(at).alias("bucket")).agg(F.count("*").alias("n"))
    if buckets == 1:
        return mark, counts
    counts = materialize(counts, "sharding-counts")
    mean = counts.agg(F.sum("n")).first()[0] / buckets
    crowded = counts.where(F.col("n") > UNEVEN * mean + 1000).orderBy(F.desc("n"), "bucket").limit(MOST_SPLIT).collect()
    if not crowded:
        return mark, counts
    ways = F.create_map(*(F.lit(x) for r in crowded for x in (r.bucket, math.ceil(r.n / mean))))
    ways = F.coalesce(ways[F.col(at)], F.lit(1))
    # split s > 0 of bucket b is number buckets * s + b
    mark = mark.withColumn(at, F.col(at) + buckets * F.pmod(F.xxhash64(F.spark_partition_id()), ways))
    return mark, materialize(mark.groupBy(F.col(at).alias("bucket")).agg(F.count("*").alias("n")), "sharding-counts")


def with_firsts(counts: DataFrame) -> DataFrame:
    """(bucket, n, first): the place of each bucket's first record, by sums over spans of buckets."""
    span = F.floor(F.col("bucket") / SPAN)
    spans = counts.groupBy(span.alias("span")).agg(F.sum("n").alias("s"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # one row for SPAN buckets: of 100 TB a few thousand
    bases = spans.withColumn("base", F.coalesce(F.sum("s").over(earlier(Window.orderBy("span"))), F.lit(0))).select("span", "base")
    inside = counts.withColumn("span", span).withColumn("before", F.coalesce(F.sum("n").over(earlier(Window.partitionBy("span").orderBy("bucket"))), F.lit(0)))
    return inside.join(bases, "span").select("bucket", "n", (F.col("base") + F.col("before")).alias("first"))


def shuffle_into_shards(docs: DataFrame, shards: int = 8, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of docs, with every column, plus `shard` and `slot`.

    Records are told apart by id and text checksum: a group of equal texts scatters by
    its ids, rows without an id by their texts. Rows equal in both are interchangeable;
    where they crowd a bucket, they spread by input split. Null texts count as empty. An
    empty table gives no rows. Columns of docs named shard or slot are replaced; any
    other name may occur.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.drop("shard", "slot")
    kept = rows.columns
    size, crc, bucket, at, tie, first, places, number = free_names([*kept, "shard", "slot"], "_size", "_crc", "_bucket", "_at", "_tie", "_first", "_places", "_number")
    widths = {c: F.octet_length(f"`{c}`") for c, kind in rows.dtypes if kind in ("string", "binary")}
    total = rows.agg(F.sum(sum((F.coalesce(w, F.lit(0)) for w in widths.values()), F.lit(8 * len(kept)).cast("long")))).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    summed = rows.withColumn(crc, F.crc32(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")))
    mark, counts = scattered(summed, {"bucket": bucket, "crc": crc, "id": id_col}, seed, buckets)

    drawn = with_firsts(counts).repartition(max(1, math.ceil(buckets / 64)), "bucket").mapInArrow(permutations(seed), "bucket long, first long, places array<bigint>")
    drawn = drawn.toDF(bucket, first, places)
    # what tells equal keys apart is a function of the row too
    plain = [F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind and kind != "variant"]
    order = Window.partitionBy(bucket).orderBy(f"`{id_col}`", crc, tie)
    numbered = mark.withColumn(tie, F.xxhash64(*plain)).withColumn(at, F.row_number().over(order))
    # the array stands once for a bucket, and both sides are dealt by it: records do not move again
    placed = numbered.join(drawn.hint("merge"), bucket).withColumn(number, F.col(first) + F.element_at(F.col(places), F.col(at)))
    return placed.withColumn("shard", (F.col(number) % shards).cast("int")).withColumn("slot", F.floor(F.col(number) / F.lit(shards)).cast("long")).select(*(f"`{c}`" for c in kept), "shard", "slot")


def report(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) of every shuffled record."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return shuffle_into_shards(docs, shards, id_col=id_col, text_col=text_col).select(
        id_col,
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, rows_per_file: int = 1_000_000, **options) -> None:
    """Write the shuffled records as one folder per shard, in files of consecutive slots, in slot order."""
    placed = shuffle_into_shards(docs, shards, **options)
    files = max(1, math.ceil(docs.count() / rows_per_file))
    (part,) = free_names(placed.columns, "_part")
    dealt = placed.withColumn(part, F.floor(F.col("slot") / rows_per_file)).repartition(max(files, shards), "shard", part)
    dealt.sortWithinPartitions("shard", "slot").drop(part).write.partitionBy("shard").parquet(path)


def crc_of(text: str | None) -> int:
    """The checksum of a text that the report holds."""
    return zlib.crc32((text or "").encode())

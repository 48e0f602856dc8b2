"""Quality by importance resampling: hashed n-gram models of target and raw text.

Two generative models share their buckets: one of the target (a bounded sample of rows
that are labelled good), one of all raw text. Each gives a byte's probability after the
two bytes before it (hashed trigrams over hashed pairs) and the probability that a word
repeats the one before. A document's log weight is the log ratio of the two models over
a passage of REFERENCE n-grams that is like the document: the log ratio of the whole
text, divided by its n-grams and times REFERENCE, so that long texts do not outweigh
everything. Nothing else goes into it; documents that are labelled bad have no part.

The sample is drawn without replacement by Gumbel top-k: standard Gumbel noise, seeded by
the row, is added to each log weight, and the k largest sums stay. k does not follow from
the sign of the weights: it is the number of documents that weigh as much as the lightest
target document that was set aside when the models were counted, less SLACK for the noise.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import materialize, ship_package

TRIGRAMS, CONTEXTS = 1 << 14, 1 << 12
BUCKETS = TRIGRAMS + CONTEXTS + 2  # the last two: word pairs that do not repeat a word, and that do
#: Target rows at most; every ASIDE-th of them is kept from the counts.
TARGET_ROWS, ASIDE = 2000, 4
#: Bytes of labelled text that may be collected at once.
SAMPLE_BYTES = 64 << 20
#: n-grams of the passage that a weight stands for, and n-grams without evidence that a text counts as having besides its own.
REFERENCE, PRIOR = 256, 100.0
#: A word pair weighs like the letters of a word.
WORD_GRAMS = 6
SMOOTH = 0.5
#: How much lighter than the lightest target document set aside a document may be and still count for k.
SLACK = 3.0
SEED = 5


def grams(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams, of their first two bytes, and of all word pairs."""
    b = np.frombuffer(b" " + text + b" ", np.uint8).astype(np.uint32)
    if len(b) > 2:
        two = b[:-2] * np.uint32(2654435761) ^ b[1:-1] * np.uint32(40503)
        three = (two ^ b[2:] * np.uint32(2246822519)) >> np.uint32(7) & np.uint32(TRIGRAMS - 1)
        two = (two >> np.uint32(9) & np.uint32(CONTEXTS - 1)) + np.uint32(TRIGRAMS)
    else:
        two = three = b[:0]
    words = text.split()
    again = np.fromiter(map(bytes.__eq__, words[:-1], words[1:]), bool, max(0, len(words) - 1))
    return three, two, again + np.uint32(TRIGRAMS + CONTEXTS)


def count_grams(texts: list[bytes]) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    for text in texts:
        for part in grams(text):
            total += np.bincount(part, minlength=BUCKETS)
    return total


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a task's texts: a row for each bucket that has any."""
    total, parts, waiting = np.zeros(BUCKETS, np.int64), [], 0
    for batch in batches:
        for value in batch.column(0):
            found = grams((value.as_py() or "").encode())
            parts += found
            waiting += len(found[0])
            if waiting > 1 << 18:
                total += np.bincount(np.concatenate(parts), minlength=BUCKETS)
                parts, waiting = [], 0
    if parts:
        total += np.bincount(np.concatenate(parts), minlength=BUCKETS)
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["bucket", "n"])


def corpus_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts over all texts: BUCKETS numbers, whatever the size of the corpus."""
    ship_package(docs.sparkSession)
    rows = docs.select(text_col).mapInArrow(count_batches, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows:
        total[bucket] = n
    return total


@dataclass
class Model:
    """log_ratio: by bucket, target over raw; of contexts with the sign turned, as they divide."""

    log_ratio: np.ndarray

    def log_weight(self, text: bytes) -> float:
        three, two, pairs = grams(text)
        letters = (self.log_ratio[three].sum() + self.log_ratio[two].sum()) / (len(three) + PRIOR)
        words = self.log_ratio[pairs].sum() / (WORD_GRAMS * len(pairs) + PRIOR)
        return float(REFERENCE * (letters + words))


def fit(raw: np.ndarray, target: np.ndarray) -> Model:
    """The ratio of the two models, from their counts; without target text every log weight is 0."""
    ratio = np.zeros(BUCKETS)
    if not target.any():
        return Model(ratio)
    for start, stop, by, smooth in ((0, TRIGRAMS, 1, SMOOTH), (TRIGRAMS, TRIGRAMS + CONTEXTS, -1, 4 * SMOOTH), (TRIGRAMS + CONTEXTS, BUCKETS, 1, 1)):
        p, q = target[start:stop] + smooth, raw[start:stop] + smooth
        ratio[start:stop] = by * (np.log(p / p.sum()) - np.log(q / q.sum()))
    return Model(ratio)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, balance: bool = True) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; balance: classes weigh the same."""
    mid, wide = x.mean(0), x.std(0) + 1e-9
    a = np.hstack([(x - mid) / wide, np.ones((len(x), 1))])
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    if not balance:
        weight = np.full(len(y), 1 / len(y))
    beta = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + ridge * beta * np.r_[np.ones(len(mid)), 0] / 10
        hessian = (a * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ a + np.eye(a.shape[1]) * ridge / 10
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if abs(step).max() < 1e-8:
            break
    return beta[:-1] / wide, float(beta[-1] - (beta[:-1] * mid / wide).sum())


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _text, _y): at most most[class] labelled rows of a class, chosen by a hash of the id; one row of each id."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("_y"))
    picked = None
    for y in (0, 1):
        some = known.where(F.col("_y") == y).orderBy(F.xxhash64(id_col), id_col).limit(most[y])
        picked = some if picked is None else picked.union(some)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("_text")).join(F.broadcast(picked), id_col)
    return rows.groupBy(F.col(id_col).alias("_id"), "_y").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text")).select("_id", "_text", "_y")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> list[tuple[bytes, int]]:
    """(text, label) of the labelled rows, in order of id; of each class only while those before, by hash, have under SAMPLE_BYTES."""
    rows = labelled_rows(docs, labels, label, most, id_col, text_col)
    order = Window.partitionBy("_y").orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, -1)  # most[class] rows
    before = F.coalesce(F.sum(F.octet_length("_text").cast("long")).over(order), F.lit(0))
    found = rows.withColumn("_before", before).where(F.col("_before") < SAMPLE_BYTES).select("_id", "_text", "_y").collect()
    return [(r[1].encode(), r[2]) for r in sorted(found)]


def gumbel(key: str, seed: int = SEED) -> float:
    """Standard Gumbel noise that the key and the seed decide."""
    u = ((xxhash.xxh64_intdigest(key, seed) >> 11) + 0.5) / (1 << 53)
    return -math.log(-math.log(u))


def perturbed(model: Model, row_id, text: str | None) -> tuple[float, float]:
    """Log weight and perturbed log weight of a row. Equal rows have equal noise."""
    raw = (text or "").encode()
    weight = model.log_weight(raw)
    return weight, weight + gumbel(f"{row_id}:{zlib.crc32(raw)}")


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest finite double, exactly, by histograms of at most 65536 bins each.

    Each pass narrows the range to the extremes of the bin that holds the k-th value.
    """
    if k <= 0:
        return None
    keyed = df.select(column)
    low, high = keyed.agg(F.min(column), F.max(column)).first()
    if low is None:
        return None
    left = k
    for _ in range(64):
        if low == high:
            return low
        width = (high - low) / 65536
        if width == 0 or low + width == low:
            break
        bin_of = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(65535))
        rows = (
            keyed.where(F.col(column).between(low, high))
            .groupBy(bin_of.alias("bin"))
            .agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
            .collect()
        )
        for row in sorted(rows, key=lambda r: -r.bin):
            if left <= row.n:
                low, high = row.lo, row.hi
                break
            left -= row.n
        else:
            return low
    return low


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, log_weight, key) for every row."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [perturbed(model, i.as_py(), t.as_py()) for i, t in zip(batch.column(0), batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in (zip(*pairs) if pairs else ([], [])))], names=["id", "log_weight", "key"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, log_weight double, key double")
    return out.withColumnRenamed("id", id_col)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, float | None]:
    """The model, and the log weight of the lightest target document set aside, less SLACK; None without target documents."""
    target = materialize(labelled_rows(docs, labels, "quality", {0: 0, 1: TARGET_ROWS}, id_col, text_col), "resampling-target")
    aside = F.pmod(F.xxhash64("_id", F.lit(SEED)), F.lit(ASIDE)) == 0
    model = fit(corpus_counts(docs, text_col), corpus_counts(target.where(~aside), "_text"))
    if not model.log_ratio.any():
        return model, None
    lightest = lambda rows: scores(rows, model, "_id", "_text").agg(F.min("log_weight")).first()[0]
    least = lightest(target.where(aside))
    return model, (lightest(target) if least is None else least) - SLACK


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model, float | None]:
    """(id_col, log_weight, key, kept) for every row, the model, and the least kept key.

    k: rows to keep; by default as many as weigh no less than the lightest target document
    set aside, less SLACK (all, without target documents). Null texts count as empty; a text without
    n-grams has log weight 0. Rows equal in id and text share their noise and stay or go
    together; so do rows whose keys tie with the k-th. Other columns are ignored; an empty
    table gives no rows. Labels of ids that docs lacks, and null labels, count for nothing.
    """
    model, lightest = train(docs, labels, id_col, text_col)
    made = materialize(scores(docs, model, id_col, text_col), "resampling-scores")
    if k is None:
        k = made.count() if lightest is None else made.where(F.col("log_weight") >= F.lit(lightest)).count()
    least = kth_largest(made, "key", k)
    kept = F.lit(False) if least is None else F.col("key") >= F.lit(least)
    return made.withColumn("kept", kept), model, least


def filter_rows(docs: DataFrame, test: Callable[[dict], list[bool]], columns: list[str]) -> DataFrame:
    """The rows of docs for which test(columns as lists) is true; all columns pass unchanged."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns}
            yield batch.filter(pa.array(test(given), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def keep_sample(docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the sample keeps, with all columns. Scores are made anew, so no text is shuffled."""
    _, model, least = resample(docs, labels, k, id_col, text_col)
    if least is None:
        return docs.where(F.lit(False))

    def test(given: dict) -> list[bool]:
        return [perturbed(model, i, t)[1] >= least for i, t in zip(given[id_col], given[text_col])]

    return filter_rows(docs, test, [id_col, text_col])

"""Best-fit packing of documents into token sequences, after a Martello-Toth reduction.

How documents can be packed depends only on how many pieces there are of each length,
so the plan is made on the histogram of lengths (at most `capacity` counts, whatever the
size of the corpus). The reduction fixes sets of pieces that dominate every alternative,
best-fit-decreasing packs the remainder, both for whole length classes at a time. The
plan is a list of runs: pieces number first..first+count-1 of a length go to sequences
base, base+1, ... at one offset. Numbering the pieces within their length is distributed:
within (length, salt) by a window, across salts by the counts before.
"""

from __future__ import annotations

import bisect
import math
import os
import zlib
from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.session import materialize, ship_package

CAPACITY = 2048
END = (0).to_bytes(4, "little")
#: Distinct words whose ids a Python worker keeps, and the longest such word.
KEPT_WORDS, KEPT_LENGTH = 600_000, 40
#: Characters of the texts that are taken apart at once, and words whose ids are gathered at once (one text may have more).
SLICE, TOGETHER = 1 << 21, 1 << 17
#: Blanks that the pre-tokenizer may join with what stands before them; of white space, all that Unicode has.
WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
JOINED = rf"  |[{WHITE}] (?:[{WHITE}]|\z)"
#: Pieces of one length that one salt holds on average, and the least number of salts.
SALT_ROWS, LEAST_SALTS = 50_000, 64

Run = tuple[int, int, int, int, int]  # length, first, count, base, offset


def gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs numbered `at` of a flat array, end to end, and where each ends."""
    n = size[at]
    ends = np.cumsum(n)
    return flat[np.repeat(first[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends


class WordCachedTokenizer:
    """Ids of whole texts by a `tokenizers` file, with the ids of common words kept.

    The byte-level pre-tokenizer never joins what stands on both sides of a blank that has
    no blank before it, nor other white space before it and white space or the end after it.
    So a text without such blanks has the ids of its first word and of each other word with
    its blank; any other text is encoded whole. Arrow splits a batch and numbers its distinct
    words; ids stand in one flat array, from which texts are gathered by word number. Words
    not met before are encoded in one text, and cut apart where a token begins with a blank;
    those that hold one of the file's added tokens are encoded on their own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept: dict[str, int] = {}  # numbers of words; their ids stand in `flat` by number, `size` for each
        self.flat, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        blank = self.tokenizer.pre_tokenizer.pre_tokenize_str(" a")[0][0][0]
        self.begins = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.begins[i] = piece.startswith(blank)

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct words in another order, their ids with a blank before them, end to end, and how many each has."""
        line, odd = " " + " ".join(words), []
        if "" in words or any(t in line for t in self.added):
            odd = [w for w in words if not w or any(t in w for t in self.added)]
        ids, size = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        for apart in (lambda w: False, lambda w: w[:1].isspace(), lambda w: True):  # what a word before it may be joined to
            odd += [w for w in words if apart(w)]
            drop = set(odd)
            words = [w for w in words if w not in drop] if drop else words
            if not words:
                break
            (ids,) = self._raw([" " + " ".join(words) if odd else line])
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(words) and not starts[0]:
                size = np.diff(np.r_[starts, len(ids)])
                break
            ids = ids[:0]
        found = self._raw([" " + w for w in odd])
        return words + odd, np.concatenate([ids, *found]), np.r_[size, np.array([len(x) for x in found], np.int64)]

    def _apart(self, texts: pa.LargeStringArray) -> Iterator[bytes]:
        """Ids of texts that can be taken apart at every blank."""
        parts = pc.split_pattern(texts, " ")
        begin = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        words, at, heads = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), begin[:-1]
        behind = np.ones(len(at), bool)  # a blank
        behind[heads] = False
        used = np.zeros(len(words), bool)
        used[at[behind]] = True
        number = np.fromiter(map(self.kept.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(used & (number < 0)).tolist()
        names, ids, size = self._new([words[i] for i in missing])
        known = len(self.size)
        numbers = dict(zip(names, range(known, known + len(names))))
        number[missing] = [numbers[words[i]] for i in missing]
        first_words = self._raw([words[i] for i in at[heads].tolist()])
        flat = np.concatenate([self.flat, ids, *first_words])
        size = np.r_[self.size, size, np.array([len(x) for x in first_words], np.int64)]
        first = np.cumsum(size) - size
        room = KEPT_WORDS - known
        short = np.array([i for w, i in numbers.items() if len(w) <= KEPT_LENGTH][: max(0, room)], np.int64)
        if len(short):
            self.kept.update((names[i - known], known + k) for k, i in enumerate(short.tolist()))
            self.flat, self.size = np.r_[self.flat, gather(flat, first, size, short)[0]], np.r_[self.size, size[short]]
        number = number[at]
        number[heads] = np.arange(len(size) - len(heads), len(size))
        for some in pairwise(np.unique(np.r_[np.searchsorted(begin[:-1], np.arange(0, begin[-1], TOGETHER)), len(heads)]).tolist()):
            block = begin[some[0] : some[1] + 1]
            raw, ends = gather(flat, first, size, number[block[0] : block[-1]])
            cut = np.r_[0, ends[block[1:] - block[0] - 1]].tolist()
            yield from (raw[a:b].tobytes() for a, b in pairwise(cut))

    def _encode(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        whole = pc.match_substring_regex(column, JOINED)
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(at := np.flatnonzero(whole).tolist(), self._raw([texts[i] for i in at])):
            out[i] = ids.tobytes()
        rest = pc.invert(whole)
        for i, raw in zip(np.flatnonzero(rest).tolist(), self._apart(column.filter(rest))):
            out[i] = raw
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        ends = np.cumsum([len(t) for t in texts])
        at = np.searchsorted(ends, np.arange(SLICE, ends[-1], SLICE)) if texts else []
        return [ids for a, b in pairwise(np.unique(np.r_[0, at, len(texts)].astype(int)).tolist()) for ids in self._encode(texts[a:b])]


_TOKENIZERS: dict[str, WordCachedTokenizer] = {}


def tokenizer(path: str) -> WordCachedTokenizer:
    """One tokenizer for each Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordCachedTokenizer(path)
    return _TOKENIZERS[path]


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Where pieces of n tokens begin and end: only the first piece may be shorter."""
    return [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]


def cut_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row (id, piece, start, length, ids_crc32[, ids]) per piece of each document."""
    ship_package(docs.sparkSession)
    fields = "piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path).encode
        for batch in batches:
            rows, columns = [], ([], [], [], [], [])
            for at, raw in enumerate(encode([t.as_py() or "" for t in batch.column(1)])):
                raw += END
                for k, (a, b) in enumerate(pairwise(cuts(len(raw) // 4, capacity))):
                    part = raw[4 * a : 4 * b]
                    rows.append(at)
                    for column, value in zip(columns, (k, a, b - a, zlib.crc32(part), part)):
                        column.append(value)
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:4])]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(columns[4], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {fields}")


class Plan:
    """Packs a histogram of lengths; `runs` says where the pieces go, `bins` how many sequences there are."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        if any(not 0 < w <= capacity for w in counts):
            raise ValueError("a length is outside 1..capacity")
        self.capacity, self.bins, self.runs = capacity, 0, []
        self.left = {w: n for w, n in counts.items() if n > 0}
        self.used = dict.fromkeys(self.left, 0)
        self.fixed = 0
        self._reduce()
        self._best_fit()

    def _place(self, length: int, count: int, base: int, offset: int) -> None:
        """Piece after piece of a length, one into each of `count` sequences from `base` on."""
        self.runs.append((length, self.used[length], count, base, offset))
        self.used[length] += count
        self.left[length] -= count

    def _fix(self, sizes: tuple[int, ...], times: int) -> None:
        offset = 0
        for w in sizes:
            self._place(w, times, self.bins, offset)
            offset += w
        self.bins += times
        self.fixed += times

    def _smallest(self, sizes: list[int], n: int, but: int) -> list[int]:
        """The n smallest pieces left, without one piece of length `but`."""
        out: list[int] = []
        for w in sizes:
            out += [w] * min(n - len(out), self.left[w] - (w == but))
            if len(out) == n:
                break
        return out

    def _alike(self, sizes: tuple[int, ...]) -> int:
        """How often a set can be fixed at least before the choice could be another: while four pieces of each length are left."""
        return max(1, min((self.left[w] - 4) // sizes.count(w) for w in sizes))

    def _reduce(self) -> None:
        """Fix every set that dominates all other sets with its largest piece.

        For a piece j with room r beside it:
        nothing fits: j alone; a piece k fills r: {j, k}, as whatever else goes with j
        has a sum of at most k; no two pieces fit: {j, k} with the largest k that fits;
        no three fit: {j, k} if k is as large as any fitting pair's sum, or {j, a, b}
        if every fitting pair is covered by a and b place by place or by b alone.
        """
        for j in sorted(self.left, reverse=True):
            while self.left[j]:
                sizes = sorted(w for w, n in self.left.items() if n - (w == j) > 0)
                room = self.capacity - j
                at = bisect.bisect_right(sizes, room)
                if not at:
                    self._fix((j,), self.left[j])
                    continue
                k = sizes[at - 1]
                low = self._smallest(sizes, 3, j)
                if k == room or len(low) < 2 or low[0] + low[1] > room:
                    self._fix((j, k), self.left[j] // 2 if j == k else min(self.left[j], self.left[k]))
                    continue
                if len(low) == 3 and sum(low) <= room:
                    break
                pairs = []
                for a in sizes[:at]:
                    fit = bisect.bisect_right(sizes, room - a)
                    b = sizes[fit - 1] if fit else 0
                    if b == a and self.left[a] - (a == j) < 2:
                        b = sizes[fit - 2] if fit > 1 else 0
                    if b >= a:
                        pairs.append((a, b))
                if all(a + b <= k for a, b in pairs):
                    self._fix((j, k), self._alike((j, k)))
                    continue
                best = next(((a, b) for a, b in pairs if b == k and all((c <= a and d <= b) or c + d <= b for c, d in pairs)), None)
                if best is None:
                    break
                self._fix((j, best[1], best[0]), self._alike((j, *best)))

    def _best_fit(self) -> None:
        """Best-fit decreasing; sequences with equal room are kept as ranges of their numbers."""
        ranges: dict[int, list[tuple[int, int]]] = {}
        rooms: list[int] = []

        def put(room: int, base: int, count: int) -> None:
            if room and count:
                if room not in ranges:
                    bisect.insort(rooms, room)
                    ranges[room] = []
                ranges[room].append((base, count))

        for w in sorted(self.left, reverse=True):
            while self.left[w]:
                at = bisect.bisect_left(rooms, w)
                if at < len(rooms):
                    room = rooms[at]
                    base, count = ranges[room].pop()
                    if not ranges[room]:
                        del ranges[room], rooms[at]
                else:
                    room, base = self.capacity, self.bins
                    count = -(-self.left[w] // (room // w))
                    self.bins += count
                each = min(room // w, self.left[w])
                filled = min(count, self.left[w] // each)
                put(room, base + filled, count - filled)
                for k in range(each):
                    self._place(w, filled, base, self.capacity - room + k * w)
                put(room - each * w, base, filled)


def place(runs: list[Run]):
    """A function that gives each (length, number) its sequence and offset."""
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 44) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_number"))
            hit = table[np.searchsorted(keys, (length << 44) + number, "right") - 1]
            arrays = [*batch.columns, pa.array(hit[:, 3] + number - hit[:, 1]), pa.array(hit[:, 4])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "sequence_id", "offset"])

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, key: tuple[str, ...] = ("id", "piece", "ids_crc32")) -> DataFrame:
    """Adds sequence_id and offset to rows that have a `length` of 1 to capacity."""
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = Plan(histogram, capacity)
    salts = max(LEAST_SALTS, math.ceil(sum(histogram.values()) / SALT_ROWS))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).select(
        "length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")
    )
    within = Window.partitionBy("length", "_salt").orderBy(*key)
    numbered = (
        salted.withColumn("_at", F.row_number().over(within))
        .join(firsts, ["length", "_salt"])
        .withColumn("_number", F.col("_first") + F.col("_at") - 1)
        .drop("_first", "_at", "_salt")
    )
    schema = T.StructType([*numbered.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    ship_package(spark)
    return numbered.mapInArrow(place(plan.runs), schema).drop("_number")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    Each document is its ids and a closing id 0; null and empty texts are that id alone.
    Only documents over the capacity are cut. Repeated rows are packed each. Other
    columns are ignored; an empty table gives no rows.
    """
    pieces = materialize(cut_pieces(docs, tokenizer_path, id_col, text_col, capacity, with_ids), "packing-pieces")
    packed = pack_pieces(pieces, capacity)
    names = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return packed.select(F.col("id").alias(id_col), *names)

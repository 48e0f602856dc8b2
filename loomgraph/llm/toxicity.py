"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters as an embedding of the whole word plus those of its character n-grams,
all hashed. Two GRUs read a window of words in either direction, attention pools their
states, and a logit comes out. Every overlapping window of the whole text is scored; a
document's score is its highest window's, on a scale fitted to held-back documents.

Labels mark documents, not windows, so training goes in rounds: windows that stand for
a document (first by word and n-gram log-odds, then by the network's own score) are
chosen, and the network is fitted to them by backpropagation through time.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.resampling import filter_rows, labelled_sample, logistic
from loomgraph.session import give_back, ship_package

WORDS, GRAMS = 1 << 15, 1 << 15
DIM, HIDDEN = 8, 8
WINDOW, STRIDE = 24, 12
#: Labelled rows of each class that the network is fitted on, at most.
SAMPLE = {0: 4500, 1: 1500}
ROUNDS, EPOCHS, BATCH = 4, 2, 256
#: Bytes of a word at most.
LONGEST = 64
#: Words whose input a Python worker keeps, and strides of words that are run at once.
TABLE, CHUNK = 1 << 17, 4096
SEED = 8

#: ASCII bytes other than digits and letters become blanks, A-Z become a-z.
CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words; of a longer run than LONGEST bytes, consecutive pieces of it."""
    words = text.translate(CLEAN).split()
    if max(map(len, words), default=0) > LONGEST:
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def word_id(word: bytes) -> int:
    return zlib.crc32(word) & (WORDS - 1)


def gram_ids(word: bytes) -> list[int]:
    """Hashed beginnings of 2 to 6 bytes and all runs of 4 bytes of the word between its edges."""
    w = b"<" + word + b">"
    crc = zlib.crc32
    return [crc(w[:n], 1) & (GRAMS - 1) for n in range(3, min(8, len(w) + 1))] + [crc(w[i : i + 4], 2) & (GRAMS - 1) for i in range(len(w) - 3)]


def window_starts(n: int) -> range:
    """Where windows over n words begin: every STRIDE words, the last reaches the end."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def squash(x: np.ndarray) -> np.ndarray:
    """The network's bounded activation, x / (1 + |x|); gates use (1 + squash) / 2."""
    return x / (1 + np.abs(x))


@dataclass
class Network:
    """Weights; `scale` and `shift` turn a document's highest logit into log-odds."""

    word: np.ndarray  # WORDS x DIM
    gram: np.ndarray  # GRAMS x DIM
    into: np.ndarray  # DIM x 6H: update, reset, new; forward, then backward
    bias: np.ndarray  # 6H
    loop: np.ndarray  # 2 x H x 3H
    look: np.ndarray  # 2H
    read: np.ndarray  # 2H
    base: np.ndarray  # 1
    scale: float = 1.0
    shift: float = 0.0
    digest: str = ""  # of all weights, once they are final

    @staticmethod
    def fresh(rng: np.random.Generator) -> Network:
        draw = lambda *shape, by: rng.normal(0, by, shape)
        return Network(
            draw(WORDS, DIM, by=0.02), draw(GRAMS, DIM, by=0.02), draw(DIM, 6 * HIDDEN, by=0.5), np.zeros(6 * HIDDEN),
            draw(2, HIDDEN, 3 * HIDDEN, by=0.3), draw(2 * HIDDEN, by=0.3), draw(2 * HIDDEN, by=0.3), np.zeros(1),
        )

    def dense(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in ("into", "bias", "loop", "look", "read", "base")}


def forward(net: Network, x: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, dict]:
    """Logits of windows; x: T x B x DIM inputs, there: T x B, 1 where a word stands."""
    steps, size = x.shape[:2]
    a = x @ net.into + net.bias
    states = np.zeros((steps, size, 2 * HIDDEN))
    kept: dict = {"x": x, "there": there, "gates": [[None] * steps, [None] * steps]}
    for d in (0, 1):
        u, h = net.loop[d], np.zeros((size, HIDDEN))
        part = a[:, :, 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)]
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            zr = 0.5 + 0.5 * squash(part[t, :, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN] * there[t, :, None], zr[:, HIDDEN:]
            n = squash(part[t, :, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
            kept["gates"][d][t] = (h, zr[:, :HIDDEN], r, n)
            h = h + z * (n - h)
            states[t, :, HIDDEN * d : HIDDEN * (d + 1)] = h
    e = np.where(there > 0, states @ net.look, -1e9)
    e = np.exp(e - e.max(0))
    alpha = e * (there > 0)
    alpha /= np.maximum(alpha.sum(0), 1e-9)
    pooled = np.einsum("tb,tbh->bh", alpha, states)
    kept |= {"states": states, "alpha": alpha, "pooled": pooled}
    return pooled @ net.read + net.base[0], kept


def backward(net: Network, kept: dict, grad: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the dense weights and of the inputs, for d loss / d logit."""
    x, there, states, alpha, pooled = (kept[k] for k in ("x", "there", "states", "alpha", "pooled"))
    steps = len(x)
    out = {"read": pooled.T @ grad, "base": np.array([grad.sum()]), "loop": np.zeros_like(net.loop)}
    d_pooled = grad[:, None] * net.read
    d_alpha = np.einsum("bh,tbh->tb", d_pooled, states)
    d_e = alpha * (d_alpha - (alpha * d_alpha).sum(0))
    out["look"] = np.einsum("tb,tbh->h", d_e, states)
    d_states = alpha[:, :, None] * d_pooled + d_e[:, :, None] * net.look
    d_a = np.zeros((*x.shape[:2], 6 * HIDDEN))
    for d in (0, 1):
        u, carry = net.loop[d], np.zeros((x.shape[1], HIDDEN))
        at = slice(3 * HIDDEN * d, 3 * HIDDEN * (d + 1))
        for t in range(steps - 1, -1, -1) if d == 0 else range(steps):
            h, z, r, n = kept["gates"][d][t]
            dh = carry + d_states[t, :, HIDDEN * d : HIDDEN * (d + 1)]
            m = there[t, :, None]
            dn = dh * z * m * (1 - np.abs(n)) ** 2
            dz = dh * (n - h) * m * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            back = dn @ u[:, 2 * HIDDEN :].T
            dr = back * h * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            out["loop"][d, :, 2 * HIDDEN :] += (r * h).T @ dn
            both = np.hstack([dz, dr])
            out["loop"][d, :, : 2 * HIDDEN] += h.T @ both
            carry = dh * (1 - z * m) + back * r + both @ u[:, : 2 * HIDDEN].T
            d_a[t, :, at] = np.hstack([both, dn])
    flat = d_a.reshape(-1, 6 * HIDDEN)
    out["into"] = x.reshape(-1, DIM).T @ flat
    out["bias"] = flat.sum(0)
    return out, d_a @ net.into.T


class Corpus:
    """The sample as word numbers, with each distinct word's id and n-grams.

    The numbers stand in flat arrays, and windows are made when they are asked for: a sample
    has some 300 000 distinct words, whose n-grams as lists took most of the driver's Python.
    """

    def __init__(self, texts: list[bytes]):
        number: dict[bytes, int] = {}
        self.docs = [np.fromiter((number.setdefault(w, len(number)) for w in words_of(t)), np.int32) for t in texts]
        self.ids = np.fromiter(chain(map(word_id, number), [0]), np.int32, len(number) + 1)
        grams, ends = array("i"), array("q", [0])
        for word in number:
            grams.extend(gram_ids(word))
            ends.append(len(grams))
        ends.append(len(grams))  # the blank has none
        self.first, self.grams = np.array(ends), np.array(grams)
        self.blank = len(number)

    def inputs(self, net: Network, words: np.ndarray) -> np.ndarray:
        """Input vectors of distinct words."""
        return net.word[self.ids[words]] + self.summed(net.gram, words)

    def spans(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of words, end to end, and for each the place of its word."""
        n = self.first[words + 1] - self.first[words]
        of = np.repeat(np.arange(len(words)), n)
        return self.grams[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[words], n)], of

    def summed(self, table: np.ndarray, words: np.ndarray) -> np.ndarray:
        grams, of = self.spans(words)
        out = np.zeros((len(words), table.shape[1]))
        if len(of):
            begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            out[of[begin]] = np.add.reduceat(table[grams], begin, axis=0)
        return out

    def windows(self, doc: int) -> np.ndarray:
        """Word numbers of the document's windows; the blank's number fills up."""
        words = self.docs[doc]
        starts = np.array(window_starts(len(words)))
        padded = np.r_[words, np.full(WINDOW + STRIDE, self.blank, np.int32)]
        return padded[starts[:, None] + np.arange(WINDOW)]


def log_odds(corpus: Corpus, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For word and n-gram buckets: log-odds of documents that have them, shrunk where they are few."""
    out = []
    for size, of in ((WORDS, lambda d: corpus.ids[d]), (GRAMS, lambda d: corpus.spans(d)[0])):
        seen = np.zeros((2, size))
        for doc, label in zip(corpus.docs, y):
            seen[label, np.unique(of(np.unique(doc)))] += 1
        clean, toxic = seen
        odds = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((clean + 0.5) / (len(y) - y.sum() + 1))
        many = np.where(odds > 0, toxic, clean)
        out.append(np.clip(odds * many / (many + 4), -1, 6))
    return out[0], out[1]


def fit_windows(net: Network, corpus: Corpus, windows: np.ndarray, y: np.ndarray, state: dict, rng: np.random.Generator) -> None:
    """An epoch of Adam over the dense weights and Adagrad over the embeddings in use."""
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    order = rng.permutation(len(y))
    for start in range(0, len(order), BATCH):
        at = order[start : start + BATCH]
        distinct, where = np.unique(windows[at].T, return_inverse=True)
        where = where.reshape(WINDOW, len(at))
        x, there = corpus.inputs(net, distinct)[where], (windows[at].T != corpus.blank).astype(float)
        logit, kept = forward(net, x, there)
        grad = weight[at] * (sigmoid(logit) - y[at]) / len(at)
        grads, d_x = backward(net, kept, grad)
        state["t"] += 1
        for k, w in net.dense().items():
            m, v = state.setdefault(k, (np.zeros_like(w), np.zeros_like(w)))
            g = np.clip(grads[k], -1, 1)
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= 0.02 * (m / (1 - 0.9 ** state["t"])) / (np.sqrt(v / (1 - 0.999 ** state["t"])) + 1e-8)
        d_word = np.zeros((len(distinct), DIM))
        np.add.at(d_word, where.ravel(), (d_x * there[:, :, None]).reshape(-1, DIM))
        grams, of = corpus.spans(distinct)
        for name, ids, g in (("word", corpus.ids[distinct], d_word), ("gram", grams, d_word[of])):
            rows, inverse = np.unique(ids, return_inverse=True)
            total = np.zeros((len(rows), DIM))
            np.add.at(total, inverse, g)
            square = state.setdefault(name, np.full_like(getattr(net, name), 1e-6))
            square[rows] += total**2
            getattr(net, name)[rows] -= 0.02 * total / np.sqrt(square[rows])


def train(sample: list[tuple[bytes, int]], seed: int = SEED, hints: bool = True) -> Network | None:
    """A network fitted on labelled texts; None without both classes.

    hints: whether embeddings begin at the log-odds of words and n-grams, or at random.
    """
    y = np.array([label for _, label in sample], dtype=np.int64)
    if len(y) < 2 or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    aside = np.zeros(len(y), bool)  # every fourth of each class fits the scale only
    for label in (0, 1):
        of = np.flatnonzero(y == label)
        aside[of[3::4]] = True
    learn, held = np.flatnonzero(~aside), np.flatnonzero(aside)
    corpus = Corpus([sample[i][0] for i in learn])
    give_back()
    label = y[learn]
    by_word, by_gram = log_odds(corpus, label)
    if hints:
        net.word[:, 0] = by_word / 2
        net.gram[:, 1] = by_gram / 4
    hint = by_word[corpus.ids]
    for start in range(0, len(hint), CHUNK):
        some = np.arange(start, min(start + CHUNK, len(hint)))
        hint[some] += corpus.summed(by_gram[:, None], some)[:, 0] / 2
    hint[corpus.blank] = -9
    rank = [hint[corpus.windows(i)].max(1) for i in range(len(learn))]
    state: dict = {"t": 0}
    for turn in range(ROUNDS):
        chosen, of = [], []
        for i, (score, one) in enumerate(zip(rank, label)):
            best = np.argsort(-score, kind="stable")[:1]
            picked = best if one else np.r_[best, rng.integers(0, len(score), 1)]
            chosen.append(corpus.windows(i)[picked])
            of.append(np.full(len(picked), one))
        stacked, target = np.vstack(chosen), np.concatenate(of)
        for _ in range(EPOCHS):
            fit_windows(net, corpus, stacked, target, state, rng)
        if turn + 1 < ROUNDS:
            rank = Scorer(net).window_logits([sample[i][0] for i in learn])
        give_back()
    del corpus, state
    give_back()
    if not len(held):
        held = np.arange(len(y))
    top = np.array([x.max() for x in Scorer(net).window_logits([sample[i][0] for i in held])])
    scale, net.shift = logistic(top[:, None], y[held], balance=False)
    net.scale = float(max(scale[0], 1e-3))
    numbers = [net.word, net.gram, *net.dense().values(), np.array([net.scale, net.shift])]
    net.digest = xxhash.xxh3_128_hexdigest(b"".join(np.ascontiguousarray(x).tobytes() for x in numbers))
    return net


class Scorer:
    """Scores whole texts. Inputs of words are kept, already multiplied by the input weights."""

    def __init__(self, net: Network):
        self.net = net
        by_word = net.word @ net.into
        by_word += net.bias
        self.by_word = by_word.astype(np.float32)
        del by_word
        self.by_gram = (net.gram @ net.into).astype(np.float32)
        self.loop = [np.ascontiguousarray(u.T, np.float32) for u in net.loop]
        self.out = [np.stack([net.look[p], net.read[p]]).astype(np.float32) for p in (slice(HIDDEN), slice(HIDDEN, None))]
        self.slot: dict[bytes, int] = {}
        self.table = np.zeros((TABLE, 6 * HIDDEN), np.float32)

    def slots(self, words: list[bytes]) -> np.ndarray:
        """Table rows of words, at most half as many as the table has; row 0 is of no word."""
        at = np.fromiter(map(self.slot.get, words, repeat(0)), np.int64, len(words))
        if not at.all():
            new = list(dict.fromkeys(w for w, i in zip(words, at.tolist()) if not i))
            if len(self.slot) + len(new) + 1 > TABLE:
                self.slot.clear()  # rows are written again before they are read
                new = list(dict.fromkeys(words))
            grams = [gram_ids(w) for w in new]
            begin = np.cumsum([0] + [len(g) for g in grams[:-1]])
            first = len(self.slot) + 1
            flat = np.fromiter((i for g in grams for i in g), np.int64)
            self.table[first : first + len(new)] = self.by_word[[word_id(w) for w in new]] + np.add.reduceat(self.by_gram[flat], begin, axis=0)
            self.slot.update(zip(new, range(first, first + len(new))))
            at = np.fromiter(map(self.slot.get, words), np.int64, len(words))
        return at

    def run(self, strides: np.ndarray) -> np.ndarray:
        """Logits of the windows that begin at each stride but the last; strides: table rows, 0 where no word stands."""
        size = len(strides) - 1
        x = np.empty((STRIDE, 6 * HIDDEN, size + 1), np.float32)
        for k in range(STRIDE):
            x[k] = self.table[strides[:, k]].T
        mask = np.ascontiguousarray(strides.T > 0, np.float32)
        e, value = np.zeros((2, WINDOW, size), np.float32)
        zr, zr_abs = np.empty((2, 2 * HIDDEN, size), np.float32)
        n, n_abs, rh = np.empty((3, HIDDEN, size), np.float32)
        for d in (0, 1):
            gates, new = self.loop[d][: 2 * HIDDEN], self.loop[d][2 * HIDDEN :]
            part = x[:, 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)]
            h = np.zeros((HIDDEN, size), np.float32)
            for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                k, at = t % STRIDE, slice(t // STRIDE, t // STRIDE + size)
                np.matmul(gates, h, out=zr)
                zr += part[k, : 2 * HIDDEN, at]
                np.abs(zr, out=zr_abs)
                zr_abs += 1
                zr /= zr_abs
                zr += 1
                zr *= 0.5
                np.multiply(zr[HIDDEN:], h, out=rh)
                np.matmul(new, rh, out=n)
                n += part[k, 2 * HIDDEN :, at]
                np.abs(n, out=n_abs)
                n_abs += 1
                n /= n_abs
                n -= h
                n *= zr[:HIDDEN]
                n *= mask[k, at]
                h += n
                both = self.out[d] @ h
                e[t] += both[0]
                value[t] += both[1]
        live = np.concatenate([mask[:, :-1], mask[:, 1:]])
        e = np.where(live > 0, e, np.float32(-1e9))
        e = np.exp(e - e.max(0)) * live
        return (e * value).sum(0) / np.maximum(e.sum(0), np.float32(1e-9)) + self.net.base[0]

    def window_logits(self, texts: list[bytes]) -> list[np.ndarray]:
        """The logits of every window of each text, texts end to end in strides of words."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        rows: list[np.ndarray] = []  # strides with their table rows; what waits for the next run
        marks: list[tuple[int, int]] = []  # (text, its windows)
        waiting = 0

        def flush() -> None:
            nonlocal waiting
            if marks:
                logits = self.run(np.vstack(rows))
                at = 0
                for text, n in marks:
                    out[text].append(logits[at : at + n])
                    at += n + 1
            rows.clear()
            marks.clear()
            waiting = 0

        for number, text in enumerate(texts):
            words = words_of(text)
            windows = len(window_starts(len(words)))
            for begin in range(0, windows, CHUNK):
                n = min(CHUNK, windows - begin)
                part = words[begin * STRIDE : (begin + n + 1) * STRIDE]
                if len(self.slot) + len(part) + 1 > TABLE:
                    flush()  # the table may be cleared
                strides = np.zeros((n + 1) * STRIDE, np.int64)
                strides[: len(part)] = self.slots(part)
                rows.append(strides.reshape(-1, STRIDE))
                marks.append((number, n))
                waiting += n + 1
                if waiting >= CHUNK:
                    flush()
        flush()
        return [np.concatenate(x) for x in out]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Score of each text, 0 to 1."""
        top = np.array([x.max() for x in self.window_logits(texts)], dtype=float)
        return sigmoid(top * self.net.scale + self.net.shift)


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network | None:
    """Fitted on labelled rows whose crc32 of the id as text isn't divisible by 5."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0
    net = train(labelled_sample(docs, labels.where(fold), "toxic", SAMPLE, id_col, text_col))
    give_back()
    return net


def score_texts(net_of, texts: list[str | None]) -> np.ndarray:
    if net_of is None:
        return np.zeros(len(texts))
    return net_of.scores([(t or "").encode() for t in texts])


_SCORERS: dict[str, Scorer] = {}


def scorer_of(block) -> Scorer | None:
    """One scorer for each broadcast network and Python worker."""
    if block.value is None:
        return None
    if block.value.digest not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[block.value.digest] = Scorer(block.value)
    return _SCORERS[block.value.digest]


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of docs.

    Null texts count as empty and are scored as a window without words. Without labelled
    rows of both classes every score is 0. Repeated rows come back repeated; a null id is
    held out of nothing (held_out false). Other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    block = spark.sparkContext.broadcast(fit_on(docs, labels, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(block)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(scorer, batch.column(1).to_pylist()))], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return made.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score below 0.5, with all columns."""
    block = docs.sparkSession.sparkContext.broadcast(fit_on(docs, labels, id_col, text_col))

    def test(given: dict) -> list[bool]:
        return (score_texts(scorer_of(block), given[text_col]) < 0.5).tolist()

    return filter_rows(docs, test, [text_col])

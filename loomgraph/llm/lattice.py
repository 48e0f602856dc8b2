"""SentencePiece encoding and decoding with sampled segmentations.

The lattice of a text has an edge for every piece that matches somewhere. No piece has
its blank mark after another character, so the lattice is a chain of word lattices, and
each distinct word's lattice is built once. Backward sums make every choice of a piece a
conditional probability, so a segmentation is a path in a tree of choices.

Gumbel top-k without replacement is an A* search of that tree: a set of segmentations
has a perturbed bound, a Gumbel variable at its log mass, truncated at the bound of the
set it was split from. The set with the highest bound gives up its best segmentation, an
exact sample of it, and what remains is split at every choice made. The k segmentations
found have the k highest perturbed log probabilities; the next bound is the threshold
that inclusion probabilities follow from. All numbers are hashes of the row's key.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import ship_package

MARK = "▁"
SAMPLES = 2
SEED = 2
#: A byte's weight where no piece has a character; tree states that a worker keeps.
BYTE_WEIGHT, KEPT_STATES = -12.0, 2_500_000
#: Texts sampled at once, and their bytes (one text may have more).
TOGETHER, TOGETHER_BYTES = 128, 1 << 20
#: Bits of a counter that number a word's steps, and its words.
STEP_BITS, WORD_BITS = 28, 28
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces:
    """The pieces of a model file, with a Zipf weight -log(2 + rank) for each."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.weight: list[float] = []
        self.byte_ids = {}
        rank = 0
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
                self.weight.append(BYTE_WEIGHT)
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
                self.weight.append(-math.inf)
            else:
                rank += 1
                self.ids[piece] = i
                self.bytes_of.append(piece.encode())
                self.weight.append(-math.log(2 + rank))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has its blank mark after another character")
        self.spellings = pa.array(self.bytes_of, pa.large_binary())
        self._trie()

    def _trie(self) -> None:
        """All pieces as a trie: a node's children stand in one table, each at the node's base plus its character.

        A place holds the key (node, character) and the node after it; a base is moved until
        its children's places are free. trie_piece is a node's piece or -1.
        """
        nodes, ends, number = {}, {}, 1
        for piece, i in self.ids.items():
            at = 0
            for c in piece:
                if (at, c) not in nodes:
                    nodes[at, c] = number
                    number += 1
                at = nodes[at, c]
            ends[at] = i
        children: dict[int, list[tuple[int, int]]] = {}
        for (at, c), node in nodes.items():
            children.setdefault(at, []).append((ord(c), node))
        sizes = ((1 << bits) - 1 for bits in (min(21, (4 * number).bit_length()), 21))  # of 21 bits no two characters fall on one place
        self.trie_last = next(last for last in sizes if all(len({c & last for c, _ in x}) == len(x) for x in children.values()))
        key, after, base = np.full(self.trie_last + 1, -1), np.zeros(self.trie_last + 1, np.int64), np.zeros(number, np.int64)
        taken: set[int] = set()
        for at, some in sorted(children.items(), key=lambda x: -len(x[1])):
            start = at * 0x9E3779B1
            while not taken.isdisjoint(places := [start + c & self.trie_last for c, _ in some]):
                start += 0x9E37
            taken.update(places)
            base[at] = start & self.trie_last
            for place, (c, node) in zip(places, some):
                key[place], after[place] = at << 21 | c, node
        self.trie_key, self.trie_node, self.trie_base = key, after, base
        self.trie_piece = np.array([ends.get(n, -1) for n in range(number)])

    def matches(self, chars: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, piece) of every piece that begins at a place, longest first; left: characters from there to the word's end."""
        places, lengths, found = [], [], []
        at, node, depth = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
        while len(at):
            c = chars[at + depth]
            hit = self.trie_base[node] + c & self.trie_last
            ok = self.trie_key[hit] == (node << 21 | c)
            at, node = at[ok], self.trie_node[hit[ok]]
            depth += 1
            piece = self.trie_piece[node]
            there = piece >= 0
            places.append(at[there])
            lengths.append(np.full(there.sum(), depth))
            found.append(piece[there])
            more = left[at] > depth
            at, node = at[more], node[more]
        return tuple(np.concatenate(x[::-1]) for x in (places, lengths, found))

    def split(self, text: str) -> list[str]:
        """Words with the blank marks before them; a text gets one blank in front."""
        return WORD.findall(MARK + text.replace(" ", MARK)) if text else []

    def words(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct words of texts in order, the place of each word among them, end to end, and how many words each text has."""
        odd = lambda t: "  " in t or t[0] == " " or t[-1] == " " or MARK in t  # noqa: E731  # words are not what stands between blanks
        lines = [None if not t else " ".join([w[1:] for w in self.split(t)]) if odd(t) else t for t in texts]
        parts = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
        coded = parts.flatten().dictionary_encode()
        return [MARK + w for w in coded.dictionary.to_numpy(zero_copy_only=False)], coded.indices.to_numpy(), np.diff(parts.offsets.to_numpy())

    def spelled(self, ids: np.ndarray) -> bytes:
        """The bytes of pieces, end to end, with blank marks."""
        if not len(ids):
            return b""
        taken = self.spellings.take(pa.array(ids))
        _, ends, flat = taken.buffers()
        return flat.slice(0, int(np.frombuffer(ends, np.int64)[len(ids)])).to_pybytes()

    def marked(self, text: str) -> bytes | None:
        """The bytes that pieces of the text spell; None if it has a blank mark itself."""
        return None if MARK in text else (MARK + text.replace(" ", MARK)).encode(errors="replace") if text else b""

    def decodes_to(self, ids: np.ndarray, text: str, marked: bytes | None = None) -> bool:
        """Whether decode(ids) gives the text; marked: what `marked` gives, if it is known."""
        if marked is None:
            marked = self.marked(text)
        return self.decode(ids.tolist()) == text if marked is None else self.spelled(ids) == marked

    def decode(self, ids: list[int]) -> str:
        """The text that was encoded (of which a blank mark itself comes back as a blank)."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids)).decode(errors="replace").replace(MARK, " ")
        return raw[1:] if raw.startswith(" ") else raw


EDGE = np.dtype([("upto", "f8"), ("log_p", "f8"), ("to", "i4"), ("of", "i4"), ("piece", "i4")], align=True)


class Lattices:
    """Choices of many words: states numbered on end, the edges of a state in order.

    upto: probability of the edge and those before it; log_p: conditional; of: the state;
    to: the next, -1 at a word's end; first: index of a state's first edge.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.weight = np.array(pieces.weight)
        self.clear()

    def clear(self) -> None:
        self.start: dict[str, int] = {}
        self.states, self.edges = 0, 0
        self._hold(np.zeros(1 << 12, EDGE))
        self.first = np.zeros(1 << 12, np.int64)
        self.spelled: list[tuple[int, ...]] = []  # of edges that stand for the bytes of a character, numbered -1, -2, ...

    def add(self, words: list[str]) -> None:
        """Build the lattices of distinct new words."""
        if not words:
            return
        lengths = np.array([len(w) for w in words])
        bases = np.cumsum(lengths) - lengths
        count = int(lengths.sum())
        self.start.update(zip(words, (bases + self.states).tolist()))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        left = np.repeat(bases + lengths, lengths) - np.arange(count)
        state, width, piece = self.pieces.matches(chars, left)
        weight = self.weight[piece]
        alone = np.ones(count, bool)
        alone[state[width == 1]] = False  # characters that are no piece are spelled in bytes
        missing = np.flatnonzero(alone)
        if len(missing):
            spelled = [tuple(self.pieces.byte_ids[b] for b in chr(c).encode(errors="replace")) for c in chars[missing].tolist()]
            numbers = []
            for raw in spelled:  # one byte is a piece of its own
                if len(raw) > 1:
                    self.spelled.append(raw)
                numbers.append(raw[0] if len(raw) == 1 else -len(self.spelled))
            state, width = np.r_[state, missing], np.r_[width, np.ones(len(missing), np.int64)]
            piece, weight = np.r_[piece, numbers], np.r_[weight, [BYTE_WEIGHT * len(x) for x in spelled]]
        order = np.argsort(state, kind="stable")
        state, width, piece, weight = state[order], width[order], piece[order], weight[order]
        end = np.where(left[state] == width, -1, state + width)
        first = np.searchsorted(state, np.arange(count + 1))
        edge_n = np.diff(first)
        beta = np.zeros(count + 1)  # the last stands for a word's end
        for k in range(1, int(lengths.max()) + 1):
            s = np.flatnonzero(left == k) if k == 1 or count < 4096 else (bases + lengths - k)[lengths >= k]
            n = edge_n[s]
            begin = np.cumsum(n) - n
            e = np.repeat(first[s] - begin, n) + np.arange(n.sum())
            value = weight[e] + beta[end[e]]
            top = np.maximum.reduceat(value, begin)
            beta[s] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, n)), begin))
        log_p = np.where(edge_n[state] == 1, 0.0, np.minimum(weight + beta[end] - beta[state], 0.0))
        p = np.exp(log_p)
        total = np.cumsum(p)
        before = total - p
        upto = np.minimum((total - before[first[:-1]][state]) / np.add.reduceat(p, first[:-1])[state], 1.0)
        upto[first[1:] - 1] = 2.0
        self._grow(len(state), count)
        a, b = self.edges, self.edges + len(state)
        self.upto[a:b], self.log_p[a:b], self.piece[a:b], self.of[a:b] = upto, log_p, piece, state + self.states
        self.to[a:b] = np.where(end < 0, -1, end + self.states)
        self.first[self.states : self.states + count + 1] = first + self.edges
        self.edges, self.states = b, self.states + count

    def _hold(self, table: np.ndarray) -> None:
        """An edge's fields stand side by side, so that a walk touches one place in memory."""
        self.table = table
        self.upto, self.log_p, self.to, self.of, self.piece = (table[f] for f in EDGE.names)

    def _grow(self, edges: int, states: int) -> None:
        if self.edges + edges > len(self.table):
            new = np.zeros(max(self.edges + edges, 2 * len(self.table)), EDGE)
            new[: self.edges] = self.table[: self.edges]
            self._hold(new)
        if self.states + states + 1 > len(self.first):
            new = np.zeros(max(self.states + states + 1, 2 * len(self.first)), np.int64)
            new[: self.states + 1] = self.first[: self.states + 1]
            self.first = new

    def starts(self, words: list[str]) -> np.ndarray:
        """First states of words."""
        get = self.start.get
        found = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        new = found < 0
        if new.any():
            missing = list(compress(words, new.tolist()))
            self.add(list(dict.fromkeys(missing)))
            found[new] = np.fromiter(map(get, missing), np.int64, len(missing))
        return found


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64 of unsigned numbers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(seed: np.ndarray, *numbers: np.ndarray | int) -> np.ndarray:
    """Numbers between 0 and 1, both excluded, that seeds and counters decide."""
    for n in numbers:
        seed = mix(np.atleast_1d(seed + np.atleast_1d(n).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))
    return ((seed >> np.uint64(12)).astype(float) + 0.5) / (1 << 52)


FULL = (1 << 64) - 1


def uniform_one(seed: int, *numbers: int) -> float:
    """The same for one counter, in plain whole numbers."""
    for n in numbers:
        x = (seed + n * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & FULL
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & FULL
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & FULL
        seed = x ^ (x >> 31)
    return ((seed >> 12) + 0.5) / (1 << 52)


def walk(lattices: Lattices, state: np.ndarray, word: np.ndarray, doc: np.ndarray, seed: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Random choices from states of words to the words' ends; (edges, index of their word in `word`), in order."""
    at, edges, walkers, step = np.arange(len(state)), [], [], 0
    own, counter = seed[doc], (turn << STEP_BITS + WORD_BITS) + (word << STEP_BITS)
    while len(at):
        u = uniform(own, counter + step)
        e = lattices.first[state]
        later = np.flatnonzero(u >= lattices.upto[e])
        while len(later):
            e[later] += 1
            later = later[u[later] >= lattices.upto[e[later]]]
        edges.append(e)
        walkers.append(at)
        state = lattices.to[e]
        live = np.flatnonzero(state >= 0)
        at, state, own, counter = at[live], state[live], own[live], counter[live]
        step += 1
    if not edges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    who = np.concatenate(walkers)
    order = np.argsort(who, kind="stable")
    return np.concatenate(edges)[order], who[order]


def truncated(log_mass: float, u: float, bound: float) -> float:
    """A Gumbel variable at a log mass, given that it does not exceed a bound."""
    if log_mass == -math.inf:
        return -math.inf
    x, y = -bound, math.log(-math.log(u)) - log_mass
    return -(max(x, y) + math.log1p(math.exp(-abs(x - y))))


def log_rest(log_p: np.ndarray) -> np.ndarray:
    """log(1 - exp(log_p))."""
    with np.errstate(divide="ignore"):
        return np.log(-np.expm1(np.minimum(log_p, 0)))


def log_rest_one(log_p: float) -> float:
    return math.log(-math.expm1(log_p)) if log_p < 0 else -math.inf


class Leaf:
    """A found segmentation and the sets of others beside it.

    One set for each choice from `free` on: those that agree before it and choose another
    piece there. The sets are held as one group, which has one bound, a Gumbel variable at
    their common mass: the largest of several is that, and which set it belongs to follows
    their shares. When a set gives up a segmentation, what it still has stands in `rests`.
    """

    def __init__(self, lattices: Lattices, edges: np.ndarray, words: np.ndarray, bound: float, free: int, seed: int, turn: int):
        self.edges, self.words, self.bound, self.free = edges, words, bound, free
        self.each = lattices.log_p[edges]
        tail, head = float(self.each[free:].sum()), float(self.each[:free].sum())
        self.log_p = head + tail
        mass = head + log_rest_one(tail) if len(edges) > free else -math.inf
        self.group = truncated(mass, uniform_one(seed, 4 << 20, turn), bound)
        self.before = self.mass = None  # log probability before each choice from `free` on, and of the set beside it while it is in the group
        self.rests: dict[int, tuple[float, float, list[int]]] = {}  # choice: (bound, log probability before it, edges taken)

    def top(self) -> float:
        """The highest bound of any set beside this segmentation."""
        return max([self.group, *(r[0] for r in self.rests.values())])

    def split(self, lattices: Lattices, seed: int, turn: int) -> tuple[int, int]:
        """Take a segmentation's first differing choice out of the set with the highest bound: (place, edge)."""
        bound = self.top()
        u = [uniform_one(seed, 2 << 20, turn * 4 + i) for i in range(4)]
        if bound == self.group:
            if self.mass is None:
                log_p = self.each
                self.before = (np.cumsum(log_p) - log_p)[self.free :]
                self.mass = self.before + log_rest(log_p[self.free :])
            mass = self.mass
            most = float(mass.max())
            share = np.exp(mass - most)
            upto = np.cumsum(share)
            t = int(np.searchsorted(upto, u[0] * upto[-1], "right"))
            if t >= len(share) or not share[t]:
                t = int(np.flatnonzero(share)[-1])
            left = float(upto[-1] - share[t]) if upto[-1] > 2 * share[t] else float(share[:t].sum() + share[t + 1 :].sum())
            prefix, mass[t] = float(self.before[t]), -np.inf
            t += self.free
            self.group = truncated(math.log(left) + most if left > 0 else -math.inf, u[1], bound)
            taken = [int(self.edges[t])]
        else:
            t = next(i for i, r in self.rests.items() if r[0] == bound)
            _, prefix, taken = self.rests[t]
        s = int(lattices.of[self.edges[t]])
        first, last = int(lattices.first[s]), int(lattices.first[s + 1])
        p = [0.0 if e in taken else math.exp(x) for e, x in enumerate(lattices.log_p[first:last].tolist(), first)]
        at, aim = len(p) - 1, u[2] * sum(p)
        for i, x in enumerate(p):
            if x > 0:
                at = i
                aim -= x
                if aim < 0:
                    break
        taken = [*taken, first + at]
        p[at] = 0.0
        left = sum(p)
        rest = prefix + math.log(left) if left > 0 else -math.inf
        self.rests[t] = (truncated(rest, u[3], bound), prefix, taken)
        return t, taken[-1]


def sample(lattices: Lattices, texts: list[str], keys: list[str], k: int, seed: int = SEED) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k distinct segmentations (ids, log probability, perturbed, log inclusion probability)."""
    words, at, lengths = lattices.pieces.words(texts)
    own = [xxhash.xxh64_intdigest(key, seed) for key in keys]
    seeds, n = np.array(own, np.uint64), len(texts)
    begin = np.cumsum(lengths) - lengths  # of each text's words in `first`
    first = lattices.starts(words)[at]
    docs = np.repeat(np.arange(n), lengths)
    number = np.arange(len(first)) - np.repeat(begin, lengths)
    root = -np.log(-np.log(uniform(seeds, 1 << 20)))
    leaves: list[list[Leaf]] = [[] for _ in range(n)]  # per text, in the order found
    edges, who = walk(lattices, first, number, docs, seeds, 0)
    place = number[who]
    cut = np.searchsorted(docs[who], np.arange(n + 1)).tolist()
    for d in range(n):
        part = slice(cut[d], cut[d + 1])
        leaves[d].append(Leaf(lattices, edges[part], place[part], float(root[d]), 0, own[d], 0))
    for turn in range(1, k):
        # the first choice of each new segmentation, then the rest of its word and the words after
        w_state, w_number, counts, heads = [], [], [], []
        for d in range(n):
            leaf = max(leaves[d], key=Leaf.top)
            bound = leaf.top()
            if bound == -math.inf:
                continue
            t, chosen = leaf.split(lattices, own[d], turn)
            here = int(leaf.words[t])
            nxt = int(lattices.to[chosen])
            if nxt >= 0:
                w_state.append([nxt])
                w_number.append([here])
            after = slice(begin[d] + here + 1, begin[d] + lengths[d])
            w_state.append(first[after])
            w_number.append(number[after])
            counts.append((nxt >= 0) + int(lengths[d]) - here - 1)
            heads.append((d, bound, t, leaf, chosen, here))
        if not heads:
            break
        state, place = (np.concatenate(x).astype(np.int64, copy=False) for x in (w_state, w_number))
        docs = np.repeat(np.array([h[0] for h in heads]), counts)
        edges, who = walk(lattices, state, place, docs, seeds, turn)
        place, doc_of = place[who], docs[who]
        cut = np.searchsorted(doc_of, np.array([h[0] for h in heads])).tolist() + [len(doc_of)]
        for i, (d, bound, t, leaf, chosen, here) in enumerate(heads):
            part = slice(cut[i], cut[i + 1])
            all_edges = np.concatenate([leaf.edges[:t], [chosen], edges[part]])
            all_words = np.concatenate([leaf.words[:t], [here], place[part]])
            leaves[d].append(Leaf(lattices, all_edges, all_words, bound, t + 1, own[d], turn))
    found = []
    for d in range(n):
        threshold = max(map(Leaf.top, leaves[d]))
        out = []
        for leaf in leaves[d]:
            ids = _ids(lattices, leaf.edges)
            x = leaf.log_p - threshold
            inclusion = 0.0 if threshold == -math.inf or x > 4 else math.log(-math.expm1(-math.exp(x))) if x > -30 else x
            out.append((ids, leaf.log_p, leaf.bound, inclusion))
        found.append(out)
    return found


def _ids(lattices, edges: np.ndarray) -> np.ndarray:
    ids = lattices.piece[edges]
    if ids.min(initial=0) < 0:
        ids = np.array([y for x in ids.tolist() for y in ((x,) if x >= 0 else lattices.spelled[-x - 1])], np.int32)
    return ids


_LATTICES: dict[str, Lattices] = {}


def lattices_of(path: str) -> Lattices:
    """One set of lattices for each model file and Python worker."""
    if path not in _LATTICES:
        _LATTICES[path] = Lattices(Pieces(path))
    return _LATTICES[path]


def together(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most TOGETHER rows, and of TOGETHER_BYTES bytes or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (i - start >= TOGETHER or held + size > TOGETHER_BYTES):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def sample_segmentations(docs: DataFrame, model_path: str, k: int = SAMPLES, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id_col, sample, n_pieces, log_prob, perturbed, log_inclusion, ids_crc32, round_trip[, ids]).

    Up to k distinct segmentations of every text, those with the highest perturbed log
    probabilities, in that order from sample 0. log_inclusion is the log probability that
    a segmentation is among them, given the threshold below the last (0 if there is no
    other). ids_crc32 is of little-endian 32-bit ids; round_trip tells whether decoding
    gives the text. Null and empty texts have one segmentation, of no pieces. Rows equal
    in id and text get equal samples; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    fields = "sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids_crc32 long, round_trip boolean"
    kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()]
    if with_ids:
        fields, kinds = fields + ", ids binary", [*kinds, pa.binary()]
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = lattices_of(model_path)
        for batch in batches:
            for part in together(batch):
                texts = [t.as_py() or "" for t in part.column(1)]
                if lattices.states > KEPT_STATES:
                    lattices.clear()
                keys = [f"{i.as_py()}" for i in part.column(0)]
                rows, columns = [], [[] for _ in kinds]
                for at, (text, found) in enumerate(zip(texts, sample(lattices, texts, keys, k, seed))):
                    marked = lattices.pieces.marked(text)
                    for number, (ids, log_p, perturbed, inclusion) in enumerate(found):
                        raw = ids.astype("<u4").tobytes()
                        values = (number, len(ids), log_p, perturbed, inclusion, zlib.crc32(raw), lattices.pieces.decodes_to(ids, text, marked), raw)
                        rows.append(at)
                        for column, value in zip(columns, values):
                            column.append(value)
                arrays = [part.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, kind) for c, kind in zip(columns, kinds))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {fields}")
    return out.withColumnRenamed("id", id_col)

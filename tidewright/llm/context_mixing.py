"""LM scoring by logistic context mixing: every token as bits of a code, each bit predicted from hashed contexts, mixed with gated weights."""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain, islice, repeat
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import cut, written
from tidewright.llm.quality_classifier import held_out

#: Hashed contexts of a bit. Of a token: the last hub, the word before (if it isn't frequent, the last hub), and the last two hubs.
#: Its bits from the DEEPth on, which tell rare tokens apart, have weights of their own, and all have one more input, the tree's own
#: counts. Of a byte of a spelled token: the last hub with two bytes before it in the token, three, five, eight, the last hub with one,
#: and four. Each context of either has a table.
CONTEXTS, SPELLING, DEEP = 3, 6, 9
#: Kinds of bits.
HEAD, TAIL, SPELLED = 0, 1, 2
#: Most slots of a context's table, as a power of two. Smaller corpora have four to eight slots for each training token.
SLOT_BITS = 21
#: Sets of mixing weights for each kind: by how often the contexts were seen.
GATES = (6, 5, 5)
GATED = math.prod(GATES)
SETS = 3 * GATED
#: Steps of the final adaptive map, for each set of weights.
STEPS = 33
RATE = 0.05
#: Bits of one step of learning.
STEP_ROWS = 1 << 14
#: Tokens and bytes of a numpy block; a longer text is cut, and contexts begin anew.
BLOCK, PIECE = 8192, 1 << 16
#: Symbols whose pairs with their contexts are counted together.
PAIRS = 1 << 20
#: Partitions that one counting task takes, where there are more than cores, so that few tables are shuffled.
TASK_PARTS = 4
#: Training tokens of a shard, in which one mixer learns, about, and of the texts that it is handed at a time; most shards of a task.
SHARD, HANDED, TASK_SHARDS = 1 << 19, 1 << 16, 64
#: Tokens that have a code of their own, at most, and the bytes of the longest; the others are spelled.
FREQUENT, LONGEST = 1 << 18, 64
#: Of the tokens by frequency: those that are hubs, those of a pair of hubs, those that a word before is told apart by.
HUBS, PAIRED, BEFORE = 256, 64, 4096
#: Bytes of texts that are parted into words at a time; slices whose words are counted together; rows handed on at a time.
SLICE, SLICES, OUT = 1 << 22, 8, 1 << 14

#: The end of a document, counted as a token. No word has this byte: it is white space.
END = b"\n"
#: Follows each spelled token.
STOP = 0x20

_LOG10_2 = math.log10(2)
_ODD, _STEP, _FIB = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint32(0x9E3779B1)


def _hashed(x: np.ndarray) -> np.ndarray:
    """32 bits of a 64-bit hash."""
    x = x * _ODD
    return ((x ^ (x >> np.uint64(29))) * _STEP >> np.uint64(32)).astype(np.uint32)


#: A count as one of LEVELS: exact below 24, then in quarters of a doubling.
LEVELS, EXACT = 64, 24
_COUNT = np.where(np.arange(LEVELS) < EXACT, np.arange(LEVELS), EXACT * 2.0 ** ((np.arange(LEVELS) - EXACT) / 4))


def _coded(n: np.ndarray) -> np.ndarray:
    out = np.minimum(n, EXACT).astype(np.uint16)
    big = n >= EXACT
    out[big] = np.minimum(EXACT + np.rint(4 * np.log2(n[big] / EXACT)), LEVELS - 1)
    return out


def _own(bits: np.ndarray) -> np.ndarray:
    """What leaves bits out of codes of counts, see _lookup()."""
    return (bits + np.uint16(1)) * np.uint16(LEVELS**2)


#: Of a step: its code.
_CODE = np.uint16(LEVELS**2 - 1)


def _bits(steps: np.ndarray) -> np.ndarray:
    return (steps >> np.uint16((2 * LEVELS**2).bit_length() - 1)).astype(np.uint8)


class Tree:
    """A binary code of symbols in a fixed order: each node parts its symbols where their weights come nearest to halves. The
    path of symbol s is nodes[begin[s] : begin[s] + size[s]], with a step each, which holds its bit, as _own() has it, and a code of
    the weights of both sides. A node is named by a hash of the first symbol of its right side."""

    def __init__(self, weights: np.ndarray) -> None:
        n = len(weights)
        sums = np.concatenate([[0], np.cumsum(weights, dtype=np.float64)])
        low, high, active = np.zeros(n, np.int32), np.full(n, n, np.int32), np.arange(n, dtype=np.int32)
        found: list[tuple] = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool), np.zeros(0, np.uint16))]
        while True:
            active = active[high[active] - low[active] > 1]
            if not len(active):
                break
            a, b = low[active], high[active]
            half = (sums[a] + sums[b]) / 2
            at = np.searchsorted(sums, half)
            at = np.clip(np.where(half - sums[at - 1] < sums[at] - half, at - 1, at), a + 1, b - 1).astype(np.int32)
            right = active >= at
            sides = np.stack([sums[at] - sums[a], sums[b] - sums[at]], axis=1)
            found.append((active, at, right, _coded(sides)[:, 0] * np.uint16(LEVELS) + _coded(sides)[:, 1]))
            low[active], high[active] = np.where(right, at, a), np.where(right, b, at)
        symbol, node, bit, code = map(np.concatenate, zip(*found))
        order = np.argsort(symbol, kind="stable")
        self.size = np.bincount(symbol, minlength=n)
        self.begin = np.cumsum(self.size) - self.size
        self.nodes = node[order].astype(np.uint32) * np.uint32(0x85EBCA6B)
        self.steps = code[order] + _own(bit[order])

    @property
    def bits(self) -> np.ndarray:
        return _bits(self.steps)

    @property
    def codes(self) -> np.ndarray:
        return self.steps & _CODE


def _byte_tree() -> Tree:
    """A fixed code of bytes, shorter for those that texts have more of."""
    weights = np.full(256, 1e-4)
    weights[0x80:0xC6] = 1e-3
    for i, b in enumerate(b" etaoinsrhldcumfpgwybvk.,xjqz0123456789\n-'\"():;/"):
        weights[b] = 1 / (i + 2)
    return Tree(weights / 100)  # under one: no counts


_BYTES = _byte_tree()


class Code:
    """Codes of the frequent tokens. Symbol 0 stands for all others, which are spelled; then come the tokens in byte order, so
    that a node's tokens share their beginnings. other: how many training tokens are spelled."""

    def __init__(self, tokens: list[bytes], counts: np.ndarray, other: int) -> None:
        order = sorted(range(len(tokens)), key=tokens.__getitem__)
        self.tokens = [tokens[i] for i in order]
        counts = np.asarray(counts, np.int64)[order]
        self.tree = Tree(np.concatenate([[max(1, other)], np.maximum(counts, 1)]))
        rank = np.full(len(order) + 1, HUBS + BEFORE)
        rank[1 + np.lexsort((np.arange(len(order)), -counts))] = np.arange(len(order))
        self.rank = rank
        # of each symbol, and last of a text's begin: its name as a context (0: none), and whether it is found as such
        self.hub, self.paired, self.before = (np.append(np.where(rank < most, rank + 1, 0), 0).astype(np.int32) for most in (HUBS, PAIRED, BEFORE))
        self.is_hub, self.is_paired = (np.append(x[:-1] > 0, True).astype(np.int32) for x in (self.hub, self.paired))

    def places(self) -> dict[bytes, int]:
        return dict(zip(self.tokens, range(1, len(self.tokens) + 1)))


def token_contexts(code: Code, ids: np.ndarray, sizes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the contexts of each token of streams of so many tokens, and its last hub (0: none)."""
    n = len(ids) + len(sizes)
    begins = np.cumsum(sizes + 1) - sizes - 1
    own = np.ones(n, bool)
    own[begins] = False
    x = np.empty(n, np.int32)
    x[own], x[begins] = ids, len(code.rank)
    place = np.arange(n, dtype=np.int32)
    at = np.flatnonzero(own) - 1  # the place before each token; a text's begin stops every search
    hub = code.hub.take(x.take(np.maximum.accumulate(place * code.is_hub.take(x)).take(at)))
    paired = np.maximum.accumulate(place * code.is_paired.take(x))
    last = paired.take(at)
    first = code.paired.take(x.take(last))
    second = code.paired.take(x.take(paired.take(last - 1))) * (first > 0)
    before = code.before.take(x.take(at))
    keys = [hub, before + (before == 0) * (hub + np.int32(BEFORE + 1)), first * np.int32(PAIRED + 1) + second]
    return [_hashed((k * np.int32(CONTEXTS) + np.int32(c + 1)).astype(np.uint64)) for c, k in enumerate(keys)], hub


def byte_contexts(raw: np.ndarray, first: np.ndarray, hub: np.ndarray) -> list[np.ndarray]:
    """Hashes of the contexts of each byte. first: where a token begins; hub: of each byte's token."""
    n = len(raw)
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    before = np.zeros((8, n), np.uint64)
    for k in range(8):
        before[k, k + 1 :] = raw[: max(n - k - 1, 0)] + np.uint64(1)
        before[k][np.arange(n) - k - 1 < begin] = 0
    two = before[0] << np.uint64(9) | before[1]
    three = two << np.uint64(9) | before[2]
    four = three << np.uint64(9) | before[3]
    five = four << np.uint64(9) | before[4]
    eight = five * _ODD + (before[5] << np.uint64(18) | before[6] << np.uint64(9) | before[7])
    hub = hub.astype(np.uint64)
    keys = [two << np.uint64(9) | hub, three, five, eight, before[0] << np.uint64(9) | hub, four]
    return [_hashed(k + (np.uint64(c + 1) << np.uint64(50))) for c, k in enumerate(keys)]


class Rows:
    """Bits of one kind in order: the symbols that they spell, hashed contexts by symbol, and each symbol's number of bits and text."""

    def __init__(self, tree: Tree, symbols: np.ndarray, hashes: list[np.ndarray], text: np.ndarray, kind: int) -> None:
        size, after = tree.size.take(symbols), 0
        if kind == TAIL:
            some, after = np.flatnonzero(size > DEEP), DEEP
            symbols, size, hashes, text = symbols.take(some), size.take(some) - DEEP, [h.take(some) for h in hashes], text.take(some)
        elif kind == HEAD:
            size = np.minimum(size, DEEP)
        self.tree, self.symbols, self.sizes, self.hashes, self.text, self.kind, self.after = tree, symbols, size, hashes, text, kind, after

    def parts(self) -> Iterator[Bits]:
        """The bits, STEP_ROWS at a time, so that what is made of them stays at hand."""
        of = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        offset = self.tree.begin.take(self.symbols) + (self.after - np.cumsum(self.sizes) + self.sizes)
        for lo in range(0, len(of), STEP_ROWS):
            yield Bits(self, of[lo : lo + STEP_ROWS], lo, offset)

    def by_text(self, x: np.ndarray, texts: int) -> np.ndarray:
        """Sums of a number for each bit by text."""
        if not len(x):
            return np.zeros(texts)
        return np.bincount(self.text, np.add.reduceat(x, np.cumsum(self.sizes) - self.sizes), texts)


class Bits:
    """Bits of Rows from the lo-th on: the places of their symbols there, nodes, steps and values."""

    def __init__(self, rows: Rows, of: np.ndarray, lo: int, offset: np.ndarray) -> None:
        path = np.arange(lo, lo + len(of)) + offset.take(of, mode="clip")
        self.rows, self.of = rows, of
        self.nodes, self.steps = rows.tree.nodes.take(path, mode="clip"), rows.tree.steps.take(path, mode="clip")
        self.bits = _bits(self.steps)

    def slots(self, c: int, slot_bits: int) -> np.ndarray:
        return ((self.rows.hashes[c].take(self.of, mode="clip") ^ self.nodes) * _FIB >> np.uint32(32 - slot_bits)).view(np.int32)


def rows_of(code: Code, texts: list[tuple[np.ndarray, bytes]]) -> Iterator[Rows]:
    """The bits of texts (symbols; the spelled tokens' bytes, each with STOP), in blocks of about BLOCK tokens."""
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    tokens = 0

    def flush() -> Iterator[Rows]:
        sizes = np.array([len(ids) for _, ids, _ in held])
        ids = np.concatenate([x for _, x, _ in held])
        text = np.array([t for t, _, _ in held])
        hashes, hub = token_contexts(code, ids, sizes)
        of = np.repeat(text, sizes)
        yield Rows(code.tree, ids, hashes, of, HEAD)
        yield Rows(code.tree, ids, hashes, of, TAIL)
        raw = np.concatenate([x for _, _, x in held])
        if len(raw):
            stops = np.cumsum(raw == STOP) - (raw == STOP)
            hubs = hub[ids == 0][stops]
            of = np.repeat(text, [len(x) for _, _, x in held])
            for lo in range(0, len(raw), PIECE):
                part = slice(lo, lo + PIECE)
                first = np.append(True, raw[part][:-1] == STOP)
                yield Rows(_BYTES, raw[part], byte_contexts(raw[part], first, hubs[part]), of[part], SPELLED)

    for t, (ids, spelled) in enumerate(texts):
        raw = np.frombuffer(spelled, np.uint8)
        if len(ids) > BLOCK:
            ends = np.append(np.flatnonzero(raw == STOP) + 1, 0)  # the last: of no token
            for lo in range(0, len(ids), BLOCK):
                before, after = np.count_nonzero(ids[:lo] == 0), np.count_nonzero(ids[: lo + BLOCK] == 0)
                held.append((t, ids[lo : lo + BLOCK], raw[ends[before - 1] : ends[after - 1]] if after > before else raw[:0]))
                yield from flush()
                held.clear()
            continue
        if held and tokens + len(ids) > BLOCK:
            yield from flush()
            held.clear()
            tokens = 0
        held.append((t, ids, raw))
        tokens += len(ids)
    if held:
        yield from flush()


def _lookup() -> tuple[np.ndarray, np.ndarray]:
    """By LEVELS ** 2 * left out (0: nothing, 1: a zero, 2: a one) + a slot's code: log odds of a one; half the log2 of the times seen."""
    zeros, ones = np.repeat(_COUNT, LEVELS), np.tile(_COUNT, LEVELS)
    odds, level = [], []
    for lose in ((0, 0), (1, 0), (0, 1)):
        n0, n1 = np.maximum(zeros - lose[0], 0), np.maximum(ones - lose[1], 0)
        odds.append(np.clip(np.log((n1 + 0.4) / (n0 + 0.4)), -12, 12))
        level.append(np.log2(n0 + n1 + 1) / 2)
    return np.concatenate(odds).astype(np.float32), np.concatenate(level).astype(np.uint8)


_ODDS, _LEVEL = _lookup()
#: What each gated context adds to the number of a bit's set of weights.
_GATE = [(np.minimum(_LEVEL, g - 1) * math.prod(GATES[i + 1 :])).astype(np.uint8) for i, g in enumerate(GATES)]


class Tables:
    """Counts of zeros and ones by context and slot, over all bits of all training texts: both as levels in one code a slot."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, self.slot_bits = codes, codes.shape[1].bit_length() - 1

    @staticmethod
    def counts(rows: Iterator[Rows], slot_bits: int) -> np.ndarray:
        """Counts (SPELLING, slots, 2). A context and a symbol that meet again among PAIRS symbols are told apart before bits are, so
        that each pair's bits are drawn once, with its count, and neighbours in order share the beginnings of their paths."""
        out = np.zeros((SPELLING, 2 << slot_bits), np.uint32)
        held: dict[bool, list[tuple[np.ndarray, list[np.ndarray]]]] = {}

        def draw(tree: Tree, some: list[tuple[np.ndarray, list[np.ndarray]]]) -> None:
            symbols = np.concatenate([x for x, _ in some])
            for c in range(len(some[0][1])):
                pairs = np.concatenate([hashes[c] for _, hashes in some]).astype(np.uint64) << np.uint64(32)
                pairs |= symbols.astype(np.uint32)
                pairs.sort()
                first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
                times, pairs = np.diff(first, append=len(pairs)).astype(np.uint32), pairs[first]
                for lo in range(0, len(pairs), BLOCK >> 2):
                    part = pairs[lo : lo + (BLOCK >> 2)]
                    symbol = (part & np.uint64(0xFFFFFFFF)).astype(np.int64)
                    size = tree.size.take(symbol)
                    ends = np.cumsum(size)
                    path = np.arange(ends[-1]) + np.repeat(tree.begin.take(symbol) - ends + size, size)
                    slot = (np.repeat((part >> np.uint64(32)).astype(np.uint32), size) ^ tree.nodes.take(path)) * _FIB >> np.uint32(32 - slot_bits)
                    np.add.at(out[c], (slot * np.uint32(2) + _bits(tree.steps.take(path))).astype(np.intp), np.repeat(times[lo : lo + (BLOCK >> 2)], size))
            some.clear()

        trees = {}
        for r in rows:
            if r.kind != TAIL and len(r.symbols):  # a HEAD's symbols bring all their bits
                trees[r.kind], some = r.tree, held.setdefault(r.kind, [])
                some.append((r.symbols, r.hashes))
                if sum(len(x) for x, _ in some) >= PAIRS:
                    draw(r.tree, some)
        for kind, some in held.items():
            if some:
                draw(trees[kind], some)
        return out.reshape(SPELLING, -1, 2)

    @staticmethod
    def of(counts: np.ndarray) -> np.ndarray:
        """Codes of counts (..., 2)."""
        both = _coded(counts)
        return both[..., 0] * np.uint16(LEVELS) + both[..., 1]

    def inputs(self, bits: Bits, left_out: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
        """Log odds of a one from each context and the tree, and the gate of each bit among its kind's. left_out: what is taken from the
        counts, as in _lookup(): in training texts a bit's own."""
        codes = [self.codes[c].take(bits.slots(c, self.slot_bits), mode="clip") for c in range(len(bits.rows.hashes))]
        if bits.rows.kind != SPELLED:
            codes.append(bits.steps & _CODE)
        if left_out is not None:
            for code in codes:
                code += left_out
        gate = _GATE[0].take(codes[0], mode="clip")
        for at, code in zip(_GATE[1:], codes[1:]):
            gate += at.take(code, mode="clip")
        return [_ODDS.take(code, mode="clip") for code in codes], gate.astype(np.intp)


def _start_weights() -> np.ndarray:
    w = np.full((SPELLING + 2, SETS), 0.3, np.float32)
    w[0] = 0
    return w


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


_IDENTITY = _squash(np.linspace(-12, 12, STEPS))


def _logs(bits: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log10 of the chances of bits whose chance of a one is p."""
    return np.log(np.abs(p - (np.uint8(1) - bits))) * np.float32(1 / math.log(10))


class Mixer:
    """Weights of a constant and the contexts by gate, and the adaptive map: what share of bits were one, by gate and step of
    the mixed log odds, between whose steps it interpolates. The map starts as the identity with the mass of 50 bits a step. Bits of
    a kind use its own sets of weights and its part of the map."""

    def __init__(self, weights: np.ndarray | None = None, hits: np.ndarray | None = None) -> None:
        self.weights = _start_weights() if weights is None else weights
        self.squares = np.full_like(self.weights, 1e-4, dtype=np.float64)
        self.hits = np.zeros((2, SETS, STEPS)) if hits is None else hits
        self.map = np.zeros((SETS, STEPS), np.float32)
        self.seen: list[np.ndarray] = []
        for kind in (HEAD, TAIL, SPELLED):
            self.draw(kind)

    @staticmethod
    def sets(kind: int) -> slice:
        return slice(kind * GATED, (kind + 1) * GATED)

    def mixed(self, kind: int, odds: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        weights = self.weights[:, self.sets(kind)]
        z = weights[0].take(gate, mode="clip")
        for w, x in zip(weights[1:], odds):
            z += x * w.take(gate, mode="clip")
        return np.clip(z, -12, 12, out=z)

    def learn(self, kind: int, odds: list[np.ndarray], gate: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """An online step: each gate's weights follow its bits' mean gradient, by the size of those before; the map counts, and
        follows when it is drawn. The log10 chances of the bits, before they were learned from."""
        z = self.mixed(kind, odds, gate)
        p = _squash(z)
        out = _logs(bits, self.refined(kind, z, p, gate))
        error = bits - p
        mass = np.bincount(gate, minlength=GATED)
        step = np.stack([np.bincount(gate, error, GATED), *(np.bincount(gate, error * x, GATED) for x in odds)]) / (mass + 30)
        own = slice(len(step)), self.sets(kind)
        self.squares[own] += step * step
        self.weights[own] += (RATE * step / np.sqrt(self.squares[own])).astype(np.float32)
        at = np.rint((z + 12) * np.float32((STEPS - 1) / 24)).astype(np.int32)
        at += (gate * STEPS).astype(np.int32)
        at += bits * np.int32(GATED * STEPS)
        self.seen.append(at)
        return out

    def draw(self, kind: int) -> None:
        """The kind's part of the map, by all counts so far."""
        hits = self.hits[:, self.sets(kind)]
        if self.seen:
            hits += np.bincount(np.concatenate(self.seen), minlength=2 * GATED * STEPS).reshape(hits.shape)
            self.seen.clear()
        self.map[self.sets(kind)] = (hits[1] + 50 * _IDENTITY) / (hits[0] + hits[1] + 50)

    def refined(self, kind: int, z: np.ndarray, p: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """p(one): the mean of the mixed chance and the map's."""
        at = (z + 12) * np.float32((STEPS - 1) / 24)
        low = np.minimum(at.astype(np.int32), np.int32(STEPS - 2))
        at -= low.astype(np.float32)
        low = gate * STEPS + low
        flat = self.map[self.sets(kind)].ravel()
        fixed = flat.take(low, mode="clip")
        at *= flat[1:].take(low, mode="clip") - fixed
        fixed += at
        fixed += p
        fixed /= 2
        return np.clip(fixed, 1e-6, 1 - 1e-6, out=fixed)

    def chance(self, kind: int, odds: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        z = self.mixed(kind, odds, gate)
        return self.refined(kind, z, _squash(z), gate)


def bit_logs(rows: Rows, tables: Tables, mixer: Mixer, training: np.ndarray | None = None) -> np.ndarray:
    """log10 chance of each bit. training: by text, whether each bit is left out of the counts."""
    own = training is not None and training[rows.text].any()
    of_training = training[rows.text] if own else None
    out = [np.zeros(0, np.float32)]
    for part in rows.parts():
        left_out = (part.steps & ~_CODE) * of_training[part.of] if own else None
        out.append(_logs(part.bits, mixer.chance(rows.kind, *tables.inputs(part, left_out))))
    return np.concatenate(out)


def text_scores(texts: list[tuple[np.ndarray, bytes]], code: Code, tables: Tables, mixer: Mixer, training: np.ndarray | None = None) -> np.ndarray:
    """log10 probability of each text's bits."""
    out = np.zeros(len(texts))
    for rows in rows_of(code, texts):
        out += rows.by_text(bit_logs(rows, tables, mixer, training), len(texts))
    return out


def learn_from(texts: list[tuple[np.ndarray, bytes]], code: Code, tables: Tables, mixer: Mixer) -> tuple[np.ndarray, int]:
    """The mixer passes over all bits of training texts, each left out of the counts when it is predicted, and learns from them
    after. The log10 probability of each text as it was predicted, and the number of bits."""
    out, bits = np.zeros(len(texts)), 0
    for rows in rows_of(code, texts):
        logs = [mixer.learn(rows.kind, *tables.inputs(part, part.steps & ~_CODE), part.bits) for part in rows.parts()]
        mixer.draw(rows.kind)
        out += rows.by_text(np.concatenate([np.zeros(0, np.float32), *logs]), len(texts))
        bits += int(rows.sizes.sum())
    return out, bits


def tokens_of(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased, and END."""
    return [*(text or "").encode().lower().split(), END]


def encoded(words: list[bytes], places: dict[bytes, int]) -> tuple[np.ndarray, bytes]:
    """A text's symbols, and the bytes of its spelled tokens, each with STOP."""
    ids = np.fromiter(map(places.get, words, repeat(0)), np.int32, len(words))
    other = np.flatnonzero(ids == 0).tolist()
    return ids, b" ".join([*[words[i] for i in other], b""]) if other else b""


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in slices of at most about SLICE bytes of text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < len(batch):
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + SLICE, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _handed_on(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows in small batches, as the JVM keeps room for the largest; what Arrow holds for no array goes back."""
    batch = pa.RecordBatch.from_arrays(columns, names=names)
    for lo in range(0, len(batch), OUT):
        yield batch.slice(lo, OUT)
    pa.default_memory_pool().release_unused()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All texts' words, as tokens_of() has them, without the ends, and where each text's begin and end among them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.string())))
    words, at = lists.values, lists.offsets.to_numpy()
    some = pc.binary_length(words).to_numpy() > 0  # white space at a text's begin or end leaves an empty word
    if not some.all():
        words, at = words.filter(pa.array(some)), np.append(0, np.cumsum(some))[at]
    return words.cast(pa.binary()), at.astype(np.int64)


def encoded_texts(texts: pa.Array, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """As encoded() for many texts: their symbols and where each text's begin and end among them, the bytes of their spelled tokens; and
    these tokens without the ends, with the number of each one's text."""
    words, at = words_of(texts)
    many = len(at) - 1
    ids, bounds = np.empty(len(words) + many, np.int32), at + np.arange(many + 1)
    own = np.ones(len(ids), bool)
    own[bounds[1:] - 1] = False
    ids[own] = pc.fill_null(pc.index_in(words, value_set=tokens), -1).to_numpy() + np.int32(1)
    end = pc.index_in(pa.scalar(END, pa.binary()), value_set=tokens).as_py()
    ids[~own] = 0 if end is None else end + 1
    other = ids[own] == 0
    rare, each = words.filter(pa.array(other)), np.append(0, np.cumsum(other))[at]
    spelled = pc.binary_join(pa.ListArray.from_arrays(pa.array(each.astype(np.int32)), rare), pa.scalar(b" ", pa.binary()))
    stop, none = pa.scalar(bytes([STOP]), pa.binary()), pa.scalar(b"", pa.binary())
    spelled = pc.if_else(pa.array(np.diff(each) > 0), pc.binary_join_element_wise(spelled, stop, none), none)
    if end is None:
        spelled = pc.binary_join_element_wise(spelled, pa.scalar(END, pa.binary()), stop, none)
    return ids, bounds, spelled, rare, np.repeat(np.arange(many), np.diff(each))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, count in training texts, SLICES slices at a time, and last the ends. A held-out text's tokens come with count 0."""
    ends, slices = [0, 0], _slices(batches)
    while some := list(islice(slices, SLICES)):
        train, other = [], []
        for batch in some:
            words, at = words_of(batch["text"])
            held = batch["held_out"].to_numpy(zero_copy_only=False).astype(bool)
            ends[0], ends[1] = ends[0] + np.count_nonzero(~held), ends[1] + np.count_nonzero(held)
            held = np.repeat(held, np.diff(at))
            train.append(words.filter(pa.array(~held)))
            other.append(pc.unique(words.filter(pa.array(held))))
        found = pc.value_counts(pa.chunked_array(train, pa.binary()))
        yield from _handed_on([found.field("values"), found.field("counts")], ["token", "n"])
        only = pc.unique(pa.chunked_array(other, pa.binary()))
        yield from _handed_on([only, pa.array(np.zeros(len(only), np.int64))], ["token", "n"])
    if any(ends):
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends[0]], pa.int64())], names=["token", "n"])


def spellings(tokens: list[bytes]) -> Iterator[Rows]:
    """The bits of each token, spelled once without a hub: what words are like, whether they are frequent or not."""
    for lo in range(0, len(tokens), BLOCK):
        raw = np.frombuffer(b" ".join([*tokens[lo : lo + BLOCK], b""]), np.uint8)
        none = np.zeros(len(raw), np.int64)
        yield Rows(_BYTES, raw, byte_contexts(raw, np.append(True, raw[:-1] == STOP), none), none, SPELLED)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, bytes]]]:
    for batch in batches:
        for lo in range(0, len(batch), 500):
            part = batch.slice(lo, 500)
            yield [(np.frombuffer(x.as_buffer(), np.int32), s.as_py()) for x, s in zip(part["ids"], part["spelled"])]


#: Slots of one row of a table on its way to the driver.
PART = 1 << 14


def _tables(code, held, slot_bits: int):
    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's counts, by parts of tables, in as few bytes a count as hold it; parts without any are left out. The first task
        counts the frequent tokens' spellings too."""
        once = spellings(held.value[0]) if TaskContext.get().partitionId() == 0 else ()
        counts = Tables.counts(chain(once, (r for texts in _texts(batches) for r in rows_of(code.value, texts))), slot_bits)
        for i, x in enumerate(counts.reshape(-1, min(PART, 1 << slot_bits), 2)):
            if most := int(x.max()):
                kind = np.min_scalar_type(most)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.astype(kind).tobytes()], pa.binary())], names=["part", "counts"])

    return tables


def _summed(part: int):
    def summed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((part, 2), np.int64)
        for batch in batches:
            for x in batch["counts"].to_pylist():
                total += np.frombuffer(x, f"u{len(x) // (2 * part)}").reshape(part, 2)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([Tables.of(total).tobytes()], pa.binary())], names=["part", "codes"])

    return summed


#: A scored document, and what a task has learned, which a row without them bears.
SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, size long, score double"
LEARNED = "mass double, weights array<double>, hits array<double>"


def _trained(code, tables):
    """Training documents, sorted by shard, scored as the mixer of their shard learns from them; then a row of the task's mixers:
    weights times bits, and hits, added up."""
    kept = [x.split()[0] for x in SCORED.split(", ")][:-1]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    names = [*kept, "score", *(x.split()[0] for x in LEARNED.split(", "))]

    def handed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        """Rows of one shard, about HANDED tokens at a time from its first on, wherever batches end."""
        held, tokens, of = [], 0, None
        for batch in batches:
            for i, (shard, n) in enumerate(zip(batch["shard"].to_pylist(), batch["n_tokens"].to_pylist())):
                if held and (shard != of or tokens >= HANDED):
                    yield of, pa.concat_batches(held)
                    held, tokens = [], 0
                held.append(batch.slice(i, 1))
                tokens, of = tokens + n, shard
        if held:
            yield of, pa.concat_batches(held)

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, of, size, mass = Mixer(), None, 0, 0
        weights, hits = np.zeros(mixer.weights.shape), np.zeros(mixer.hits.shape)
        for shard, part in handed(batches):
            if shard != of:
                weights, hits, mass = weights + size * mixer.weights.astype(np.float64), hits + mixer.hits, mass + size
                mixer, of, size = Mixer(), shard, 0
            score = []
            for texts in _texts(iter([part])):
                found, bits = learn_from(texts, code.value, tables.value, mixer)
                score.append(found)
                size += bits
            yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), pa.array(np.concatenate(score)), *(pa.nulls(len(part), k) for k in kinds[-3:])], names=names)
        mass += size
        if mass:
            weights, hits = weights + size * mixer.weights.astype(np.float64), hits + mixer.hits
            last = [[float(mass)], [weights.ravel().tolist()], [hits.ravel().tolist()]]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds[:-3]), *(pa.array(x, k) for x, k in zip(last, kinds[-3:]))], names=names)

    return trained


def fit(training: DataFrame, code, held, tokens: int):
    """(tables, mixer, scored) of training(row, doc_id, ids, spelled ...): broadcast values of bounded size, 2 bytes a slot and the
    mixer's few; and the training documents with their scores.

    Every bit of every training text takes part. Tasks count and add up their tables by parts. Then texts are dealt by a hash of
    doc_id and text to shards of about SHARD tokens, and in each a mixer passes over them in the order of that hash with all
    counts, predicts each bit and learns from it. The mixers' weights are averaged by their bits, their maps added. The number of
    shards follows from the tokens alone and no mixer meets two shards, so scores don't depend on partitions.
    """
    sc = training.sparkSession.sparkContext
    slot_bits = min(SLOT_BITS, max(12, tokens.bit_length() + 2))
    part = min(PART, 1 << slot_bits)
    parts, cores = training.rdd.getNumPartitions(), sc.defaultParallelism
    texts = training.select("ids", "spelled").coalesce(max(-(-parts // TASK_PARTS), min(parts, cores), 1))
    sums = texts.mapInArrow(_tables(code, held, slot_bits), "part int, counts binary").groupBy("part").applyInArrow(_summed(part), "part int, codes binary")
    codes = np.zeros((SPELLING << slot_bits) // part * part, np.uint16).reshape(-1, part)
    for row in sums.toLocalIterator():  # the tables, whose size is bounded
        codes[row["part"]] = np.frombuffer(row["codes"], np.uint16)
    tables = sc.broadcast(Tables(codes.reshape(SPELLING, -1)))
    shards = tokens // SHARD + 1
    tasks = min(shards, max(cores, -(-shards // TASK_SHARDS)))
    place = F.xxhash64("doc_id", "ids", "spelled")
    dealt = training.withColumn("place", place).withColumn("shard", F.pmod("place", F.lit(shards)))
    dealt = dealt.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "place")
    both = written(dealt.mapInArrow(_trained(code, tables), f"{SCORED}, {LEARNED}"))
    mixed = both.where("mass is not null")  # one row a task, summed by place before the driver sees it
    total = mixed.agg(F.sum("mass")).first()[0]
    scored = both.where("mass is null").drop("mass", "weights", "hits")
    if not total:
        return tables, sc.broadcast(Mixer()), scored
    sums_of = lambda c: np.array([r["x"] for r in mixed.select(F.posexplode(c).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()], np.float64)
    weights, hits = sums_of("weights") / total, sums_of("hits")
    return tables, sc.broadcast(Mixer(weights.reshape(SPELLING + 2, SETS).astype(np.float32), hits.reshape(2, SETS, STEPS))), scored


def frequent(counted: DataFrame, most: int = FREQUENT) -> DataFrame:
    """The tokens of counted(token, n) seen over some number of times, once at least, the least that leaves `most` of them at most."""
    able = counted.where(F.octet_length("token") <= LONGEST)
    times = able.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count("*").alias("tokens"))
    over, kept = 100_000, 0
    for row in times.where("n > 1").orderBy(F.desc("n")).collect():  # at most 100,000 rows
        if kept + row["tokens"] > most:
            break
        over, kept = row["n"] - 1, kept + row["tokens"]
    return able.where(F.col("n") > over)


def score_documents(docs: DataFrame, fold: int = 1, most_frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of docs(doc_id, text).

    Tokens are words and an end, A-Z lower-cased; a null text is empty. The base is the smoothed frequency of tokens in
    the training fold. The score is the log10 probability of all bits of all tokens: a frequent token's bits are its path in a
    tree over the frequent tokens, any other's those of an escape and of its bytes. Several contexts, which reach back to the two
    words and the two hubs (very frequent tokens, which tell the language) before a token, give log odds from counts of all bits of
    all training texts; weights that a gate picks mix these, and an adaptive map refines the result. Chances of all next tokens
    sum to one in held-out texts. A training text is scored online, by the mixer of its shard as it stood before it learned from the
    text's bits, with each bit left out of the counts that foretell it. So its score is comparable with held-out ones, but its bits'
    chances of zero and one, each with another bit left out, don't sum to one. Scores are the same under any partitioning, but for
    rounding; rows repeated under one doc_id share a shard, and each is learned from.

    Texts become symbols once, in a table in the shared folder that all passes read. For the base the frequent tokens, a bounded
    number, are summed there; the others are joined by token to their counts. Every row is scored, repeated ones alike; a
    null doc_id is not held out. Without training texts tables are empty. Other columns are not read.
    """
    sc = docs.sparkSession.sparkContext
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id"), fold).alias("held_out"))
    tokens = named.select("text", "held_out").mapInArrow(_counted, "token binary, n long")
    vocabulary = written(tokens.groupBy("token").agg(F.sum("n").alias("n")))
    n = F.col("n")
    row = vocabulary.agg(F.coalesce(F.sum(n), F.lit(0)).alias("total"), F.count_if(n > 0).alias("distinct")).first()
    total, distinct = int(row["total"]), row["distinct"]
    hot = frequent(vocabulary, most_frequent).toArrow()
    counts = hot["n"].to_numpy()
    code = Code(hot["token"].to_pylist(), counts, total - int(counts.sum()))
    share = math.log10(total + 0.5 * (distinct + 1))
    known = np.zeros(len(counts) + 1)
    places = code.places()
    known[[places[t] for t in hot["token"].to_pylist()]] = np.log10(counts + 0.5) - share
    held = sc.broadcast((code.tokens, known))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, with its symbols and the base of its frequent tokens, and a row for each other token that it has."""
        at_hand = pa.array(held.value[0], pa.binary())
        first = TaskContext.get().partitionId() << 36
        for part in _slices(batches):
            ids, bounds, spelled, rare, of = encoded_texts(part["text"], at_hand)
            rows, sizes, begins = first + np.arange(len(part)), np.diff(bounds), bounds[:-1]
            n_known = np.add.reduceat((ids > 0).astype(np.int64), begins)
            base = np.add.reduceat(held.value[1].take(ids), begins)
            offsets = (4 * bounds).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            size = pc.fill_null(pc.binary_length(part["text"]), 0).cast(pa.int64())
            columns = [pa.array(rows), pa.nulls(len(part), pa.binary()), pa.array(np.ones(len(part), np.int64)), part["doc_id"], part["held_out"], pa.array(sizes), pa.array(n_known), pa.array(base), size, packed, spelled]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            others = [pa.table([pa.array(rows[of]), rare], names=names[:2]).group_by(names[:2], use_threads=False).aggregate([([], "count_all")])]
            if len(lost := rows[ids[bounds[1:] - 1] == 0]):
                others.append(pa.table([pa.array(lost), pa.array([END] * len(lost), pa.binary()), pa.array(np.ones(len(lost), np.int64))], names=others[0].column_names))
            for x in pa.concat_tables(others).select([*names[:2], "count_all"]).to_batches():
                yield from _handed_on([*x.columns, *(pa.nulls(len(x), k) for k in kinds[3:])], names)
            first += len(part)

    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.binary(), pa.binary()]
    names = ["row", "token", "times", "doc_id", "held_out", "n_tokens", "n_known", "base", "size", "ids", "spelled"]
    parts = written(named.mapInArrow(summed, "row long, token binary, times long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, size long, ids binary, spelled binary"))
    # a document's own row has no token and no partner in the join
    whole = parts.where(F.col("token").isNull()).drop("token", "times")
    places = code.tokens = None  # held apart
    shared = sc.broadcast(code)
    tables, mixer, scores = fit(whole.where(~F.col("held_out")), shared, held, total)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [text_scores(texts, shared.value, tables.value, mixer.value) for texts in _texts(iter([batch]))]
            keep = [c for c in batch.schema.names if c not in ("ids", "spelled")]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(np.concatenate([np.zeros(0), *score]))], names=[*keep, "score"])

    scores = scores.unionByName(whole.where("held_out").mapInArrow(scored, SCORED))
    rare = parts.where(F.col("token").isNotNull()).select("row", "token", "times").join(vocabulary, "token")
    times = F.col("times")
    rare = rare.groupBy("row").agg(F.sum(F.when(n > 0, times).otherwise(0)).alias("rare_known"), F.sum(times * (F.log10(n + 0.5) - share)).alias("rare_base"))
    out = scores.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        "score",
        "size",
    )
    bits = F.when(F.col("size") > 0, -F.col("score") / (_LOG10_2 * F.col("size")))
    return out.withColumn("bits_per_byte", bits).drop("size")

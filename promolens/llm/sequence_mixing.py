"""Logistic mixing of word-context predictors over token streams.

A token is a leaf of a prefix code: the end of a text, a word not in training,
one of the most frequent words, or a hash class of the others. Each bit on the
way to the leaf is predicted without context (exact counts of the code's nodes),
after the last word, and after the last two, from counts in hashed tables; the
words before count by their number or class. The predictions, stretched to logits, are combined by weights that a
gate selects (depth in the code and how often either context was seen) and that
are learnt online along the stream; an adaptive map of the mixed prediction,
counted per gate while learning, refines it.

Three levels of the code share a line of eight slots, so that a token reads few
places of a table and is hashed once a line. Bits are worked on by depth in the
code, the tokens with the longest paths first, so that those which have a depth
lead the others; while learning, by gate. All arrays have sizes fixed by the code
and ``slots``.
"""

from __future__ import annotations

from collections.abc import Callable
from copy import copy

import numpy as np

BEFORE = 2  # words that a context reaches back
LEVELS, DEPTHS, SEEN = 33, 4, 4
GATES = DEPTHS * SEEN * SEEN
STRENGTH = 0.2  # added to zeros and ones of a predictor
#: What a slot predicts, and its part of the gate, read together.
SLOT = np.dtype({"names": ["x", "gate"], "formats": ["f4", "i1"], "offsets": [0, 4], "itemsize": 8})


def mixed_hash(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def contexts(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per context and token a hash of the words before it in its text; ``first`` marks where
    texts begin. The two tokens before a part of a text must lead it."""
    out = np.empty((BEFORE, len(word)), np.uint64)
    last, gone = np.zeros(len(word), np.uint64), np.zeros(len(word), bool)
    for k in range(1, BEFORE + 1):
        gone = gone | np.roll(first, k - 1)
        earlier = np.where(gone, np.uint64(0), np.roll(word, k).astype(np.uint64) + np.uint64(1))
        last = mixed_hash(last ^ earlier ^ np.uint64(k << 40))
        out[k - 1] = last
    return out


def stretched(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(STRENGTH)) / (zeros + np.float32(STRENGTH)))


def often(seen: np.ndarray) -> np.ndarray:
    """0 to 3: never, up to 3 times, up to 31 times, more often."""
    return (seen > 0).view(np.int8) + (seen > 3).view(np.int8) + (seen > 31).view(np.int8)


def squashed(mixed: np.ndarray) -> np.ndarray:
    out = np.clip(mixed, -30, 30)
    np.exp(np.negative(out, out=out), out=out)
    out += 1
    return np.reciprocal(out, out=out)


def steps(mixed: np.ndarray) -> np.ndarray:
    """Number of the map's level that a mixed prediction falls in."""
    half, out = LEVELS // 2, mixed * 2
    return np.clip(np.rint(out, out=out), -half, half, out=out).astype(np.int64) + half


class Sequence:
    """Code paths, counts per node and per hashed context, gated weights and adaptive map."""

    def __init__(self, leaves: np.ndarray, counts: np.ndarray, slots: int,
                 code: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """``leaves``: numbers of those that can occur; ``counts``: of every number, how often."""
        weights = counts[leaves]
        length, nodes, bits = code(weights)
        depth = np.arange(nodes.shape[1])
        there = depth < length[:, None]
        self.length, self.start = np.zeros((2, len(counts)), np.int64)
        self.length[leaves], self.start[leaves] = length, np.cumsum(length) - length
        self.bit = bits[there].astype(np.float32)
        self.node = nodes[there]
        self.key = mixed_hash(self.node.astype(np.uint64) + np.uint64(1 << 32))
        before = [np.roll(bits, k, axis=1).astype(np.int64) for k in (1, 2)]
        low = np.where(depth % 3 == 0, 1, np.where(depth % 3 == 1, 2 + before[0], 4 + 2 * before[1] + before[0]))
        self.low = low[there]
        self.coded = 2 * self.low + bits[there]
        self.depth = (np.minimum(depth // 3, DEPTHS - 1) * SEEN * SEEN).astype(np.int8)
        self.slots = slots
        n, weight = len(length), np.repeat(weights, length)
        self.plain = np.stack([np.bincount(self.node[self.bit == b], weight[self.bit == b], n)
                               for b in (0, 1)], axis=1).astype(np.float32)
        self.shape = (BEFORE, 1 << slots, 2)
        self.tables: np.ndarray | None = None  # zeros and ones, once they are counted
        pair = self.plain[self.node]
        self.plain_left_out = stretched(np.maximum(pair[:, 0] + (self.bit - 1), 0), np.maximum(pair[:, 1] - self.bit, 0))
        self.weights = np.full((BEFORE + 1, GATES), 0.35, np.float32)
        self.adaptive = np.zeros((2, GATES * LEVELS))

    def fresh(self) -> Sequence:
        """The same counts, with weights and a map of its own."""
        other = copy(self)
        other.weights, other.adaptive = self.weights.copy(), self.adaptive.copy()
        return other

    def decisions(self, leaf: np.ndarray, context: np.ndarray, coded: bool) -> tuple[np.ndarray, ...]:
        """Of all bits of all tokens: place on the code's paths, slot per context (``coded``: twice
        it, and the bit), gate by depth alone. Then the order of the tokens, and how many of them
        have each depth."""
        n = self.length.take(leaf).astype(np.int16)
        order = np.argsort(-n, kind="stable")
        start, context = self.start.take(leaf.take(order)), context.take(order, axis=1)
        many = len(n) - np.cumsum(np.bincount(n))[:-1]
        at = np.empty(many.sum(), np.int64)
        slots = np.empty((BEFORE, len(at)), np.int64)
        inside, shift, wide = self.coded if coded else self.low, np.uint64(64 - self.slots + 3), np.uint64(4 if coded else 3)
        end = 0
        for depth, m in enumerate(many.tolist()):
            there = slice(end, end + m)
            here = np.add(start[:m], depth, out=at[there])
            if depth % 3 == 0:
                lines = context[:, :m] ^ self.key.take(here)
                lines *= np.uint64(0xD6E8FEB86659FD93)
                lines >>= shift
                lines <<= wide
                lines = lines.view(np.int64)
            np.add(lines[:, :m], inside.take(here), out=slots[:, there])
            end += m
        return at, slots, self.depth[:len(many)].repeat(many), order, many

    def count(self, tables: np.ndarray, leaf: np.ndarray, context: np.ndarray) -> None:
        """Add the tokens' bits to ``tables`` (context, slot and bit)."""
        for table, slot in zip(tables, self.decisions(leaf, context, True)[1]):
            np.add.at(table, slot, np.uint32(1))

    def left_out(self, at: np.ndarray, slots: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> list[np.ndarray]:
        """Stretched predictions of each bit, with the coded bit itself taken out of the counts, as
        if the token had not been seen; ``gate`` is completed."""
        x, zero = [self.plain_left_out.take(at)], bit - 1
        for k, (table, slot) in enumerate(zip(self.tables, slots)):
            pair = table.view(np.int64).ravel().take(slot).view(np.float32).reshape(-1, 2)
            zeros, ones = np.maximum(pair[:, 0] + zero, 0), np.maximum(pair[:, 1] - bit, 0)
            gate += often(zeros + ones) * np.int8(SEEN ** k)
            x.append(stretched(zeros, ones))
        return x

    def ready(self) -> Sequence:
        """For scoring: what each slot predicts, worked out once; it takes the place of the counts."""
        both = np.empty(self.shape[:2], SLOT)
        for k, table in enumerate(self.tables):
            both[k]["x"] = stretched(table[:, 0], table[:, 1])
            both[k]["gate"] = often(table.sum(axis=1)) * np.int8(SEEN ** k)
        self.predicts, self.tables = both.view(np.int64), None
        self.predicts_plain = stretched(self.plain[:, 0], self.plain[:, 1])[self.node]
        self.became = self.adaptive[1].astype(np.float32), self.adaptive.sum(axis=0).astype(np.float32) + 4
        return self

    def inputs(self, at: np.ndarray, slots: np.ndarray, gate: np.ndarray) -> list[np.ndarray]:
        """Stretched predictions of each bit, by all counts; ``gate`` is completed."""
        x = [self.predicts_plain.take(at)]
        for table, slot in zip(self.predicts, slots):
            both = table.take(slot).view(SLOT)
            gate += both["gate"]
            x.append(both["x"])
        return x

    def learn(self, leaf: np.ndarray, context: np.ndarray, rate: float) -> None:
        """One online step: the adaptive map counts what became of the predictions, then the
        weights move by the scaled mean gradient of the coding cost, per gate."""
        at, slots, gate, _, _ = self.decisions(leaf, context, False)
        bit = self.bit.take(at)
        x = self.left_out(at, slots, gate, bit)
        kind = (2 * gate + bit.astype(np.int8)).view(np.uint8)
        order = np.argsort(kind, kind="stable")
        each = np.diff(np.searchsorted(kind[order], np.arange(2 * GATES + 1)))
        there = np.flatnonzero(each)
        each, gate, bit = each[there], there >> 1, there & 1
        x = [one.take(order) for one in x]
        mixed = np.repeat(self.weights[0][gate], each) * x[0]
        for w, one in zip(self.weights[1:], x[1:]):
            mixed += np.repeat(w[gate], each) * one
        n = self.adaptive.shape[1]
        level = steps(mixed)
        level += np.repeat(gate * LEVELS + n * bit, each)
        self.adaptive += np.bincount(level, minlength=2 * n).reshape(2, n)
        error = np.repeat(bit.astype(np.float32), each) - squashed(mixed)
        starts = np.cumsum(each) - each
        total = np.bincount(gate, each, GATES) + 1e-9
        for k, one in enumerate(x):
            slope, square = (np.bincount(gate, np.add.reduceat(y * one, starts, dtype=float), GATES) / total
                             for y in (error, one)) if len(starts) else np.zeros((2, GATES))
            self.weights[k] += rate * slope / (1 + square)
        np.clip(self.weights, -3, 3, out=self.weights)

    def log10(self, leaf: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Log10 probability of each token after its contexts, once ``ready``."""
        at, slots, gate, order, many = self.decisions(leaf, context, False)
        x = self.inputs(at, slots, gate)
        gate = gate.astype(np.int64)
        mixed = self.weights[0].take(gate) * x[0]
        for w, one in zip(self.weights[1:], x[1:]):
            mixed += w.take(gate) * one
        # What the map makes of a level, between the mixed prediction and what came of it.
        level = steps(mixed)
        level += gate * LEVELS
        p = squashed(mixed)
        one = 4 * p
        one += self.became[0].take(level)
        one /= self.became[1].take(level)
        one += p
        one /= 2
        np.clip(one, 1e-6, 1 - 1e-6, out=one)
        one += self.bit.take(at) - 1
        np.log10(np.abs(one, out=one), out=one)
        # Back to whole tokens.
        n = self.length.take(leaf)
        first, bits, end = np.cumsum(n) - n, np.empty(len(one), np.float32), 0
        for depth, m in enumerate(many.tolist()):
            bits[first[order[:m]] + depth] = one[end:end + m]
            end += m
        return np.add.reduceat(bits, first).astype(float) if len(first) else np.zeros(0)


#: A token as stored: its word's number, and above it whether training knows the word once or never.
STATE = 14
ONCE, NEVER = 1, 2
END_OF_TEXT, NEW = 0, 1


def part(tokens: np.ndarray, first: np.ndarray, at: int, to: int, learning: bool) -> tuple[np.ndarray, np.ndarray]:
    """Leaves and contexts of the tokens from ``at`` to ``to``. While learning, a word that occurs
    once is new there, as it would be without this occurrence."""
    lead = max(at - BEFORE, 0)
    word = tokens[lead:to] & ((1 << STATE) - 1)
    leaf = np.where(tokens[at:to] >> STATE >= (ONCE if learning else NEVER), NEW, word[at - lead:]).astype(np.int64)
    return leaf, contexts(word, first[lead:to])[:, at - lead:]

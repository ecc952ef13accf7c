"""Sampled segmentations into pieces, and their lossless decoding.

A text's lattice has an edge for every piece that fits; an edge weighs
``(1 - score) ** (-1 / temperature)`` of its piece, so common pieces are
likelier, and a segmentation weighs the product of its edges. Forward filtering
sums the weights of all ways to reach each place; backward sampling then draws
the last piece, the one before it, and so on, in proportion, which draws whole
segmentations with their exact probabilities. Pieces never hold a space after
another character, so the lattice splits into units (a run of spaces and the
word behind it). Equal units of a slice of texts are filtered once, and all
units of one length go through the same array operations.

The draws come from a counter-based generator keyed by the row's key and the
seed: the same key and text give the same pieces on any executor, in any run.
Characters without a piece, and the literal space mark, become byte pieces, so
decoding always returns the exact text.

Edge cases: null and empty texts have no pieces; a null key is the key of all
rows without one; repeated rows get the same pieces; an unpaired surrogate
cannot occur in Spark strings.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolens.llm.columns import whole_text

MARK = "▁"
CODE_BITS = 21
UNIT = re.compile(r" *[^ ]+| +")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Sampling:
    """``temperature``: near zero always the likeliest pieces, large ones all alike;
    ``cells``: lattice edges held in memory at once."""

    tokenizer: str = "piece_bpe_32k.model"
    temperature: float = 0.5
    seed: int = 7
    slice_chars: int = 6_000_000
    cells: int = 4_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64: the number at place x of a fixed random sequence."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PieceLattice:
    """Segmentations of texts under one piece model."""

    def __init__(self, path: str, config: Sampling = Sampling()) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.config, self.surface = config, []
        self.byte = np.zeros(256, dtype=np.int32)
        child: dict[int, int] = {}
        piece_id, weight = [-1], [0.0]
        self.longest = 1
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                self.surface.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.surface.append(b"")
            else:
                text, node = piece.replace(MARK, " "), 0
                for c in text:
                    key = node << CODE_BITS | ord(c)
                    if key not in child:
                        child[key] = len(piece_id)
                        piece_id.append(-1)
                        weight.append(0.0)
                    node = child[key]
                piece_id[node] = i
                weight[node] = (1 - model.get_score(i)) ** (-1 / config.temperature)
                self.longest = max(self.longest, len(text))
                self.surface.append(text.encode())
        keys = np.array(sorted(child), dtype=np.int64)
        self.keys, self.child = keys, np.array([child[k] for k in keys.tolist()], dtype=np.int64)
        self.piece_id, self.weight = np.array(piece_id, dtype=np.int64), np.array(weight)
        self.byte_weight = len(self.surface) ** (-1 / config.temperature)

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and ids by (unit, end, length - 1); a character without a piece has
        the negative of its code less one as its id and the weight of its bytes."""
        units, n = codes.shape
        wide = min(n, self.longest)
        weight, ids = np.zeros((units, n + 1, wide)), np.zeros((units, n + 1, wide), dtype=np.int32)
        unit, start = (x.ravel() for x in np.indices((units, n)))
        node = np.zeros(len(unit), dtype=np.int64)
        for length in range(1, wide + 1):
            code = codes[unit, start + length - 1]
            key = node << CODE_BITS | code
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            alive = self.keys[at] == key
            node = np.where(alive, self.child[at], 0)
            piece = np.where(alive, self.piece_id[node], -1)
            whole = piece >= 0
            weight[unit[whole], start[whole] + length, length - 1] = self.weight[node[whole]]
            ids[unit[whole], start[whole] + length, length - 1] = piece[whole]
            if length == 1:
                lone = ~whole
                size = 1 + (code[lone] >= 0x80) + (code[lone] >= 0x800) + (code[lone] >= 0x10000)
                weight[unit[lone], start[lone] + 1, 0] = self.byte_weight ** size
                ids[unit[lone], start[lone] + 1, 0] = -code[lone] - 1
            on = alive & (start + length < n)
            unit, start, node = unit[on], start[on], node[on]
        return weight, ids

    def filtered(self, weight: np.ndarray) -> np.ndarray:
        """Running sums of the chances of each last length, by (unit, end): the forward
        values of the places before, times the weights, scaled at every place.

        A run of characters without a piece lets the older values outgrow any
        number; such units are filtered again with logarithms."""
        units, places, wide = weight.shape
        before, sums = np.zeros((units, wide)), np.zeros_like(weight)
        before[:, 0] = 1
        with np.errstate(over="ignore", invalid="ignore"):
            for end in range(1, places):
                ways = before * weight[:, end]
                total = ways.sum(axis=1, keepdims=True)
                sums[:, end] = np.cumsum(ways, axis=1) / total
                before = np.concatenate([total, before[:, :-1]], axis=1) / total
        lost = ~np.isfinite(sums[:, :, -1]).all(axis=1)
        if lost.any():
            sums[lost] = self.filtered_logs(weight[lost])
        return sums

    def filtered_logs(self, weight: np.ndarray) -> np.ndarray:
        """``filtered`` with the forward values as logarithms, relative to the newest."""
        units, places, wide = weight.shape
        before, sums = np.full((units, wide), -np.inf), np.zeros_like(weight)
        before[:, 0] = 0
        with np.errstate(divide="ignore"):
            for end in range(1, places):
                ways = before + np.log(weight[:, end])
                top = ways.max(axis=1, keepdims=True)
                chances = np.exp(ways - top)
                total = chances.sum(axis=1, keepdims=True)
                sums[:, end] = np.cumsum(chances, axis=1) / total
                newest = top + np.log(total)
                before = np.concatenate([newest, before[:, :-1]], axis=1) - newest
        return sums

    def drawn(self, sums: np.ndarray, ids: np.ndarray, unit: np.ndarray, state: np.ndarray):
        """Backward draws for occurrences of units: (occurrence, step, id), last piece first."""
        place = np.full(len(unit), sums.shape[1] - 1)
        occurrence, step, out = np.arange(len(unit)), 0, []
        while len(occurrence):
            u = (mixed(state + GOLDEN * np.array([step + 1], dtype=np.uint64)) >> np.uint64(11)) * 2.0 ** -53
            chances = sums[unit, place]
            pick = np.minimum((chances <= u[:, None]).sum(axis=1),
                              (chances < chances[:, -1:]).sum(axis=1))
            out.append((occurrence, np.full(len(unit), step), ids[unit, place, pick]))
            place = place - pick - 1
            on = place > 0
            occurrence, unit, place, state = occurrence[on], unit[on], place[on], state[on]
            step += 1
        return [np.concatenate(x) for x in zip(*out)]

    def sample(self, texts: list[str], keys: list[str]) -> list[np.ndarray]:
        """Ids of one segmentation per text, determined by text, key and seed."""
        split = [UNIT.findall(" " + t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        every = list(chain.from_iterable(split))
        number = {u: i for i, u in enumerate(dict.fromkeys(every))}
        which = np.fromiter(map(number.__getitem__, every), dtype=np.int64, count=len(every))
        first = np.concatenate([[0], np.cumsum(sizes)])
        seeds = np.array([xxhash.xxh64_intdigest(k.encode(), self.config.seed) for k in keys],
                         dtype=np.uint64)
        nth = np.arange(len(which)) - np.repeat(first[:-1], sizes)
        state = mixed(np.repeat(seeds, sizes) + GOLDEN * nth.astype(np.uint64))
        lengths = np.fromiter(map(len, number), dtype=np.int64, count=len(number))
        names = np.array(list(number), dtype=object)
        found = [[], [], []]
        by_unit = np.argsort(which, kind="stable")
        starts = np.searchsorted(which[by_unit], np.arange(len(number) + 1))
        for n in np.unique(lengths):
            of_length = np.flatnonzero(lengths == n)
            some = max(1, self.config.cells // int(n * min(n, self.longest)))
            for at in range(0, len(of_length), some):
                mine = of_length[at:at + some]
                codes = np.frombuffer("".join(names[mine]).encode("utf-32-le", "surrogatepass"),
                                      dtype="<u4").astype(np.int64).reshape(len(mine), n)
                weight, ids = self.edges(codes)
                spans = [by_unit[a:b] for a, b in zip(starts[mine], starts[mine + 1])]
                occurrence = np.concatenate(spans)
                unit = np.repeat(np.arange(len(mine)), [len(x) for x in spans])
                o, step, piece = self.drawn(self.filtered(weight), ids, unit, state[occurrence])
                for store, x in zip(found, (occurrence[o], step, piece)):
                    store.append(x)
        if not len(which):
            return [np.zeros(0, np.int32) for _ in texts]
        return self.joined(first, *(np.concatenate(x) for x in found))

    def joined(self, first: np.ndarray, occurrence: np.ndarray, step: np.ndarray,
               piece: np.ndarray) -> list[np.ndarray]:
        """The drawn pieces in reading order, one array per text, bytes spelled out."""
        count = np.bincount(occurrence, minlength=first[-1])
        offset = np.concatenate([[0], np.cumsum(count)])
        flat = np.empty(len(piece), dtype=np.int32)
        flat[offset[occurrence + 1] - 1 - step] = piece
        spelled = np.flatnonzero(flat < 0)
        code = -flat[spelled].astype(np.int64) - 1
        size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        times = np.ones(len(flat), dtype=np.int64)
        times[spelled] = size
        out, ends = np.repeat(flat, times), np.concatenate([[0], np.cumsum(times)])
        for k in range(4):
            has = size > k
            c, n = code[has], size[has]
            low = 0x80 | (c >> 6 * (n - 1 - k)) & 0x3F
            lead = np.where(n == 1, c, (0xF00 >> n & 0xFF) | c >> 6 * (n - 1))
            out[ends[spelled[has]] + k] = self.byte[lead if k == 0 else low]
        cuts = ends[offset[first]]
        return [out[a:b] for a, b in zip(cuts, cuts[1:])]

    def slices(self, texts: list[str], keys: list[str]) -> Iterator[np.ndarray]:
        """``sample`` over slices of bounded size."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= self.config.slice_chars):
                chars += len(texts[end])
                end += 1
            yield from self.sample(texts[at:end], keys[at:end])
            at = end

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


def encode(docs: DataFrame, config: Sampling = Sampling(), key: str = "doc_id", text: str = "text",
           into: str = "pieces") -> DataFrame:
    """``docs`` with the sampled ids of every whole text as an array column."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        lattice = PieceLattice(public_tokenizers.path(config.tokenizer), config)
        for texts, keys in batches:
            yield pd.Series(list(lattice.slices(list(texts), list(keys))))

    return docs.withColumn(into, ids(whole_text(text), _key(key)))


def decode(ids: Column, config: Sampling = Sampling()) -> Column:
    """The text of an array of ids; null ids are an empty text."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lattice = PieceLattice(public_tokenizers.path(config.tokenizer), config)
        for batch in batches:
            yield pd.Series([lattice.decode(x) if x is not None else "" for x in batch])

    return text(ids)


def round_trip(docs: DataFrame, config: Sampling = Sampling(), key: str = "doc_id",
               text: str = "text", into: str = "pieces") -> DataFrame:
    """``docs`` with the struct ``into`` (n_pieces, ids_crc32, lossless): encoded and decoded in
    one pass, for counts over tables whose ids are not to be stored."""

    @F.pandas_udf("n_pieces long, ids_crc32 long, lossless boolean")
    def both(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        lattice = PieceLattice(public_tokenizers.path(config.tokenizer), config)
        for texts, keys in batches:
            rows = []
            for whole, ids in zip(texts, lattice.slices(list(texts), list(keys))):
                rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()),
                             lattice.decode(ids) == whole))
            yield pd.DataFrame(rows, columns=["n_pieces", "ids_crc32", "lossless"])

    return docs.withColumn(into, both(whole_text(text), _key(key)))


def _key(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit(""))

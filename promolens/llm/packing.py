"""Packing of tokenised documents into sequences of bounded length.

The lengths of all pieces form a histogram with at most ``capacity`` entries,
the only thing the driver sees. Over it the configuration linear program
(how often to use each multiset of lengths that fits one sequence) is solved by
multiplicative weights: a length's price falls by a factor with the share of it
that is covered, an unbounded knapsack by dynamic programming prices the
patterns, and those within ``slack`` of the dearest are used until the next
share is covered. Its work is bounded by ``rounds`` knapsacks; what is uncovered
then is covered longest first. A program of at most ``refined_lengths`` lengths
that is not within ``gap`` of its bound is refined by column generation, of at
most ``refined_steps`` steps. The fractional
uses are rounded down, then up where pieces are still there, and only what is
left is filled by best fit on the histogram, again a whole
number of uses of one pattern at a time. Every piece then finds its place by its rank
among the pieces of its length: ranks come from counts per (length, salt), so
a length that a third of all pieces have is ranked in many tasks.

Pieces are tokenised in Arrow batches; chunks between ASCII white space are
encoded once each (the pre-tokeniser drops white space, so tokens never cross
it) and remembered in a bounded table per worker, which outlives its tasks.

Edge cases: null and empty texts are the end token alone; a document longer
than the capacity is cut; a null id and repeated rows are packed like any other
row; an empty table gives an empty result; other columns pass unchanged.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, pre_tokenizers

from promolens.llm.columns import any_names, whole_text
from promolens.llm.scratch import table


@dataclass(frozen=True)
class Packing:
    """``rounds``: knapsacks of the linear program at most; ``gap``: how far it may end above its
    bound without refinement, and ``refined_lengths``, ``refined_steps`` what that may cost;
    ``salts``: tasks that rank one length;
    ``remembered``: chunks kept per worker, about 250 bytes each."""

    capacity: int = 4096
    end_token: int = 1
    tokenizer: str = "word_bpe_49k.json"
    rounds: int = 300
    gap: float = 0.001
    refined_lengths: int = 128
    refined_steps: int = 1000
    salts: int = 64
    remembered: int = 250_000
    texts_per_batch: int = 256


#: What may end a plain chunk: ASCII marks but the apostrophe, which opens contractions.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Other letters of a plain chunk; their lower case is one letter, too.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Bytes of a chunk beyond which it is not remembered, which bounds the table's memory.
LONG = 100
#: Runs of marks that are remembered; few are common.
MARKS_KEPT = 4096


class ChunkEncoder(dict):
    """Ids of texts as little-endian bytes; maps up to ``limit`` chunks to theirs.

    The pre-tokeniser parts letters from the marks behind them. Such a plain
    chunk goes to the library's model at once, its lower-cased word, which is
    remembered as a chunk of its own, and its marks apart; any other chunk passes
    the whole library.
    """

    def __init__(self, path: str, limit: int) -> None:
        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.limit = self.library.model, limit
        self.spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.marks = lru_cache(MARKS_KEPT)(self.part_ids)

    def part_ids(self, part: str) -> bytes:
        if not part.isascii():
            part = self.spelled.pre_tokenize_str(part)[0][0]
        return array("I", [token.id for token in self.model.tokenize(part)]).tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if len(chunk) > LONG:
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        word = text.rstrip(MARKS)
        if word.isalpha() and (word.isascii() or LATIN(word)):
            lower, marks = word.lower(), text[len(word):]
            ids = self.part_ids(lower) if lower == text else self[lower.encode()]
            ids += self.marks(marks) if marks else b""
        else:
            ids = array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) >= self.limit:
            self.clear()
        self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode("utf-8", "surrogatepass").split()))


@cache
def worker_encoder(path: str, limit: int) -> ChunkEncoder:
    """The encoder of this worker process; what it remembers serves all its tasks."""
    return ChunkEncoder(path, limit)


def pieces(docs: DataFrame, config: Packing = Packing(), text: str = "text",
           into: str = "piece", with_ids: bool = True) -> DataFrame:
    """One row per piece: the other columns and the struct (piece, start, length, crc, ids).

    Rows pass in small Arrow batches, so a worker holds a few hundred texts at a time.
    """
    others = [c for c in docs.columns if c not in (text, into)]
    fields = {"piece": "int", "start": "long", "length": "long", "crc": "long"}
    if with_ids:
        fields["ids"] = "array<int>"
    # Columns travel by place, as names of the table at hand may repeat or clash.
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)],
                        whole_text(text).alias("_text"))
    shape = T.StructType([*plain.schema.fields[:-1], T.StructField("_piece", T.StructType.fromDDL(
        ", ".join(f"{name}: {kind}" for name, kind in fields.items())))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(public_tokenizers.path(config.tokenizer), config.remembered)
        end, width = np.array([config.end_token], dtype="<u4").tobytes(), 4 * config.capacity
        for batch in batches:
            for at in range(0, batch.num_rows, config.texts_per_batch):
                some = batch.slice(at, config.texts_per_batch)
                row, number, parts = [], [], []
                for i, whole in enumerate(some.column(len(others)).to_pylist()):
                    data = encoder.encode(whole) + end
                    for k, start in enumerate(range(0, len(data), width)):
                        row.append(i)
                        number.append(k)
                        parts.append(data[start:start + width])
                numbers = np.array(number, dtype=np.int64)
                sizes = np.array([len(p) // 4 for p in parts], dtype=np.int64)
                columns = [pa.array(numbers, pa.int32()), pa.array(numbers * config.capacity),
                           pa.array(sizes), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                        pa.array(np.frombuffer(b"".join(parts), "<i4"))))
                taken = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(i).take(taken) for i in range(len(others))),
                     pa.StructArray.from_arrays(columns, list(fields))],
                    [f.name for f in shape])

    return plain.mapInArrow(cut, shape).select(
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(others)], F.col("_piece").alias(into))


#: Of the multiplicative weights: shares that a length is covered in, how fast its price falls with
#: them, how far below the dearest a pattern may be, and how much dearer a token of a long length is.
SHARES, FALL, SLACK, LONGER = 10, 5.0, 0.01, 0.1


def knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths with a price; per room the largest total price that fits, and the length to take
    there for it, the longest of several, or 0 to leave a token's room."""
    sizes = np.flatnonzero(prices > 0)
    value, best = prices[sizes], np.zeros(capacity + 1)
    taken = np.zeros(capacity + 1, dtype=np.int64)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if fit := fits[room]:
            total = best[room - sizes[:fit]] + value[:fit]
            at = fit - 1 - int(total[::-1].argmax())
            if total[at] > best[room]:
                best[room], taken[room] = total[at], sizes[at]
    return sizes, best, taken


def through(size: int, taken: list[int]) -> dict[int, int]:
    """The dearest pattern among those that hold ``size``."""
    pattern, room = {size: 1}, len(taken) - 1 - size
    while room > 0:
        if other := taken[room]:
            pattern[other] = pattern.get(other, 0) + 1
        room -= other or 1
    return pattern


def dearest(sizes: np.ndarray, best: np.ndarray, value: np.ndarray, there: np.ndarray) -> dict[int, int]:
    """Lengths and their counts of a pattern with the largest total price, if the lengths still
    ``there`` have one; of several, the one with the longest lengths."""
    pattern: dict[int, int] = {}
    room = len(best) - 1
    while room > 0 and best[room] > 0:
        fit = int(np.searchsorted(sizes, room, side="right"))
        fits = np.flatnonzero((best[room] - (best[room - sizes[:fit]] + value[:fit]) <= 1e-9 * best[-1])
                              & there[:fit])
        if not len(fits):
            room -= 1
            continue
        size = int(sizes[fits[-1]])
        pattern[size] = pattern.get(size, 0) + 1
        room -= size
    return pattern


def dual_bound(counts: np.ndarray, capacity: int) -> float:
    """A lower bound of the linear program: for a cut a, lengths above ``capacity - a`` cost a
    sequence, lengths below a nothing, others their share of one; no pattern costs more than one."""
    size = np.arange(len(counts))
    n, tokens = np.cumsum(counts[::-1])[::-1], np.concatenate([[0], np.cumsum(counts * size)])
    cuts = np.arange(0, capacity // 2 + 1)
    above = np.concatenate([n, [0]])[capacity - cuts + 1]
    return float((above + (tokens[capacity - cuts + 1] - tokens[cuts]) / capacity).max(initial=0.0))


def fullest(need: np.ndarray, capacity: int) -> Iterator[dict[int, int]]:
    """Fullest patterns of the lengths that ``need`` has at the time."""
    size = np.arange(len(need), dtype=float)
    while True:
        price = np.where(need > 0, size, 0.0)
        sizes, best, _ = knapsack(price, capacity)
        pattern = dearest(sizes, best, price[sizes], need[sizes] > 0)
        while sum(l * n for l, n in pattern.items()) == best[-1]:
            yield pattern
            pattern = dearest(sizes, best, price[sizes], need[sizes] > 0)


def longest(need: np.ndarray, capacity: int) -> Iterator[dict[int, int]]:
    """Patterns of the longest length that ``need`` has at the time, then the longest that fits."""
    while True:
        sizes, room, pattern = np.flatnonzero(need > 0), capacity, {}
        while fit := int(np.searchsorted(sizes, room, side="right")):
            size = int(sizes[fit - 1])
            pattern[size] = room // size
            room %= size
        yield pattern


def first_basis(counts: np.ndarray, capacity: int, patterns) -> tuple[list[dict[int, int]], np.ndarray]:
    """Per length a pattern and its uses, which together cover every count.

    The next of ``patterns`` of what is left is used until a length is gone,
    which becomes that pattern's length. No later pattern holds it, so the
    patterns are a triangular basis of the linear program.
    """
    need = counts.astype(float)
    basis = {l: ({l: capacity // l}, 0.0) for l in np.flatnonzero(counts).tolist()}
    source = patterns(need, capacity)
    while need.any():
        pattern = next(source)
        at, each = np.array(list(pattern)), np.array(list(pattern.values()))
        step = float((need[at] / each).min())
        need[at] -= each * step
        gone = at[need[at] <= 1e-9 * counts[at]]
        need[gone] = 0
        basis[int(gone[0])] = (pattern, step)
    return [p for p, _ in basis.values()], np.array([u for _, u in basis.values()])


def weighted(counts: np.ndarray, capacity: int, rounds: int, bound: float
             ) -> tuple[list[tuple[dict[int, int], float]], np.ndarray, float]:
    """Patterns and uses by multiplicative weights, the counts they leave, and a lower bound.

    All lengths are covered share by share. A length's price is about its size
    times exp(-``FALL`` x its covered share), so what lags gets dear. Each round
    prices once and uses, for every length that lacks its share, the dearest pattern through it if
    that is within ``SLACK`` of the dearest of all; a round that hardly
    moves doubles the slack of the next one. No count is covered twice.
    """
    lengths, need = np.flatnonzero(counts), counts.astype(float)
    uses: dict[tuple, float] = {}
    share, slack, least = 1, SLACK, 0.002 * bound
    for _ in range(rounds):
        covered = 1 - need[lengths] / counts[lengths]
        while share <= SHARES and covered.min() >= share / SHARES - 1e-9:
            share += 1
        if share > SHARES:
            break
        price = np.zeros(len(counts))
        price[lengths] = (lengths / capacity) ** (1 + LONGER) * np.exp(-FALL * (covered - covered.min()))
        price[need <= 0] = 0
        sizes, best, taken = knapsack(price, capacity)
        if len(sizes) == len(lengths):
            bound = max(bound, float((price * counts).sum()) / best[-1])
        near = price[sizes] + best[capacity - sizes] >= (1 - slack) * best[-1]
        pick, moved = taken.tolist(), 0.0
        for size in sizes[near][::-1].tolist():
            most = need[size] - (1 - share / SHARES) * counts[size]
            if most <= 1e-9 * counts[size]:
                continue
            pattern = through(size, pick)
            step = min(most / pattern[size], *(need[l] / n for l, n in pattern.items()))
            if step <= 1e-12 * counts[size]:
                continue
            for l, n in pattern.items():
                need[l] -= n * step
                if need[l] <= 1e-9 * counts[l]:
                    need[l] = 0
            key = tuple(pattern.items())
            uses[key] = uses.get(key, 0.0) + step
            moved += step
        slack = SLACK if moved > least else min(1.0, 2 * slack)
    return [(dict(pattern), use) for pattern, use in uses.items()], need, bound


def linear_program(counts: np.ndarray, capacity: int, rounds: int, gap: float,
                   refined_lengths: int = Packing.refined_lengths, refined_steps: int = Packing.refined_steps
                   ) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Patterns and fractional uses that cover every count, and a lower bound of their sum.

    Multiplicative weights, what they leave longest first, and for few lengths column generation.
    """
    uses, need, bound = weighted(counts, capacity, rounds, dual_bound(counts, capacity))
    source = longest(need, capacity)
    while need.any():
        pattern = next(source)
        step = min(need[l] / n for l, n in pattern.items())
        for l, n in pattern.items():
            need[l] -= n * step
            if need[l] <= 1e-9 * counts[l]:
                need[l] = 0
        uses.append((pattern, step))
    value = sum(use for _, use in uses)
    if value > (1 + gap) * bound and np.count_nonzero(counts) <= refined_lengths:
        better, bound = refined(counts, capacity, refined_steps, gap, bound)
        if sum(use for _, use in better) < value:
            uses = better
    return uses, bound


def inverted(basis: np.ndarray) -> np.ndarray:
    """The inverse by elimination. A threaded linear algebra library is not called: it was seen to
    wait for ever in a driver that had started Python workers."""
    m = len(basis)
    rows = np.concatenate([basis, np.eye(m)], axis=1)
    for i in range(m):
        top = i + int(np.abs(rows[i:, i]).argmax())
        rows[[i, top]] = rows[[top, i]]
        rows[i] /= rows[i, i]
        others = np.arange(m) != i
        rows[others] -= rows[others, i:i + 1] * rows[i]
    return rows[:, m:]


def refined(counts: np.ndarray, capacity: int, steps: int, gap: float, bound: float
            ) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Uses of a basis that prices the lengths; the dearest pattern enters it, until
    their sum is within ``gap`` of the bound or ``steps`` patterns have entered."""
    lengths = np.flatnonzero(counts)
    patterns, uses = min((first_basis(counts, capacity, source) for source in (fullest, longest)),
                         key=lambda basis: basis[1].sum())
    m, row = len(lengths), {int(l): i for i, l in enumerate(lengths)}
    def column(pattern: dict[int, int]) -> np.ndarray:
        out = np.zeros(m)
        for l, n in pattern.items():
            out[row[l]] = n
        return out

    inverse = inverted(np.stack([column(p) for p in patterns], axis=1))
    for _ in range(steps):
        if uses.sum() <= (1 + gap) * bound:
            break
        price = np.zeros(len(counts))
        price[lengths] = np.maximum(inverse.sum(axis=0), 0)
        sizes, best, _ = knapsack(price, capacity)
        bound = max(bound, float((price * counts).sum()) / best[-1])
        if best[-1] <= 1 + 1e-9:
            break
        pattern = dearest(sizes, best, price[sizes], np.ones(len(sizes), dtype=bool))
        into = (inverse * column(pattern)).sum(axis=1)
        ratio = np.where(into > 1e-9, uses / np.where(into > 1e-9, into, 1.0), np.inf)
        out = int(np.argmin(ratio))
        step = float(ratio[out])
        uses = np.maximum(uses - step * into, 0)
        uses[out], patterns[out] = step, pattern
        inverse[out] /= into[out]
        into[out] = 0
        for at in np.flatnonzero(into):
            inverse[at] -= into[at] * inverse[out]
    return list(zip(patterns, uses.tolist())), bound


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns with whole uses for what is left: longest first, then the longest that fits."""
    out = []
    left = left.copy()
    while True:
        present = np.flatnonzero(left)
        if not len(present):
            return out
        pattern: dict[int, int] = {}
        room, upper = capacity, len(present)
        while room > 0:
            upper = min(upper, int(np.searchsorted(present, room, side="right")))
            if not upper:
                break
            size = int(present[upper - 1])
            take = min(room // size, int(left[size]))
            pattern[size] = take
            room -= take * size
            upper -= 1
        times = min(int(left[l]) // n for l, n in pattern.items())
        for l, n in pattern.items():
            left[l] -= n * times
        out.append((pattern, times))


def rounded(uses: list[tuple[dict[int, int], float]], counts: np.ndarray
            ) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Whole uses of all patterns, rounded down, then up where their pieces are still there,
    the largest fraction first; and the counts they leave."""
    left, chosen = counts.copy(), []
    whole = [(p, int(u + 1e-6)) for p, u in uses]
    more = [(p, 1) for p, u in sorted(uses, key=lambda use: int(use[1] + 1e-6) - use[1]) if u > int(u + 1e-6)]
    for pattern, most in whole + more:
        times = min(most, *(int(left[l]) // n for l, n in pattern.items()))
        if times > 0:
            for l, n in pattern.items():
                left[l] -= n * times
            chosen.append((pattern, times))
    return chosen, left


def plan(counts: np.ndarray, config: Packing = Packing()) -> list[tuple[dict[int, int], int]]:
    """Patterns with whole uses that hold exactly ``counts[l]`` pieces of each length l."""
    if not counts.any():
        return []
    uses, _ = linear_program(counts, config.capacity, config.rounds, config.gap,
                             config.refined_lengths, config.refined_steps)
    chosen, left = rounded(uses, counts)
    return chosen + best_fit(left, config.capacity)


def slots(uses: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, sequence of the first use, per use, place of the first)."""
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, times in uses:
        place = 0
        for size, n in pattern.items():
            by_length.setdefault(size, []).append((taken.get(size, 0), sequence, n, place))
            taken[size] = taken.get(size, 0) + n * times
            place += size * n
        sequence += times
    return {size: np.array(rows, dtype=np.int64) for size, rows in by_length.items()}


@any_names
def packed(docs: DataFrame, config: Packing = Packing(), text: str = "text", into: str = "piece",
           with_ids: bool = True) -> DataFrame:
    """One row per piece with ``sequence_id`` and ``offset`` added to the struct ``into``."""
    rows = table(pieces(docs, config, text, into, with_ids)
                 .withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(config.salts)))
                 .withColumn("_row", F.monotonically_increasing_id()), "pieces")
    length = F.col(into)["length"]
    counts = table(rows.groupBy(length.alias("_length"), "_salt").agg(
        F.count(F.lit(1)).alias("_n")), "lengths")
    before = Window.partitionBy("_length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    histogram = np.zeros(config.capacity + 1, dtype=np.int64)
    for r in counts.groupBy("_length").agg(F.sum("_n").alias("n")).collect():  # at most `capacity` rows
        histogram[r["_length"]] = r["n"]
    where = docs.sparkSession.sparkContext.broadcast(slots(plan(histogram, config)))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def placed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        table_of = where.value
        for sizes, ranks in batches:
            size, rank = sizes.to_numpy(), ranks.to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            cuts = np.flatnonzero(np.diff(size[order])) + 1
            for part in np.split(order, cuts) if len(order) else ():
                row = table_of[int(size[part[0]])]
                use = row[np.searchsorted(row[:, 0], rank[part], side="right") - 1]
                behind = rank[part] - use[:, 0]
                sequence[part] = use[:, 1] + behind // use[:, 2]
                offset[part] = use[:, 3] + behind % use[:, 2] * size[part]
            yield pd.DataFrame({"sequence_id": sequence, "offset": offset})

    within = F.row_number().over(Window.partitionBy("_length", "_salt").orderBy("_row"))
    ranked = (rows.withColumn("_length", length).join(F.broadcast(base), ["_length", "_salt"])
              .withColumn("_rank", F.col("_base") + within - 1))
    names = [c for c in rows.columns if c not in ("_salt", "_row", into)]
    spot = ranked.withColumn("_spot", placed(length, F.col("_rank")))
    fields = [F.col(into)[f].alias(f) for f in rows.schema[into].dataType.names]
    return spot.select(*[f"`{c}`" for c in names], F.struct(
        *fields, F.col("_spot.sequence_id").alias("sequence_id"),
        F.col("_spot.offset").alias("offset")).alias(into))


def digest_columns(into: str = "piece") -> list[Column]:
    piece = F.col(into)
    return [piece["piece"].alias("piece"), piece["start"].alias("start"),
            piece["length"].alias("length"), piece["crc"].alias("ids_crc32"),
            piece["sequence_id"].alias("sequence_id"), piece["offset"].alias("offset")]

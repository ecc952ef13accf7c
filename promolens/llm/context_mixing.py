"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is a sequence of tokens, its lower-cased words and one end. Two models of
the same kind code it bit by bit.

* ``Sequence`` codes which token follows in the text: along a prefix code of the
  corpus' tokens each bit is predicted without context, after the last word and
  after the last two. It counts every token of every training text in its
  place, and learns its weights online along the training texts.
* ``Model`` spells a word that training does not know, byte by byte up to an
  end-of-word symbol, along a prefix code of the corpus' bytes, in contexts
  within the word (place, the last one, two and three bytes, the whole prefix).
  A word is new once, so it learns from each distinct training word once, with
  the word's own counts left out.

In both, contexts are hashed to slots of tables that count zeros and ones; the
predictions, stretched to logits, are combined by weights that a gate selects
and that are learnt online, and an adaptive map of the mixed prediction refines
it. A token's probability is that of its leaf after the words before it, times
the word's share of the leaf: its counts among the leaf's words, all for the
most frequent words, which have their own leaves, and the end, and the spelled
probability for a new word. Probabilities of all words sum to at most one; what
is missing is the speller's share for words that training knows.

What moves:

* Each task deals its documents into batches of bounded size and writes, per
  batch, the distinct words and, per document, the word numbers.
* The distinct words of all batches meet once, by word, which gives the exact
  corpus counts; the leaves and the speller are made from that table.
* Leaves and shares return to their batch, where documents become streams of
  two bytes a token; counting, learning and scoring read these.

Tables of the models are sums over tasks, of a size that the parameters bound.

Edge cases: null and empty texts are one end token; without training texts all
counts are zero and the models predict from empty tables; repeated rows and
rows without an id are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolens.llm.columns import whole_text
from promolens.llm.scratch import owned, release, table
from promolens.llm.sequence_mixing import (BEFORE, END_OF_TEXT, NEVER, NEW, ONCE, STATE, Sequence,
                                           part)

END = 256
CONTEXTS = 5
PLACES, SEEN, LEVELS = 4, 8, 33


@dataclass(frozen=True)
class Mixing:
    """``slots``: bits of a table of the speller; ``batch_bytes``: text per batch; ``learners``:
    tasks that learn; ``words_at_once`` and ``learn_at_once``: words in one array operation and
    between two updates of the speller's weights. Of the sequence, ``frequent``: words with their
    own leaves; ``classes``: leaves of the others; ``most_slots``: bits of a table, fewer for less
    than four training tokens a slot; ``tokens_at_once``: between two updates; ``count_tokens``: a
    counting task's."""

    slots: int = 18
    batch_bytes: int = 16_000_000
    learners: int = 24
    words_at_once: int = 20_000
    learn_at_once: int = 1_500
    rate: float = 1.0
    frequent: int = 4096
    classes: int = 1024
    most_slots: int = 20
    tokens_at_once: int = 4096
    count_tokens: int = 16_000_000


def prefix_code(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Huffman code: per symbol its length, the nodes passed, and the bits taken there."""
    heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    children: list[tuple[int, int]] = []
    n = len(counts)
    while len(heap) > 1:
        (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        children.append((left, right))
        heapq.heappush(heap, (a + b, n + len(children) - 1, n + len(children) - 1))
    paths: dict[int, list[tuple[int, int]]] = {n + len(children) - 1: []}
    for inner in range(len(children) - 1, -1, -1):
        for bit, child in enumerate(children[inner]):
            paths[child] = [*paths[n + inner], (inner, bit)]
    deepest = max(len(paths[s]) for s in range(n))
    length = np.array([len(paths[s]) for s in range(n)])
    nodes, bits = np.zeros((n, deepest), np.int64), np.zeros((n, deepest), np.int8)
    for s in range(n):
        for d, (node, bit) in enumerate(paths[s]):
            nodes[s, d], bits[s, d] = node, bit
    return length, nodes, bits


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Code, count tables, gated weights and adaptive map; all of fixed size."""

    def __init__(self, config: Mixing, byte_counts: np.ndarray) -> None:
        self.config = config
        self.length, self.nodes, self.bits = prefix_code(byte_counts)
        self.size = 1 << config.slots
        self.tables = np.zeros((2, CONTEXTS, self.size), dtype=np.float32)
        self.weights = np.full((PLACES * SEEN, CONTEXTS), 0.35)
        self.adaptive = np.zeros((2, PLACES * SEEN * LEVELS))

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """Of all places of all words: symbol, word, place, and a hash per context."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        ends = np.cumsum(lengths + 1)
        symbol = np.full(int(ends[-1]) if len(ends) else 0, END, dtype=np.int64)
        inside = np.ones(len(symbol), dtype=bool)
        inside[ends - 1] = False
        symbol[inside] = data
        word = np.repeat(np.arange(len(words)), lengths + 1)
        place = np.arange(len(symbol)) - np.repeat(ends - lengths - 1, lengths + 1)
        with np.errstate(over="ignore"):
            before = [np.where(place >= k, np.roll(symbol, k) + 1, 0).astype(np.uint64) for k in (1, 2, 3)]
            power = np.cumprod(np.full(int(lengths.max(initial=0)) + 2, 0x9E3779B97F4A7C15, np.uint64))
            running = np.cumsum((symbol + 1).astype(np.uint64) * power[place])
            start = np.repeat(ends - lengths - 1, lengths + 1)
            shifted = np.concatenate([np.zeros(1, np.uint64), running[:-1]])
            prefix = shifted - shifted[start]
            one, two = before[0], before[0] + before[1] * np.uint64(263)
            three = two + before[2] * np.uint64(263 * 263)
            hashes = [np.minimum(place, 5).astype(np.uint64), one, two, three, prefix]
        return symbol, word, place, hashes

    def decisions(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """By depth of the code: word, place, slots (context, bit) and bits of all decisions."""
        symbol, word, place, hashes = self.symbols(words)
        shift, length, at = np.uint64(64 - self.config.slots), self.length[symbol], np.arange(len(symbol))
        hashes = [h * np.uint64(0xD6E8FEB86659FD93) ^ np.uint64(k) for k, h in enumerate(hashes)]
        for depth in range(self.nodes.shape[1]):
            at = at[length.take(at) > depth]
            if not len(at):
                return
            s = symbol.take(at)
            node = (self.nodes[:, depth].astype(np.uint64) + np.uint64(1)) * np.uint64(0xCA5A826395121157)
            node = node.take(s)
            slots = [((h.take(at) ^ node) * np.uint64(0x9FB21C651E98DF25) >> shift).astype(np.int64) for h in hashes]
            yield word.take(at), place.take(at), slots, self.bits[:, depth].take(s).astype(np.int64)

    def count(self, words: list[bytes]) -> None:
        flat = self.tables.reshape(-1)
        for _, _, slots, bit in self.decisions(words):
            for k, slot in enumerate(slots):
                np.add.at(flat, (bit * CONTEXTS + k) * self.size + slot, np.float32(1))

    def inputs(self, place, slots, bit, left_out: bool) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions and the gate of each decision; ``left_out`` takes one
        occurrence of the coded bit out of the counts, as if the word had not been seen."""
        x = np.empty((CONTEXTS, len(bit)), np.float32).T
        for k, slot in enumerate(slots):
            zeros, ones = self.tables[0, k].take(slot), self.tables[1, k].take(slot)
            if left_out:
                zeros, ones = np.maximum(zeros - (bit == 0), 0), np.maximum(ones - (bit == 1), 0)
            x[:, k] = np.log((ones + np.float32(0.2)) / (zeros + np.float32(0.2)))
        seen = np.minimum(np.log2(zeros + ones + 1), SEEN - 1).astype(np.int64)
        return x, np.minimum(place, PLACES - 1) * SEEN + seen

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        weights = np.ascontiguousarray(self.weights.T)
        out = x[:, 0] * weights[0].take(gate)
        for k in range(1, CONTEXTS):
            out += x[:, k] * weights[k].take(gate)
        return out

    def learn(self, words: list[bytes], adapting: bool = False) -> None:
        """One online step: per gate, the scaled mean gradient of the coding cost; ``adapting``
        counts what became of the predictions before it."""
        gates = len(self.weights)
        for _, place, slots, bit in self.decisions(words):
            x, gate = self.inputs(place, slots, bit, True)
            mixed = self.mixed(x, gate)
            if adapting:
                self.became(mixed, gate, bit)
            error = bit - squash(mixed)
            total = np.bincount(gate, minlength=gates) + 1e-9
            for k in range(CONTEXTS):
                slope = np.bincount(gate, error * x[:, k], gates) / total
                self.weights[:, k] += self.config.rate * slope / (
                    1 + np.bincount(gate, x[:, k] ** 2, gates) / total)
            np.clip(self.weights, -3, 3, out=self.weights)

    def level(self, mixed: np.ndarray, gate: np.ndarray) -> np.ndarray:
        half = LEVELS // 2
        return gate * LEVELS + np.clip(np.rint(mixed * 2), -half, half).astype(np.int64) + half

    def adapt(self, words: list[bytes]) -> None:
        """Count what became of mixed predictions, per gate and level."""
        for _, place, slots, bit in self.decisions(words):
            x, gate = self.inputs(place, slots, bit, True)
            self.became(self.mixed(x, gate), gate, bit)

    def became(self, mixed: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> None:
        n = self.adaptive.shape[1]
        self.adaptive += np.bincount(self.level(mixed, gate) + bit * n, minlength=2 * n).reshape(2, n)

    def log10(self, words: list[bytes]) -> np.ndarray:
        """Log10 probability of each word with its end."""
        out = np.zeros(len(words))
        for word, place, slots, bit in self.decisions(words):
            x, gate = self.inputs(place, slots, bit, False)
            mixed = self.mixed(x, gate)
            p = squash(mixed)
            zeros, ones = self.adaptive.take(self.level(mixed, gate), axis=1)
            refined = (ones + 4 * p) / (zeros + ones + 4)
            one = np.clip((p + refined) / 2, 1e-7, 1 - 1e-7)
            out += np.bincount(word, np.log10(np.where(bit == 1, one, 1 - one)), len(words))
        return out


def with_counts(spelled: np.ndarray, c: np.ndarray, n: np.ndarray | int, novel: np.ndarray | float) -> np.ndarray:
    """Log10 of ``(1 - novel) * c / n`` plus ``novel`` times the spelled probability, added as
    logarithms: the spelled probability of a long word is far below the smallest number."""
    with np.errstate(divide="ignore"):
        counted = np.log10((1 - novel) * c / n)
        new = np.log(novel)
    return np.logaddexp(counted * np.log(10), new + spelled * np.log(10)) / np.log(10)


def batches_of(docs: DataFrame, key: str, text: str, train: Column, config: Mixing) -> DataFrame:
    """Rows of two kinds: distinct words of a batch (word not null), and documents of it."""
    kind = docs.schema[key].dataType.simpleString()
    schema = (f"batch long, number int, word binary, n_train long, id {kind}, train boolean, "
              "n_bytes long, n_tokens long, numbers binary")

    def flush(batch: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids, texts, train = (rows.column(i).combine_chunks() for i in range(3))
        # Only A-Z change, and only ASCII white space parts words.
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        parts = lists.flatten()
        there = pc.greater(pc.binary_length(parts), 0).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), pc.list_value_length(lists).to_numpy())
        if not there.all():
            doc, parts = doc[there], parts.filter(pa.array(there))
        coded = parts.dictionary_encode()
        number, size = coded.indices.to_numpy(), len(coded.dictionary)
        seen = np.bincount(number[train.to_numpy(zero_copy_only=False)[doc]], minlength=size)
        tokens = np.bincount(doc, minlength=len(ids))
        cuts = np.concatenate([[0], np.cumsum(tokens)])
        # Byte planes of the numbers, as the high ones of a document are alike.
        planes = [number[i:j].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
                  for i, j in zip(cuts, cuts[1:])]
        types = pa.schema([("batch", pa.int64()), ("number", pa.int32()), ("word", pa.binary()),
                           ("n_train", pa.int64()), ("id", ids.type), ("train", pa.bool_()),
                           ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("numbers", pa.binary())])

        def made(length: int, **columns) -> pa.RecordBatch:
            columns["batch"] = pa.array(np.full(length, batch))
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns
                                               else pa.nulls(length, f.type) for f in types], schema=types)

        yield made(size, number=pa.array(np.arange(size)), word=coded.dictionary, n_train=pa.array(seen))
        yield made(len(ids), id=ids, train=train, n_bytes=pc.binary_length(texts),
                   n_tokens=pa.array(tokens + 1), numbers=pa.array(planes, pa.binary()))

    def split(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        nth, used, held = TaskContext.get().partitionId() << 24, 0, []
        for some in incoming:
            ends = np.cumsum(pc.binary_length(some.column(1)).to_numpy(), dtype=np.int64)
            first = 0
            while first < some.num_rows:
                base = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, base + config.batch_bytes - used, side="right")))
                held.append(some.slice(first, last - first))
                used += int(ends[last - 1]) - base
                first = last
                if used >= config.batch_bytes:
                    yield from flush(nth, held)
                    nth, used, held = nth + 1, 0, []
        if held:
            yield from flush(nth, held)
        held.clear()
        pa.default_memory_pool().release_unused()  # later stages run in the same worker

    return docs.select(F.col(key).alias("_id"), whole_text(text).alias("_text"),
                       train.alias("_train")).mapInArrow(split, schema)


def runs_of(incoming: Iterator[pa.RecordBatch], at_once: int) -> Iterator[list[bytes]]:
    """The words, at most ``at_once`` in a list."""
    for some in incoming:
        for at in range(0, some.num_rows, at_once):
            yield some.column(0).slice(at, at_once).to_pylist()


CHUNK = 4096


def counted_chunks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's counts as rows, without chunks of zeros; byte planes, as most counts are small."""
    flat = counts.reshape(-1, CHUNK)
    some = np.flatnonzero(flat.any(axis=1))
    for at in range(0, len(some), 64):
        part = some[at:at + 64]
        data = [flat[i].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for i in part]
        yield pa.RecordBatch.from_pydict({"at": pa.array(part, pa.int32()), "n": pa.array(data, pa.binary())})


def add_up(parts: DataFrame, into: np.ndarray) -> None:
    """Sum the rows of ``counted_chunks`` of all tasks into a table of bounded size."""
    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.uint64)
        for data in group["n"]:
            total += np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()
        return pd.DataFrame({"at": group["at"][:1].to_numpy(), "n": [total.astype(np.float32).tobytes()]})

    flat = into.reshape(-1, CHUNK)
    for r in parts.groupBy("at").applyInPandas(added, "at int, n binary").toLocalIterator():
        flat[r["at"]] = np.frombuffer(r["n"], np.float32)


def trained(vocabulary: DataFrame, config: Mixing) -> Model:
    """The speller: count, learn and adapt over all training words; each pass sums tables of
    fixed size."""
    spark = vocabulary.sparkSession
    train = vocabulary.filter("first AND c > 0").select("word").coalesce(config.learners)

    def passes(step, shape: str) -> DataFrame:
        def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from step(runs_of(incoming, config.words_at_once))

        return train.mapInArrow(run, shape)

    def spell(runs):
        counts = np.zeros(END + 1)
        for words in runs:
            counts += np.bincount(np.frombuffer(b"".join(words), np.uint8), minlength=END + 1)
            counts[END] += len(words)
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(END + 1), pa.int32()), "n": counts})

    counts = np.zeros(END + 1)
    for r in passes(spell, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] = r["n"]
    model = Model(config, counts)

    def count(runs):
        own = Model(config, counts)
        for words in runs:
            own.count(words)
        yield from counted_chunks(own.tables.astype(np.uint32))

    add_up(passes(count, "at int, n binary"), model.tables)
    model_of = spark.sparkContext.broadcast(model)

    # Each learner has the words of one hash class in a fixed order, so how the table happens to
    # be partitioned does not matter.
    order = F.xxhash64("word")
    dealt = (train.select("word", F.pmod(order, F.lit(config.learners)).cast("int").alias("learner"),
                          order.alias("place"))
             .repartition(config.learners, "learner").sortWithinPartitions("learner", "place", "word"))

    def learn(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, own, waiting, n = None, None, [], 0

        def result() -> pa.RecordBatch:
            if waiting:
                own.learn(waiting, adapting=True)
            return learnt_row(learner, n, own)

        for some in incoming:
            number = some.column("learner").to_numpy()
            for part in np.split(np.arange(len(number)), np.flatnonzero(np.diff(number)) + 1):
                if not len(part):
                    continue
                if number[part[0]] != learner:
                    if learner is not None:
                        yield result()
                    learner, waiting, n = int(number[part[0]]), [], 0
                    own = copy(model_of.value)
                    own.weights, own.adaptive = own.weights.copy(), own.adaptive.copy()
                waiting += some.column("word").slice(part[0], len(part)).to_pylist()
                n += len(part)
                while len(waiting) >= config.learn_at_once:
                    own.learn(waiting[:config.learn_at_once], adapting=True)
                    waiting = waiting[config.learn_at_once:]
        if learner is not None:
            yield result()

    average(model, dealt.mapInArrow(learn, LEARNT).collect())
    model_of.destroy()
    return model


LEARNT = "learner int, n double, w binary, a binary"


def learnt_row(learner: int, n: int, own: Model | Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "learner": pa.array([learner], pa.int32()), "n": pa.array([float(n)]),
        "w": pa.array([own.weights.tobytes()]), "a": pa.array([own.adaptive.tobytes()])})


def average(model: Model | Sequence, rows: list) -> None:
    """Weights by what each learner has read, and the sum of their maps; one row a learner."""
    if rows:
        rows = sorted(rows)
        shares = np.array([r["n"] for r in rows])
        each = np.array([np.frombuffer(r["w"], model.weights.dtype).reshape(model.weights.shape) for r in rows])
        model.weights = np.tensordot(shares / shares.sum(), each, axes=1).astype(model.weights.dtype)
        model.adaptive = sum(np.frombuffer(r["a"]) for r in rows).reshape(model.adaptive.shape)


def streams_of(incoming: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with the tokens of their texts end to end, and where texts begin."""
    for some in incoming:
        column = some.column("stream")
        tokens = np.frombuffer(b"".join(column.to_pylist()), "<u2")
        first = np.zeros(len(tokens), bool)
        length = pc.binary_length(column).to_numpy() // 2
        first[np.cumsum(length) - length] = True
        yield some, tokens, first


def trained_sequence(streams: DataFrame, model: Sequence, n: int, config: Mixing) -> None:
    """Count every token of every training text in its place, then learn along the texts."""
    spark, step = streams.sparkSession, config.tokens_at_once
    train = streams.filter("train").select("stream")

    def count(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(model_of.value.shape, np.uint32)
        flat = counts.reshape(len(counts), -1)
        for _, tokens, first in streams_of(incoming):
            for at in range(0, len(tokens), step):
                model_of.value.count(flat, *part(tokens, first, at, at + step, True))
        yield from counted_chunks(counts)

    model_of = spark.sparkContext.broadcast(model)
    tasks = min(config.learners, n // config.count_tokens + 1)
    tables = np.zeros(model.shape, np.float32)
    add_up(train.coalesce(tasks).mapInArrow(count, "at int, n binary"), tables)
    model_of.destroy()
    model.tables = tables
    model_of = spark.sparkContext.broadcast(model)

    # As for the speller: texts of one hash class a learner, in a fixed order. Equal texts have
    # equal streams, so their order does not matter.
    order = F.xxhash64("stream")
    dealt = (train.select("stream", F.pmod(order, F.lit(config.learners)).cast("int").alias("learner"),
                          order.alias("place"))
             .repartition(config.learners, "learner").sortWithinPartitions("learner", "place", "stream"))

    def learn(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, own, learnt, at = None, None, 0, 0
        tokens, first = np.zeros(0, "<u2"), np.zeros(0, bool)

        def upto(to: int) -> None:
            nonlocal learnt, at
            if to > at:
                own.learn(*part(tokens, first, at, to, True), config.rate)
                learnt, at = learnt + to - at, to

        def result() -> pa.RecordBatch:
            upto(len(tokens))
            return learnt_row(learner, learnt, own)

        for some, new, begins in streams_of(incoming):
            number = some.column("learner").to_numpy()
            ends = np.cumsum(pc.binary_length(some.column("stream")).to_numpy() // 2)
            for rows in np.split(np.arange(len(number)), np.flatnonzero(np.diff(number)) + 1):
                if not len(rows):
                    continue
                if number[rows[0]] != learner:
                    if learner is not None:
                        yield result()
                    learner, learnt, at, tokens, first = int(number[rows[0]]), 0, 0, tokens[:0], first[:0]
                    own = model_of.value.fresh()
                there = slice(ends[rows[0] - 1] if rows[0] else 0, ends[rows[-1]])
                keep = max(at - BEFORE, 0)
                at -= keep
                tokens = np.concatenate([tokens[keep:], new[there]])
                first = np.concatenate([first[keep:], begins[there]])
                while len(tokens) - at >= step:
                    upto(at + step)
        if learner is not None:
            yield result()

    average(model, dealt.mapInArrow(learn, LEARNT).collect())
    model_of.destroy()


def mixing_scores(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text",
                  config: Mixing = Mixing()) -> DataFrame:
    """One row per document: id, train, n_bytes, n_tokens, n_known, train_tokens, base_score,
    score (log10), bits_per_byte."""
    spark = docs.sparkSession
    with owned() as made:
        streams, model, n = coded_texts(docs, train, key, text, config)
        release(spark, made, unless=streams)
    trained_sequence(streams, model, n, config)
    model_of = spark.sparkContext.broadcast(model.ready())
    step = config.tokens_at_once

    def scored(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of.value
        for some, tokens, first in streams_of(incoming):
            row = np.cumsum(first) - 1
            score = some.column("spelled").to_numpy().copy()
            for at in range(0, len(tokens), step):
                rows = row[at:at + step]
                found = np.bincount(rows - rows[0], own.log10(*part(tokens, first, at, at + step, False)))
                score[rows[0]:rows[-1] + 1] += found
            yield pa.RecordBatch.from_arrays(
                [*(some.column(c) for c in kept), pa.array(score)], names=[*kept, "score"])

    kept = ["id", "train", "n_bytes", "n_tokens", "n_known", "train_tokens", "base_score"]
    kind = docs.schema[key].dataType.simpleString()
    result = streams.mapInArrow(scored, f"id {kind}, train boolean, n_bytes long, n_tokens long, n_known long, "
                                        "train_tokens long, base_score double, score double")
    return result.withColumn("bits_per_byte", -F.col("score") * float(np.log2(10))
                             / F.greatest(F.col("n_bytes"), F.lit(1))).withColumnRenamed("id", key)


def coded_texts(docs: DataFrame, train: Column, key: str, text: str,
                config: Mixing) -> tuple[DataFrame, Sequence, int]:
    """Documents with their base score, the log10 shares of their words in their leaves (column
    ``spelled``) and their tokens; a model of the leaves that has not learnt; training tokens."""
    spark = docs.sparkSession
    both = table(batches_of(docs, key, text, F.coalesce(train, F.lit(False)), config), "batches")
    documents = both.filter("word IS NULL").select("batch", "id", "train", "n_bytes", "n_tokens", "numbers")
    entries = both.filter("word IS NOT NULL").select("batch", "number", "word", "n_train")
    # One shuffle by word; a word has one row per batch at most, however often it occurs.
    word = Window.partitionBy("word")
    words = table(entries.select("word", F.sum("n_train").over(word).alias("c"),
                                 (F.col("batch") == F.min("batch").over(word)).alias("first"),
                                 "batch", "number"), "words")
    totals = documents.agg(F.sum(F.when(F.col("train"), F.col("n_tokens"))).alias("n"),
                           F.count_if("train").alias("ends")).first()
    n, ends = totals["n"] or 0, totals["ends"]

    # Leaves: the end, new words, frequent words (not long ones, as all tasks hold them), classes.
    often = (words.filter("first AND c > 1 AND length(word) <= 100").orderBy(F.desc("c"), "word")
             .limit(config.frequent).select("word").collect())
    own = spark.createDataFrame([(r["word"], NEW + 1 + i) for i, r in enumerate(often)], "word binary, own int")
    classes = F.pmod(F.xxhash64("word"), F.lit(config.classes)).cast("int") + NEW + 1 + config.frequent
    coded = words.join(F.broadcast(own), "word", "left").withColumn("leaf", F.coalesce("own", classes))
    mass, counts = np.zeros((2, NEW + 1 + config.frequent + config.classes))
    once = distinct = 0
    for r in coded.filter("first AND c > 0").groupBy("leaf").agg(
            F.sum("c").alias("c"), F.count_if(F.col("c") == 1).alias("once"), F.count(F.lit(1)).alias("all")).collect():
        mass[r["leaf"]], counts[r["leaf"]] = r["c"], r["c"] - r["once"]
        once, distinct = once + r["once"], distinct + r["all"]
    distinct += bool(ends)
    # What training words met once tell of new ones: without this occurrence they are new.
    counts[END_OF_TEXT], counts[NEW] = ends, once
    mass[[END_OF_TEXT, NEW]] = 1
    slots = min(config.most_slots, max(12, (n // 4).bit_length()))
    sequence = Sequence(np.flatnonzero(mass), counts, slots, prefix_code)

    shared = spark.sparkContext.broadcast(trained(words, config))
    base = np.log10(n + 0.5 * (distinct + 1))

    def shares(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a word in its leaf; new words, whose spelling alone is read, are spelled."""
        speller = shared.value
        for some in incoming:
            c, leaf = some.column("c").to_numpy(), some.column("leaf").to_numpy()
            column = some.column("new").dictionary_encode()
            new = column.dictionary.to_pylist()
            spelled = np.zeros(len(c))
            if new:
                values = np.concatenate([speller.log10(new[i:i + config.words_at_once])
                                         for i in range(0, len(new), config.words_at_once)])
                spelled[c == 0] = values[column.indices.drop_null().to_numpy()]
            state = np.where(c == 0, NEVER, np.where(c == 1, ONCE, 0))
            yield pa.RecordBatch.from_pydict({
                "batch": some.column("batch"), "number": some.column("number"), "c": some.column("c"),
                "token": pa.array((leaf + (state << STATE)).astype(np.int32)),
                "p": pa.array(with_counts(spelled, c, np.maximum(mass[leaf], 1), (c == 0).astype(float)))})
        pa.default_memory_pool().release_unused()

    valued = coded.select("batch", "number", "c", "leaf", F.when(F.col("c") == 0, F.col("word")).alias("new")).mapInArrow(
        shares, "batch long, number int, c long, token int, p double")
    kind = docs.schema[key].dataType.simpleString()

    def joined(rows: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        size = len(values)
        c, p, token = np.zeros(size), np.zeros(size), np.zeros(size, "<u2")
        c[values["number"]], p[values["number"]], token[values["number"]] = values["c"], values["p"], values["token"]
        unit = np.log10(c + 0.5) - base
        out = []
        for r in rows.itertuples():
            planes = np.frombuffer(r.numbers, np.uint8)
            at = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel() if len(planes) else \
                np.zeros(0, np.uint32)
            out.append((r.id, bool(r.train), r.n_bytes, r.n_tokens, int((c[at] > 0).sum()) + bool(ends), n,
                        float(unit[at].sum() + np.log10(ends + 0.5) - base), float(p[at].sum()),
                        np.append(token[at], np.uint16(END_OF_TEXT)).astype("<u2").tobytes()))
        frame = pd.DataFrame(out, columns=["id", "train", "n_bytes", "n_tokens", "n_known",
                                           "train_tokens", "base_score", "spelled", "stream"])
        frame["id"] = rows["id"].to_numpy()
        pa.default_memory_pool().release_unused()
        return frame

    streams = documents.groupBy("batch").cogroup(valued.groupBy("batch")).applyInPandas(
        joined, f"id {kind}, train boolean, n_bytes long, n_tokens long, n_known long, "
                "train_tokens long, base_score double, spelled double, stream binary")
    return table(streams, "streams"), sequence, n

"""Ranked lexical search of many items at once, by presence masks.

Terms are runs of ASCII letters, digits and characters beyond ASCII, with only
A-Z lower-cased. Items are taken in blocks of bounded size, so that a block's
terms fit a worker; documents are read once a block:

1. Each document is reduced to its number of terms and the counts of those
   that some item of the block holds. This table lies in the shared folder.
2. Document counts, sums and document frequencies are aggregates over all rows;
   term weights follow from them.
3. A task takes its documents in batches. Per item, every term sets its bit in
   a bitmap over the batch, and documents are grouped by their mask of matched
   terms. The largest contribution of each term in the batch gives every
   distinct mask a maximum score; masks are evaluated by falling maximum until
   the next one is below the item's worst kept score. Equal maxima are still
   evaluated, as ties go to the smaller id. Kept scores carry over from batch to
   batch, so late batches evaluate few masks.
4. Each task gives at most ``top`` rows an item; a window ranks them.

No pairs of items and documents leave a task but those, none is skipped that
could be among the best, and texts are used whole.

Edge cases: a null text has no terms; a document without terms counts nowhere;
an item without known terms has no rows; scores of zero are left out; a null
document id comes last among equal scores; rows that repeat an id are rows of
their own, for documents and for items. Empty tables give an empty result.
Other columns, whatever their names, are left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolens.llm.columns import whole_text
from promolens.llm.scratch import table


@dataclass(frozen=True)
class Search:
    """``block_chars``: characters of items (each counts 100 more) whose terms are met in one pass;
    ``postings``: term counts of documents that a batch holds at most, one document at least;
    ``words``: 64-bit words of masks held at once."""

    top: int = 10
    block_chars: int = 4_000_000
    postings: int = 2_000_000
    words: int = 4_000_000
    evaluate: int = 64


#: A-Z in lower case, other bytes of terms as they are, the rest as spaces.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERMS).split()


def counted(docs: DataFrame, vocabulary: dict[bytes, int], config: Search, key: str, text: str) -> DataFrame:
    """Per document with terms: id, ``n`` and the known terms with their counts, by number."""
    plain = docs.select(F.col(f"`{key}`").alias("id"), whole_text(F.col(f"`{text}`")).cast("binary").alias("text"))
    shape = T.StructType([plain.schema["id"], *T.StructType.fromDDL("n long, terms array<int>, tfs array<int>")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            lengths, known, counts, cuts = [], [], [], [0]
            for whole in batch.column(1):
                found = terms(whole.as_py())
                ids, tfs = np.unique(np.array([i for i in map(number, found) if i is not None], np.int32),
                                     return_counts=True)
                lengths.append(len(found))
                known.append(ids)
                counts.append(tfs)
                cuts.append(cuts[-1] + len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(
                np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32))) for parts in (known, counts)]
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists],
                                              [f.name for f in shape])
            yield made.filter(pa.array(np.array(lengths, np.int64) > 0))

    return plain.mapInArrow(rows, shape)


@dataclass
class Items:
    """The items of a block: ids, numbers of their terms, and what weights need."""

    ids: list
    terms: list[np.ndarray]
    weights: np.ndarray
    docs: int
    length: int


class Batch:
    """Documents as postings by document and by term, with the contribution of each posting."""

    def __init__(self, batch: pa.RecordBatch, items: Items) -> None:
        self.ids = batch.column(0)
        lists, tfs = batch.column(2), batch.column(3)
        self.size = batch.num_rows
        n = batch.column(1).to_numpy().astype(np.int64)
        self.terms = lists.flatten().to_numpy()
        self.counts = lists.value_lengths().to_numpy().astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        doc = np.repeat(np.arange(self.size), self.counts)
        tf = tfs.flatten().to_numpy().astype(np.int64)
        m = 10 + (90 * n * items.docs) // items.length
        self.parts = items.weights[self.terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        by_term = np.argsort(self.terms, kind="stable")
        self.docs_of, cuts = doc[by_term], np.searchsorted(self.terms[by_term], np.arange(len(items.weights) + 1))
        self.cuts = cuts
        self.largest = np.zeros(len(items.weights), np.int64)
        np.maximum.at(self.largest, self.terms, self.parts)
        self.in_item = np.zeros(len(items.weights), bool)

    def masks(self, item: np.ndarray, first: int, last: int) -> np.ndarray:
        """Bitmaps of the item's terms over the documents from ``first`` on, as words per document."""
        bits = np.zeros((last - first, -(-len(item) // 64)), np.uint64)
        for k, t in enumerate(item):
            docs = self.docs_of[self.cuts[t]:self.cuts[t + 1]]
            if first or last < self.size:
                docs = docs[(docs >= first) & (docs < last)] - first
            bits[docs, k // 64] |= np.uint64(1 << k % 64)
        return bits

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Exact scores of documents for the terms marked in ``in_item``."""
        counts = self.counts[docs]
        at = np.repeat(self.starts[docs] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        sums = np.concatenate([[0], np.cumsum(np.where(self.in_item[self.terms[at]], self.parts[at], 0))])
        ends = np.cumsum(counts)
        return sums[ends] - sums[ends - counts]


def best_of(batch: Batch, item: np.ndarray, held: list[tuple], config: Search) -> list[tuple]:
    """The item's best rows of ``held`` and the batch, as (-score, id is null, id)."""
    item = item[batch.cuts[item + 1] > batch.cuts[item]]
    if not len(item):
        return held
    batch.in_item[item] = True
    step = max(1, config.words // -(-len(item) // 64))
    for first in range(0, batch.size, step):
        bits = batch.masks(item, first, min(first + step, batch.size))
        some = np.flatnonzero(bits.any(axis=1))
        kinds = bits[some, 0] if bits.shape[1] == 1 else bits[some].view(f"V{8 * bits.shape[1]}")[:, 0]
        kinds, group = np.unique(kinds, return_inverse=True)
        words = kinds.view(np.uint64).reshape(len(kinds), -1)
        most = np.zeros(len(kinds), np.int64)
        for k, t in enumerate(item):
            most += np.where(words[:, k // 64] >> np.uint64(k % 64) & np.uint64(1), batch.largest[t], 0)
        members, order = np.argsort(group, kind="stable"), np.argsort(-most, kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=len(kinds)))
        starts = np.concatenate([[0], ends[:-1]])
        at = 0
        while at < len(order):
            worst = -held[-1][0] if len(held) == config.top else 1
            docs: list[np.ndarray] = []
            taken = 0
            while at < len(order) and most[order[at]] >= worst and taken < config.evaluate:
                kind = order[at]
                docs.append(members[starts[kind]:ends[kind]])
                taken += len(docs[-1])
                at += 1
            if not taken:
                break
            found = first + some[np.concatenate(docs)]
            scores = batch.scores(found)
            keep = scores >= worst
            if keep.sum() > config.top:
                keep &= scores >= -np.partition(-scores[keep], config.top - 1)[config.top - 1]
            rows = [(-int(s), i is None, 0 if i is None else i) for s, i in zip(
                scores[keep], batch.ids.take(pa.array(found[keep])).to_pylist())]
            held = sorted(held + rows)[:config.top]
    batch.in_item[item] = False
    return held


def best_rows(counts: DataFrame, items: Items, config: Search, key: T.StructField, item: T.StructField) -> DataFrame:
    """Per task and item the best rows: number of the item, its id, document id, score."""
    shape = T.StructType([T.StructField("item", T.LongType()), item, key, T.StructField("score", T.LongType())])
    types = [f.dataType for f in (item, key)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        held: list[list[tuple]] = [[] for _ in items.ids]
        for whole in batches:
            ends = np.cumsum(whole.column(2).value_lengths().to_numpy().astype(np.int64))
            first = 0
            while first < whole.num_rows:
                base = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, base + config.postings, side="right")))
                batch = Batch(whole.slice(first, last - first), items)
                held = [best_of(batch, own, rows, config) for own, rows in zip(items.terms, held)]
                first = last
        who = [i for i, found in enumerate(held) for _ in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array(who, pa.int64()), pa.array([items.ids[i] for i in who], to_arrow_type(types[0])),
             pa.array([None if null else i for found in held for _, null, i in found], to_arrow_type(types[1])),
             pa.array([-s for found in held for s, _, _ in found], pa.int64())], [f.name for f in shape])

    return counts.mapInArrow(rows, shape)


def searched(docs: DataFrame, rows: list, config: Search, key: str, text: str, item: T.StructField) -> DataFrame:
    """Ranked rows of one block of items, given as (id, text)."""
    found = [sorted(set(terms((whole or "").encode("utf-8", "replace")))) for _, whole in rows]
    vocabulary = {term: i for i, term in enumerate(sorted(set().union(*found)))}
    counts = table(counted(docs, vocabulary, config, key, text), "terms")
    total = counts.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("length")).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for r in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(
            F.count(F.lit(1)).alias("df")).collect():  # at most the terms of the block
        weights[r["term"]] = math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * r["df"] + 1)))
    items = Items([i for i, _ in rows], [np.array([vocabulary[t] for t in own], np.int64) for own in found],
                  weights, total["docs"], total["length"] or 1)
    best = best_rows(counts, items, config, T.StructField("doc_id", counts.schema["id"].dataType), item)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return best.withColumn("rank", rank).filter(F.col("rank") <= config.top).select(
        item.name, "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, config: Search = Search(), key: str = "doc_id",
           text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each item its ``top`` documents: item_id, rank, doc_id, score."""
    asked = table(items.select(F.col(f"`{item}`").alias("item_id"), whole_text(F.col(f"`{item_text}`")).alias("text"),
                               F.monotonically_increasing_id().alias("row")), "items")
    size = asked.agg(F.sum(F.char_length("text") + 100)).first()[0] or 0
    blocks = max(1, -(-size // config.block_chars))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks))
    found = [searched(docs, [(r["item_id"], r["text"]) for r in asked.filter(block == b).orderBy("row").collect()],
                      config, key, text, asked.schema["item_id"]) for b in range(blocks)]
    return reduce(DataFrame.unionByName, found)

"""The sequence model: words count in their order, all tokens are learnt, leaves sum to one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from promolens.llm.context_mixing import Mixing, mixing_scores, prefix_code
from promolens.llm.sequence_mixing import BEFORE, NEVER, NEW, ONCE, STATE, Sequence, part

SMALL = Mixing(slots=14, batch_bytes=60_000, learners=3, frequent=64, classes=16, tokens_at_once=256)


def _pairs(rng, n):
    """Texts of pairs of words: after each left word always comes its right one."""
    return [" ".join(f"left{i} right{i}" for i in rng.integers(0, 20, 40)) for _ in range(n)]


@pytest.mark.parametrize("config", [SMALL, Mixing(slots=14, learners=2, frequent=4, classes=64)])
def test_order_of_words_counts(spark, config):
    rng = np.random.default_rng(11)
    known, new = _pairs(rng, 200), _pairs(rng, 20)
    mixed = [" ".join(rng.permutation(t.split())) for t in new]
    rows = [(i, t) for i, t in enumerate(known + new + mixed)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in mixing_scores(docs, F.col("doc_id") < 200, config=config).collect()}
    for i in range(200, 220):
        ordered, shuffled = got[i], got[i + 20]
        assert ordered.base_score == pytest.approx(shuffled.base_score)
        assert ordered.score > shuffled.score + 20
        # Half the words follow from the one before, which the base score cannot know.
        assert ordered.score > 0.75 * ordered.base_score


def _stream(rng, texts):
    lengths = rng.integers(1, 9, texts)
    tokens = rng.integers(2, 12, lengths.sum()).astype("<u2")
    first = np.zeros(len(tokens), bool)
    first[np.cumsum(lengths) - lengths] = True
    tokens[np.cumsum(lengths) - 1] = 0
    return tokens, first


def test_all_leaves_after_a_context_sum_to_one():
    rng = np.random.default_rng(4)
    tokens, first = _stream(rng, 300)
    counts = np.bincount(tokens, minlength=14).astype(float)
    counts[NEW] = 5
    leaves = np.flatnonzero(counts)
    model = Sequence(leaves, counts, 12, prefix_code)
    tables = np.zeros(model.shape, np.uint32)
    model.count(tables.reshape(BEFORE, -1), *part(tokens, first, 0, len(tokens), True))
    leaf, context = part(tokens, first, 0, len(tokens), True)
    assert (tables.sum(axis=(1, 2)) == model.length[leaf].sum()).all()  # every bit of every token
    model.tables = tables.astype(np.float32)
    for at in range(0, len(tokens), 100):
        model.learn(*part(tokens, first, at, at + 100, True), 1.0)
    model.ready()
    for at in range(0, len(tokens), 37):
        one = model.log10(leaves, np.repeat(context[:, at:at + 1], len(leaves), axis=1))
        assert (10 ** one).sum() == pytest.approx(1, abs=1e-4)


def test_parts_have_the_contexts_of_whole_texts():
    tokens, first = _stream(np.random.default_rng(5), 50)
    tokens[3] += ONCE << STATE
    tokens[4] += NEVER << STATE
    leaf, context = part(tokens, first, 0, len(tokens), False)
    assert leaf[3] == tokens[3] & 0x3FFF and leaf[4] == NEW
    assert part(tokens, first, 3, 5, True)[0].tolist() == [NEW, NEW]
    for step in (1, 2, 7):
        parts = [part(tokens, first, at, at + step, False) for at in range(0, len(tokens), step)]
        assert (np.concatenate([p[0] for p in parts]) == leaf).all()
        assert (np.concatenate([p[1] for p in parts], axis=1) == context).all()
    # A text's contexts are its own: alone it has the same.
    begin = int(np.flatnonzero(first)[7])
    end = int(np.flatnonzero(first)[8])
    alone = part(tokens[begin:end], first[begin:end], 0, end - begin, False)[1]
    assert (alone == context[:, begin:end]).all()


def test_a_text_read_in_parts_scores_as_in_one(spark):
    rng = np.random.default_rng(6)
    texts = _pairs(rng, 60) + [" ".join(_pairs(rng, 30)), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # Without learning the steps between updates do not matter.
    found = [{r.doc_id: r.score for r in mixing_scores(docs, F.lit(False), config=Mixing(
        slots=12, learners=2, tokens_at_once=step)).collect()} for step in (3, 5000)]
    assert found[0] == pytest.approx(found[1], rel=1e-6)


class _Counted(np.ndarray):
    """Counts the numbers that are looked up."""

    found = 0

    def take(self, at, *args, **kwargs):
        _Counted.found += np.size(at)
        return np.asarray(self).take(at, *args, **kwargs)

    def __getitem__(self, at):
        _Counted.found += np.size(at)
        return np.asarray(self)[at]


def test_three_bits_share_a_hash_and_score_as_one_by_one():
    rng = np.random.default_rng(8)
    tokens, first = _stream(rng, 400)
    counts = np.bincount(tokens, minlength=14).astype(float) ** 2
    counts[NEW] = 5
    model = Sequence(np.flatnonzero(counts), counts, 12, prefix_code)
    tables = np.zeros(model.shape, np.uint32)
    leaf, context = part(tokens, first, 0, len(tokens), True)
    model.count(tables.reshape(BEFORE, -1), leaf, context)
    model.tables = tables = tables.astype(np.float32)
    for at in range(0, len(tokens), 100):
        model.learn(*part(tokens, first, at, at + 100, True), 1.0)
    key = np.asarray(model.key)
    model.key = key.view(_Counted)
    _Counted.found = 0
    found = model.ready().log10(leaf, context)
    assert _Counted.found == ((model.length[leaf] + 2) // 3).sum() < model.length[leaf].sum()

    some = rng.integers(0, len(tokens), 60)
    zeros, ones = model.adaptive
    for t in some:
        total = 0.0
        for depth in range(model.length[leaf[t]]):
            at = model.start[leaf[t]] + depth
            x, gate = [model.plain[model.node[at]]], 16 * min(depth // 3, 3)
            for k in range(BEFORE):
                line = int(context[k, t] ^ key[at - depth % 3]) * 0xD6E8FEB86659FD93 % 2 ** 64 >> 55
                x.append(tables[k, 8 * line + model.low[at]])
                gate += 4 ** k * np.searchsorted([0, 3, 31], x[-1].sum())
            mixed = sum(w * np.log((b + 0.2) / (a + 0.2)) for w, (a, b) in zip(model.weights[:, gate], x))
            p = 1 / (1 + np.exp(-mixed))
            level = 33 * gate + int(np.clip(np.rint(2 * mixed), -16, 16)) + 16
            one = (p + (ones[level] + 4 * p) / (zeros[level] + ones[level] + 4)) / 2
            total += np.log10(one if model.bit[at] else 1 - one)
        assert found[t] == pytest.approx(total, abs=1e-4)

"""Context mixing: exact counts and base scores, a proper model, better than its parts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from promolens.llm.columns import fold
from promolens.llm.context_mixing import CONTEXTS, Mixing, Model, mixing_scores, prefix_code, with_counts

SMALL = Mixing(slots=14, batch_bytes=60_000, learners=3)


def _base(rows):
    """Counts by the contract: id -> (held_out, n_tokens, n_known, base), and N."""
    tokens = {k: (t or "").encode().lower().split() for k, t in rows}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in rows}
    c = Counter(w for k in tokens if not held[k] for w in [*tokens[k], None])
    n, v = sum(c.values()), len(c)
    unit = lambda w: math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1)))
    return {k: (held[k], len(x) + 1, sum(c[w] > 0 for w in [*x, None]),
                sum(map(unit, [*x, None]))) for k, x in tokens.items()}, n


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "ÀB É\x0bé " * 3), (-4, "q" * 50000)], "doc_id long, text string")
    docs = docs.unionByName(odd)
    want, n = _base([(r.doc_id, r.text) for r in docs.collect()])
    got = mixing_scores(docs, fold() != 1, config=SMALL).collect()
    assert len(got) == len(want)
    for r in got:
        held, tokens, known, base = want[r.doc_id]
        assert (not r.train, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    held = [r for r in got if want[r.doc_id][0] and r.n_bytes]
    bits = -sum(r.score for r in held) * math.log2(10) / sum(r.n_bytes for r in held)
    assert bits < 3.5  # a byte costs 8 bits without a model, about 4.2 by byte frequencies


def test_probabilities_of_all_words_sum_to_one():
    counts = np.zeros(257)
    counts[[97, 98, 256]] = 30
    model = Model(Mixing(slots=10), counts)
    some = [b"ab", b"ba", b"aab", b"abab", b"b"]
    model.count(some)
    model.learn(some)
    model.adapt(some)
    length, nodes, bits = prefix_code(counts)
    assert sum(2.0 ** -length) == pytest.approx(1)
    # The first symbol's paths: every symbol once, its prefix probabilities from the model.
    total = 0.0
    for symbol in range(256):
        word = bytes([symbol])
        step = [(s, b) for _, p, s, b in model.decisions([word])]
        assert sum(len(b) for _, b in step) == length[symbol] + length[256]
        p = 1.0
        for _, place, slots, bit in model.decisions([word]):
            first = place == 0
            if first.any():
                x, gate = model.inputs(place[first], [s[first] for s in slots], bit[first], False)
                mixed = (x * model.weights[gate]).sum(axis=1)
                zeros, ones = model.adaptive[:, model.level(mixed, gate)]
                q = 1 / (1 + np.exp(-mixed))
                one = np.clip((q + (ones + 4 * q) / (zeros + ones + 4)) / 2, 1e-7, 1 - 1e-7)
                p *= float(np.where(bit[first] == 1, one, 1 - one)[0])
        total += p
    empty = 10 ** float(model.log10([b""])[0])
    assert total + empty == pytest.approx(1, abs=1e-6)


def test_learning_beats_single_predictors():
    rng = np.random.default_rng(3)
    parts = [b"tion", b"ing", b"re", b"the", b"an", b"er", b"st"]
    words = list({b"".join(rng.choice(parts, rng.integers(1, 5))) for _ in range(3000)})
    train, test = words[::2], words[1::2]
    counts = np.bincount(np.frombuffer(b"".join(train), np.uint8), minlength=257).astype(float)
    counts[256] = len(train)
    model = Model(Mixing(slots=16), counts)
    model.count(train)
    before = model.log10(test).sum()
    for at in range(0, len(train), 100):
        model.learn(train[at:at + 100])
    model.adapt(train)
    learnt = model.log10(test).sum()
    assert learnt > before
    for k in range(CONTEXTS):
        one = Model(Mixing(slots=16), counts)
        one.tables = model.tables
        one.weights[:] = np.eye(CONTEXTS)[k]
        assert learnt > one.log10(test).sum()


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (7, "a b", 2), (7, "a b", 2)], "doc_id long, text string, score int")
    none = mixing_scores(docs, F.lit(False), config=SMALL).collect()
    assert len(none) == 3 and all(r.train_tokens == r.n_known == 0 and r.score < 0 for r in none)
    assert mixing_scores(docs.limit(0), F.lit(True), config=SMALL).count() == 0


def test_long_unseen_words_cost_all_their_bits(spark):
    rng = np.random.default_rng(5)
    word = bytes(rng.integers(33, 127, 50000).astype(np.uint8)).lower()
    model = Model(Mixing(slots=14), np.ones(257))
    spelled = model.log10([word])
    assert spelled[0] < -50000  # far below the smallest number
    got = with_counts(np.append(spelled, -2.0), np.array([0.0, 3.0]), 10, 0.1)
    assert got[0] == pytest.approx(spelled[0] + math.log10(0.1), rel=1e-12)
    assert got[1] == pytest.approx(math.log10(0.9 * 0.3 + 0.1 * 0.01), rel=1e-12)
    rows = [(i, "the cat sat on the mat") for i in range(30)] + [(i, word[:n].decode()) for i, n in ((50, 5000), (51, 50000))]
    scored = mixing_scores(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 30, config=SMALL)
    short, long = (r.score for r in scored.filter("doc_id >= 50").orderBy("doc_id").collect())
    assert long == pytest.approx(10 * short, rel=0.05)


def test_scores_do_not_depend_on_the_partitioning(spark, sf_dir):
    """A word that is in every document included."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", F.concat(F.lit("everywhere "), "text").alias("text"))
    found = []
    for partitions, shuffled in ((2, 8), (7, 3)):
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffled))
        try:
            rows = mixing_scores(docs.repartition(partitions), fold() != 1, config=SMALL).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        found.append({r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in rows})
    assert found[0].keys() == found[1].keys()
    for key, one in found[0].items():
        assert one == pytest.approx(found[1][key], rel=1e-6)

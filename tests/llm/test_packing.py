"""Packing: ids, exact places, no gaps, few sequences."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from promolens.llm.packing import LONG, ChunkEncoder, Packing, best_fit, digest_columns, packed, plan


def _check(rows, texts, capacity):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for key, parts in by_doc.items():
        ids = library.encode(texts[key] or "", add_special_tokens=False).ids + [1]
        parts.sort(key=lambda r: r.piece)
        want = [ids[i:i + capacity] for i in range(0, len(ids), capacity)]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in parts] == [
            (i, i * capacity, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for i, p in enumerate(want)]
    for spots in by_sequence.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), sum(r.length for r in rows)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    odd = {-1: None, -2: "", -3: "wörd " * 9000, -4: "x<|endoftext|>Y don't I'LL 12345 é́ ΑΣ ﬁ z",
           -5: "\x1c\x85a　b"}
    texts |= odd
    more = spark.createDataFrame(list(odd.items()), "doc_id long, text string")
    config = Packing(rounds=40, salts=3)
    got = packed(docs.unionByName(more), config, with_ids=False).select("doc_id", *digest_columns()).collect()
    used, tokens = _check(got, texts, 4096)
    assert used <= 1.02 * -(-tokens // 4096) + 1


def test_plans_hold_every_piece_and_are_close_to_the_bound():
    rng = random.Random(2)
    for kind in range(4):
        capacity = 100
        counts = np.zeros(capacity + 1, dtype=np.int64)
        for _ in range(5000):
            size = [rng.randint(1, 100), rng.randint(30, 50), rng.choice([51, 34, 26, 23]),
                    min(100, int(rng.lognormvariate(3, 1)) + 1)][kind]
            counts[size] += 1
        uses = plan(counts, Packing(capacity=capacity, rounds=100))
        held = np.zeros_like(counts)
        for pattern, times in uses:
            assert sum(l * n for l, n in pattern.items()) <= capacity
            for l, n in pattern.items():
                held[l] += n * times
        assert (held == counts).all()
        used = sum(t for _, t in uses)
        assert used <= sum(t for _, t in best_fit(counts, capacity))
        if kind in (0, 3):
            assert used <= 1.03 * (np.arange(capacity + 1) * counts).sum() / capacity + 2


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (1, "a b", 2), (1, "a b", 2)], "doc_id long, text string, piece int")
    got = packed(docs, Packing(rounds=5), into="spot").select("doc_id", "piece", "spot.*").collect()
    assert len(got) == 3 and len({r.offset for r in got}) == 3 and len({r.sequence_id for r in got}) == 1
    assert all(len(r.ids) == r.length == 3 for r in got)
    assert packed(docs.limit(0), Packing(rounds=5)).count() == 0


@pytest.mark.parametrize("limit", [2, 250_000])
def test_chunks_have_the_ids_of_the_whole_text(limit):
    path = public_tokenizers.path(Packing().tokenizer)
    whole, encoder = Tokenizer.from_file(path), ChunkEncoder(path, limit)
    texts = ["", " ", "Rain, rain... (go) away!", "we'll WE'LL 'tis rock'n'roll", "x<|endoftext|>y a<|startoftext|>",
             "İstanbul ΣΑΣ Straße É ñ̃ é क़ 日本語", "a1b22 a_b _ ß ÿ Ÿ µ ª º ×÷ \x01 x y \x1c \x85",
             "A" * 5000 + "!" * 300, "naïve naïve Naïve, naïve"]
    for text in texts:
        ids = whole.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == np.array(ids, dtype="<u4").tobytes()
    assert len(encoder) <= limit and all(len(chunk) <= LONG for chunk in encoder)


def test_the_program_covers_every_length_within_its_gap():
    from promolens.llm.packing import linear_program, rounded

    rng = np.random.default_rng(4)
    wide = np.bincount(np.clip(rng.lognormal(5.5, 1, 50000).astype(int) + 1, 1, 4096), minlength=4097)
    narrow = np.bincount(rng.integers(30, 51, 5000), minlength=101)
    for counts, capacity in ((wide, 4096), (narrow, 100)):
        uses, bound = linear_program(counts, capacity, 300, Packing().gap)
        assert sum(u for _, u in uses) <= (1 + Packing().gap) * bound
        held = np.zeros(len(counts))
        for pattern, u in uses:
            assert sum(l * n for l, n in pattern.items()) <= capacity
            for l, n in pattern.items():
                held[l] += n * u
        assert held == pytest.approx(counts, abs=1e-3)
        chosen, left = rounded(uses, counts)
        assert left.sum() <= 0.2 * counts.sum()
        assert sum(t for _, t in plan(counts, Packing(capacity=capacity))) <= bound * (1 + Packing().gap) + 3


@pytest.mark.parametrize("kind", ["near a third", "any length"])
def test_wide_histograms_have_a_bounded_plan_from_the_weights(kind):
    """Thousands of different lengths: the weights place most pieces, in a bounded number of knapsacks."""
    import time

    from promolens.llm.packing import dual_bound, rounded, weighted

    rng = np.random.default_rng(4)
    sizes = rng.normal(1400, 150, 5000).astype(int) if kind == "near a third" else rng.integers(1, 4097, 50000)
    counts = np.bincount(np.clip(sizes, 1, 4096), minlength=4097)
    uses, need, bound = weighted(counts, 4096, Packing().rounds, dual_bound(counts, 4096))
    assert (need >= 0).all() and need.sum() <= 0.1 * counts.sum()
    assert rounded(uses, counts)[1].sum() <= 0.1 * counts.sum()
    began = time.monotonic()
    got = sum(n for _, n in plan(counts))
    assert time.monotonic() - began < 60
    best = sum(n for _, n in best_fit(counts, 4096))
    assert bound <= got <= (best if kind == "near a third" else 1.003 * best)


def test_uses_of_the_weights_and_of_the_refinement_cover_exactly():
    from promolens.llm.packing import dual_bound, inverted, refined, weighted

    rng = np.random.default_rng(6)
    counts = np.bincount(rng.choice([51, 34, 26, 23, 100, 1], 3000), minlength=101)
    uses, need, bound = weighted(counts, 100, 50, dual_bound(counts, 100))
    better, tight = refined(counts, 100, 100, 1e-6, bound)
    for some, left in ((uses, need), (better, np.zeros(101))):
        held = left.copy()
        for pattern, use in some:
            assert sum(l * n for l, n in pattern.items()) <= 100
            for l, n in pattern.items():
                held[l] += n * use
        assert held == pytest.approx(counts, abs=1e-3)
    assert tight <= sum(use for _, use in better) * (1 + 1e-9)
    matrix = np.triu(rng.integers(1, 5, (30, 30))).astype(float)
    assert (matrix[:, :, None] * inverted(matrix)[None]).sum(axis=1) == pytest.approx(np.eye(30), abs=1e-6)

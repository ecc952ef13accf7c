"""Prefix token counts, sampled pieces and the quality classifier."""

import random
import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from promolens.llm.columns import fold
from promolens.llm.piece_sampling import PieceLattice, Sampling, decode, encode, round_trip
from promolens.llm.prefix_tokens import Counting, PrefixCounter, token_counts, tokens_until
from promolens.llm.quality_classifier import FEATURES, Discriminant, fit, quality_scores, statistics

ODD = ["a   b \n\n c\t\td  ", "it's don't we're I'll 'rex 'r 'v", "x<|endoftext|>y <|endoftext|> z<|endof",
       "日本語  é́   　x\x1c\x85y", "ab² ½c Ⅷx _a_b__ 1234567 ....!!!!", "aaaaaaa        ccc", "😀😀 ΑΣ ﬁ ", "", " ", "▁ x▁▁"]


def test_counts_of_every_prefix_are_the_library_s():
    counter = PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    for text in ODD + ["".join(rng.choices("ab '\n\trevl s.<|1é ", k=60)) for _ in range(40)]:
        got = counter.prefixes(text).tolist()
        assert got == [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]


def test_token_counts(spark, sf_dir):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, None), (None, "q" * 50000)], "doc_id long, text string"))
    for r in token_counts(docs, Counting(budget=100)).select("text", "tokens.*").collect():
        text = r.text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 100)
        assert len(library.encode(text[:r.fit_chars], add_special_tokens=False).ids) <= 100
    stored = token_counts(docs.filter("doc_id = 0"), with_prefixes=True).select("text", tokens_until("tokens", 25)).first()
    assert stored[1] == len(library.encode(stored[0][:25], add_special_tokens=False).ids)
    assert token_counts(docs.limit(0)).count() == 0


def test_pieces_are_drawn_with_the_lattice_s_chances():
    lattice = PieceLattice(public_tokenizers.path("piece_bpe_32k.model"), Sampling(temperature=1.0))
    text, ways = "then", {}
    full = " " + text
    surface = {s.decode(): i for i, s in enumerate(lattice.surface) if len(s) and i > 258}
    weight = {i: float(lattice.weight[n]) for n, i in enumerate(lattice.piece_id.tolist()) if i >= 0}
    for cuts in product([0, 1], repeat=len(full) - 1):
        parts, at = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(full[at:i])
                at = i
        if all(p in surface for p in parts):
            ids = tuple(surface[p] for p in parts)
            ways[ids] = float(np.prod([weight[i] for i in ids]))
    n = 20000
    drawn = [tuple(x.tolist()) for x in lattice.sample([text] * n, [str(i) for i in range(n)])]
    assert set(drawn) <= set(ways)
    for ids, w in ways.items():
        p = w / sum(ways.values())
        assert abs(drawn.count(ids) / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3


@pytest.mark.parametrize("run", ["\u1208" * 20, "\u1208\u0e81" * 300, "\U000130a0" * 40])
def test_a_word_behind_characters_without_a_piece_keeps_its_chances(run):
    lattice = PieceLattice(public_tokenizers.path("piece_bpe_32k.model"), Sampling())
    surface = {s.decode(): i for i, s in enumerate(lattice.surface) if len(s) and i > 258}
    assert not set(run) & set(surface)
    weight = {i: float(lattice.weight[n]) for n, i in enumerate(lattice.piece_id.tolist()) if i >= 0}
    word, ways = "then", {}
    for cuts in product([0, 1], repeat=len(word) - 1):
        ends = [i for i, c in enumerate([*cuts, 1], 1) if c]
        parts = [word[a:b] for a, b in zip([0, *ends], ends)]
        if all(p in surface for p in parts):
            ways[tuple(surface[p] for p in parts)] = float(np.prod([weight[surface[p]] for p in parts]))
    n = 4000
    lead = len(run.encode())
    drawn = [tuple(x.tolist()) for x in lattice.sample([run + word] * n, [str(i) for i in range(n)])]
    tails = [ids[len(ids) - next(k for k in range(1, 5) if ids[-k:] in ways):] for ids in drawn]
    assert all(lattice.decode(np.array(ids)) == run + word for ids in set(drawn))
    assert all(len(ids) - len(t) <= lead + 1 for ids, t in zip(drawn, tails))
    for ids, w in ways.items():
        p = w / sum(ways.values())
        assert abs(tails.count(ids) / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3


def test_pieces_round_trip_and_repeat(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-i - 1, t) for i, t in enumerate([*ODD, None, "x" * 3000])], "doc_id long, text string"))
    coded = encode(docs).select("doc_id", "text", "pieces", decode(F.col("pieces")).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in coded)
    other = {r.doc_id: r for r in round_trip(docs.repartition(5)).select("doc_id", "pieces.*").collect()}
    for r in coded:
        crc = zlib.crc32(np.array(r.pieces, "<u4").tobytes())
        assert (other[r.doc_id].n_pieces, other[r.doc_id].ids_crc32, other[r.doc_id].lossless) == (len(r.pieces), crc, True)
    assert encode(docs.limit(0)).count() == 0


def test_classifier_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_scores(docs, labels, fold() != 0)
    assert scored.count() == docs.count()
    held = scored.filter(fold() == 0).join(labels, "doc_id").select("score", "quality").collect()
    right = sum((r.score >= 0.3) == (r.quality == 1) for r in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_scores_are_gaussian_log_density_differences():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5, len(FEATURES)))
    d = len(FEATURES)
    model = Discriminant(np.zeros((2, d)), np.array([np.eye(d), 2 * np.eye(d)]), np.zeros(2), np.zeros(d), np.ones(d))
    want = 1 / (1 + np.exp(-(0.5 * (x**2).sum(1) - 0.5 * (4 * x**2).sum(1))))
    assert model.scores(x) == pytest.approx(want)


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "a b " * 9000, 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    assert [r.score for r in quality_scores(docs, labels, F.lit(True)).collect()] == [1.0] * 3
    assert quality_scores(docs.limit(0), labels, F.lit(True)).count() == 0
    assert all(np.isfinite(statistics(t)).all() for t in ("", " ", "a", "é" * 100000))
    none = spark.createDataFrame([], "statistics array<double>, quality int")
    assert fit(none).prior == 0.5

"""SimHash groups against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from promolens.llm.simhash import (Near, connected, fingerprint_of, first_shared, forest, links,
                                   near_duplicates, variants)
from tests.llm import brute


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    prints = {r.doc_id: brute.simhash(r.text) for r in docs.collect()}
    want = brute.components(prints)
    got = near_duplicates(docs, keep_text=False).select("doc_id", "near.*").collect()
    assert {r.doc_id: r.fingerprint for r in got} == {k: f"{p:016x}" for k, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("config", [Near(), Near(small_bucket=2, block=8), Near(max_bits=3, small_bucket=4, block=4)])
def test_links_connect_what_all_pairs_connect(spark, config):
    rng = random.Random(5)
    prints = []
    for _ in range(20):
        at = rng.getrandbits(64)
        prints.append(at)
        for _ in range(rng.choice([0, 1, 5, 60])):
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                at ^= 1 << bit
            prints.append(at)
    prints = sorted(set(prints))
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = links(frame, config)
    assert all((int(r.a) ^ int(r.b)).bit_count() <= config.max_bits if r.a * r.b >= 0 else
               ((r.a & (2**64 - 1)) ^ (r.b & (2**64 - 1))).bit_count() <= config.max_bits
               for r in found.collect())
    want = brute.components({i: p for i, p in enumerate(prints)}, config.max_bits)
    root = {r.fp: r.root for r in connected(found).collect()}
    groups = {}
    for i, p in enumerate(prints):
        groups.setdefault(want[i], set()).add(root.get(signed(p), signed(p)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({min(g) for g in groups.values()}) == len(groups)


def test_first_shared_variant(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        rows.append((signed(a), signed(b)))
    frame = spark.createDataFrame(rows, "a long, b long").select(
        F.array_intersect(variants(F.col("a"), 4), variants(F.col("b"), 4)).alias("both"),
        first_shared(F.col("a").bitwiseXOR(F.col("b")), 4).alias("first"))
    for r in frame.collect():
        assert min(k >> 40 for k in r.both) == r.first


def test_forest_spans():
    members = np.array([0, 1, 3, 7, 2**40 + 2**41 + 2**42 + 2**43 + 2**44], dtype=np.int64)
    assert sorted(forest(members, 1)) == [(0, 1), (1, 3), (3, 7)]


def test_edges(spark):
    texts = ["", None, " \n", "one", "One", "two words", "x " * 60000]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, "one", "c")],
                                 "doc_id long, text string, component string")
    got = near_duplicates(docs).select("doc_id", "component", "near.*").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 8 and [by[i].component_id for i in range(5)] == [0, 0, 0, 3, 3]
    assert by[None].component_id == 3 and by[0].fingerprint == "0" * 16
    assert fingerprint_of("a b c", Near()) == signed(brute.simhash("A  b\tC"))
    assert near_duplicates(docs.limit(0)).count() == 0

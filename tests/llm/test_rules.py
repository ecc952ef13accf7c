"""Quality rules: counts, certified cutoffs, edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from promolens.llm.quality_rules import (RULES, Risk, apply_cutoffs, binomial_tail,
                                         certified_cutoffs, rule_statistics)
from tests.llm import brute

TEXTS = ["", None, " \n\t ", "a b c d e a b c d e a b c", "x " * 40, "one\none\n\ntwo\r\none\n",
         "# $ % word & | <b>", "ä ö ü\x0bß\x0cé " * 5, "w" * 5000,
         " ".join(f"w{i % 97}" for i in range(20000)), "a b c d e f\n a b c d e g"]


def test_counts_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    rows = rule_statistics(docs).select("doc_id", "n_words", "rules.*").collect()
    for row in rows:
        assert row[1] == 7
        want = brute.rule_counts(TEXTS[row["doc_id"]])
        assert {k: row[2:][i] for i, k in enumerate(want)} == want, row["doc_id"]


def test_documents_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = rule_statistics(docs).select("text", "rules.*").collect()
    assert got
    for row in got:
        want = brute.rule_counts(row["text"])
        assert {k: row[k] for k in want} == want


@pytest.mark.parametrize("k,n,rate", [(0, 50, 0.05), (3, 400, 0.02), (10, 3000, 0.005), (7, 20, 0.1)])
def test_binomial_tail_is_exact(spark, k, n, rate):
    got = spark.range(1).select(binomial_tail(F.lit(k), F.lit(n), rate)).first()[0]
    want = sum(math.comb(n, i) * rate**i * (1 - rate)**(n - i) for i in range(k + 1))
    assert got == pytest.approx(want if k < n * rate else 1.0, rel=1e-9)


def _labelled(spark, clean, junk):
    good = "plain words that say something new in every single sentence here today {}"
    bad = "bad## words** that%% say&& some## new** in%% every&& one## here** {}"
    rows = [(i, good.format(i), "x") for i in range(clean)]
    rows += [(clean + i, bad.format(i), "x") for i in range(junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") < clean, 1).otherwise(0).alias("quality"))
    return docs, labels


def test_cutoffs_need_enough_clean_labels(spark):
    config = Risk(risk=0.1)
    for clean, certified in ((2000, True), (30, False)):
        docs, labels = _labelled(spark, clean, 40)
        stats = rule_statistics(docs, config)
        cuts = certified_cutoffs(stats, labels, config).collect()
        assert bool(cuts) == certified
        if certified:
            assert [c is not None for c in cuts[0]["cutoffs"]] == [r == "symbols" for r in RULES]
        kept = apply_cutoffs(stats, certified_cutoffs(stats, labels, config), config)
        lost = kept.filter("NOT rules.kept").agg(F.count("*"), F.min("doc_id")).first()
        assert tuple(lost) == ((40, clean) if certified else (0, None))


def test_a_cutoff_that_rejects_clean_documents_is_not_certified(spark):
    docs, labels = _labelled(spark, 1000, 200)
    noisy = labels.withColumn("quality", F.lit(1))  # the same texts, all of them clean
    config = Risk(risk=0.1)
    assert certified_cutoffs(rule_statistics(docs, config), noisy, config).isEmpty()


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, None, 1), (1, "a " * 30, None, 2), (1, "a " * 30, None, 2)],
                                 "doc_id long, text string, lang string, rules int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (9, None)], "doc_id long, quality int")
    stats = rule_statistics(docs)
    out = apply_cutoffs(stats, certified_cutoffs(stats, labels)).select("rules.*").collect()
    assert [r["kept"] for r in out] == [False] * 3
    empty = rule_statistics(docs.limit(0))
    assert apply_cutoffs(empty, certified_cutoffs(empty, labels)).count() == 0

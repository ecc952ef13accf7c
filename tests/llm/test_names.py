"""Columns named like the operators' own come back as they were."""

from pyspark.sql import functions as F

from promolens.llm.exact_dedup import exact_duplicates
from promolens.llm.packing import packed
from promolens.llm.quality_classifier import quality_scores
from promolens.llm.quality_rules import apply_cutoffs, certified_cutoffs, rule_statistics
from promolens.llm.simhash import near_duplicates

OWN = ["_digest", "_norm", "_size", "_keep", "_at", "_fp", "_component", "_root", "_salt", "_row", "_length",
       "_learn", "_statistics", "_stratum", "_cutoffs", "_text", "_piece", "_metadata", "own0"]


def test_any_extra_column_comes_back(spark):
    texts = ["one two three four five six"] * 3 + [f"text {i} has words of its own {i * i}" for i in range(20)] + [None]
    docs = spark.createDataFrame([(i, t, "en", *[f"{c}{i}" for c in OWN]) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in OWN))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    rules = rule_statistics(docs)
    results = [exact_duplicates(docs), near_duplicates(docs), packed(docs),
               quality_scores(docs, labels, F.lit(True)),
               apply_cutoffs(rules, certified_cutoffs(rules, labels))]
    for found in results:
        rows = found.select("doc_id", *[f"`{c}`" for c in OWN]).collect()
        assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in OWN)


def test_a_key_with_such_a_name(spark):
    docs = spark.createDataFrame([(2, "a b"), (1, "a  b"), (3, "c")], "_id long, _norm string")
    got = exact_duplicates(docs, key="_id", text="_norm").select("_id", "dedup.*").collect()
    assert {(r[0], r["keep_id"]) for r in got} == {(2, 1), (1, 1), (3, 3)}

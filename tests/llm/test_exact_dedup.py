"""Exact deduplication against grouping by text."""

from pyspark.sql import functions as F

from promolens.llm.exact_dedup import exact_duplicates
from tests.llm import brute


def _check(rows, got):
    want = brute.exact_groups(rows)
    assert len(got) == len(rows)
    for r in got:
        keep, size, sha = want[r["doc_id"]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, size, keep == r["doc_id"])
        assert r["text_sha256"] == sha or sha is None


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    _check(rows, exact_duplicates(docs.select("doc_id", "text"), keep_text=False)
           .select("doc_id", "dedup.*").collect())
    with_text = exact_duplicates(docs)
    assert with_text.columns == [*docs.columns, "dedup"]
    _check(rows, with_text.select("doc_id", "dedup.*").collect())


def test_joins_instead_of_broadcasts_give_the_same(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    _check(rows, exact_duplicates(docs, broadcast_rows=0).select("doc_id", "dedup.*").collect())


def test_colliding_digests_are_told_apart_by_their_bytes(spark):
    rows = [(i, t) for i, t in enumerate(["ab", "a b", "a  b", "ab", "b", "", None, "b "] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weak = exact_duplicates(docs, digest=lambda t: F.substring(F.sha2(t, 256), 1, 0))
    want = brute.exact_groups(rows)
    for r in weak.select("doc_id", "dedup.*").collect():
        keep, size, _ = want[r["doc_id"]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, size, keep == r["doc_id"])


def test_edges(spark):
    rows = [(None, "a"), (3, "a"), (2, "a"), (2, "a"), (None, None), (None, ""), (7, "z" * 300000)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, dedup string")
    got = exact_duplicates(docs).select("doc_id", "dedup.*").collect()
    a = [r for r in got if r["group_size"] == 4]
    assert len(a) == 4 and {r["keep_id"] for r in a} == {2} and sum(r["kept"] for r in a) == 1
    assert sum(r["kept"] for r in got if r["keep_id"] is None) == 1
    assert exact_duplicates(docs.limit(0)).count() == 0

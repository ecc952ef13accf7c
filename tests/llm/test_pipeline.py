"""The five stages against brute force on the smallest table."""

import re

import corpus_pipeline
from promolens.llm.queries import ORACLE, QUERIES
from tests.llm import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, frames = docs.columns, {}
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        frames[name] = current
        out = stage(spark, current, sf_dir)
        path = f"{spark.sparkContext.getCheckpointDir()}/test-{name.replace(' ', '-')}"
        out.write.mode("overwrite").parquet(path)
        current = spark.read.parquet(path)
        if name != "best-fit packing":
            assert current.columns == columns
    text = {r.doc_id: r.text for r in docs.collect()}
    # So few labels certify no cutoff, hence only base failures go.
    want = {k for k, t in text.items() if not brute.rule_counts(t)["base_failed"]}
    assert {r.doc_id for r in frames["exact dedup"].collect()} == want
    want = {k for k in want if brute.exact_groups([(i, text[i]) for i in want])[k][0] == k}
    assert {r.doc_id for r in frames["SimHash near-dedup"].collect()} == want
    names = brute.components({k: brute.simhash(text[k]) for k in want})
    want = {k for k in want if names[k] == k}
    assert {r.doc_id for r in frames["secret scans"].collect()} == want
    clean = {r.doc_id: r for r in frames["best-fit packing"].collect()}
    assert set(clean) == want
    for k, r in clean.items():
        assert r.n_chars == len(r.text)
        assert brute.secret_base(text[k]) or r.text == text[k] or "[secret]" in r.text
        assert not re.search("AKIA[A-Z0-9]{16}", r.text)
    packed = current.collect()
    assert {r.doc_id for r in packed} == want and all(len(r.ids) == r.length for r in packed)


def test_registered():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


def test_results_that_others_hold_stay_readable(spark, sf_dir):
    """A stage removes what the stage before it staged, and nothing else."""
    from promolens.llm import secrets

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = secrets.secret_spans(docs.select("doc_id", "text"))
    for _, stage in corpus_pipeline.STAGES[1:3]:
        stage(spark, docs, sf_dir).write.format("noop").mode("overwrite").save()
    assert held.count() == docs.count()


def test_rows_that_share_an_id_keep_unlinked_texts(spark, sf_dir):
    one, two = ("alpha beta gamma delta epsilon zeta " * 5, "one two three four five six seven " * 5)
    rows = [(1, one, "en", "s", 1), (1, two, "en", "s", 1), (1, two, "en", "s", 1), (None, one + "x", "en", "s", 1),
            (None, "quite another text of several words here", "en", "s", 1), (2, two, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()
    linked = (brute.simhash(one) ^ brute.simhash(one + "x")).bit_count() <= 4
    want = [(1, one), (1, two), (None, rows[4][1])] + ([] if linked else [(None, one + "x")])
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(want, key=repr)

"""Personal data: base spans against brute force, learnt spans, redaction."""

from pyspark.sql import functions as F

from promolens.llm.personal_data import Boosting, digest_columns, personal_spans, redact
from tests.llm import brute

TRICKY = ["", None, "a@b.c_d@e.f x@y z@.q ü.a@b.co.uk, +1 (555) 123-4567.", "1.2.3.4.5 256.1.1.1 0001.2.3.255 1.2.3",
          "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111", "+12345678 +123456789 ++49 (0)30.123456 +1",
          "😀 +4412345678901 é a.b@c-d.e.f@g.h 10.0.0.1:80", "a" * 100000, "a@" + "b." * 30000, "1." * 50000,
          "1" * 100000, "+1" + " " * 50000, "99999999999999999999.1.1.1"]


def test_base_spans(spark, sf_dir):
    texts = TRICKY + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_ip int")
    got = personal_spans(docs, Boosting(rounds=2), keep_text=False).select("doc_id", "n_ip", *digest_columns()).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute.pii_base(texts[r.doc_id])
        assert r.base_sha256 == brute.sha(brute.listed(want)), (texts[r.doc_id] or "")[:80]
        assert [r[2], r[3], r[4], r[5]] == [sum(s[1] == k for s in want) for k in range(4)]
        assert set(brute.listed(want).split(",")) <= set(r.spans.split(","))


def test_trees_add_what_looks_like_the_confirmed(spark):
    rows = [f"please call +1 (918) 555-{1000 + i} now" if i % 2 else f"in total {i * 7919} {i} pieces" for i in range(600)]
    rows += [f"please call 1 (918) 555-{1000 + i} now" for i in range(3)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")

    def found(precision):
        return {r.doc_id: r for r in personal_spans(docs, Boosting(rounds=3, precision=precision)).select(
            "doc_id", F.size("pii.base").alias("base"), F.size("pii.all").alias("every")).collect()}

    strict, lax = found(0.99), found(0.0)
    assert all(strict[i].base == strict[i].every == i % 2 for i in range(600))
    assert all(lax[i].every >= 1 for i in range(600, 603))


def test_redaction_and_edges(spark):
    docs = spark.createDataFrame([(1, "é x@y.org or +49 30 123456789"), (2, "clean 12"), (None, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in redact(personal_spans(docs)).collect()}
    assert got == {1: "é [personal] or [personal]", 2: "clean 12", None: None}
    assert personal_spans(docs.limit(0)).count() == 0


def test_trees_add_hidden_forms_and_leave_other_text(spark):
    rows = []
    for i in range(900):
        rows.append([f"please write to user{i}.name@mail{i % 7}.org today", f"please call +49 30 {7000000 + 31 * i} now",
                     f"in total {i * 7919 + 1000000} {i} pieces of stock"][i % 3])
    planted = ["please write to jane.doe (at) host.org today", "please write to joe (at) mail3.org today",
               "please call 49 30 7654321 now", "mobile 49 30 7012345 after six"]
    clean = ["a stock of 49 30 7654321 pieces", "see jane (at the gate)", "between 1000000 2000000 units"]
    docs = spark.createDataFrame(list(enumerate(rows + planted + clean)), "doc_id long, text string")
    got = {r.doc_id: r for r in personal_spans(docs).select(
        "doc_id", F.size("pii.base").alias("base"), F.size("pii.all").alias("every")).collect()}
    assert all(got[i].every == got[i].base == (i % 3 < 2) for i in range(900))
    assert all(got[900 + k].base == 0 and got[900 + k].every >= 1 for k in range(len(planted)))
    assert all(got[904 + k].every == 0 for k in range(len(clean)))

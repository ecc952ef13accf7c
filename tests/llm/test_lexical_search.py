"""Ranked lexical search against brute force and SQL."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from promolens.llm import lexical_search
from promolens.llm.lexical_search import Search, ranked
from promolens.llm.queries import ORACLE, op13_lexical_search
from tests.compare import oracle_rows, spark_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _brute(docs, items, top=10):
    counts = [(k, Counter(_terms(t))) for k, t in docs if _terms(t)]
    total, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for key, text in items:
        scored = []
        for doc, c in counts:
            m = 10 + (90 * sum(c.values()) * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                        * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(_terms(text)) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(key, n + 1, None if null else doc, -s) for n, (s, null, doc) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def _ranked(spark, docs, items, config=Search()):
    frames = (spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "2 as id", "3 as terms"),
              spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "4 as row"))
    return sorted((tuple(r) for r in ranked(frames[0].repartition(3), frames[1], config).collect()), key=repr)


def _made(seed, docs, items, words, size):
    rng = np.random.default_rng(seed)
    text = lambda n: " ".join(f"w{x}" for x in np.minimum(rng.zipf(1.3, n), words))
    return [(i, text(rng.integers(1, size))) for i in range(docs)], [(i, text(rng.integers(1, 30))) for i in range(items)]


def test_query_equals_sql(spark, sf_dir):
    import duckdb

    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    got = spark_rows(op13_lexical_search(spark, sf_dir))
    assert got == oracle_rows(connection, ORACLE["op13_lexical_search"]) and len(got[1]) > 100


@pytest.mark.parametrize("config", [Search(), Search(top=3, block_chars=900, postings=200, evaluate=1)])
def test_batches_and_blocks_of_items(spark, config):
    docs, items = _made(1, 400, 25, 300, 80)
    assert _ranked(spark, docs, items, config) == _brute(docs, items, config.top)


def test_items_of_many_terms(spark):
    docs, _ = _made(2, 150, 1, 400, 300)
    items = [(1, " ".join(f"w{i}" for i in range(1, 400))), (2, " ".join(f"w{i}" for i in range(40, 170)))]
    assert _ranked(spark, docs, items, Search(words=200)) == _brute(docs, items)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "... \x00 \x7f"), (4, "Äpfel ÄPFEL äpfel A1_b"), (4, "a1 b"), (None, "a1 b"),
            (5, "a1 b"), (6, "x " * 200_000 + "b"), (7, "K K k"), (8, "日本 語")] + [(9, "a1 b")] * 12
    items = [(1, "A1"), (1, "b x"), (2, None), (3, ""), (4, "nothing here"), (None, "äpfel 日本"), (5, "k K")]
    assert _ranked(spark, docs, items) == _brute(docs, items)
    assert _ranked(spark, [], items) == []
    assert _ranked(spark, docs, []) == []


def test_later_batches_evaluate_few_masks(spark, monkeypatch):
    docs, items = _made(5, 600, 5, 50, 40)
    evaluated = []
    scores = lexical_search.Batch.scores
    monkeypatch.setattr(lexical_search.Batch, "scores", lambda self, at: evaluated.append(len(at)) or scores(self, at))
    import pyarrow as pa

    found = [sorted({t.encode() for t in _terms(text)}) for _, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*found)))}
    own = [np.array([vocabulary[t] for t in terms]) for terms in found]
    rows = [(k, len(_terms(t)), Counter(vocabulary[w.encode()] for w in _terms(t) if w.encode() in vocabulary))
            for k, t in docs]
    weights = np.full(len(vocabulary), 700, np.int64)
    everything = lexical_search.Items([k for k, _ in items], own, weights, len(rows), sum(r[1] for r in rows))
    held = [[] for _ in items]
    for at in range(0, 600, 100):
        some = rows[at:at + 100]
        batch = lexical_search.Batch(pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in some]), pa.array([r[1] for r in some]),
             pa.array([sorted(r[2]) for r in some], pa.list_(pa.int32())),
             pa.array([[r[2][t] for t in sorted(r[2])] for r in some], pa.list_(pa.int32()))],
            ["id", "n", "terms", "tfs"]), everything)
        held = [lexical_search.best_of(batch, o, h, Search(evaluate=1)) for o, h in zip(own, held)]
    assert all(len(h) == 10 for h in held)
    assert sum(evaluated) < 0.5 * 600 * len(items)

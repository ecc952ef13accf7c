"""Hard negatives against brute force, over several blocks, rounds and clusters."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from promolens.llm.hard_negatives import Mining, mined, products, shared_list
from promolens.llm.queries import ORACLE, op12_hard_negatives
from tests.compare import oracle_rows, spark_rows

SMALL = Mining(clusters=3, block_rows=60, round_anchors=5, chunk=16, sample=20)
TYPES = "vec_id long, embedding array<float>, label int, row string, block int"


def _brute(rows, config, is_anchor):
    """Rows (anchor, positive, rank, negative, positive score, negative score), sorted."""
    part = []
    for at, (key, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        q = [max(-2 ** 63, min(2 ** 63 - 1, math.floor(config.scale * float(np.float32(x))))) for x in vector]
        part.append((at, key, q, label))
    out = []
    for at, key, q, label in part:
        if key is None or not is_anchor(key):
            continue
        scored = sorted(((-max(1 - 2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(q, v)))),
                          k is None, k or 0, i, g) for i, k, v, g in part if i != at))
        for p in [s for s in scored if s[4] == label][:config.positives]:
            fit = [s for s in scored if s[4] != label and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]]
            out += [(key, None if p[1] else p[2], n + 1, None if s[1] else s[2], -p[0], -s[0])
                    for n, s in enumerate(fit[:config.negatives])]
    return sorted(out, key=repr)


def _mined(spark, rows, config=SMALL, every=5):
    frame = spark.createDataFrame([(k, v, g, "x", 0) for k, v, g in rows], TYPES).repartition(3)
    return sorted((tuple(r) for r in mined(frame, F.col("vec_id") % every == 0, config).collect()), key=repr)


def _random(n, dims, seed):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=dims).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(n)]


def test_query_equals_sql(spark, sf_dir):
    import duckdb

    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = spark_rows(op12_hard_negatives(spark, sf_dir))
    assert got == oracle_rows(connection, ORACLE["op12_hard_negatives"]) and got[1]


@pytest.mark.parametrize("dims", [2, 16])
def test_blocks_rounds_and_clusters(spark, dims):
    rows = _random(200, dims, dims)
    got = _mined(spark, rows)
    assert got == _brute(rows, SMALL, lambda k: k % 5 == 0) and len(got) > 50


def test_ties_and_repeated_vectors(spark):
    rows = [(k, [0.5, 0.25] if k % 3 else [0.4, 0.2], k % 2) for k in range(90)]
    assert _mined(spark, rows) == _brute(rows, SMALL, lambda k: k % 5 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = _random(40, 3, 9) + [
        (100, None, 1), (105, [nan, 1.0, 1.0], 1), (110, [None, 1.0, 1.0], 1), (115, [inf, 0.0, 0.0], 1),
        (120, [1.0, 1.0, 1.0], None), (125, [0.0, 0.0, 0.0], 2), (130, [], 2), (135, [1.5], 1),
        (None, [2.0, 2.0, 2.0], 1), (140, [1e30, -1e30, 3.0], 0), (145, [1e12, 1e11, 1.0], 1)]
    assert _mined(spark, rows) == _brute(rows, SMALL, lambda k: k % 5 == 0)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.5], 1), (1, [0.8, 0.0], 2), (2, [0.7, 0.1], 2)]
    got = _mined(spark, rows)
    assert [r[1] for r in got if r[0] == 0] and got == _brute(rows, SMALL, lambda k: k % 5 == 0)


def test_no_rows_or_anchors(spark):
    assert _mined(spark, []) == []
    assert _mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_bounds_hold_and_fall():
    rng = np.random.default_rng(3)
    block, members = (np.floor(256 * rng.normal(size=(n, 8))) for n in (300, 20))
    order, bounds = shared_list(block, members)
    assert (np.diff(bounds) <= 0).all()
    limit = np.linalg.norm(members, axis=1)[:, None] * bounds * (1 + 1e-9) + 0.5
    assert (products(members, block[order]) <= limit).all()


def test_a_walk_ends_early_where_directions_differ():
    from promolens.llm.hard_negatives import Block
    import pyarrow as pa

    rng = np.random.default_rng(4)
    near, far = rng.normal([900, 0, 0], 10, (50, 3)), rng.normal([-900, 0, 0], 10, (5000, 3))
    vectors = np.floor(np.concatenate([near, far])).astype(np.int64)
    block = Block(pa.table({"id": pa.array(range(5050), pa.int64()), "row": pa.array(range(5050), pa.int64()),
                            "label": ["a"] * 5050, "q": vectors.tolist()}), 3)
    members = np.array([[900.0, 0, 0], [900.0, 9, 9]])
    order, bounds = shared_list(block.q, members)
    met = []

    def meet(i, rows, scores):
        met.append(len(rows))
        return scores.max()

    block.walk(members, order, bounds, 64, np.full(2, -np.inf), meet)
    assert met == [64, 64]

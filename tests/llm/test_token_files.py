"""Token files: ids as the library gives them, order, places, layout and reads in part."""

import glob
import random
import tempfile
import zlib
from contextlib import contextmanager

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from promolens.llm.queries import op11_token_files
from promolens.llm.token_files import TextEncoder, TokenFiles, read_tokens, read_window, with_crc, write_tokens

SMALL = TokenFiles(page_rows=20, row_group_bytes=1 << 14, page_bytes=1 << 10)


@pytest.fixture(scope="module")
def written(spark, sf_dir):
    path = tempfile.mkdtemp(prefix="promolens-tokens-") + "/files"
    with _many_files(spark):
        write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5), path, SMALL)
    return path


@contextmanager
def _many_files(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def _ids(texts):
    return [LIBRARY.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def _want(rows):
    """(key, start, n, crc) of rows in order."""
    at, want = 0, []
    for key, ids in rows:
        want.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return want


def test_query_equals_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = [tuple(r) for r in op11_token_files(spark, sf_dir).orderBy("doc_id").select(
        "doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert got == _want(zip([r.doc_id for r in docs], _ids([r.text for r in docs])))


def test_layout(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = tempfile.mkdtemp(prefix="promolens-tokens-") + "/files"
    write_tokens(docs.crossJoin(spark.range(5).withColumnRenamed("id", "copy")), path, SMALL)
    files = sorted(glob.glob(f"{path}/tokens/*.parquet"))
    groups = 0
    for file in files:
        meta = pq.ParquetFile(file).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                chunk = meta.row_group(g).column(c)
                assert chunk.has_offset_index and chunk.has_column_index
                if chunk.path_in_schema == "ids.list.element":
                    assert "RLE_DICTIONARY" in chunk.encodings
                elif chunk.path_in_schema in ("at", "n_tokens"):
                    assert "DELTA_BINARY_PACKED" in chunk.encodings
    assert groups > len(files)


def test_reads_in_part(spark, sf_dir, written):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    ids = _ids([r.text for r in docs])
    stream = np.concatenate(ids)
    lengths = read_tokens(spark, written, ("n_tokens", "meta.lang"))
    plan = lengths._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert {(r.key, r.n_tokens, r.lang) for r in lengths.collect()} == {
        (d.doc_id, len(i), d.lang) for d, i in zip(docs, ids)}
    some = read_tokens(spark, written, keys=(50, 60))
    assert "GreaterThanOrEqual(key,50)" in some._jdf.queryExecution().executedPlan().toString()
    assert {r.key: r.ids for r in some.collect()} == {
        d.doc_id: i for d, i in zip(docs, ids) if 50 <= d.doc_id <= 60}
    for first, last in ((0, 1), (777, 12_345), (len(stream) - 3, len(stream) + 9), (10**9, 10**9 + 1), (5, 5)):
        window = read_window(spark, written, first, last)
        assert "part" in window._jdf.queryExecution().optimizedPlan().toString() or first > len(stream)
        rows = sorted(window.collect(), key=lambda r: r.start)
        assert [x for r in rows for x in r.ids] == stream[first:last].tolist()
        if rows:
            assert rows[0].start == first


@pytest.mark.parametrize("rows", [
    [], [(None, None), (None, ""), (3, "a b"), (3, "a b"), (3, "z"), (1, "wörd " * 30_000), (2, "<|endoftext|>")]])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in rows],
                                 "doc_id long, text string, key int, part int, ids int")
    path = tempfile.mkdtemp(prefix="promolens-tokens-") + "/files"
    write_tokens(docs, path)
    got = with_crc(read_tokens(spark, path, ("n_tokens", "meta", "ids"))).orderBy("start").collect()
    assert [r.key for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    assert sorted((r.key or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (k or 0, n, crc) for k, _, n, crc in _want(zip([k for k, _ in rows], _ids([t for _, t in rows]))))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert all(r.meta.part == 2 and r.meta.ids == 3 for r in got)


def test_texts_in_parts_equal_the_library():
    encoder = TextEncoder(public_tokenizers.path("word_bpe_49k.json"), 50)
    rng = random.Random(1)
    bits = ["'s", "'t", "'ll", "'", "''", "!'s", "don't", "x", "É", "ß", "ẞ", "ñ", "12", "...", "—", "<", "|>", "a1b",
            " ", "\n", "\x0b", "\t ", "\x1c", "\x85", "ÿ", "Œ", "º", "²", "_", "\u0301", "S", "<|endoftext|>", "y" * 120]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert encoder.encode(text) == np.array(_ids([text])[0][:-1], "<u4").tobytes(), repr(text)


def test_a_hot_key_fills_several_files(spark):
    docs = spark.range(4000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("doc_id"),
                                    F.lit("the same text").alias("text")).repartition(8)
    path = tempfile.mkdtemp(prefix="promolens-tokens-") + "/files"
    with _many_files(spark):
        write_tokens(docs, path)
    rows = spark.read.parquet(f"{path}/tokens")
    assert rows.filter("key = 7").select("part").distinct().count() > 1
    starts = [r.start for r in read_tokens(spark, path, ("n_tokens",)).orderBy("start").collect()]
    assert starts == list(range(0, 4 * 4000, 4))

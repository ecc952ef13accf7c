"""Token ids as Parquet list columns that can be read in part.

Documents are dealt by ranges of their key, sorted within a task, tokenised and
written as one file a task. A row holds the key, the file's number, the ids
before it in its file, its number of ids and the ids as a list; other columns
of the documents stay beside them in the struct ``meta``. The list is
dictionary encoded (a vocabulary fits one dictionary page), the counts and
places are delta encoded. Row groups and pages have bounded sizes and every
column chunk has a page index, so a read of lengths or of metadata never
touches the ids, and a read of a key range or of a window of the token stream
skips files, row groups and pages by their statistics.

Where a file starts in the whole stream is known when all are written. It is
kept in a second, small table with one row per file (``parts``), summed in two
levels, and added when the files are read: ids are written once and not moved.

Edge cases: null and empty texts are the end token alone; null keys come first;
rows of one key are in the order of their texts' hashes, and rows that are
equal in both are equal in ids. Ranges are cut over key, text hash and row, so
a key with a third of all rows fills several files. Other columns may have any
names, as they are nested; the key is written as ``key`` whatever its name. An
empty table gives files without rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolens.llm.columns import whole_text
from promolens.llm.packing import LONG, MARKS, ChunkEncoder


@dataclass(frozen=True)
class TokenFiles:
    """``row_group_bytes``, ``page_bytes``, ``page_rows``: upper sizes; ``broadcast_parts``: files
    whose places in the stream are broadcast (24 bytes each), more meet the rows in a shuffle join;
    ``remembered``: words and marks kept per worker, and a quarter as many chunks, about 250 bytes each."""

    end_token: int = 2
    tokenizer: str = "word_bpe_49k.json"
    row_group_bytes: int = 64 << 20
    page_bytes: int = 256 << 10
    page_rows: int = 2_000
    broadcast_parts: int = 200_000
    remembered: int = 300_000
    texts_per_batch: int = 256

    def options(self) -> dict[str, str]:
        """Settings of the Parquet writer; its second version encodes whole numbers as deltas."""
        return {"parquet.writer.version": "v2",
                "parquet.block.size": str(self.row_group_bytes),
                "parquet.page.size": str(self.page_bytes),
                "parquet.page.row.count.limit": str(self.page_rows),
                "parquet.enable.dictionary": "false",
                "parquet.enable.dictionary#ids.list.element": "true",
                "compression": "snappy"}


#: Files whose sums are added up in one window of the second level.
PER_CHUNK = 4096
#: Letters of byte-level models for the bytes 0 to 255: printable ones as they are, the others from 256 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
OTHERS = [b for b in range(256) if b not in PRINTED]
SPELLED = {b: 256 + i for i, b in enumerate(OTHERS)}


#: Letters that are one letter in lower case and stay as they are in normal form C.
LETTERS = "a-zß-öø-ÿ"
#: A text of such letters, ASCII digits, white space and marks.
PLAIN = re.compile(f"[A-ZÀ-ÖØ-Þ{LETTERS}0-9 \\t-\\r'{re.escape(MARKS)}]*").fullmatch
#: What the pre-tokeniser parts such a text into: contractions, runs of letters, single digits, runs of marks.
PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[0-9]|['{re.escape(MARKS)}]+").findall


class Parts(dict):
    """Ids of lower-cased words and runs of marks as little-endian bytes; holds up to ``limit``."""

    def __init__(self, model, limit: int) -> None:
        super().__init__()
        self.model, self.limit = model, limit

    def __missing__(self, part: str) -> bytes:
        spelled = part if part.isascii() else part.encode().decode("latin-1").translate(SPELLED)
        ids = array("I", [token.id for token in self.model.tokenize(spelled)]).tobytes()
        if len(part) <= LONG:
            if len(self) >= self.limit:
                self.clear()
            self[part] = ids
        return ids


class TextEncoder(ChunkEncoder):
    """Ids of texts as little-endian bytes.

    A plain text is parted as the pre-tokeniser does, and its parts go to the
    library's model; any other text goes on in chunks between white space.
    """

    def __init__(self, path: str, limit: int) -> None:
        super().__init__(path, limit // 4)
        self.parts = Parts(self.model, limit)

    def encode(self, text: str) -> bytes:
        if PLAIN(text) and "<|" not in text:
            return b"".join(map(self.parts.__getitem__, PARTS(text.lower())))
        return super().encode(text)


@cache
def worker_encoder(path: str, limit: int) -> TextEncoder:
    """The encoder of this worker process; what it remembers serves all its tasks."""
    return TextEncoder(path, limit)


def encoded(docs: DataFrame, config: TokenFiles, key: str, text: str) -> DataFrame:
    """Rows of the files, in the order of their keys."""
    others = [c for c in docs.columns if c not in (key, text)]
    meta = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("meta")] if others else []
    plain = (docs.select(F.col(f"`{key}`").alias("key"), *meta, whole_text(F.col(f"`{text}`")).alias("text"))
             .select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row")))
    sorted_rows = plain.repartitionByRange("key", "hash", "row").sortWithinPartitions("key", "hash", "row")
    kept = sorted_rows.select("key", *(["meta"] if others else []),
                              F.spark_partition_id().alias("part"), "text")
    shape = T.StructType([
        *kept.schema.fields[:-1], T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(public_tokenizers.path(config.tokenizer), config.remembered)
        end, at = np.array([config.end_token], dtype="<u4").tobytes(), 0
        for batch in batches:
            for first in range(0, batch.num_rows, config.texts_per_batch):
                some = batch.slice(first, config.texts_per_batch)
                parts = [encoder.encode(whole) + end for whole in some.column(some.num_columns - 1).to_pylist()]
                sizes = np.array([len(p) // 4 for p in parts], dtype=np.int64)
                ends = np.cumsum(sizes)
                ids = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]), pa.int32()),
                    pa.array(np.frombuffer(b"".join(parts), "<i4")),
                    type=pa.list_(pa.field("element", pa.int32(), nullable=False)))
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:-1], pa.array(at + ends - sizes), pa.array(sizes), ids],
                    [f.name for f in shape])
                at += int(ends[-1])

    return kept.mapInArrow(rows, shape)


def write_tokens(docs: DataFrame, path: str, config: TokenFiles = TokenFiles(),
                 key: str = "doc_id", text: str = "text") -> None:
    """Write the token files of ``docs`` below ``path``, in ascending order of ``key``."""
    encoded(docs, config, key, text).write.options(**config.options()).parquet(f"{path}/tokens")
    spark = docs.sparkSession
    sums = (spark.read.parquet(f"{path}/tokens").groupBy("part")
            .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            .withColumn("chunk", F.floor(F.col("part") / PER_CHUNK)))
    before = (Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1),
              Window.partitionBy("chunk").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    chunks = sums.groupBy("chunk").agg(F.sum("n_tokens").alias("in_chunk")).select(
        "chunk", F.coalesce(F.sum("in_chunk").over(before[0]), F.lit(0)).alias("chunk_start"))
    starts = sums.join(chunks, "chunk").withColumn(
        "start", F.col("chunk_start") + F.coalesce(F.sum("n_tokens").over(before[1]), F.lit(0)))
    starts.select("part", "start", "n_docs", "n_tokens").write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str, columns: Sequence[str] = ("n_tokens", "ids"),
                keys: tuple | None = None, config: TokenFiles = TokenFiles()) -> DataFrame:
    """``key``, ``start`` (ids of all rows before it) and the named columns of the files.

    ``keys`` bounds the keys, both ends included; the bound reaches the scan.
    """
    rows = spark.read.parquet(f"{path}/tokens")
    if keys is not None:
        rows = rows.filter(F.col("key").between(*keys))
    return _placed(spark, path, rows, columns, config)


def read_window(spark: SparkSession, path: str, first: int, last: int,
                config: TokenFiles = TokenFiles()) -> DataFrame:
    """Of the whole stream the ids from place ``first`` to before ``last``, by row: key, start, ids."""
    touched = spark.read.parquet(f"{path}/parts").filter(
        (F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))
    low, high = touched.agg(F.min("part"), F.max("part")).first()
    rows = spark.read.parquet(f"{path}/tokens").filter(
        F.col("part").between(low, high) if low is not None else F.lit(False))
    found = _placed(spark, path, rows, ("n_tokens", "ids"), config).filter(
        (F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))
    skipped = F.greatest(F.lit(first) - F.col("start"), F.lit(0))
    taken = F.least(F.lit(last) - F.col("start"), F.col("n_tokens")) - skipped
    return found.select("key", (F.col("start") + skipped).alias("start"), F.slice(
        "ids", (skipped + 1).cast("int"), taken.cast("int")).alias("ids"))


def _placed(spark: SparkSession, path: str, rows: DataFrame, columns: Sequence[str],
            config: TokenFiles) -> DataFrame:
    starts = spark.read.parquet(f"{path}/parts").select("part", F.col("start").alias("file_start"))
    if starts.count() <= config.broadcast_parts:
        starts = F.broadcast(starts)
    return rows.join(starts, "part").select(
        "key", (F.col("file_start") + F.col("at")).alias("start"), *columns)


def with_crc(tokens: DataFrame, ids: str = "ids", into: str = "ids_crc32") -> DataFrame:
    """``tokens`` with the crc32 of the ids as little-endian unsigned numbers in place of ``ids``."""
    others = [c for c in tokens.columns if c not in (ids, into)]
    shape = T.StructType([*(tokens.schema[c] for c in others), T.StructField(into, T.LongType())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(others))
            values, cuts = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(
                [zlib.crc32(values[a:b]) for a, b in zip(cuts, cuts[1:])], pa.int64())],
                [f.name for f in shape])

    return tokens.select(*others, ids).mapInArrow(sums, shape)

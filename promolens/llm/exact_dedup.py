"""Exact deduplication with disk-backed streaming state.

The table is landed as a log of (identifier, locator, digest of the normalised
text). A Structured Streaming query reads the log and keeps, per digest and
without expiry, the stable identifier and content locator of the row that
stays and the number of rows seen; the state lives in RocksDB and is
checkpointed to the shared folder, so a lost executor or a later run goes on
from there. A digest that was hit more than once is a claim only: the whole
normalised texts of such rows are fetched and compared with the row that stays,
and digests with a mismatch are grouped by the texts themselves.

Copies fold into one row per task before the state's shuffle (partial
aggregation), so a group with a third of all rows costs no more than others.

Edge cases: a null text is empty; texts that differ in white space runs only
are equal; the smallest identifier stays, a null one only if its group has no
other; of repeated rows with one identifier the one with the smallest locator
stays. An empty table gives an empty result. ``into`` names the added struct
(keep_id, group_size, kept, text_sha256) and replaces a column of that name;
other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolens.llm.columns import SPACE, any_names, whole_text
from promolens.llm.scratch import exists, folder, table
from promolens.operators.joins import split_join

#: State on disk; without preallocation, which takes 4 MB a state partition however little it holds.
STATE = {"spark.sql.streaming.stateStore.providerClass":
         "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(whole_text(text), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_at``: file and row number where the content is found again.

    A frame that is not a plain read of files is written to the shared folder first.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"),
                  F.col("_metadata.row_index").alias("row")).alias("_at")
    try:
        return docs.select("*", at)
    except AnalysisException:
        return table(docs, "landed").select("*", at)


def stream_groups(log: DataFrame, log_path: str, files_per_batch: int = 200) -> DataFrame:
    """Run the stateful query over the log; one row per digest that was hit twice or more."""
    spark = log.sparkSession
    state, out = folder(spark, "dedup-state"), folder(spark, "dedup-groups")
    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        seen = (spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files_per_batch)
                .parquet(log_path).groupBy("_digest")
                .agg(F.min(F.struct(F.col("_id").isNull().alias("absent"), "_id", "_at"))
                     .alias("_stays"), F.count(F.lit(1)).alias("_size")))

        def store(batch: DataFrame, number: int) -> None:
            batch.filter("_size > 1").write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = (seen.writeStream.outputMode("update").option("checkpointLocation", state)
                 .foreachBatch(store).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    shape = seen.schema
    # State only grows and its row that stays only gets smaller, so the newest entry is max and min.
    return (spark.read.schema(shape).option("recursiveFileLookup", "true").parquet(out)
            if exists(spark, out) else spark.createDataFrame([], shape)
            ).groupBy("_digest").agg(F.min("_stays").alias("_stays"), F.max("_size").alias("_size"))


@any_names
def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                     into: str = "dedup", keep_text: bool = True,
                     digest: Callable[[Column], Column] = sha256,
                     broadcast_rows: int = 200_000) -> DataFrame:
    """``docs`` with the struct ``into``; every row comes back, dropped ones marked.

    ``keep_text=False`` leaves the text column out of the result, which then
    comes from the log and the state alone. The table of digests with more than
    one row is counted and broadcast up to ``broadcast_rows`` (about 100 bytes
    each); beyond that both joins shuffle, with hot digests split by Spark.
    """
    spark = docs.sparkSession
    rows = located(docs)
    marked = rows.withColumns({"_norm": normalised(text)}).withColumn("_digest", digest(F.col("_norm")))
    others = [c for c in docs.columns if c not in (into, text if not keep_text else into)]
    log_path = folder(spark, "dedup-log")
    kept_columns = [] if keep_text else [c for c in others if c != key]
    (marked.select(F.col(key).alias("_id"), "_at", "_digest", *kept_columns)
     .write.parquet(log_path))
    plain = marked.select(F.col(key).alias("_id"), "_at", "_digest", *kept_columns)
    log = spark.read.schema(plain.schema).parquet(log_path)
    groups = table(stream_groups(log.select("_id", "_at", "_digest"), log_path), "dedup-hits")
    few = groups.count() <= broadcast_rows

    def with_groups(left: DataFrame, how: str) -> DataFrame:
        return left.join(F.broadcast(groups) if few else groups, "_digest", how)

    # Full bytes of every hit against the row that stays.
    texts = table(with_groups(marked.select("_digest", "_at", "_norm"), "inner")
                  .withColumn("_first", F.col("_stays._at") == F.col("_at")), "dedup-texts")
    first = texts.filter("_first").select("_digest", F.col("_norm").alias("_first_norm"))
    # A join of its own partitioning, so that Spark can split a digest with very many copies.
    wrong = (split_join(texts.filter("NOT _first"), first, ["_digest"])
             .filter("_norm != _first_norm").select("_digest").distinct())
    wrong = table(wrong, "dedup-collisions")
    base = marked.select(*[f"`{c}`" for c in others], "_at", "_digest") if keep_text else log.select(
        *[F.col("_id").alias(key) if c == key else F.col(f"`{c}`") for c in others], "_at", "_digest")
    joined = with_groups(base, "left").select(
        *[f"`{c}`" for c in others], "_at", "_digest",
        F.when(F.col("_size").isNull(), F.col(key)).otherwise(F.col("_stays._id")).alias("_keep"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("_n"),
        (F.col("_size").isNull() | (F.col("_stays._at") == F.col("_at"))).alias("_kept"))
    if not wrong.isEmpty():
        joined = _regroup(joined, marked, wrong, key)
    return joined.select(*[f"`{c}`" for c in others], F.struct(
        F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
        F.col("_kept").alias("kept"), F.col("_digest").alias("text_sha256")).alias(into))


def _regroup(joined: DataFrame, marked: DataFrame, wrong: DataFrame, key: str) -> DataFrame:
    """Rows whose digest stands for several texts, grouped by the texts instead."""
    colliding = marked.select(F.col(key).alias("_id"), "_at", "_digest", "_norm").join(wrong, "_digest", "left_semi")
    by_text = colliding.groupBy("_digest", "_norm").agg(
        F.min(F.struct(F.col("_id").isNull().alias("absent"), "_id", "_at")).alias("_true"),
        F.count(F.lit(1)).alias("_true_n"))
    fixed = colliding.join(by_text, ["_digest", "_norm"]).select(
        F.col("_at").alias("_fixed_at"), "_true", "_true_n")
    both = joined.join(fixed, F.col("_at") == F.col("_fixed_at"), "left")
    found = F.col("_true_n").isNotNull()
    return both.withColumns({
        "_keep": F.when(found, F.col("_true._id")).otherwise(F.col("_keep")),
        "_n": F.when(found, F.col("_true_n")).otherwise(F.col("_n")),
        "_kept": F.when(found, F.col("_true._at") == F.col("_at")).otherwise(F.col("_kept"))})

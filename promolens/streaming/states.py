"""Stateful streaming forms of the newest-row and hour-cutoff operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.operators.cdc import latest_per_key


def latest_state(log: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """Newest row per key of a streamed change log; run it in update mode.

    The state is one row per key. Map tasks fold their rows first, so a busy
    key reaches its state as one row per task and batch.
    """
    newest = F.max_by(F.struct(*log.columns), F.struct(*order_cols)).alias("_row")
    return log.groupBy(*[F.col(key).alias(f"_{key}") for key in keys]).agg(newest).select("_row.*")


def hourly_discounts(lines: DataFrame, delay: str) -> DataFrame:
    """Line counts and discount sums per (dt, hr, store) of streamed lines.

    Hours close once ``delay`` has passed since the newest line; later lines
    of a closed hour are dropped and its state is freed. A day's figure up to
    an hour is the sum of its hours, so any cutoff can be read from the result.
    """
    taken = F.make_timestamp(F.year("dt"), F.month("dt"), F.day("dt"), F.col("hr"), F.lit(0),
                             F.lit(0))
    hour = F.col("_hour.start")
    return (lines.withColumn("_taken", taken)
            .withWatermark("_taken", delay)
            .groupBy(F.window("_taken", "1 hour").alias("_hour"), "store_id")
            .agg(F.count(F.lit(1)).alias("lines"),
                 F.sum(F.coalesce("store_discount", F.lit(0))).alias("store_discount"),
                 F.sum(F.coalesce("platform_discount", F.lit(0))).alias("platform_discount"))
            .select(F.to_date(hour).alias("dt"), F.hour(hour).alias("hr"), "store_id", "lines",
                    "store_discount", "platform_discount"))


def _line_time() -> Column:
    """Start of a line's hour; of its day if the hour is missing."""
    return F.make_timestamp(F.year("dt"), F.month("dt"), F.day("dt"),
                            F.coalesce("hr", F.lit(0)), F.lit(0), F.lit(0))


def lines_with_orders(lines: DataFrame, orders: DataFrame, delay: str) -> DataFrame:
    """Streamed lines with the amount and customer of their streamed order of the day.

    Either side may come first. Each side waits in the state for the other
    until ``delay`` has passed since the newest row of the slower stream and
    the order's day is over; rows that come later than that are dropped. Run
    it in append mode: a pair leaves as soon as both are there. As in a batch
    join, an order delivered twice meets its lines twice.
    """
    placed = (orders.select(F.col("order_id").alias("_order"), F.to_timestamp("dt").alias("_placed"),
                            "gmv", "customer_id")
              .withWatermark("_placed", delay))
    taken = lines.withColumn("_taken", _line_time()).withWatermark("_taken", delay)
    same = ((F.col("order_id") == F.col("_order")) & (F.to_timestamp("dt") == F.col("_placed"))
            & (F.col("_taken") >= F.col("_placed"))
            & (F.col("_taken") < F.col("_placed") + F.expr("interval 1 day")))
    return taken.join(placed, same).drop("_order", "_placed", "_taken")


def order_sums(joined: DataFrame, delay: str) -> DataFrame:
    """The order grain of streamed pairs: discount sums per (dt, order, store, amount, customer).

    Run it in update mode. Pairs leave ``lines_with_orders`` up to its own
    delay and a day after newer ones, so ``delay`` should be twice that delay
    and a day more; state of older days is freed.
    """
    amounts = {name: F.sum(F.coalesce(name, F.lit(0))).alias(name)
               for name in ("store_discount", "platform_discount")}
    grain = ["dt", "order_id", "store_id", "gmv", "customer_id"]
    return (joined.withColumn("_day", F.to_timestamp("dt")).withWatermark("_day", delay)
            .groupBy("_day", *grain).agg(*amounts.values())
            .select(*grain, *amounts,
                    (F.col("store_discount") + F.col("platform_discount")).alias("total_discount")))


def drain(updates: DataFrame, folder: str, keys: Sequence[str] | None = None,
          fold_every: int = 16) -> None:
    """Process what a stream holds now, then stop; calling it again resumes.

    Each micro-batch replaces its own ``batch_id`` folder, so a batch repeated
    after a failure leaves no second copy. With ``keys``, every ``fold_every``
    batches the last update of each key is folded into a new base, and what an
    older base covers is removed: a reader meets one row per key and the
    updates since, however long the stream has run.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch_id={batch_id}")
        if keys is not None and (batch_id + 1) % fold_every == 0:
            _fold(batch.sparkSession, folder, keys, batch_id)

    (updates.writeStream.outputMode("update")
     .option("checkpointLocation", f"{folder}/progress")
     .trigger(availableNow=True)
     .foreachBatch(write)
     .start()
     .awaitTermination())


def drain_rows(rows: DataFrame, folder: str) -> None:
    """As ``drain`` for a stream in append mode: its rows are added to ``folder``/rows, once each."""
    (rows.writeStream.outputMode("append").format("parquet")
     .option("checkpointLocation", f"{folder}/progress")
     .option("path", f"{folder}/rows")
     .trigger(availableNow=True)
     .start()
     .awaitTermination())


def newest_updates(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """The current state: the last written update of each key."""
    return latest_per_key(_updates(spark, folder), keys, ["batch_id"]).drop("batch_id")


def _numbered(spark: SparkSession, parent: str, name: str) -> dict[int, str]:
    """Complete folders ``name=<number>`` below ``parent``, by number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(parent)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return {}
    made = [status.getPath() for status in files.listStatus(path)
            if status.getPath().getName().startswith(f"{name}=")]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return {int(folder.getName().split("=")[1]): folder.toString() for folder in made
            if files.exists(done(folder, "_SUCCESS"))}


def _updates(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The newest base made before batch ``before``, and the updates behind it, with ``batch_id``."""
    bases = {n: p for n, p in _numbered(spark, f"{folder}/base", "upto").items()
             if before is None or n < before}
    base = max(bases, default=-1)
    parts = [spark.read.parquet(path).withColumn("batch_id", F.lit(n).cast("long"))
             for n, path in sorted(_numbered(spark, f"{folder}/updates", "batch_id").items()) if n > base]
    if bases:
        parts.insert(0, spark.read.parquet(bases[base]))
    if not parts:
        raise ValueError(f"no updates below {folder}")
    return reduce(DataFrame.unionByName, parts)


def _fold(spark: SparkSession, folder: str, keys: Sequence[str], upto: int) -> None:
    """Make the base up to a batch; the one before stays, as that batch may be repeated."""
    newest = latest_per_key(_updates(spark, folder, before=upto), keys, ["batch_id"])
    newest.write.mode("overwrite").parquet(f"{folder}/base/upto={upto}")
    bases = _numbered(spark, f"{folder}/base", "upto")
    kept = max((n for n in bases if n < upto), default=-1)
    covered = [path for n, path in bases.items() if n < kept]
    covered += [path for n, path in _numbered(spark, f"{folder}/updates", "batch_id").items() if n <= kept]
    for name in covered:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

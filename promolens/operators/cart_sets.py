"""Distinct carts as bitmaps, whose counts over any days come from daily sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from promolens.operators.joins import split_join
from promolens.vocabulary import DEFAULT_VOCABULARY, Vocabulary

#: Numbers of one task: ``monotonically_increasing_id`` counts on from a multiple of this.
TASK = 1 << 33


def stored_cart_numbers(spark: SparkSession, path: str) -> DataFrame | None:
    """The numbers given so far, or None before the first ones."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def number_carts(carts: DataFrame, path: str) -> None:
    """Give carts without a number in ``path`` one, and append them: (cart_id, cart_number).

    New carts are sorted by store, first day and id and counted on from there, so the carts that a
    store has on a day get neighbouring numbers and share bitmaps. Tasks part
    the sorted carts by range, the id included, which splits a hot store.
    Numbers count once they are written; a lost executor before that changes
    nothing that anyone read. One caller at a time may number into a path.
    """
    new = (carts.where(F.col("cart_id").isNotNull()).groupBy("cart_id")
           .agg(F.min(F.struct("dt", "store_id")).alias("_first")))
    given, start = stored_cart_numbers(carts.sparkSession, path), 0
    if given is not None:
        new = split_join(new, given.select("cart_id"), ["cart_id"], "left_anti")
        last = given.agg(F.max("cart_number")).first()[0]
        start = 0 if last is None else (last // TASK + 1) * TASK
    order = ["_first.store_id", "_first.dt", "cart_id"]
    (new.repartitionByRange(*order).sortWithinPartitions(*order)
     .select("cart_id", (F.lit(start) + F.monotonically_increasing_id()).alias("cart_number"))
     .write.mode("append").parquet(path))


def cart_sets(carts: DataFrame, numbers: DataFrame, group: Sequence[str],
              vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Per group and bucket of cart numbers the carts and the placed carts, one bit each.

    With ``dt`` in the group these are daily sets, to be stored. A cart's rows
    set the same bit, so nothing is made distinct first, and bits combine in
    every map task before the shuffle.
    """
    numbered = split_join(carts.where(F.col("cart_id").isNotNull()), numbers, ["cart_id"])
    bit = F.bitmap_bit_position("cart_number")
    placed = F.col("cart_state") == vocab.placed_state
    return numbered.groupBy(*group, F.bitmap_bucket_number("cart_number").alias("bucket")).agg(
        F.bitmap_construct_agg(bit).alias("carts"),
        F.bitmap_construct_agg(F.when(placed, bit)).alias("placed_carts"))


def cart_set_counts(sets: DataFrame, group: Sequence[str]) -> DataFrame:
    """Exact distinct carts and placed carts per ``group``, which may leave out any of the sets' keys.

    A cart of several days is counted once over all of them, which a sum of daily counts gets wrong.
    """
    merged = sets.groupBy(*group, "bucket").agg(
        *[F.bitmap_count(F.bitmap_or_agg(name)).alias(name) for name in ("carts", "placed_carts")])
    return merged.groupBy(*group).agg(F.sum("carts").alias("cart_count"),
                                      F.sum("placed_carts").alias("placed_cart_count"))

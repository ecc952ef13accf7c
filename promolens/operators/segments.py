"""Customer segments."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolens.functions import segment_label
from promolens.operators.joins import split_join
from promolens.vocabulary import DEFAULT_VOCABULARY, Vocabulary


def override_customers(override: DataFrame,
                       vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Distinct customers holding the override segment on the table's last date.

    The last date is taken over all segments: if it lacks the segment, nobody
    is overridden.
    """
    last_date = override.agg(F.max("dt")).scalar()
    return (override
            .where((F.col("segment") == vocab.override_segment) & (F.col("dt") == last_date))
            .select("customer_id")
            .distinct())


def customer_segments(tiers: DataFrame, month: date | None = None,
                      overridden: DataFrame | None = None,
                      vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """(customer_id, dt, customer_segment), for one month start or for all months."""
    if month is not None:
        tiers = tiers.where(F.col("dt") == F.lit(month))
    if overridden is None:
        return tiers.select("customer_id", "dt",
                            segment_label(F.col("tier"), vocab=vocab).alias("customer_segment"))
    marked = overridden.select("customer_id", F.lit(True).alias("_overridden"))
    return (tiers.join(marked, "customer_id", "left")
            .select("customer_id", "dt",
                    segment_label(F.col("tier"), F.col("_overridden"), vocab)
                    .alias("customer_segment")))


def segment_or_default(vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    return F.coalesce(F.col("customer_segment"), F.lit(vocab.unclassified))


def with_segment(facts: DataFrame, segments: DataFrame,
                 vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Facts with ``customer_segment``; customers without a tier get the default label.

    A hot customer is split at run time, a missing customer id included.
    """
    labels = segments.select("customer_id", "customer_segment")
    return (split_join(facts, labels, ["customer_id"], "left")
            .withColumn("customer_segment", segment_or_default(vocab)))


def with_month_segment(facts: DataFrame, segments: DataFrame,
                       vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """As ``with_segment``, matching the segment of the month of each fact's ``dt``."""
    monthly = segments.select("customer_id", F.col("dt").alias("_month"), "customer_segment")
    return (split_join(facts.withColumn("_month", F.trunc("dt", "month")), monthly,
                       ["customer_id", "_month"], "left")
            .drop("_month")
            .withColumn("customer_segment", segment_or_default(vocab)))

"""Segment and variant roll-ups of order measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolens.operators.experiments import with_variant
from promolens.operators.joins import split_join
from promolens.operators.orders import measure_columns, sum_measures
from promolens.operators.segments import with_segment
from promolens.vocabulary import DEFAULT_VOCABULARY, Vocabulary


def segment_rollup(measures: DataFrame, segments: DataFrame, extra: Sequence[str] = (),
                   vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Sum measures per (dt, customer segment, extra keys)."""
    labelled = with_segment(measures, segments, vocab)
    return sum_measures(labelled, ["dt", "customer_segment", *extra])


def store_exposures(stores: DataFrame, variants: DataFrame, count_store_once: bool = False,
                    vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """(dt, store_id, variant, copies) of (as_of_dt, campaign_id, store_id) rows.

    A store in several campaigns of a day counts once per campaign; ``copies``
    keeps that multiplicity in one row per variant. ``count_store_once`` sets
    it to 1.
    """
    copies = F.max(F.lit(1)) if count_store_once else F.count(F.lit(1))
    return (with_variant(stores.withColumnRenamed("as_of_dt", "run_date"), variants)
            .groupBy(F.col("run_date").alias("dt"), "store_id",
                     F.coalesce("variant", F.lit(vocab.default_variant)).alias("variant"))
            .agg(copies.cast("int").alias("copies")))


def expose(measures: DataFrame, exposures: DataFrame) -> DataFrame:
    """Credit measures to the variants of their store and day, once per copy."""
    values = measure_columns(measures)
    others = [name for name in measures.columns if name not in values]
    return (split_join(measures, exposures, ["dt", "store_id"])
            .select(*others, "variant",
                    *[(F.col(name) * F.col("copies")).alias(name) for name in values]))

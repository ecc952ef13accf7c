"""Order and discount metrics of stores with an active campaign."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolens.functions import offer_discount_type
from promolens.operators import campaigns, offers, orders, rollup, segments
from promolens.operators.cdc import date_spine
from promolens.operators.experiments import latest_variant
from promolens.operators.joins import broadcast_if_small, split_join
from promolens.params import ReportParams
from promolens.sources import Frames
from promolens.vocabulary import DEFAULT_VOCABULARY, Vocabulary


def month_segments(frames: Frames, params: ReportParams, vocab: Vocabulary) -> DataFrame:
    """Segments of the report month, overrides applied."""
    overridden = segments.override_customers(frames.segment_override, vocab)
    return segments.customer_segments(frames.customer_tiers, params.month, overridden, vocab)


def _live_store_lines(frames: Frames, params: ReportParams, vocab: Vocabulary) -> DataFrame:
    """Eligible lines of stores with a live campaign, cut before anything is shuffled."""
    lines = orders.eligible_lines(frames.offer_lines, params.start, params.end, params.dates,
                                  vocab=vocab)
    stores = campaigns.live_stores(frames.campaign_events, params.as_of, vocab)
    return split_join(lines, broadcast_if_small(stores, params.max_broadcast_rows),
                      ["store_id"], "left_semi")


def with_offer_mark(lines: DataFrame, marked_offers: DataFrame, mark: str,
                    default_offer: int | None = None) -> DataFrame:
    """Lines with a boolean ``mark``: is the offer among ``marked_offers``?

    Only marked offers are joined, a short list next to all offers.
    ``default_offer`` stands in for a missing offer id.
    """
    offer = F.col("offer_id")
    if default_offer is not None:
        kind = lines.schema["offer_id"].dataType
        offer = F.coalesce(offer, F.lit(default_offer).cast(kind))
    side = marked_offers.select(F.col("offer_id").alias("_offer"), F.lit(True).alias("_marked"))
    return (split_join(lines.withColumn("_offer", offer), side, ["_offer"], "left")
            .withColumn(mark, F.coalesce("_marked", F.lit(False)))
            .drop("_offer", "_marked"))


def overall_segment(frames: Frames, params: ReportParams,
                    vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Orders, gmv and discounts per (dt, customer segment) of live campaign stores."""
    grain = orders.order_discount_grain(
        _live_store_lines(frames, params, vocab),
        orders.eligible_orders(frames.orders, params.start, params.end, params.dates))
    measures = orders.order_measures(grain, ["dt", "store_id", "customer_id"])
    return orders.money_as_double(
        rollup.segment_rollup(measures, month_segments(frames, params, vocab), vocab=vocab))


def managed_vs_unmanaged(frames: Frames, params: ReportParams,
                         vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Orders and discounts per (dt, segment, managed flag, discount type).

    An order counts once in every (flag, type) it has a line of, so order
    counts must not be added up over those.
    """
    flags = offers.offer_managed_flag(frames.offer_events, params.end, params.offer_window_days,
                                      vocab)
    managed = flags.where(F.col("managed_flag") == vocab.managed).select("offer_id")
    lines = with_offer_mark(_live_store_lines(frames, params, vocab),
                            broadcast_if_small(managed, params.max_broadcast_rows), "_managed")
    lines = (lines
             .withColumn("managed_flag", F.when(F.col("_managed"), vocab.managed)
                         .otherwise(vocab.unmanaged))
             .withColumn("discount_label", offer_discount_type(
                 F.col("offer_type"), F.col("applied"), F.col("discount_type"),
                 F.col("benefit_type"), vocab)))
    kinds = ["managed_flag", "discount_label"]
    grain = orders.order_discount_grain(
        lines, orders.eligible_orders(frames.orders, params.start, params.end, params.dates),
        line_keys=kinds, order_keys=["customer_id"])
    measures = orders.order_measures(grain, ["dt", "store_id", "customer_id", *kinds])
    report = rollup.segment_rollup(measures, month_segments(frames, params, vocab), kinds, vocab)
    return orders.money_as_double(report).withColumnRenamed("discount_label", "discount_type")


def intraday_segment_variant(frames: Frames, params: ReportParams,
                             vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Metrics up to an hour of the day per (dt, segment, experiment variant).

    A store is credited once per campaign it was in that day, unless
    ``count_store_once`` is set.
    """
    spine = date_spine(frames.live_orders, params.dates, params.start, params.end)
    exposures = broadcast_if_small(
        rollup.store_exposures(
            campaigns.stores_asof(frames.campaign_events, spine, vocab),
            latest_variant(frames.assignments, params.dates), params.count_store_once, vocab),
        params.max_broadcast_rows)
    tagged = (offers.offer_lock_meta(frames.offer_events, params.offer_since, vocab)
              .where(F.col("is_tagged") == 1).select("offer_id"))
    lines = orders.eligible_lines(frames.offer_lines, params.start, params.end, params.dates,
                                  params.hour_cutoff, vocab)
    lines = split_join(lines, exposures.select("dt", "store_id"), ["dt", "store_id"], "left_semi")
    lines = with_offer_mark(lines, broadcast_if_small(tagged, params.max_broadcast_rows),
                            "_tagged", default_offer=0)
    grain = orders.order_discount_grain(
        lines.withColumn("is_tagged", F.col("_tagged").cast("int")),
        orders.eligible_orders(frames.live_orders, params.start, params.end, params.dates,
                               check_ignored=False),
        tagged=True)
    measures = orders.order_measures(grain, ["dt", "store_id", "customer_id"])
    labelled = segments.with_segment(measures, month_segments(frames, params, vocab), vocab)
    return orders.money_as_double(orders.sum_measures(
        rollup.expose(labelled, exposures), ["dt", "customer_segment", "variant"]))

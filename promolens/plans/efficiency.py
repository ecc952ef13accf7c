"""Discount efficiency of the packs chosen per store, segment and day-part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolens.functions import slot_of
from promolens.operators import orders, packs, segments
from promolens.operators.experiments import latest_variant
from promolens.operators.joins import keep_listed, staged
from promolens.params import ReportParams
from promolens.plans.discounts import month_segments
from promolens.sources import Frames
from promolens.vocabulary import DEFAULT_VOCABULARY, Vocabulary


_CHOICE = ["run_date", "store_id", "segment", "slot", "pack_id"]


def window_runs(frames: Frames, params: ReportParams) -> DataFrame:
    """Runs of the report window: documents of other days are neither parsed nor staged."""
    return frames.campaign_state.where(
        F.col("run_date").between(F.lit(params.start), F.lit(params.end)))


def pack_stores(mapping: DataFrame, params: ReportParams) -> DataFrame:
    """Distinct (dt, store) of a mapping in the report window."""
    window = mapping.where(F.col("run_date").between(F.lit(params.start), F.lit(params.end)))
    return window.select(F.col("run_date").alias("dt"), "store_id").distinct()


def slot_metrics(frames: Frames, params: ReportParams, vocab: Vocabulary = DEFAULT_VOCABULARY,
                 stores: DataFrame | None = None) -> DataFrame:
    """Order metrics per (dt, store, slot, customer segment).

    Segments meet the orders before the lines do: afterwards everything down
    to the final sums keeps the partitioning of the order join. ``stores``
    drops other stores' lines, before any shuffle if it is short enough to broadcast.
    """
    labelled = segments.with_segment(
        orders.eligible_orders(frames.orders, params.start, params.end, params.dates)
        .select("order_id", "dt", "gmv", "customer_id"),
        month_segments(frames, params, vocab), vocab)
    lines = orders.eligible_lines(frames.offer_lines, params.start, params.end, params.dates,
                                  vocab=vocab).withColumn("slot", slot_of(F.col("hr"), vocab))
    if stores is not None:
        lines = keep_listed(lines, stores, ["dt", "store_id"], params.max_broadcast_rows)
    grain = orders.order_discount_grain(lines, labelled, line_keys=["slot"],
                                        order_keys=["gmv", "customer_segment"])
    return orders.store_customer_metrics(grain, ["dt", "store_id", "slot", "customer_segment"])


def efficiency_for(mapping: DataFrame, metrics: DataFrame, params: ReportParams,
                   attributes: Sequence[str] = (),
                   vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Metrics of each distinct pack choice that sold something.

    Choices are distinct and metrics unique on the join keys, so the join is
    one to one and nothing is left to sum; choices without sales are not
    reported, hence an inner join. An order is credited to every (tier, mode)
    chosen for its store, segment and slot.
    """
    choices = packs.pack_choices(mapping, params.start, params.end,
                                 ["run_date", "store_id", "segment", "slot", *attributes], vocab)
    sold = metrics.where(F.col("gmv") > 0).select(
        F.col("dt").alias("run_date"), "store_id", "slot",
        F.col("customer_segment").alias("segment"), *orders.measure_columns(metrics))
    report = choices.join(sold, ["run_date", "store_id", "segment", "slot"])
    return orders.money_as_double(report.select(
        "run_date", "store_id", "tier", "mode", "segment", "slot", *attributes,
        *orders.measure_columns(metrics)))


def efficiency(frames: Frames, params: ReportParams, vocab: Vocabulary = DEFAULT_VOCABULARY,
               mapping: DataFrame | None = None) -> DataFrame:
    """Efficiency per (date, store, tier, mode, segment, slot); ``mapping`` may be a stored one.

    Without one the choices are staged: their stores then prune the lines, and
    the documents are parsed once.
    """
    if mapping is None:
        mapping = staged(packs.pack_identities(window_runs(frames, params), params.state_from,
                                               keys=_CHOICE))
    metrics = slot_metrics(frames, params, vocab, pack_stores(mapping, params))
    return efficiency_for(mapping, metrics, params, vocab=vocab)


def efficiency_by_variant(frames: Frames, params: ReportParams,
                          vocab: Vocabulary = DEFAULT_VOCABULARY,
                          mapping: DataFrame | None = None) -> DataFrame:
    """As ``efficiency``, also by the campaign's experiment variant."""
    if mapping is None:
        mapping = staged(packs.pack_identities(window_runs(frames, params), params.state_from,
                                               latest_variant(frames.assignments),
                                               ["campaign_id", *_CHOICE]))
    metrics = slot_metrics(frames, params, vocab, pack_stores(mapping, params))
    return efficiency_for(mapping, metrics, params, ["variant"], vocab)

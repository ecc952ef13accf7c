"""Cart-to-order funnels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolens.functions import pack_part
from promolens.operators import carts, orders, packs, segments
from promolens.operators.experiments import latest_variant
from promolens.params import ReportParams
from promolens.sources import Frames
from promolens.vocabulary import DEFAULT_VOCABULARY, Vocabulary


def labelled_carts(frames: Frames, params: ReportParams,
                   vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Cart rows with segment (no overrides) and repeat flag; the carts are read once."""
    grain = carts.cart_grain(frames.carts, params.start, params.end, vocab)
    days = carts.order_days(frames.orders, params.start, params.end, params.lookback_days, vocab)
    labels = segments.customer_segments(frames.customer_tiers, params.month, vocab=vocab)
    return segments.with_month_segment(
        carts.flag_repeats(grain, days, params.lookback_days, vocab), labels.distinct(), vocab)


def cart_funnel_by_pack(frames: Frames, params: ReportParams,
                        vocab: Vocabulary = DEFAULT_VOCABULARY,
                        mapping: DataFrame | None = None, bucketed: bool = False) -> DataFrame:
    """Funnel per (store, pack, segment, repeat flag, slot, value bucket).

    ``mapping`` may be a stored pack mapping, and ``bucketed`` says that
    ``write_bucketed_mapping`` stored it. Sums count a cart once per
    mapping row of its pack; the cart counts are distinct.
    """
    if mapping is None:
        mapping = packs.pack_identities(frames.campaign_state, params.state_from)
    window = mapping.where(F.col("run_date").between(F.lit(params.start), F.lit(params.end)))
    funnel = carts.cart_funnel(labelled_carts(frames, params, vocab),
                               carts.pack_multiplicity(window), vocab, bucketed)
    return orders.money_as_double(
        funnel.withColumn("tier", pack_part(F.col("pack_id"), 0))
        .withColumn("mode_part", pack_part(F.col("pack_id"), 1)))


def cart_funnel_by_variant(frames: Frames, params: ReportParams,
                           vocab: Vocabulary = DEFAULT_VOCABULARY,
                           mapping: DataFrame | None = None) -> DataFrame:
    """Carts and placed carts per (date, store, tier, mode, segment, variant).

    Covers the last complete days before ``as_of``. Carts are counted per
    (date, store, segment) before they meet the packs, whose choices are
    distinct, so the join adds no rows to count; choices without carts stay.
    """
    start, end = params.pack_window
    if mapping is None:
        mapping = packs.pack_identities(
            frames.campaign_state, params.state_from, latest_variant(frames.assignments),
            ["campaign_id", "run_date", "store_id", "segment", "pack_id"])
    choices = packs.pack_choices(mapping, start, end,
                                 ["run_date", "store_id", "segment", "variant"], vocab)
    labels = segments.customer_segments(frames.customer_tiers, params.month, vocab=vocab)
    counted = carts.cart_counts(
        segments.with_segment(carts.carts_between(frames.carts, start, end), labels, vocab), vocab)
    counted = counted.withColumnsRenamed({"dt": "run_date", "customer_segment": "segment"})
    return (choices.join(counted, ["run_date", "store_id", "segment"], "left")
            .select("run_date", "store_id", "tier", "mode", "segment", "variant",
                    *[F.coalesce(name, F.lit(0)).alias(name)
                      for name in ("cart_count", "placed_cart_count")]))

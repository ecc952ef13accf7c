from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Frames:
    """The input frames; a report only touches the ones it needs."""

    campaign_events: DataFrame | None = None
    store_events: DataFrame | None = None
    offer_events: DataFrame | None = None
    assignments: DataFrame | None = None
    campaign_state: DataFrame | None = None
    customer_tiers: DataFrame | None = None
    segment_override: DataFrame | None = None
    orders: DataFrame | None = None
    live_orders: DataFrame | None = None
    offer_lines: DataFrame | None = None
    carts: DataFrame | None = None

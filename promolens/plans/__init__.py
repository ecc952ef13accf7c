"""The eleven reports, each a function of the input frames and the parameters."""

from promolens.plans.discounts import (
    intraday_segment_variant,
    managed_vs_unmanaged,
    overall_segment,
)
from promolens.plans.efficiency import efficiency, efficiency_by_variant
from promolens.plans.funnels import cart_funnel_by_pack, cart_funnel_by_variant
from promolens.plans.stores import (
    active_by_day,
    active_now,
    whitelisted_now,
    whitelisted_without_live_campaign,
)

__all__ = [
    "active_by_day",
    "active_now",
    "cart_funnel_by_pack",
    "cart_funnel_by_variant",
    "efficiency",
    "efficiency_by_variant",
    "intraday_segment_variant",
    "managed_vs_unmanaged",
    "overall_segment",
    "whitelisted_now",
    "whitelisted_without_live_campaign",
]

"""Business vocabulary: every label, enum value and lookup table the reports use.

The tables are data. Deployments with other labels pass their own
``Vocabulary`` (``dataclasses.replace`` or ``with_segment_suffix``).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import NamedTuple


class DiscountRule(NamedTuple):
    """One discount label; ``None`` means the attribute is not tested."""

    label: str
    offer_type: str
    applied: tuple[str, ...] | None = None
    discount_type: str | None = None
    benefit_type: str | None = None


# Customer tier -> segment label.
TIER_SEGMENTS = {
    "P1A": "S1",
    "P1B": "S1",
    "P1C": "S1",
    "P1D": "S1",
    "P1_P": "S2",
    "P2": "S3",
    "P2_P": "S4",
    "P3": "S5",
    "P3_P": "S6",
}

# Customer tier -> coarse tier group.
TIER_GROUPS = {
    "P1A": "P1",
    "P1B": "P1",
    "P1C": "P1",
    "P1D": "P1",
    "P1_P": "P1",
    "P2": "P2",
    "P2_P": "P2",
    "P3": "P3",
    "P3_P": "P3",
}

# Second part of a pack id -> mode label.
PACK_MODES = {"O": "5_O", "A": "4_A", "M": "3_M", "C": "2_C", "P": "1_P"}

# Day-part label, first hour, last hour (both inclusive).
SLOTS = (("lunch", 11, 15), ("snacks_dinner", 16, 22))
OTHER_SLOT = "latenight_breakfast"

# Cart value label, lower bound, upper bound (both inclusive,
# tested in order); above the last bound the label is OVER_BUCKET.
CART_BUCKETS = (
    ("a_0_100", 0, 100),
    ("b_100_200", 100, 200),
    ("c_200_300", 200, 300),
    ("d_300_400", 300, 400),
    ("e_400_500", 400, 500),
    ("f_500_700", 500, 700),
)
OVER_BUCKET = "700+"

# Discount labels, tested in order; no match gives OTHER_DISCOUNT.
DISCOUNT_RULES = (
    DiscountRule("Cashback", "coupon_offer", discount_type="FLAT_CASHBACK"),
    DiscountRule("BXGY", "coupon_offer", discount_type="BXGY"),
    DiscountRule("Percentage off", "coupon_offer", discount_type="PERCENTAGE"),
    DiscountRule("Flat Off", "coupon_offer", discount_type="FLAT"),
    DiscountRule("Cashback", "trade_offer", benefit_type="CASHBACK"),
    DiscountRule("Ex_Fee", "trade_offer", ("APPLIES_ON_EXPRESS_FEE",)),
    DiscountRule("Del_Fee", "trade_offer", ("APPLIES_ON_DELIVERY_FEE",)),
    DiscountRule("Wea_Fee", "trade_offer", ("APPLIES_ON_WEATHER_RAIN_FEE",)),
    DiscountRule("FREEBIE", "trade_offer", ("APPLIES_ON_CATALOG_ITEM",), "FREEBIE"),
    DiscountRule("FVO", "trade_offer", ("APPLIES_ON_CATALOG_ITEM",), "FINAL_PRICE"),
    DiscountRule("Packaging Fees", "trade_offer", ("APPLIES_ON_PACKAGING_FEE",), "PERCENTAGE"),
    DiscountRule("Percentage off TD", "trade_offer",
                 ("APPLIES_ON_CATALOG_ITEM", "APPLIES_ON_CART_BILL"), "PERCENTAGE"),
    DiscountRule("Flat TD", "trade_offer",
                 ("APPLIES_ON_CATALOG_ITEM", "APPLIES_ON_CART_BILL"), "FLAT"),
    DiscountRule("Anchor Price", "trade_offer", ("APPLIES_ON_CATALOG_ITEM",), "ANCHOR_PRICE"),
    DiscountRule("Bank Offer", "trade_offer", ("APPLIES_ON_CATALOG_ITEM",),
                 benefit_type="BANK_OFFER"),
)
OTHER_DISCOUNT = "other"


@dataclass(frozen=True)
class Vocabulary:
    tier_segments: tuple[tuple[str, str], ...] = tuple(TIER_SEGMENTS.items())
    tier_groups: tuple[tuple[str, str], ...] = tuple(TIER_GROUPS.items())
    override_segment: str = "S7"
    unclassified: str = "Unclassified"
    pack_modes: tuple[tuple[str, str], ...] = tuple(PACK_MODES.items())
    slots: tuple[tuple[str, int, int], ...] = SLOTS
    other_slot: str = OTHER_SLOT
    cart_buckets: tuple[tuple[str, int, int], ...] = CART_BUCKETS
    over_bucket: str = OVER_BUCKET
    discount_rules: tuple[DiscountRule, ...] = DISCOUNT_RULES
    other_discount: str = OTHER_DISCOUNT
    # Enum texts found in the source tables.
    active_status: str = "Growth_CAMPAIGN_STATUS_ACTIVE"
    test_store: str = "test"
    offer_tag: str = "NBH_OFFER"
    managed_source: str = "21"
    line_completed: str = "completed"
    order_completed: str = "Completed"
    excluded_city: str = "10000"
    placed_state: str = "PLACE_ORDER"
    # Output labels.
    managed: str = "Managed"
    unmanaged: str = "Unmanaged"
    default_variant: str = "control"
    repeat: str = "RTR"
    new: str = "NTR"

    def with_segment_suffix(self, suffix: str) -> Vocabulary:
        """Same vocabulary with ``suffix`` appended to the labels S1..S7."""
        return replace(
            self,
            tier_segments=tuple((tier, label + suffix) for tier, label in self.tier_segments),
            override_segment=self.override_segment + suffix,
        )


DEFAULT_VOCABULARY = Vocabulary()

"""Column expressions shared by the operators. All are built-in Spark functions."""

from promolens.functions.flags import is_unset
from promolens.functions.labels import (
    cart_value_bucket,
    offer_discount_type,
    pack_mode,
    pack_part,
    segment_label,
    slot_of,
    tier_group,
)
from promolens.functions.times import epoch_date, epoch_text

__all__ = [
    "cart_value_bucket",
    "epoch_date",
    "epoch_text",
    "is_unset",
    "offer_discount_type",
    "pack_mode",
    "pack_part",
    "segment_label",
    "slot_of",
    "tier_group",
]

"""The change logs, offer lines and orders as streams."""

from promolens.streaming.states import (
    drain,
    drain_rows,
    hourly_discounts,
    latest_state,
    lines_with_orders,
    newest_updates,
    order_sums,
)

__all__ = ["drain", "drain_rows", "hourly_discounts", "latest_state", "lines_with_orders",
           "newest_updates", "order_sums"]

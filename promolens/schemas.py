"""Schemas of the input frames, and of the rule engine's JSON document."""

from __future__ import annotations

from pyspark.sql import types as T

_TOLERANCE = "STRUCT<target_value: DOUBLE, lower_tolerance: DOUBLE, upper_tolerance: DOUBLE>"
_AMOUNT = "DECIMAL(18,4)"
_CART_AMOUNT = "DECIMAL(18,6)"

# Frame -> column -> type, as text Spark can cast to.
FRAMES: dict[str, dict[str, str]] = {
    "campaign_events": {
        "campaign_id": "STRING", "store_ids": "ARRAY<STRING>",
        "store_budget": "DOUBLE", "platform_budget": "DOUBLE",
        "store_tolerance": _TOLERANCE, "platform_tolerance": _TOLERANCE,
        "tagged_platform_tolerance": _TOLERANCE,
        "campaign_status": "STRING", "consent_status": "STRING",
        "smart_discount_enabled": "BOOLEAN", "updated_by": "STRING",
        "updated_at": "BIGINT", "created_at": "BIGINT", "start_time": "BIGINT",
        "end_time": "BIGINT", "dt": "DATE", "hr": "INT", "event_id": "BIGINT",
    },
    "store_events": {
        "store_id": "STRING", "status": "BOOLEAN", "updated_at": "BIGINT",
        "updated_by": "STRING", "event_id": "BIGINT",
    },
    "offer_events": {
        "offer_id": "BIGINT", "lock_flag": "STRING", "store_ids": "ARRAY<STRING>",
        "city_ids": "ARRAY<STRING>", "customer_ids": "ARRAY<STRING>",
        "service_fee_type": "INT", "tags": "ARRAY<STRUCT<value: STRING>>",
        "ingestion_source": "STRING", "dt": "DATE", "hr": "INT", "updated_at": "BIGINT",
        "server_ts": "BIGINT", "event_id": "BIGINT",
    },
    "assignments": {
        "campaign_id": "STRING", "run_date": "DATE", "run_ts": "TIMESTAMP",
        "variant": "STRING", "event_id": "BIGINT",
    },
    "campaign_state": {
        "campaign_id": "STRING", "run_date": "DATE", "run_ts": "TIMESTAMP",
        "prev_burn_state": "STRING", "campaign_context": "STRING", "event_id": "BIGINT",
    },
    "customer_tiers": {"customer_id": "BIGINT", "dt": "DATE", "tier": "STRING"},
    "segment_override": {"customer_id": "BIGINT", "segment": "STRING", "dt": "DATE"},
    "orders": {
        "dt": "DATE", "order_id": "BIGINT", "customer_id": "BIGINT", "store_id": "STRING",
        "gmv": "DECIMAL(14,2)", "excluded_flag": "INT", "ignore_flag": "INT",
        "post_status": "STRING",
    },
    "live_orders": {
        "dt": "DATE", "order_id": "BIGINT", "customer_id": "BIGINT",
        "gmv": "DECIMAL(14,2)", "excluded_flag": "INT",
    },
    "offer_lines": {
        "dt": "DATE", "hr": "INT", "order_id": "BIGINT", "store_id": "STRING",
        "offer_id": "BIGINT", "store_discount": _AMOUNT, "platform_discount": _AMOUNT,
        "order_status": "STRING", "city_code": "STRING", "offer_type": "STRING",
        "discount_type": "STRING", "benefit_type": "STRING", "applied": "STRING",
    },
    "carts": {
        "dt": "DATE", "cart_id": "BIGINT", "cart_state": "STRING", "customer_id": "BIGINT",
        "store_id": "STRING", "ts": "TIMESTAMP", "item_total": _CART_AMOUNT,
        "coupon_discount": _CART_AMOUNT, "item_store_discount": _CART_AMOUNT,
        "item_platform_discount": _CART_AMOUNT,
    },
}

# Ids that are numbers, or text in all frames alike.
ID_COLUMNS = frozenset({"cart_id", "order_id", "customer_id", "offer_id"})

# Integer columns that are 0/1/NULL flags, delivered as numbers or as text.
FLAG_COLUMNS = frozenset({"excluded_flag", "ignore_flag"})

# Field names of the rule engine's JSON document.
BURN_FIELDS = (
    "actual_cdgmv_pct",
    "agreed_cdgmv_pct",
    "cumulative_gmv",
    "cumulative_rdgmv",
    "cumulative_sdgmv",
    "lower_cdgmv_tol",
    "total_burn",
    "upper_cdgmv_tol",
)
SELECTION_FIELDS = ("emit_segment", "pack_id", "segment", "slot", "store_seg")

_SELECTION = T.StructType([T.StructField(name, T.StringType()) for name in SELECTION_FIELDS])
_STORE = T.StructType([
    T.StructField("store_id", T.StringType()),
    T.StructField("pack_selections", T.ArrayType(_SELECTION)),
])
CONTEXT = T.StructType([
    T.StructField("burn", T.StructType(
        [T.StructField(name, T.DoubleType()) for name in BURN_FIELDS])),
    T.StructField("stores", T.ArrayType(_STORE)),
])

"""The driver's generic tables as campaign, offer, order and cart frames.

Every table is used whole: attributes are derived from its columns and no row
is left out. ``oracle.py`` states the same bindings in SQL.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime, timedelta, timezone
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.params import ReportParams
from promolens.schemas import BURN_FIELDS
from promolens.session import configure
from promolens.sources import normalise

DAY = 86_400
FIRST_DAY = date(2024, 1, 1)
DAYS = 30

PARAMS = ReportParams(
    start=FIRST_DAY,
    end=FIRST_DAY + timedelta(days=DAYS - 1),
    as_of=datetime(2024, 1, 30, tzinfo=timezone.utc),
    month=FIRST_DAY,
    hour_cutoff=14,
    lookback_days=10,
    offer_since=FIRST_DAY,
    state_from=FIRST_DAY,
)
# The variant funnel looks back from the day after the last event, over all of them.
FUNNEL_PARAMS = ReportParams(
    start=PARAMS.start,
    end=PARAMS.end,
    as_of=datetime(2024, 1, 31, tzinfo=timezone.utc),
    month=FIRST_DAY,
    pack_window_days=DAYS,
    state_from=FIRST_DAY,
)
# Cuts that leave out a part of the tables.
LISTED_DATES = (date(2024, 1, 5), date(2024, 1, 20))
LISTED_PARAMS = replace(PARAMS, dates=LISTED_DATES)
WEEK_PARAMS = replace(FUNNEL_PARAMS, pack_window_days=7)
OFFERS_SINCE, OFFERS_UNTIL, OFFER_DAYS = date(2024, 1, 30), date(2024, 1, 15), 10


def table(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    stored = configure(spark, time_zone="UTC").read.parquet(f"{sf_dir}/{name}.parquet")
    if not stream:
        return stored
    return (spark.readStream.schema(stored.schema)
            .option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir))


def _events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    return (table(spark, sf_dir, "events", stream)
            .withColumn("k", F.from_json("props", "k INT").k)
            .withColumn("updated_at", F.unix_timestamp("ts"))
            .withColumn("dt", F.to_date("ts"))
            .withColumn("hr", F.hour("ts"))
            .withColumn("campaign_id", F.col("user_id").cast("string"))
            .withColumn("stores", F.expr(
                "transform(slice(array(0, 7, 14), 1, k % 4), "
                "i -> cast((user_id + i) % 100 as string))")))


def _tolerance(target: float, lower: float, upper: float) -> str:
    return (f"struct(value * {target}D as target_value, value * {lower}D as lower_tolerance, "
            f"value * {upper}D as upper_tolerance)")


def campaign_events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    return normalise(_events(spark, sf_dir, stream=stream), "campaign_events", {
        "store_ids": "case when k = 50 then null "
                     "when k % 25 = 13 then concat(array('test'), stores) else stores end",
        "store_budget": "value * 8",
        "platform_budget": "value * 4",
        "store_tolerance": _tolerance(0.5, 0.25, 1.0),
        "platform_tolerance": _tolerance(0.25, 0.125, 0.5),
        "tagged_platform_tolerance": _tolerance(0.125, 0.0625, 0.25),
        "campaign_status": "if(event_type = 'error', 'Growth_CAMPAIGN_STATUS_PAUSED', "
                           "'Growth_CAMPAIGN_STATUS_ACTIVE')",
        "consent_status": "if(k % 2 = 0, 'Growth_CAMPAIGN_CONSENT_STATUS_APPROVED', "
                          "'Growth_CAMPAIGN_CONSENT_STATUS_PENDING')",
        "smart_discount_enabled": "event_id % 3 <> 0",
        "updated_by": "concat('user_', k)",
        "created_at": f"updated_at - 3 * {DAY}",
        "start_time": f"updated_at - (k % 5) * {DAY}",
        "end_time": f"updated_at + (k % 11) * {DAY}",
    })


def store_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(_events(spark, sf_dir), "store_events", {
        "store_id": "event_id % 150",
        "status": "event_type in ('view', 'signup', 'purchase')",
        "updated_by": "user_id",
    })


def offer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(_events(spark, sf_dir), "offer_events", {
        "offer_id": "event_id % 200",
        "lock_flag": "case event_type when 'click' then 'true' when 'view' then 'TRUE' "
                     "when 'error' then 'false' when 'signup' then '' end",
        "store_ids": "if(k % 9 = 0, null, stores)",
        "city_ids": "case k % 3 when 0 then null when 1 then array() else array('10') end",
        "customer_ids": "case k % 5 when 0 then null when 4 then array('7') else array() end",
        "service_fee_type": "if(k % 7 = 0, null, k % 2)",
        "tags": "case k % 6 when 0 then null when 1 then array() "
                "when 2 then array(named_struct('value', 'NBH_OFFER')) "
                "when 3 then array(named_struct('value', 'OTHER'), "
                "named_struct('value', 'NBH_OFFER')) "
                "else array(named_struct('value', 'OTHER')) end",
        "ingestion_source": "if(k % 3 = 0, 21, 7)",
        "server_ts": "updated_at - (k % 4) * 3600",
    })


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(_events(spark, sf_dir), "assignments", {
        "run_date": "dt",
        "run_ts": "ts",
        "variant": "case event_type when 'click' then 'variant_a' when 'view' then 'variant_b' "
                   "when 'purchase' then 'control' else 'variant_c' end",
    })


def _selection(j: int) -> Column:
    """The ``j``-th pack selection of a run; some pack ids have no ``_`` part."""
    fields = {
        "emit_segment": f"'E{j % 2}'",
        "pack_id": f"concat('T', k % 3 + 1, elt((k + {j}) % 7 + 1, "
                   "'_O', '_A', '_M', '_C', '_P', '_Z', ''))",
        "segment": f"elt((event_id + {j}) % 8 + 1, 'S1', 'S2', 'S3', 'S4', 'S5', 'S6', 'S7', "
                   "'Unclassified')",
        "slot": f"elt({j % 3} + 1, 'lunch', 'snacks_dinner', 'latenight_breakfast')",
        "store_seg": f"elt((k + {j}) % 2 + 1, 'RTR', 'NTR')",
    }
    return F.struct(*[F.expr(text).alias(name) for name, text in fields.items()])


def campaign_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log whose JSON text lists six pack selections for each store of a run.

    Error events have no document, and k = 99 gives a malformed one.
    """
    burn = F.struct(*[(F.col("value") * (i + 1)).alias(name)
                      for i, name in enumerate(BURN_FIELDS)])
    selections = F.array(*[_selection(j) for j in range(6)])
    stores = F.transform("stores", lambda store: F.struct(
        store.alias("store_id"), selections.alias("pack_selections")))
    # Never NULL, so testing the text for NULL does not need to build it.
    document = F.coalesce(F.to_json(F.struct(burn.alias("burn"), stores.alias("stores"))),
                          F.lit(""))
    text = (F.when(F.col("event_type") == "error", F.lit(None))
            .when(F.col("k") == 99, F.lit("{bad"))
            .otherwise(document))
    events = _events(spark, sf_dir).withColumn("campaign_context", text)
    return normalise(events, "campaign_state", {
        "run_date": "dt",
        "run_ts": "ts",
        "prev_burn_state": "concat('STATE_', k % 3)",
    })


def customer_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(table(spark, sf_dir, "customer"), "customer_tiers", {
        "customer_id": "c_custkey",
        "dt": "if(c_nationkey < 3, date'2023-12-01', date'2024-01-01')",
        "tier": "elt((c_nationkey + length(c_mktsegment)) % 10 + 1, 'P1A', 'P1B', 'P1C', 'P1D', "
                "'P1_P', 'P2', 'P2_P', 'P3', 'P3_P', 'NEW')",
    })


def segment_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(table(spark, sf_dir, "customer"), "segment_override", {
        "customer_id": "c_custkey",
        "segment": "if(c_acctbal < 500, 'S7', 'S0')",
        "dt": "if(c_nationkey < 20, date'2024-01-15', date'2024-01-10')",
    })


def _day(key: str) -> str:
    return f"date_add(date'{FIRST_DAY}', cast({key} div 2 % {DAYS} as int))"


def _store(key: str) -> str:
    return f"{key} div {2 * DAYS} % 100"


def orders(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    return normalise(table(spark, sf_dir, "orders", stream), "orders", {
        "dt": _day("o_orderkey"),
        "order_id": "o_orderkey",
        "customer_id": "o_custkey",
        "store_id": _store("o_orderkey"),
        "gmv": "o_totalprice",
        "excluded_flag": "case o_orderpriority when '1-URGENT' then '1' when '5-LOW' then null "
                         "else '0' end",
        "ignore_flag": "case when o_orderkey % 11 = 0 then 1 when o_orderkey % 13 = 0 then null "
                       "else 0 end",
        "post_status": "if(o_orderstatus = 'P', 'Cancelled', 'Completed')",
    })


def offer_lines(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    amount = "cast(l_extendedprice as decimal(12,2)) * cast(l_discount as decimal(4,2))"
    return normalise(table(spark, sf_dir, "lineitem", stream), "offer_lines", {
        "dt": _day("l_orderkey"),
        "hr": "cast(l_partkey % 24 as string)",
        "order_id": "l_orderkey",
        "store_id": _store("l_orderkey"),
        "offer_id": "if(l_linenumber = 7, null, l_partkey % 200)",
        "store_discount": f"if(l_linestatus = 'O' or l_tax > 0.06, {amount}, null)",
        "platform_discount": f"if(l_linestatus = 'F', {amount}, null)",
        "order_status": "if(l_returnflag = 'R', 'cancelled', 'completed')",
        "city_code": "case l_suppkey % 10 when 0 then '10000' when 1 then null "
                     "else cast(l_suppkey % 10 as string) end",
        "offer_type": "case when l_quantity <= 20 then 'coupon_offer' "
                      "when l_quantity <= 45 then 'trade_offer' else 'flash_offer' end",
        "discount_type": "elt(l_partkey % 8 + 1, 'FLAT_CASHBACK', 'BXGY', 'PERCENTAGE', 'FLAT', "
                         "'FREEBIE', 'FINAL_PRICE', 'ANCHOR_PRICE', null)",
        "benefit_type": "elt(l_suppkey % 5 + 1, 'CASHBACK', 'BANK_OFFER', 'DISCOUNT', "
                        "'DISCOUNT', null)",
        "applied": "elt(l_linenumber, 'APPLIES_ON_EXPRESS_FEE', 'APPLIES_ON_DELIVERY_FEE', "
                   "'APPLIES_ON_WEATHER_RAIN_FEE', 'APPLIES_ON_CATALOG_ITEM', "
                   "'APPLIES_ON_PACKAGING_FEE', 'APPLIES_ON_CART_BILL', "
                   "'APPLIES_ON_CATALOG_ITEM')",
    })


def carts(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = "cast(o_totalprice as decimal(14,2))"
    return normalise(table(spark, sf_dir, "orders"), "carts", {
        "dt": _day("o_orderkey"),
        "cart_id": "o_orderkey div 2",
        "cart_state": "if(o_orderstatus = 'F', 'PLACE_ORDER', 'CART_UPDATED')",
        "customer_id": "o_custkey",
        "store_id": _store("o_orderkey"),
        "ts": f"timestampadd(hour, cast(o_orderkey % 24 as int), {_day('o_orderkey')})",
        "item_total": f"{price} * 0.002",
        "coupon_discount": "case when o_orderpriority in ('1-URGENT', '2-HIGH') "
                           f"then {price} * 0.0002 when o_orderpriority = '5-LOW' then null "
                           "else 0 end",
        "item_store_discount": f"if(o_custkey % 4 = 0, {price} * 0.0001, 0)",
        "item_platform_discount": f"case when o_custkey % 7 = 0 then null "
                                  f"when o_custkey % 4 = 1 then {price} * 0.0002 else 0 end",
    })


class BoundFrames:
    """The frames over one table folder, each bound when a query first asks for it."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._source = (spark, sf_dir)

    campaign_events = cached_property(lambda self: campaign_events(*self._source))
    store_events = cached_property(lambda self: store_events(*self._source))
    offer_events = cached_property(lambda self: offer_events(*self._source))
    assignments = cached_property(lambda self: assignments(*self._source))
    campaign_state = cached_property(lambda self: campaign_state(*self._source))
    customer_tiers = cached_property(lambda self: customer_tiers(*self._source))
    segment_override = cached_property(lambda self: segment_override(*self._source))
    orders = cached_property(lambda self: orders(*self._source))
    live_orders = cached_property(
        lambda self: self.orders.drop("store_id", "ignore_flag", "post_status"))
    offer_lines = cached_property(lambda self: offer_lines(*self._source))
    carts = cached_property(lambda self: carts(*self._source))

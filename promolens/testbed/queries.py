"""Registered queries: one per operator and report, each over the whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens import plans
from promolens.functions import (
    cart_value_bucket,
    epoch_date,
    epoch_text,
    offer_discount_type,
    pack_mode,
    pack_part,
    slot_of,
    tier_group,
)
from promolens.operators import campaigns, carts, offers, orders, packs, rollup, segments
from promolens.operators.cart_sets import cart_set_counts, cart_sets, number_carts, stored_cart_numbers
from promolens.operators.cdc import date_spine, latest_per_key
from promolens.operators.experiments import distinct_variants, latest_variant
from promolens.operators.validity import stored_versions
from promolens.plans.discounts import month_segments, with_offer_mark
from promolens.plans.efficiency import slot_metrics
from promolens.plans.funnels import labelled_carts
from promolens.session import use_shared_checkpoints
from promolens.sources import publish_view, write_bucketed_mapping, write_pack_mapping
from promolens.streaming import (
    drain,
    drain_rows,
    hourly_discounts,
    latest_state,
    lines_with_orders,
    newest_updates,
    order_sums,
)
from promolens.testbed.bindings import (
    FUNNEL_PARAMS,
    LISTED_PARAMS,
    OFFER_DAYS,
    OFFERS_SINCE,
    OFFERS_UNTIL,
    PARAMS,
    WEEK_PARAMS,
    BoundFrames,
    campaign_events,
    offer_lines,
)
from promolens.testbed.bindings import orders as order_facts
from promolens.vocabulary import DEFAULT_VOCABULARY

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FILES_PER_DATE = 8
MANAGED_KINDS = ["managed_flag", "discount_label"]


def _register(build: Callable[[BoundFrames], DataFrame]) -> Callable[[BoundFrames], DataFrame]:
    """Register under the function's name; a trailing underscore avoids imported names."""
    name = build.__name__.removesuffix("_")
    QUERIES[name] = lambda spark, sf_dir: build(BoundFrames(spark, sf_dir))
    return build


def _joined_list(array: str) -> F.Column:
    """An array as one text, as result hashes do not take arrays."""
    return F.array_join(array, ",", "null")


def _spine(f: BoundFrames) -> DataFrame:
    return date_spine(f.live_orders, start=PARAMS.start, end=PARAMS.end)


def _lines(f: BoundFrames) -> DataFrame:
    return orders.eligible_lines(f.offer_lines, PARAMS.start, PARAMS.end)


def _orders(f: BoundFrames) -> DataFrame:
    return orders.eligible_orders(f.orders, PARAMS.start, PARAMS.end)


def _measures(f: BoundFrames) -> DataFrame:
    grain = orders.order_discount_grain(_lines(f), _orders(f))
    return orders.order_measures(grain, ["dt", "store_id", "customer_id"])


def _kinds(lines: DataFrame, f: BoundFrames) -> DataFrame:
    flags = offers.offer_managed_flag(f.offer_events, PARAMS.end, PARAMS.offer_window_days)
    managed = flags.where(F.col("managed_flag") == DEFAULT_VOCABULARY.managed)
    return (with_offer_mark(lines, managed, "_managed")
            .withColumn("managed_flag", F.when(F.col("_managed"), "Managed")
                        .otherwise("Unmanaged"))
            .withColumn("discount_label", offer_discount_type(
                F.col("offer_type"), F.col("applied"), F.col("discount_type"),
                F.col("benefit_type"))))


# Scans, projections, scalar functions

@_register
def struct_field_projection(f: BoundFrames) -> DataFrame:
    return f.campaign_events.select(
        "event_id", *campaigns.target_columns(("store", "platform", "tagged_platform")))


@_register
def epoch_columns(f: BoundFrames) -> DataFrame:
    seconds = ("updated_at", "created_at", "start_time", "end_time")
    return f.campaign_events.select(
        "event_id", *[epoch_text(F.col(c)).alias(f"{c}_text") for c in seconds],
        *[epoch_date(F.col(c)).alias(f"{c}_date") for c in seconds])


@_register
def slot_bucket(f: BoundFrames) -> DataFrame:
    return (f.offer_lines.groupBy("hr", slot_of(F.col("hr")).alias("slot"))
            .agg(F.count(F.lit(1)).alias("lines")))


@_register
def cart_value_bucket_(f: BoundFrames) -> DataFrame:
    return f.carts.select("cart_id", "customer_id", F.col("item_total").cast("double"),
                          cart_value_bucket(F.col("item_total")).alias("cart_bucket"))


@_register
def pack_tier_mode(f: BoundFrames) -> DataFrame:
    pack = F.col("pack_id")
    return (packs.explode_context(f.campaign_state)
            .groupBy("pack_id", pack_part(pack, 0).alias("tier"), pack_mode(pack).alias("mode"))
            .agg(F.count(F.lit(1)).alias("selections")))


@_register
def tier_group_(f: BoundFrames) -> DataFrame:
    return f.customer_tiers.select("customer_id", "tier",
                                   tier_group(F.col("tier")).alias("tier_group"))


@_register
def offer_discount_type_(f: BoundFrames) -> DataFrame:
    parts = ["offer_type", "applied", "discount_type", "benefit_type"]
    return (f.offer_lines
            .groupBy(*parts, offer_discount_type(*map(F.col, parts)).alias("discount_label"))
            .agg(F.count(F.lit(1)).alias("lines")))


@_register
def json_context_explode(f: BoundFrames) -> DataFrame:
    return packs.explode_context(f.campaign_state).drop("run_ts")


@_register
def order_eligibility_filter(f: BoundFrames) -> DataFrame:
    kept = orders.eligible_orders(f.orders, PARAMS.start, PARAMS.end, completed_only=True)
    return kept.select("dt", "order_id", "customer_id", "store_id", "excluded_flag")


@_register
def line_eligibility_filter(f: BoundFrames) -> DataFrame:
    kept = orders.eligible_lines(f.offer_lines, PARAMS.start, PARAMS.end,
                                 hour_cutoff=PARAMS.hour_cutoff)
    return (kept.groupBy("dt", "hr", "city_code")
            .agg(F.count(F.lit(1)).alias("lines"),
                 F.sum("store_discount").cast("double").alias("store_discount")))


@_register
def group_by_all(f: BoundFrames) -> DataFrame:
    return f.offer_lines.sparkSession.sql(
        "SELECT dt, store_id, hr, count(*) AS lines, count(DISTINCT order_id) AS orders, "
        "cast(sum(platform_discount) AS double) AS platform_discount FROM {lines} GROUP BY ALL",
        lines=f.offer_lines)


@_register
def group_by_all_distinct(f: BoundFrames) -> DataFrame:
    return (f.campaign_events.select("campaign_id", "store_ids", "campaign_status").distinct()
            .withColumn("store_ids", _joined_list("store_ids")))


# Change logs, campaigns, stores

@_register
def date_spine_(f: BoundFrames) -> DataFrame:
    return _spine(f)


@_register
def latest_per_key_(f: BoundFrames) -> DataFrame:
    newest = latest_per_key(f.campaign_events, ["campaign_id"],
                            ["dt", "hr", "updated_at", "event_id"])
    return newest.select("campaign_id", "event_id", "dt", "hr", "updated_at", "campaign_status")


@_register
def latest_per_key_explode(f: BoundFrames) -> DataFrame:
    newest = latest_per_key(f.campaign_events, ["campaign_id"], ["updated_at", "event_id"])
    return newest.select("campaign_id", "event_id",
                         F.array_size("store_ids").alias("store_count"),
                         F.explode_outer("store_ids").alias("store_id"))


@_register
def campaign_asof_snapshot(f: BoundFrames) -> DataFrame:
    return (campaigns.campaign_snapshot(f.campaign_events, _spine(f))
            .select("as_of_dt", "campaign_id", "event_id", "updated_dt"))


@_register
def active_campaigns_now(f: BoundFrames) -> DataFrame:
    return (campaigns.active_campaigns_now(f.campaign_events, PARAMS.as_of)
            .select("campaign_id", "store_id", "updated_at"))


@_register
def active_campaigns_asof(f: BoundFrames) -> DataFrame:
    return campaigns.stores_asof(f.campaign_events, _spine(f))


@_register
def whitelisted_now(f: BoundFrames) -> DataFrame:
    return campaigns.whitelisted_stores(f.store_events)


@_register
def whitelisted_no_active(f: BoundFrames) -> DataFrame:
    live = campaigns.live_stores(f.campaign_events, PARAMS.as_of)
    return campaigns.whitelisted_without_campaign(f.store_events, live).select("store_id")


@_register
def whitelisted_not_in_strict(f: BoundFrames) -> DataFrame:
    live = campaigns.live_stores(f.campaign_events, PARAMS.as_of)
    return (campaigns.whitelisted_without_campaign(
        f.store_events, live.where(F.col("store_id").isNotNull()), strict=True)
        .select("store_id", "updated_at"))


# Segments, variants, offers, packs

@_register
def latest_override_customers(f: BoundFrames) -> DataFrame:
    return segments.override_customers(f.segment_override)


@_register
def customer_segments(f: BoundFrames) -> DataFrame:
    return month_segments(f, PARAMS, DEFAULT_VOCABULARY)


@_register
def month_segment_join(f: BoundFrames) -> DataFrame:
    labelled = segments.with_month_segment(f.orders, segments.customer_segments(f.customer_tiers))
    return labelled.select("order_id", "dt", "customer_segment")


@_register
def latest_variant_(f: BoundFrames) -> DataFrame:
    return latest_variant(f.assignments).withColumn("run_ts", F.unix_micros("run_ts"))


@_register
def distinct_variants_(f: BoundFrames) -> DataFrame:
    return distinct_variants(f.assignments)


@_register
def offer_lock_meta(f: BoundFrames) -> DataFrame:
    return offers.offer_lock_meta(f.offer_events, PARAMS.offer_since)


@_register
def offer_managed_flag(f: BoundFrames) -> DataFrame:
    return offers.offer_managed_flag(f.offer_events, PARAMS.end, PARAMS.offer_window_days)


@_register
def pack_mapping_latest(f: BoundFrames) -> DataFrame:
    mapping = packs.pack_mapping(f.campaign_state, PARAMS.state_from)
    return mapping.drop("variant").withColumn("run_ts", F.unix_micros("run_ts"))


@_register
def pack_mapping_variant(f: BoundFrames) -> DataFrame:
    mapping = packs.pack_mapping(f.campaign_state, PARAMS.state_from,
                                 latest_variant(f.assignments))
    return mapping.select("campaign_id", "run_date", "variant", "store_id", *packs.PACK_KEYS[3:],
                          F.unix_micros("run_ts").alias("run_ts"))


# Orders

@_register
def order_discount_grain(f: BoundFrames) -> DataFrame:
    return orders.money_as_double(orders.order_discount_grain(_lines(f), _orders(f)))


@_register
def store_customer_metrics(f: BoundFrames) -> DataFrame:
    grain = orders.order_discount_grain(_lines(f), _orders(f))
    return orders.money_as_double(orders.store_customer_metrics(grain))


@_register
def segment_metrics(f: BoundFrames) -> DataFrame:
    return orders.money_as_double(rollup.segment_rollup(
        _measures(f), segments.customer_segments(f.customer_tiers, PARAMS.month)))


@_register
def tagged_discount_metrics(f: BoundFrames) -> DataFrame:
    meta = offers.offer_lock_meta(f.offer_events, PARAMS.offer_since)
    lines = with_offer_mark(_lines(f), meta.where(F.col("is_tagged") == 1), "_tagged",
                            default_offer=0)
    grain = orders.order_discount_grain(
        lines.withColumn("is_tagged", F.col("_tagged").cast("int")), _orders(f), tagged=True)
    return orders.money_as_double(orders.store_customer_metrics(grain, ["dt", "store_id"]))


@_register
def offer_type_metrics(f: BoundFrames) -> DataFrame:
    grain = orders.order_discount_grain(_kinds(_lines(f), f), _orders(f), MANAGED_KINDS,
                                        ["customer_id"])
    return orders.money_as_double(
        orders.store_customer_metrics(grain, ["dt", "store_id", *MANAGED_KINDS]))


@_register
def variant_metrics(f: BoundFrames) -> DataFrame:
    exposures = rollup.store_exposures(campaigns.stores_asof(f.campaign_events, _spine(f)),
                                       latest_variant(f.assignments))
    return orders.money_as_double(orders.sum_measures(
        rollup.expose(_measures(f), exposures), ["dt", "variant"]))


@_register
def efficiency_slot(f: BoundFrames) -> DataFrame:
    return orders.money_as_double(slot_metrics(f, PARAMS))


# Carts

@_register
def cart_grain(f: BoundFrames) -> DataFrame:
    return orders.money_as_double(carts.cart_grain(f.carts, PARAMS.start, PARAMS.end))


@_register
def cart_repeat_flag(f: BoundFrames) -> DataFrame:
    return labelled_carts(f, PARAMS).select("dt", "cart_id", "repeat_flag").distinct()


@_register
def cart_funnel_full(f: BoundFrames) -> DataFrame:
    mapping = packs.pack_mapping(f.campaign_state, PARAMS.state_from)
    return orders.money_as_double(carts.cart_funnel(labelled_carts(f, PARAMS),
                                                    carts.pack_multiplicity(mapping)))


@_register
def cart_funnel_variant(f: BoundFrames) -> DataFrame:
    labels = segments.customer_segments(f.customer_tiers, PARAMS.month)
    return carts.cart_counts(segments.with_segment(f.carts, labels))


# Cuts that leave out a part of the tables

@_register
def whitelisted_not_in_lists(f: BoundFrames) -> DataFrame:
    """How many stores pass a strict NOT IN over the unfiltered list, its known stores, and none."""
    live = campaigns.live_stores(f.campaign_events, PARAMS.as_of)
    lists = {"as it is": live, "known stores": live.where(F.col("store_id").isNotNull()),
             "empty": live.where(F.col("store_id") == "none")}
    counts = [campaigns.whitelisted_without_campaign(f.store_events, listed, strict=True)
              .agg(F.count(F.lit(1)).alias("stores")).select(F.lit(name).alias("list"), "stores")
              for name, listed in lists.items()]
    return reduce(DataFrame.unionByName, counts)


@_register
def offer_lock_meta_since(f: BoundFrames) -> DataFrame:
    return offers.offer_lock_meta(f.offer_events, OFFERS_SINCE)


@_register
def offer_managed_flag_recent(f: BoundFrames) -> DataFrame:
    return offers.offer_managed_flag(f.offer_events, OFFERS_UNTIL, OFFER_DAYS)


@_register
def report_intraday_listed_dates(f: BoundFrames) -> DataFrame:
    return plans.intraday_segment_variant(f, LISTED_PARAMS)


@_register
def report_cart_funnel_week(f: BoundFrames) -> DataFrame:
    return plans.cart_funnel_by_variant(f, WEEK_PARAMS)


# Reports over a stored mapping

def _stored_mapping(spark: SparkSession, f: BoundFrames) -> DataFrame:
    """The pack mapping written once and read back, as reports share it."""
    path = f"{_scratch(spark)}/mapping"
    mapping = packs.pack_mapping(f.campaign_state, PARAMS.state_from, files_per_date=FILES_PER_DATE)
    write_pack_mapping(mapping, path=path, files_per_date=FILES_PER_DATE, dealt=True)
    return spark.read.parquet(path)


def pack_mapping_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = _stored_mapping(spark, BoundFrames(spark, sf_dir))
    return mapping.drop("variant").withColumn("run_ts", F.unix_micros("run_ts"))


def _bucketed_mapping(spark: SparkSession, f: BoundFrames) -> DataFrame:
    """The pack mapping as a bucketed table whose files lie in the scratch folder."""
    name = f"pack_mapping_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_bucketed_mapping(
        packs.pack_mapping(f.campaign_state, PARAMS.state_from, buckets=buckets), name, buckets,
        f"{_scratch(spark)}/mapping", dealt=True)
    return spark.table(name)


def report_cart_funnel_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = BoundFrames(spark, sf_dir)
    return plans.cart_funnel_by_pack(f, PARAMS, mapping=_bucketed_mapping(spark, f), bucketed=True)


def report_efficiency_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = BoundFrames(spark, sf_dir)
    return plans.efficiency(f, PARAMS, mapping=_bucketed_mapping(spark, f))


def published_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs per day and segment, asked of a published view in SQL."""
    name = f"packs_{uuid.uuid4().hex}"
    publish_view(packs.pack_mapping(BoundFrames(spark, sf_dir).campaign_state, PARAMS.state_from), name)
    return spark.sql(f"SELECT run_date, segment, count(*) AS packs FROM {name} GROUP BY ALL")


def json_context_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log's documents from their stored, parsed form."""
    path = f"{_scratch(spark)}/runs"
    packs.parsed_runs(BoundFrames(spark, sf_dir).campaign_state).write.parquet(path)
    return packs.explode_context(spark.read.parquet(path)).drop("run_ts")


def _campaign_versions(spark: SparkSession, f: BoundFrames) -> DataFrame:
    """Validity intervals of the campaign log, which arrives in three parts."""
    path = f"{_scratch(spark)}/versions"
    third = F.when(F.col("dt") < "2024-01-11", 0).when(F.col("dt") < "2024-01-21", 1).otherwise(2)
    for part in range(3):
        campaigns.merge_campaign_versions(spark, path, f.campaign_events.where(third == part))
    return stored_versions(spark, path)


def campaign_asof_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = BoundFrames(spark, sf_dir)
    return campaigns.campaign_snapshot(None, _spine(f), _campaign_versions(spark, f)).select(
        "as_of_dt", "campaign_id", "event_id", "updated_dt")


def report_active_by_day_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = BoundFrames(spark, sf_dir)
    report = plans.active_by_day(f, PARAMS, versions=_campaign_versions(spark, f))
    return report.withColumn("store_ids", _joined_list("store_ids"))


def weekly_cart_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct carts per week and store from stored daily sets, which arrive in two parts."""
    f, folder = BoundFrames(spark, sf_dir), _scratch(spark)
    early = F.col("dt") < "2024-01-18"
    for part in (early, ~early):
        some = f.carts.where(part)
        number_carts(some, f"{folder}/numbers")
        cart_sets(some, stored_cart_numbers(spark, f"{folder}/numbers"), ["dt", "store_id"]).write.mode(
            "append").parquet(f"{folder}/sets")
    sets = spark.read.parquet(f"{folder}/sets")
    week = sets.withColumn("week", F.date_trunc("week", "dt").cast("date"))
    return cart_set_counts(week, ["week", "store_id"])


for _query in (weekly_cart_counts, pack_mapping_stored, report_cart_funnel_stored, report_efficiency_stored,
               published_view, json_context_stored, campaign_asof_versions,
               report_active_by_day_stored):
    QUERIES[_query.__name__] = _query


# Streams

def _scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    use_shared_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def stream_latest_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _scratch(spark)
    log = campaign_events(spark, sf_dir, stream=True).select(
        "campaign_id", "event_id", "dt", "hr", "updated_at", "campaign_status")
    drain(latest_state(log, ["campaign_id"], ["dt", "hr", "updated_at", "event_id"]), folder,
          ["campaign_id"])
    return newest_updates(spark, folder, ["campaign_id"])


def stream_hourly_discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delay spans all dates of the table, so no line comes too late."""
    folder = _scratch(spark)
    lines = orders.eligible_lines(offer_lines(spark, sf_dir, stream=True), PARAMS.start,
                                  PARAMS.end)
    keys = ["dt", "hr", "store_id"]
    drain(hourly_discounts(lines, "60 days"), folder, keys)
    return orders.money_as_double(newest_updates(spark, folder, keys))


def stream_order_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and orders meet as streams, then sum up per order as a second stream."""
    folder = _scratch(spark)
    lines = orders.eligible_lines(offer_lines(spark, sf_dir, stream=True), PARAMS.start, PARAMS.end)
    placed = orders.eligible_orders(order_facts(spark, sf_dir, stream=True), PARAMS.start, PARAMS.end)
    drain_rows(lines_with_orders(lines, placed, "60 days"), f"{folder}/pairs")
    stored = f"{folder}/pairs/rows"
    pairs = spark.readStream.schema(spark.read.parquet(stored).schema).parquet(stored)
    keys = ["dt", "order_id", "store_id", "gmv", "customer_id"]
    drain(order_sums(pairs, "121 days"), f"{folder}/grain", keys)
    return orders.money_as_double(newest_updates(spark, f"{folder}/grain", keys))


QUERIES["stream_order_grain"] = stream_order_grain
QUERIES["stream_latest_campaigns"] = stream_latest_campaigns
QUERIES["stream_hourly_discounts"] = stream_hourly_discounts


# Reports

@_register
def report_active_by_day(f: BoundFrames) -> DataFrame:
    return plans.active_by_day(f, PARAMS).withColumn("store_ids", _joined_list("store_ids"))


@_register
def report_intraday_segment_variant(f: BoundFrames) -> DataFrame:
    return plans.intraday_segment_variant(f, PARAMS)


@_register
def report_active_now(f: BoundFrames) -> DataFrame:
    return plans.active_now(f, PARAMS).withColumn("store_ids", _joined_list("store_ids"))


@_register
def report_whitelisted(f: BoundFrames) -> DataFrame:
    return plans.whitelisted_now(f)


@_register
def report_cart_funnel_full(f: BoundFrames) -> DataFrame:
    return plans.cart_funnel_by_pack(f, PARAMS)


@_register
def report_cart_funnel_variant(f: BoundFrames) -> DataFrame:
    return plans.cart_funnel_by_variant(f, FUNNEL_PARAMS)


@_register
def report_efficiency_variant(f: BoundFrames) -> DataFrame:
    return plans.efficiency_by_variant(f, PARAMS)


@_register
def report_efficiency(f: BoundFrames) -> DataFrame:
    return plans.efficiency(f, PARAMS)


@_register
def report_managed_vs_unmanaged(f: BoundFrames) -> DataFrame:
    return plans.managed_vs_unmanaged(f, PARAMS)


@_register
def report_whitelisted_no_campaign(f: BoundFrames) -> DataFrame:
    return plans.whitelisted_without_live_campaign(f, PARAMS)


@_register
def report_overall_segment(f: BoundFrames) -> DataFrame:
    return plans.overall_segment(f, PARAMS)

"""Campaign and store lists from their change logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.functions import epoch_date, epoch_text
from promolens.operators.cdc import asof_snapshot, latest_per_key
from promolens.operators.validity import asof_versions, merge_versions
from promolens.vocabulary import DEFAULT_VOCABULARY, Vocabulary

_TARGETS = {
    "store": "store_tolerance",
    "platform": "platform_tolerance",
    "tagged_platform": "tagged_platform_tolerance",
}
_TOLERANCE_PARTS = {"value": "target_value", "lower": "lower_tolerance", "upper": "upper_tolerance"}


def target_columns(prefixes: tuple[str, ...] = ("store", "platform")) -> list[Column]:
    """The tolerance structs as flat ``<prefix>_target_<part>`` columns."""
    return [F.col(f"{_TARGETS[prefix]}.{field}").alias(f"{prefix}_target_{part}")
            for part, field in _TOLERANCE_PARTS.items() for prefix in prefixes]


def running(vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    return (F.col("campaign_status") == vocab.active_status) & F.col("smart_discount_enabled")


def live_campaigns(log: DataFrame, as_of: datetime,
                   vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Newest version of each campaign, if it is running and ``as_of`` is in its window."""
    now = F.lit(as_of)
    return latest_per_key(log, ["campaign_id"], ["dt", "hr", "updated_at", "event_id"]).where(
        (F.timestamp_seconds("start_time") <= now)
        & (F.timestamp_seconds("end_time") >= now)
        & running(vocab))


def active_campaigns_now(log: DataFrame, as_of: datetime,
                         vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """One row per live campaign and store; a campaign without stores keeps a NULL store."""
    return (live_campaigns(log, as_of, vocab)
            .withColumn("store_id", F.explode_outer("store_ids"))
            .select("campaign_id", "store_id", "store_ids", "store_budget", "platform_budget",
                    "smart_discount_enabled", "updated_by",
                    epoch_text(F.col("updated_at")).alias("updated_at"),
                    epoch_date(F.col("updated_at")).alias("updated_dt"),
                    epoch_date(F.col("created_at")).alias("created_dt"),
                    epoch_date(F.col("start_time")).alias("start_dt"),
                    epoch_date(F.col("end_time")).alias("end_dt"),
                    *target_columns(("store", "platform", "tagged_platform"))))


def live_stores(log: DataFrame, as_of: datetime,
                vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Distinct stores of live campaigns, NULL included if a campaign lists no store."""
    return (live_campaigns(log, as_of, vocab)
            .select(F.explode_outer("store_ids").alias("store_id"))
            .distinct())


def merge_campaign_versions(spark: SparkSession, path: str, log: DataFrame, buckets: int = 64) -> None:
    """Bring the stored campaign versions up to date with new log rows."""
    merge_versions(spark, path, log.withColumn("updated_dt", epoch_date(F.col("updated_at"))),
                   ["campaign_id"], "updated_dt", ["updated_at", "event_id"], buckets)


def campaign_snapshot(log: DataFrame | None, spine: DataFrame,
                      versions: DataFrame | None = None) -> DataFrame:
    """Newest campaign version on each spine date, by update time.

    From the log, or from the ``versions`` that ``merge_campaign_versions`` stored.
    """
    if versions is not None:
        return asof_versions(versions, spine, "updated_dt")
    dated = log.withColumn("updated_dt", epoch_date(F.col("updated_at")))
    return asof_snapshot(dated, spine, ["campaign_id"], "updated_dt", ["updated_at", "event_id"])


def _running_snapshot(log: DataFrame | None, spine: DataFrame, vocab: Vocabulary,
                      versions: DataFrame | None = None) -> DataFrame:
    """Running campaigns per spine date, without test stores.

    Status only: the start and end times are not looked at here. The first
    store decides whether a list is a test list, and an empty list is dropped.
    """
    return campaign_snapshot(log, spine, versions).where(
        running(vocab) & (F.get("store_ids", F.lit(0)) != vocab.test_store))


def active_campaigns_asof(log: DataFrame | None, spine: DataFrame,
                          vocab: Vocabulary = DEFAULT_VOCABULARY,
                          versions: DataFrame | None = None) -> DataFrame:
    """Distinct (date, campaign, store) rows with the campaign's attributes.

    A snapshot holds a campaign once per date, so repeats can only come from
    repeats inside ``store_ids``; dropping those spares a shuffle of wide rows.
    """
    return (_running_snapshot(log, spine, vocab, versions)
            .withColumn("store_id", F.explode_outer(F.array_distinct("store_ids")))
            .select("as_of_dt", "campaign_id", "store_ids", "store_id",
                    F.array_size("store_ids").alias("store_count"),
                    "store_budget", "platform_budget", "updated_by",
                    epoch_text(F.col("updated_at")).alias("updated_at"),
                    "updated_dt",
                    epoch_text(F.col("created_at")).alias("created_at"),
                    epoch_date(F.col("created_at")).alias("created_dt"),
                    epoch_date(F.col("start_time")).alias("start_dt"),
                    epoch_date(F.col("end_time")).alias("end_dt"),
                    *target_columns(),
                    "campaign_status", "consent_status", "smart_discount_enabled"))


def stores_asof(log: DataFrame | None, spine: DataFrame,
                vocab: Vocabulary = DEFAULT_VOCABULARY,
                versions: DataFrame | None = None) -> DataFrame:
    """Distinct (date, store, campaign) of running campaigns."""
    return _running_snapshot(log, spine, vocab, versions).select(
        "as_of_dt", "campaign_id",
        F.explode(F.array_distinct("store_ids")).alias("store_id"))


def whitelisted_stores(store_log: DataFrame) -> DataFrame:
    """Stores whose newest row has a true status; the test runs after ranking."""
    return (latest_per_key(store_log, ["store_id"], ["updated_at", "event_id"])
            .where(F.col("status"))
            .select("store_id", "status", "updated_at", "updated_by"))


def whitelisted_without_campaign(store_log: DataFrame, live: DataFrame,
                                 strict: bool = False) -> DataFrame:
    """Whitelisted stores that are not in ``live`` (a frame with ``store_id``).

    Default: NULL stores in ``live`` are ignored. ``strict`` has the meaning
    of SQL ``NOT IN``: a NULL in ``live`` empties the result, and a NULL
    store only passes when ``live`` is empty. Both are a plain anti join, so
    neither needs ``live`` to fit in one executor.
    """
    stores = whitelisted_stores(store_log)
    absent = stores.join(live.select("store_id"), "store_id", "left_anti")
    if not strict:
        return absent
    some_null = live.where(F.col("store_id").isNull()).exists()
    some_row = live.exists()
    return absent.where(~some_null).where(F.col("store_id").isNotNull() | ~some_row)

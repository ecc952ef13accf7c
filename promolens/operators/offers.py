"""Offer attributes from the offer change log."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolens.operators.cdc import latest_per_key
from promolens.vocabulary import DEFAULT_VOCABULARY, Vocabulary


def _entries(array: str) -> Column:
    return F.coalesce(F.array_size(array), F.lit(0))


def offer_lock_meta(offers: DataFrame, since: date | None = None,
                    vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Per offer: lock flag, do-not-touch flag, and whether any tag is the offer tag.

    ``since`` cuts the log before ranking. The do-not-touch flag is 0 for an
    unlocked offer and for a free-of-fee offer aimed at stores only; a NULL
    fee type or store list does not count as such an offer.
    """
    if since is not None:
        offers = offers.where(F.col("dt") >= F.lit(since))
    newest = latest_per_key(offers, ["offer_id"], ["dt", "hr", "updated_at", "event_id"])
    lock = F.lower("lock_flag")
    unlocked = lock.isNull() | lock.isin("false", "")
    stores_only = ((F.array_size("store_ids") > 0) & (_entries("city_ids") == 0)
                   & (_entries("customer_ids") == 0) & (F.col("service_fee_type") == 0))
    tagged = F.array_contains(F.col("tags.value"), vocab.offer_tag)
    return newest.select(
        "offer_id",
        F.when(lock == "true", 1).otherwise(0).alias("is_locked"),
        F.when(unlocked | stores_only, 0).otherwise(1).alias("is_dnt"),
        F.when(tagged, 1).otherwise(0).alias("is_tagged"))


def offer_managed_flag(offers: DataFrame, end: date, days: int = 90,
                       vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Per offer seen in the ``days`` before ``end``: managed or unmanaged.

    The window is cut before ranking, so the newest version inside it wins.
    """
    recent = offers.where(F.col("dt").between(F.lit(end - timedelta(days=days)), F.lit(end)))
    newest = latest_per_key(recent, ["offer_id"],
                            ["server_ts", "updated_at", "dt", "hr", "event_id"])
    managed = F.col("ingestion_source") == vocab.managed_source
    return newest.select(
        "offer_id",
        F.when(managed, vocab.managed).otherwise(vocab.unmanaged).alias("managed_flag"))

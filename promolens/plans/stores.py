"""Store and campaign lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolens.operators import campaigns
from promolens.operators.cdc import date_spine
from promolens.params import ReportParams
from promolens.sources import Frames
from promolens.vocabulary import DEFAULT_VOCABULARY, Vocabulary


def active_by_day(frames: Frames, params: ReportParams,
                  vocab: Vocabulary = DEFAULT_VOCABULARY,
                  versions: DataFrame | None = None) -> DataFrame:
    """Campaigns running on each date that has orders, newest date first.

    ``versions`` may be stored campaign versions, which spare ranking the log.

    The sort goes on by campaign and store: a date alone has too few values
    to spread a sorted result over many tasks.
    """
    spine = date_spine(frames.live_orders, params.dates, params.start, params.end)
    log = frames.campaign_events if versions is None else None
    rows = campaigns.active_campaigns_asof(log, spine, vocab, versions)
    return rows.orderBy(F.desc("as_of_dt"), "campaign_id", "store_id")


def active_now(frames: Frames, params: ReportParams,
               vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Campaigns live at ``as_of``, one row per store."""
    return campaigns.active_campaigns_now(frames.campaign_events, params.as_of, vocab)


def whitelisted_now(frames: Frames) -> DataFrame:
    """Stores whitelisted by their newest row."""
    return campaigns.whitelisted_stores(frames.store_events)


def whitelisted_without_live_campaign(frames: Frames, params: ReportParams,
                                      vocab: Vocabulary = DEFAULT_VOCABULARY,
                                      strict: bool = False) -> DataFrame:
    """Whitelisted stores that no live campaign lists."""
    live = campaigns.live_stores(frames.campaign_events, params.as_of, vocab)
    return campaigns.whitelisted_without_campaign(frames.store_events, live, strict)

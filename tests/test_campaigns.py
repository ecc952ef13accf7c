from __future__ import annotations

from datetime import date, datetime, timezone

import pytest

from promolens.operators import campaigns
from promolens.operators.cdc import asof_snapshot, date_spine, latest_per_key
from tests.builders import campaign, epoch, frame, rows

NOON = datetime(2024, 1, 10, 12, tzinfo=timezone.utc)


def spine(spark, *days: str):
    fact = frame(spark, "live_orders", [{"dt": day} for day in days])
    return date_spine(fact, start=date(2024, 1, 1), end=date(2024, 1, 31))


def test_ties_are_broken_by_the_last_order_column(spark):
    log = frame(spark, "campaign_events", [
        campaign("a", ["1"], "2024-01-10 09:00", 1),
        campaign("a", ["2"], "2024-01-10 09:00", 2)])
    newest = latest_per_key(log, ["campaign_id"], ["dt", "hr", "updated_at", "event_id"])
    assert rows(newest, "event_id") == [(2,)]


def test_hours_order_as_numbers(spark):
    log = frame(spark, "campaign_events", [
        campaign("a", ["1"], "2024-01-10 09:00", 2),
        campaign("a", ["2"], "2024-01-10 10:00", 1)])
    newest = latest_per_key(log, ["campaign_id"], ["dt", "hr", "event_id"])
    assert rows(newest, "hr") == [(10,)]


def test_live_window_is_inclusive(spark):
    now = int(NOON.timestamp())
    log = frame(spark, "campaign_events", [
        campaign("starts", ["1"], "2024-01-10 09:00", 1, start_time=now),
        campaign("ends", ["2"], "2024-01-10 09:00", 2, end_time=now),
        campaign("late", ["3"], "2024-01-10 09:00", 3, start_time=now + 1),
        campaign("over", ["4"], "2024-01-10 09:00", 4, end_time=now - 1),
        campaign("off", ["5"], "2024-01-10 09:00", 5, smart_discount_enabled=False),
        campaign("paused", ["6"], "2024-01-10 09:00", 6, campaign_status="other")])
    assert rows(campaigns.live_campaigns(log, NOON), "campaign_id") == [("ends",), ("starts",)]


def test_filters_look_at_the_newest_version_only(spark):
    log = frame(spark, "campaign_events", [
        campaign("a", ["1"], "2024-01-10 09:00", 1),
        campaign("a", ["1"], "2024-01-10 10:00", 2, campaign_status="other")])
    assert rows(campaigns.live_campaigns(log, NOON)) == []


STORE_LISTS = [None, [], ["test"], ["test", "9"], ["1", "1"], ["2"]]


def test_store_lists_now(spark):
    """Now: missing lists keep a NULL store, test stores stay, repeats stay."""
    log = frame(spark, "campaign_events", [
        campaign(str(i), stores, "2024-01-10 09:00", i) for i, stores in enumerate(STORE_LISTS)])
    assert rows(campaigns.active_campaigns_now(log, NOON), "campaign_id", "store_id") == sorted([
        ("0", None), ("1", None), ("2", "test"), ("3", "test"), ("3", "9"), ("4", "1"),
        ("4", "1"), ("5", "2")], key=repr)


def test_store_lists_asof(spark):
    """As of a date: missing, empty and test lists go, repeats fold."""
    log = frame(spark, "campaign_events", [
        campaign(str(i), stores, "2024-01-10 09:00", i) for i, stores in enumerate(STORE_LISTS)])
    days = spine(spark, "2024-01-10")
    expected = [("4", "1"), ("5", "2")]
    assert rows(campaigns.stores_asof(log, days), "campaign_id", "store_id") == expected
    assert rows(campaigns.active_campaigns_asof(log, days), "campaign_id", "store_id") == expected


def test_asof_ignores_start_and_end(spark):
    log = frame(spark, "campaign_events", [
        campaign("a", ["1"], "2024-01-02 09:00", 1, end_time=epoch("2024-01-03"))])
    assert rows(campaigns.stores_asof(log, spine(spark, "2024-01-20")), "store_id") == [("1",)]


def test_spine_holds_only_dates_with_facts(spark):
    fact = frame(spark, "live_orders", [{"dt": "2024-01-02"}, {"dt": "2024-01-05"}])
    wanted = [date(2024, 1, 2), date(2024, 1, 3)]
    assert rows(date_spine(fact, dates=wanted)) == [(date(2024, 1, 2),)]
    with pytest.raises(ValueError):
        date_spine(fact)


def test_snapshot_keeps_a_date_before_every_version(spark):
    log = frame(spark, "campaign_events", [campaign("a", ["1"], "2024-01-10 09:00", 1)])
    snapshot = campaigns.campaign_snapshot(log, spine(spark, "2024-01-09", "2024-01-10"))
    assert rows(snapshot, "as_of_dt", "campaign_id") == [
        (date(2024, 1, 10), "a"), (date(2024, 1, 9), None)]


def test_snapshot_of_an_empty_log_keeps_every_date(spark):
    log = frame(spark, "campaign_events", [campaign("a", [], "2024-01-10 09:00", 1)]).limit(0)
    snapshot = campaigns.campaign_snapshot(log, spine(spark, "2024-01-09", "2024-01-10"))
    assert rows(snapshot, "campaign_id") == [(None,), (None,)]


def test_snapshot_on_the_last_date_is_the_newest_version(spark):
    log = frame(spark, "campaign_events", [
        campaign(str(i % 3), [str(i)], f"2024-01-{1 + i % 9:02d} 0{i % 10}:00", i)
        for i in range(40)])
    last = asof_snapshot(log.withColumn("day", log.dt), spine(spark, "2024-01-31"),
                         ["campaign_id"], "day", ["updated_at", "event_id"])
    newest = latest_per_key(log, ["campaign_id"], ["updated_at", "event_id"])
    assert rows(last, "campaign_id", "event_id") == rows(newest, "campaign_id", "event_id")


def store_log(spark):
    return frame(spark, "store_events", [
        {"store_id": "1", "status": True, "updated_at": 1, "event_id": 1},
        {"store_id": "2", "status": True, "updated_at": 1, "event_id": 2},
        {"store_id": "2", "status": False, "updated_at": 2, "event_id": 3},
        {"store_id": "3", "status": True, "updated_at": 1, "event_id": 4},
        {"store_id": None, "status": True, "updated_at": 1, "event_id": 5}])


def listed(spark, *stores):
    return spark.createDataFrame([(s,) for s in stores], "store_id STRING")


def test_whitelist_tests_the_newest_row(spark):
    assert rows(campaigns.whitelisted_stores(store_log(spark)), "store_id") == \
        sorted([("1",), ("3",), (None,)], key=repr)


@pytest.mark.parametrize(("live", "relaxed", "strict"), [
    (["3"], ["1", None], ["1"]),
    (["3", None], ["1", None], []),
    ([], ["1", "3", None], ["1", "3", None]),
])
def test_not_in_modes(spark, live, relaxed, strict):
    log, live_stores = store_log(spark), listed(spark, *live)
    log.createOrReplaceTempView("store_log_of_test")
    live_stores.createOrReplaceTempView("live_of_test")

    def found(**mode):
        return rows(campaigns.whitelisted_without_campaign(log, live_stores, **mode), "store_id")

    assert found() == sorted([(s,) for s in relaxed], key=repr)
    assert found(strict=True) == sorted([(s,) for s in strict], key=repr)
    literal = spark.sql("""
        SELECT store_id FROM store_log_of_test WHERE event_id IN (1, 4, 5)
        AND store_id NOT IN (SELECT store_id FROM live_of_test)""")
    assert found(strict=True) == rows(literal)

from __future__ import annotations

from datetime import date, datetime, timezone
from decimal import Decimal

import pytest

from promolens.operators import orders, rollup
from promolens.params import ReportParams
from promolens.plans import intraday_segment_variant, overall_segment
from promolens.plans.discounts import with_offer_mark
from promolens.plans.efficiency import efficiency_for
from promolens.sources import Frames
from tests.builders import campaign, frame, rows

DAY = "2024-01-10"
PARAMS = ReportParams(start=date(2024, 1, 10), end=date(2024, 1, 11), month=date(2024, 1, 1),
                      as_of=datetime(2024, 1, 10, 12, tzinfo=timezone.utc))


def line(order_id, **changes):
    return {"dt": DAY, "hr": 12, "order_id": order_id, "store_id": "1", "offer_id": 1,
            "store_discount": 5, "platform_discount": 0, "order_status": "completed",
            "city_code": "1"} | changes


def order(order_id, **changes):
    return {"dt": DAY, "order_id": order_id, "customer_id": 1, "store_id": "1", "gmv": 100,
            "excluded_flag": 0, "ignore_flag": 0, "post_status": "Completed"} | changes


def test_eligible_orders(spark):
    log = frame(spark, "orders", [
        order(1), order(2, excluded_flag=1), order(3, excluded_flag=None),
        order(4, ignore_flag=1), order(5, ignore_flag=None), order(6, post_status="completed"),
        order(7, dt="2024-01-09")])
    window = (PARAMS.start, PARAMS.end)
    assert rows(orders.eligible_orders(log, *window), "order_id") == [(1,), (3,), (6,)]
    assert rows(orders.eligible_orders(log, *window, completed_only=True), "order_id") == \
        [(1,), (3,)]
    assert rows(orders.eligible_orders(log, dates=[date(2024, 1, 10)], check_ignored=False),
                "order_id") == [(1,), (3,), (4,), (5,), (6,)]


def test_eligible_lines(spark):
    lines = frame(spark, "offer_lines", [
        line(1), line(2, city_code="10000"), line(3, city_code=None), line(4, hr=15),
        line(5, hr=None), line(6, order_status="Completed")])
    window = (PARAMS.start, PARAMS.end)
    assert rows(orders.eligible_lines(lines, *window), "order_id") == [(1,), (4,), (5,)]
    assert rows(orders.eligible_lines(lines, *window, hour_cutoff=14), "order_id") == [(1,)]


def test_grain_and_metrics_with_missing_discounts(spark):
    lines = frame(spark, "offer_lines", [
        line(1, store_discount=None, platform_discount=None),
        line(2, store_discount=None, platform_discount=3),
        line(2, offer_id=2, store_discount=2, platform_discount=None),
        line(3, store_discount=0), line(9)])
    facts = frame(spark, "orders", [order(1), order(2), order(3), order(3, dt="2024-01-11")])
    grain = orders.order_discount_grain(lines, facts)
    assert rows(grain, "order_id", "store_discount", "platform_discount", "total_discount") == [
        (1, Decimal("0.0000"), Decimal("0.0000"), Decimal("0.0000")),
        (2, Decimal("2.0000"), Decimal("3.0000"), Decimal("5.0000")),
        (3, Decimal("0.0000"), Decimal("0.0000"), Decimal("0.0000"))]
    metrics = orders.store_customer_metrics(grain)
    assert rows(orders.money_as_double(metrics), "completed_orders", "discounted_orders", "gmv",
                "total_discount") == [(3, 1, 300.0, 5.0)]


def test_an_order_delivered_twice(spark):
    """Repeated order rows repeat the discounts but count as one order."""
    lines = frame(spark, "offer_lines", [line(1), line(1, store_discount=1)])
    same = orders.order_discount_grain(lines, frame(spark, "orders", [order(1), order(1)]))
    assert rows(orders.money_as_double(orders.store_customer_metrics(same)), "completed_orders",
                "gmv", "store_discount") == [(1, 100.0, 12.0)]
    other = orders.order_discount_grain(
        lines, frame(spark, "orders", [order(1), order(1, gmv=50)]))
    assert rows(orders.money_as_double(orders.store_customer_metrics(other)), "completed_orders",
                "discounted_orders", "gmv", "store_discount") == [(1, 1, 150.0, 12.0)]


def test_tagged_sums_stay_null_without_a_tagged_line(spark):
    lines = frame(spark, "offer_lines", [
        line(1), line(2, offer_id=None), line(2, offer_id=7, platform_discount=1)])
    tagged = spark.createDataFrame([(0,)], "offer_id BIGINT")
    marked = with_offer_mark(lines, tagged, "_tagged", default_offer=0)
    grain = orders.order_discount_grain(
        marked.withColumn("is_tagged", marked["_tagged"].cast("int")),
        frame(spark, "orders", [order(1), order(2)]), tagged=True)
    assert rows(orders.money_as_double(grain), "order_id", "tagged_store_discount",
                "tagged_platform_discount", "tagged_discount") == [
        (1, None, None, None), (2, 5.0, 0.0, 5.0)]
    unmarked = with_offer_mark(lines, tagged, "_tagged")
    assert rows(unmarked.where("_tagged")) == []


def report_frames(spark, **changes):
    base = {
        "campaign_events": frame(spark, "campaign_events", [
            campaign("a", ["1", "2"], f"{DAY} 09:00", 1), campaign("b", ["1"], f"{DAY} 09:00", 2),
            campaign("c", None, f"{DAY} 09:00", 3)]),
        "customer_tiers": frame(spark, "customer_tiers", [
            {"customer_id": 1, "dt": "2024-01-01", "tier": "P2"},
            {"customer_id": 2, "dt": "2023-12-01", "tier": "P2"}]),
        "segment_override": frame(spark, "segment_override", [
            {"customer_id": 9, "segment": "S7", "dt": "2024-01-01"}]),
        "offer_events": frame(spark, "offer_events", [{"offer_id": 5, "dt": "2024-01-01"}]),
        "assignments": frame(spark, "assignments", [
            {"campaign_id": "a", "run_date": DAY, "run_ts": f"{DAY}T01:00:00", "variant": "x",
             "event_id": 1}]),
        "offer_lines": frame(spark, "offer_lines", [
            line(1), line(2, store_id="2"), line(3, store_id="3"), line(4, store_id="1")]),
        "orders": frame(spark, "orders", [
            order(1), order(2, customer_id=2), order(3), order(4, customer_id=None)]),
    }
    base |= changes
    base["live_orders"] = base["orders"].drop("store_id", "ignore_flag", "post_status")
    return Frames(**base)


def test_live_stores_count_once(spark):
    """A store of two live campaigns is one store; unknown customers are unclassified."""
    report = overall_segment(report_frames(spark), PARAMS)
    assert rows(report, "customer_segment", "completed_orders", "gmv", "total_discount") == [
        ("S3", 1, 100.0, 5.0), ("Unclassified", 2, 200.0, 10.0)]


@pytest.mark.parametrize(("once", "expected"), [
    (False, [("S3", "control", 1), ("S3", "x", 1), ("Unclassified", "control", 1),
             ("Unclassified", "x", 2)]),
    (True, [("S3", "control", 1), ("S3", "x", 1), ("Unclassified", "control", 1),
            ("Unclassified", "x", 2)]),
])
def test_variants_credit_each_campaign(spark, once, expected):
    params = ReportParams(**{**PARAMS.__dict__, "count_store_once": once})
    report = intraday_segment_variant(report_frames(spark), params)
    assert rows(report, "customer_segment", "variant", "completed_orders") == expected


@pytest.mark.parametrize(("once", "orders_of_store"), [(False, 2), (True, 1)])
def test_campaigns_of_one_variant_may_count_a_store_once(spark, once, orders_of_store):
    params = ReportParams(**{**PARAMS.__dict__, "count_store_once": once})
    same = frame(spark, "assignments", [
        {"campaign_id": c, "run_date": DAY, "run_ts": f"{DAY}T01:00:00", "variant": "x",
         "event_id": i} for i, c in enumerate("ab")])
    one = frame(spark, "offer_lines", [line(1)])
    report = intraday_segment_variant(report_frames(spark, assignments=same, offer_lines=one), params)
    assert rows(report, "customer_segment", "variant", "completed_orders") == [
        ("S3", "x", orders_of_store)]


@pytest.mark.parametrize(("once", "copies"), [(False, 2), (True, 1)])
def test_exposure_copies(spark, once, copies):
    stores = spark.createDataFrame(
        [(date(2024, 1, 10), "a", "1"), (date(2024, 1, 10), "b", "1")],
        "as_of_dt DATE, campaign_id STRING, store_id STRING")
    variants = spark.createDataFrame([], "run_date DATE, campaign_id STRING, variant STRING")
    exposures = rollup.store_exposures(stores, variants, once)
    assert rows(exposures, "store_id", "variant", "copies") == [("1", "control", copies)]


def test_a_long_store_list_gives_the_same_report(spark):
    """Beyond the broadcast bound the store list meets the lines in a shuffle join."""
    shuffled = ReportParams(**{**PARAMS.__dict__, "max_broadcast_rows": 0})
    for report in (overall_segment, intraday_segment_variant):
        assert rows(report(report_frames(spark), shuffled)) == \
            rows(report(report_frames(spark), PARAMS))


def test_efficiency_credits_every_pack_of_a_slot(spark):
    """An order counts for each (tier, mode) of its store, segment and slot; none without gmv."""
    mapping = spark.createDataFrame(
        [(date(2024, 1, 10), s, "S1", "lunch", p) for s, p in
         [("1", "T1_O"), ("1", "T2_A"), ("1", "T2_A"), ("2", "T1_O"), ("3", "T1_O")]],
        "run_date DATE, store_id STRING, segment STRING, slot STRING, pack_id STRING")
    metrics = spark.createDataFrame(
        [(date(2024, 1, 10), "1", "lunch", "S1", 1, 1, 10.0),
         (date(2024, 1, 10), "2", "lunch", "S1", 1, 1, 0.0)],
        "dt DATE, store_id STRING, slot STRING, customer_segment STRING, completed_orders INT, "
        "discounted_orders INT, gmv DOUBLE")
    report = efficiency_for(mapping, metrics, PARAMS)
    assert rows(report, "store_id", "tier", "mode", "completed_orders") == [
        ("1", "T1", "5_O", 1), ("1", "T2", "4_A", 1)]


def test_parameters():
    assert ReportParams(**{**PARAMS.__dict__, "pack_window_days": 7}).pack_window == \
        (date(2024, 1, 3), date(2024, 1, 9))
    with pytest.raises(ValueError):
        ReportParams(**{**PARAMS.__dict__, "as_of": datetime(2024, 1, 10)})
    with pytest.raises(ValueError):
        ReportParams(**{**PARAMS.__dict__, "start": date(2024, 2, 1)})

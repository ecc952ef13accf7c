"""Bounds, list sizes, zones and the stored mapping: cases where a lost rule would show."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from promolens import plans
from promolens.operators.cdc import date_spine
from promolens.operators.joins import keep_listed
from promolens.operators.orders import eligible_lines, eligible_orders
from promolens.operators.packs import pack_mapping
from promolens.session import configure
from promolens.sources import write_pack_mapping
from promolens.testbed.bindings import PARAMS, BoundFrames
from promolens.testbed.queries import QUERIES
from tests.builders import rows

SF_DIR = "/root/testdata/sf0.001"
MIDDLE = date(2024, 1, 16)


@pytest.mark.parametrize("max_rows", [0, 10])
def test_a_list_of_any_size_filters(spark, max_rows):
    facts = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "store_id STRING, n INT")
    listed = spark.createDataFrame([("a",)], "store_id STRING")
    assert rows(keep_listed(facts, listed, ["store_id"], max_rows)) == [("a", 1)]


def test_lone_bounds_hold(spark):
    f = BoundFrames(spark, SF_DIR)
    for select, frame in ((eligible_lines, f.offer_lines), (eligible_orders, f.orders)):
        late, early = select(frame, start=MIDDLE), select(frame, end=MIDDLE)
        assert late.agg(F.min("dt")).first()[0] >= MIDDLE and not late.isEmpty()
        assert early.agg(F.max("dt")).first()[0] <= MIDDLE and not early.isEmpty()
    both = [date(2024, 1, 5), date(2024, 1, 20)]
    assert rows(date_spine(f.orders, both, start=MIDDLE)) == [(both[1],)]
    assert rows(date_spine(f.orders, both, end=MIDDLE)) == [(both[0],)]


def test_pack_window_is_meant_in_the_session_zone():
    late = datetime(2024, 1, 31, 2, tzinfo=timezone(timedelta(hours=5, minutes=30)))
    assert replace(PARAMS, as_of=late).pack_window == (date(2024, 1, 23), date(2024, 1, 29))
    there = replace(PARAMS, as_of=late, time_zone="Asia/Kolkata")
    assert there.pack_window == (date(2024, 1, 24), date(2024, 1, 30))


def test_configure_leaves_the_zone_alone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        configure(spark)
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Kolkata"
    finally:
        configure(spark, zone)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_meet_the_pack_stores_before_a_shuffle(spark, tmp_path):
    f = BoundFrames(spark, SF_DIR)
    path = str(tmp_path / "mapping")
    write_pack_mapping(pack_mapping(f.campaign_state, PARAMS.state_from), path=path)
    for mapping in (None, spark.read.parquet(path)):
        plan = _plan(plans.efficiency(f, PARAMS, mapping=mapping))
        semi = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "LeftSemi" in line]
        assert semi and all("dt#" in line and "store_id#" in line for line in semi)


def test_a_date_has_few_files_and_dates_can_be_replaced(spark, tmp_path):
    f = BoundFrames(spark, SF_DIR)
    path = str(tmp_path / "mapping")
    whole = pack_mapping(f.campaign_state, PARAMS.state_from)
    write_pack_mapping(whole, path=path, files_per_date=2)
    for folder in (tmp_path / "mapping").glob("run_date=*"):
        assert 1 <= len(list(folder.glob("*.parquet"))) <= 2
    dates = spark.read.parquet(path).select("run_date").distinct().count()
    day = whole.where(F.col("run_date") == MIDDLE).limit(1)
    write_pack_mapping(day, path=path, only_dates=True)
    stored = spark.read.parquet(path)
    assert stored.select("run_date").distinct().count() == dates
    assert stored.where(F.col("run_date") == MIDDLE).count() == 1


@pytest.mark.parametrize("cut,whole", [
    ("offer_lock_meta_since", "offer_lock_meta"),
    ("offer_managed_flag_recent", "offer_managed_flag"),
    ("report_intraday_listed_dates", "report_intraday_segment_variant"),
    ("report_cart_funnel_week", "report_cart_funnel_variant")])
def test_cuts_change_the_result(spark, cut, whole):
    assert rows(QUERIES[cut](spark, SF_DIR)) != rows(QUERIES[whole](spark, SF_DIR))


def test_not_in_depends_on_the_list(spark):
    counts = dict(rows(QUERIES["whitelisted_not_in_lists"](spark, SF_DIR)))
    assert counts["as it is"] == 0 < counts["known stores"] < counts["empty"]

"""Plan shapes the library promises."""

from __future__ import annotations

import re
from contextlib import contextmanager
from dataclasses import replace
from datetime import date

import pytest

from __spark_entry__ import queries
from promolens import plans
from promolens.operators import carts, orders
from promolens.operators.campaigns import campaign_snapshot, live_stores
from promolens.operators.cdc import date_spine, latest_per_key
from promolens.operators.packs import explode_context, pack_identities, pack_mapping
from promolens.plans.efficiency import efficiency, efficiency_for, slot_metrics, window_runs
from promolens.sources import Frames, read_frame, write_bucketed_mapping, write_pack_mapping
from promolens.testbed.bindings import PARAMS, BoundFrames
from tests.builders import frame

SF_DIR = "/root/testdata/sf0.001"
REPORTS = sorted(name for name in queries() if name.startswith("report_"))


@contextmanager
def settings(spark, **changes):
    changes = {key.replace("__", "."): value for key, value in changes.items()}
    before = {key: spark.conf.get(key, None) for key in changes}
    for key, value in changes.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def without_broadcast(spark):
    return settings(spark, spark__sql__autoBroadcastJoinThreshold="-1",
                    spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
                    spark__sql__adaptive__enabled="false")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def bound(spark):
    return BoundFrames(spark, SF_DIR)


@pytest.mark.parametrize("name", REPORTS)
def test_reports_use_no_theta_join_no_row_copies_and_no_python(spark, name):
    text = plan(queries()[name](spark, SF_DIR))
    for unwanted in ("BroadcastNestedLoopJoin", "CartesianProduct", "Expand", "Python", "Pandas"):
        assert unwanted not in text


def test_newest_rows_are_cut_before_the_shuffle(spark, bound):
    with without_broadcast(spark):
        text = plan(latest_per_key(bound.campaign_events, ["campaign_id"], ["event_id"]))
    exchange = text.index("Exchange hashpartitioning")
    assert text.index("Final") < exchange < text.index("Partial")


def test_snapshot_joins_nothing(bound):
    spine = date_spine(bound.live_orders, start=PARAMS.start, end=PARAMS.end)
    assert "Join" not in plan(campaign_snapshot(bound.campaign_events, spine))


def test_repeat_carts_is_a_semi_join(spark, bound):
    prior = carts.prior_orders(bound.orders, PARAMS.start, PARAMS.end)
    with without_broadcast(spark):
        text = plan(carts.repeat_carts(bound.carts, prior))
    assert "LeftSemi" in text


def test_the_funnel_reads_the_carts_once(spark, bound, tmp_path):
    bound.carts.write.parquet(str(tmp_path / "visited"))
    frames = Frames(carts=spark.read.parquet(str(tmp_path / "visited")), orders=bound.orders,
                    customer_tiers=bound.customer_tiers, campaign_state=bound.campaign_state)
    with without_broadcast(spark):
        text = plan(plans.cart_funnel_by_pack(frames, PARAMS))
    assert len(re.findall(r"FileScan parquet \[[^\]]*cart_id#", text)) == 1
    assert text.count("Exchange hashpartitioning") < 16


@pytest.mark.parametrize("name", ["cart_funnel_full", "report_cart_funnel_full", "report_cart_funnel_stored"])
def test_carts_are_folded_before_they_meet_the_packs(spark, name):
    """No shuffle is dealt by pack and cart: a cart does not travel once for each pack."""
    with without_broadcast(spark):
        text = plan(queries()[name](spark, SF_DIR))
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert any("pack_id#" in keys for keys in dealt)
    assert not any("pack_id#" in keys and "cart_id#" in keys for keys in dealt)


def test_packs_are_dealt_once(spark, bound, tmp_path):
    """Ranking needs no shuffle of its own, nor does storing a mapping that is dealt for it."""
    with without_broadcast(spark):
        for options in ({}, {"files_per_date": 8}, {"buckets": 8}):
            assert plan(pack_mapping(bound.campaign_state, PARAMS.state_from, **options)).count("Exchange ") == 1
    with pytest.raises(ValueError):
        pack_mapping(bound.campaign_state, variants=bound.assignments, buckets=8)
    plain, dealt = str(tmp_path / "plain"), str(tmp_path / "dealt")
    write_pack_mapping(pack_mapping(bound.campaign_state), path=plain, files_per_date=2)
    write_pack_mapping(pack_mapping(bound.campaign_state, files_per_date=2), path=dealt, files_per_date=2, dealt=True)
    one, other = spark.read.parquet(plain), spark.read.parquet(dealt)
    assert one.exceptAll(other).count() == other.exceptAll(one).count() == 0 < one.count()
    assert max(len(list(d.glob("*.parquet"))) for d in (tmp_path / "dealt").glob("run_date=*")) <= 2


@pytest.fixture(scope="module")
def bucketed(spark, bound):
    write_bucketed_mapping(pack_mapping(bound.campaign_state, PARAMS.state_from),
                           "bucketed_mapping_of_test", 8)
    return spark.table("bucketed_mapping_of_test")


def below(text: str, join: str) -> list[str]:
    """The lines of the plan below the first ``join`` that leads to the bucketed scan by no exchange."""
    lines = text.splitlines()
    scan = next(i for i, line in enumerate(lines) if "bucketed_mapping_of_test" in line)
    depth, path = len(lines[scan]), []
    for line in reversed(lines[:scan]):
        indent = len(line) - len(line.lstrip(" :+-"))
        if indent < depth:
            path.append(line)
            depth = indent
        if join in line and path and path[-1] == line:
            break
    return path


@pytest.mark.parametrize("report", ["funnel", "efficiency"])
def test_a_bucketed_mapping_is_joined_where_it_lies(spark, bound, bucketed, report):
    with without_broadcast(spark):
        made = (plans.cart_funnel_by_pack(bound, PARAMS, mapping=bucketed, bucketed=True)
                if report == "funnel" else
                efficiency_for(bucketed, slot_metrics(bound, PARAMS), PARAMS))
        path = below(plan(made), "SortMergeJoin")
        assert "SortMergeJoin" in path[-1]
        assert not any("Exchange" in line for line in path)
        assert made.count() > 0


def test_documents_outside_the_window_are_not_staged(spark, bound, tmp_path):
    week = replace(PARAMS, start=date(2024, 1, 10), end=date(2024, 1, 16))
    bound.campaign_state.write.parquet(str(tmp_path / "runs"))
    stored = Frames(campaign_state=spark.read.parquet(str(tmp_path / "runs")))
    with settings(spark, spark__sql__maxMetadataStringLength="5000"):
        runs = plan(pack_identities(window_runs(stored, week), week.state_from))
    assert "LessThanOrEqual(run_date,2024-01-16)" in runs
    assert efficiency(bound, week).where("run_date < date'2024-01-10' or run_date > date'2024-01-16'").count() == 0


def test_metrics_after_the_order_join_shuffle_once(spark, bound):
    """Lines twice, orders once, then one exchange for the final sums."""
    with without_broadcast(spark):
        grain = orders.order_discount_grain(bound.offer_lines, bound.orders)
        assert plan(grain).count("Exchange hashpartitioning") == 3
        metrics = orders.store_customer_metrics(grain)
        assert plan(metrics).count("Exchange hashpartitioning") == 4


def test_documents_are_parsed_once_and_not_carried(spark):
    state = frame(spark, "campaign_state", [{"campaign_id": "a", "campaign_context": "{}"}])
    stored = state.checkpoint()
    text = plan(explode_context(stored))
    assert text.count("from_json(") == 1
    for carried in re.findall(r"Generate explode\([^)]*\), \[([^\]]*)\]", text):
        assert "ctx" not in carried and "stores" not in carried
        assert "pack_selections" not in carried and "store#" not in carried


@pytest.fixture(scope="module")
def stored_lines(spark, bound, tmp_path_factory):
    """Offer lines as a table would hold them: partitioned by a text date."""
    path = str(tmp_path_factory.mktemp("lines") / "offer_lines")
    (bound.offer_lines.withColumn("day", bound.offer_lines["dt"].cast("string")).drop("dt")
     .write.partitionBy("day").parquet(path))
    with settings(spark, spark__sql__sources__partitionColumnTypeInference__enabled="false"):
        return read_frame(spark, path, "offer_lines", {"dt": "day"}, fmt="parquet")


def test_dates_prune_partitions_and_columns_are_pruned(spark, bound, stored_lines):
    lines = orders.eligible_lines(stored_lines, date(2024, 1, 5), date(2024, 1, 6))
    with settings(spark, spark__sql__maxMetadataStringLength="5000"):
        text = plan(orders.order_discount_grain(lines, bound.orders))
    scan = next(part for part in text.splitlines()
                if "FileScan" in part and "order_status" in part)
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", scan)
    assert "day" in filters[1]
    assert "order_status" in filters[2] and "city_code" in filters[2]
    schema = scan.split("ReadSchema: ")[1]
    for unread in ("offer_type", "applied", "benefit_type", "offer_id", "hr"):
        assert unread not in schema


def test_short_store_lists_reach_the_line_scan(spark, bound):
    report = queries()["report_overall_segment"](spark, SF_DIR)
    with without_broadcast(spark):
        text = plan(queries()["report_overall_segment"](spark, SF_DIR))
    assert "BroadcastHashJoin" in text and "LeftSemi" in text
    assert report.count() > 0
    assert live_stores(bound.campaign_events, PARAMS.as_of).count() > 0

from __future__ import annotations

from datetime import date

import pytest

from promolens.operators.packs import explode_context, pack_mapping, parsed_runs
from promolens.schemas import FRAMES
from promolens.sources import normalise, publish_view, read_frame, write_pack_mapping
from tests.builders import frame, rows


def test_text_columns_become_typed(spark):
    raw = spark.sql("""
        SELECT '2024-01-05' AS dt, 1 AS order_id, '2' AS user_id, '12.50' AS bill, flag
        FROM VALUES ('0'), ('1'), (NULL), ('x'), ('00') AS t(flag)""")
    live = normalise(raw, "live_orders", {"customer_id": "user_id", "gmv": "bill",
                                          "excluded_flag": "flag"})
    assert live.dtypes == [(name, kind.lower()) for name, kind in FRAMES["live_orders"].items()]
    assert rows(live, "excluded_flag") == [(0,), (0,), (1,), (1,), (None,)]
    assert rows(live.select("dt", "customer_id").distinct()) == [(date(2024, 1, 5), 2)]


def test_column_names_are_case_insensitive(spark):
    raw = spark.sql("SELECT 1 AS CUSTOMER_ID, DATE'2024-01-01' AS Dt, 'P2' AS TIER")
    assert rows(normalise(raw, "customer_tiers")) == [(1, date(2024, 1, 1), "P2")]


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_reading_files_and_views(spark, tmp_path, fmt):
    tiers = frame(spark, "customer_tiers", [{"customer_id": 1, "dt": "2024-01-01", "tier": "P2"}])
    path = str(tmp_path / "tiers")
    tiers.write.format(fmt).save(path)
    assert rows(read_frame(spark, path, "customer_tiers", fmt=fmt)) == rows(tiers)
    publish_view(tiers, "tiers_of_test")
    renamed = read_frame(spark, "tiers_of_test", "customer_tiers", {"tier": "upper(tier)"})
    assert rows(renamed) == rows(tiers)


@pytest.mark.parametrize("stored", ["DATE", "STRING", "TIMESTAMP", "STRING with time"])
def test_date_bounds_reach_the_scan_in_the_stored_type(spark, tmp_path, stored):
    days = spark.sql("SELECT CAST(date_add(DATE'2024-01-01', CAST(id AS INT)) AS "
                     f"{stored.split()[0]}) AS dt, id AS customer_id, 'P2' AS tier FROM range(40)"
                     " UNION ALL SELECT NULL, 99, 'P2'")
    if stored == "STRING with time":
        days = days.selectExpr("dt || ' 23:59:59' AS dt", "customer_id", "tier")
    path = str(tmp_path / "tiers")
    days.write.parquet(path)
    for bounds, want in (((date(2024, 1, 5), date(2024, 1, 7)), [4, 5, 6]), ((date(2024, 2, 8), None), [38, 39]),
                         ((None, date(2024, 1, 1)), [0])):
        kept = read_frame(spark, path, "customer_tiers", fmt="parquet", between={"dt": bounds})
        text = kept._jdf.queryExecution().executedPlan().toString()
        pushed = text.split("PushedFilters: [")[1].split("]")[0]
        assert ("GreaterThanOrEqual(dt," in pushed) == (bounds[0] is not None)
        assert ("LessThan(dt," in pushed) == (bounds[1] is not None)
        assert [r[0] for r in rows(kept, "customer_id")] == want
    assert dict(kept.dtypes)["dt"] == "date"


def test_parsed_runs_give_the_rows_of_the_text(spark, tmp_path):
    texts = ['{"burn":{"total_burn":1.5},"stores":[{"store_id":"1","pack_selections":[{"pack_id":"T1_O"},'
             '{"pack_id":"T2_A","slot":"lunch","more":[1]}]},{"store_id":"2"}]}', "{bad", "", None, "{}", "[]",
             '{"stores":[]}', '{"stores":null}', '{"stores":[{"store_id":"3","pack_selections":[]}]}']
    state = frame(spark, "campaign_state", [
        {"campaign_id": str(n), "run_date": "2024-01-01", "run_ts": "2024-01-01T01:00:00", "event_id": n,
         "campaign_context": text} for n, text in enumerate(texts)])
    path = str(tmp_path / "runs")
    parsed_runs(state).write.parquet(path)
    stored = spark.read.parquet(path)
    from_stored = explode_context(stored)
    assert rows(from_stored) == rows(explode_context(state)) and from_stored.count() == 2
    text = from_stored._jdf.queryExecution().executedPlan().toString()
    assert "parse_json" not in text and "from_json" not in text and text.count("try_variant_get") <= 1


def test_mapping_table_is_replaced(spark):
    state = frame(spark, "campaign_state", [
        {"campaign_id": "a", "run_date": "2024-01-01", "run_ts": "2024-01-01T01:00:00",
         "event_id": 1, "campaign_context":
         '{"stores":[{"store_id":"1","pack_selections":[{"pack_id":"T1_O"}]}]}'}])
    mapping = pack_mapping(state)
    for _ in range(2):
        write_pack_mapping(mapping, table="pack_mapping_of_test")
    stored = spark.table("pack_mapping_of_test")
    assert rows(stored.select(*mapping.columns)) == rows(mapping)


def test_mapping_sink_lays_out_by_run_date(spark, tmp_path):
    state = frame(spark, "campaign_state", [
        {"campaign_id": "a", "run_date": f"2024-01-0{d}", "run_ts": f"2024-01-0{d}T01:00:00",
         "event_id": d, "campaign_context":
         '{"stores":[{"store_id":"1","pack_selections":[{"pack_id":"T1_O"}]}]}'}
        for d in (1, 2)])
    path = tmp_path / "mapping"
    write_pack_mapping(pack_mapping(state), path=str(path))
    assert sorted(p.name for p in path.glob("run_date=*")) == [
        "run_date=2024-01-01", "run_date=2024-01-02"]
    one_day = spark.read.parquet(str(path)).where("run_date = DATE'2024-01-02'")
    assert "PartitionFilters: [isnotnull(run_date" in one_day._jdf.queryExecution().toString()
    assert one_day.count() == 1
    with pytest.raises(ValueError):
        write_pack_mapping(pack_mapping(state))

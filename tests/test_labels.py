from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from promolens.functions import (
    cart_value_bucket,
    offer_discount_type,
    pack_mode,
    pack_part,
    slot_of,
)
from promolens.operators import offers, packs, segments
from promolens.operators.experiments import distinct_variants, latest_variant
from promolens.schemas import BURN_FIELDS
from promolens.vocabulary import DEFAULT_VOCABULARY, DISCOUNT_RULES
from tests.builders import frame, rows


def test_cart_buckets_share_bounds_downwards(spark):
    values = spark.createDataFrame(
        [(i, v) for i, v in enumerate([-1.0, 0.0, 100.0, 100.01, 200.0, 700.0, 700.01, None])],
        "i INT, v DOUBLE")
    got = [row[1] for row in rows(values.select("i", cart_value_bucket(F.col("v"))))]
    assert got == [None, "a_0_100", "a_0_100", "b_100_200", "b_100_200", "f_500_700", "700+", None]


def test_slots(spark):
    hours = spark.createDataFrame(
        [(i, h) for i, h in enumerate([10, 11, 15, 16, 22, 23, None])], "i INT, h INT")
    got = [row[1] for row in rows(hours.select("i", slot_of(F.col("h"))))]
    assert got == ["latenight_breakfast", "lunch", "lunch", "snacks_dinner", "snacks_dinner",
                   "latenight_breakfast", "latenight_breakfast"]


def test_pack_parts(spark):
    ids = spark.createDataFrame(
        [(i, p) for i, p in enumerate(["T1_O", "T1_Z", "T1", "", None])], "i INT, p STRING")
    got = rows(ids.select("i", pack_part(F.col("p"), 0), pack_mode(F.col("p"))))
    assert [r[1:] for r in got] == [("T1", "5_O"), ("T1", "Z"), ("T1", None), ("", None),
                                    (None, None)]


def _example(rule):
    return (rule.offer_type, rule.applied[-1] if rule.applied else "APPLIES_ON_SOMETHING",
            rule.discount_type or "NONE", rule.benefit_type or "NONE", rule.label)


def test_every_discount_rule_and_their_order(spark):
    examples = [_example(rule) for rule in DISCOUNT_RULES] + [
        ("trade_offer", "APPLIES_ON_EXPRESS_FEE", "FLAT", "CASHBACK", "Cashback"),
        ("trade_offer", "APPLIES_ON_SOMETHING", "FLAT", "NONE", "other"),
        ("coupon_offer", None, None, None, "other"),
        (None, "APPLIES_ON_CATALOG_ITEM", "FLAT", "NONE", "other")]
    lines = spark.createDataFrame(examples, "o STRING, a STRING, d STRING, b STRING, want STRING")
    got = lines.select("want", offer_discount_type(*map(F.col, "oadb")).alias("got"))
    assert [r for r in rows(got) if r[0] != r[1]] == []


@pytest.mark.parametrize(("newest", "expected"), [("2024-01-05", [(1,)]), ("2024-01-09", [])])
def test_override_date_is_taken_over_all_segments(spark, newest, expected):
    override = frame(spark, "segment_override", [
        {"customer_id": 1, "segment": "S7", "dt": "2024-01-05"},
        {"customer_id": 1, "segment": "S7", "dt": "2024-01-05"},
        {"customer_id": 2, "segment": "S7", "dt": "2024-01-04"},
        {"customer_id": 3, "segment": "S1", "dt": newest}])
    assert rows(segments.override_customers(override)) == expected


def test_segments_month_and_override(spark):
    tiers = frame(spark, "customer_tiers", [
        {"customer_id": 1, "dt": "2024-01-01", "tier": "P1A"},
        {"customer_id": 1, "dt": "2023-12-01", "tier": "P3"},
        {"customer_id": 2, "dt": "2024-01-01", "tier": "P2"},
        {"customer_id": 3, "dt": "2024-01-01", "tier": None}])
    overridden = spark.createDataFrame([(2,)], "customer_id BIGINT")
    labels = segments.customer_segments(tiers, date(2024, 1, 1), overridden)
    assert rows(labels, "customer_id", "customer_segment") == [
        (1, "S1"), (2, "S7"), (3, "Unclassified")]
    facts = frame(spark, "orders", [
        {"order_id": 1, "customer_id": 1, "dt": "2024-01-31"},
        {"order_id": 2, "customer_id": 1, "dt": "2023-12-31"},
        {"order_id": 3, "customer_id": 2, "dt": "2023-12-31"},
        {"order_id": 4, "customer_id": None, "dt": "2024-01-31"}])
    monthly = segments.with_month_segment(facts, segments.customer_segments(tiers))
    assert rows(monthly, "order_id", "customer_segment") == [
        (1, "S1"), (2, "S5"), (3, "Unclassified"), (4, "Unclassified")]


def test_segment_suffix():
    vocab = DEFAULT_VOCABULARY.with_segment_suffix("_x")
    assert dict(vocab.tier_segments)["P2"] == "S3_x"
    assert vocab.override_segment == "S7_x"


def test_variants(spark):
    log = frame(spark, "assignments", [
        {"campaign_id": "a", "run_date": "2024-01-01", "run_ts": "2024-01-01T01:00:00",
         "variant": "x", "event_id": 1},
        {"campaign_id": "a", "run_date": "2024-01-01", "run_ts": "2024-01-01T02:00:00",
         "variant": "y", "event_id": 2},
        {"campaign_id": "a", "run_date": "2024-01-02", "run_ts": "2024-01-02T01:00:00",
         "variant": "x", "event_id": 3}])
    assert rows(latest_variant(log), "variant") == [("x",), ("y",)]
    assert rows(latest_variant(log, [date(2024, 1, 1)]), "variant") == [("y",)]
    assert distinct_variants(log).count() == 3


def _offer(offer_id, **changes):
    return {"offer_id": offer_id, "dt": "2024-01-05", "hr": 1, "updated_at": 1, "event_id": offer_id,
            "lock_flag": "true", "store_ids": ["1"], "city_ids": [], "customer_ids": None,
            "service_fee_type": 0, "tags": []} | changes


def test_offer_lock_meta(spark):
    offer_log = frame(spark, "offer_events", [
        _offer(1),                                              # stores only
        _offer(2, service_fee_type=None),                       # unknown fee type
        _offer(3, store_ids=None),                              # unknown stores
        _offer(4, store_ids=[]),
        _offer(5, city_ids=["c"]),
        _offer(6, customer_ids=["c"], lock_flag="FALSE"),
        _offer(7, service_fee_type=1, lock_flag=""),
        _offer(8, service_fee_type=1, lock_flag=None),
        _offer(9, service_fee_type=1, lock_flag="TRUE", tags=None),
        _offer(10, tags=[{"value": "a"}, {"value": "NBH_OFFER"}]),
        _offer(11, tags=[{"value": None}, {"value": "a"}])])
    got = rows(offers.offer_lock_meta(offer_log).orderBy("offer_id"))
    by_id = {r[0]: r[1:] for r in got}
    assert {i: m[0] for i, m in by_id.items()} == \
        {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 0, 7: 0, 8: 0, 9: 1, 10: 1, 11: 1}
    assert {i for i, m in by_id.items() if m[1] == 0} == {1, 6, 7, 8, 10, 11}
    assert {i for i, m in by_id.items() if m[2] == 1} == {10}


def test_offer_windows_cut_before_ranking(spark):
    offer_log = frame(spark, "offer_events", [
        _offer(1, dt="2024-01-05", event_id=1, server_ts=5, ingestion_source="21"),
        _offer(1, dt="2024-02-05", event_id=2, server_ts=9, ingestion_source="7"),
        _offer(2, dt="2024-01-04", event_id=3, server_ts=9, ingestion_source="21"),
        _offer(2, dt="2024-01-05", event_id=4, server_ts=8, ingestion_source=None)])
    flags = offers.offer_managed_flag(offer_log, date(2024, 1, 10), 90)
    assert rows(flags) == [(1, "Managed"), (2, "Managed")]
    later = offers.offer_managed_flag(offer_log, date(2024, 2, 10), 20)
    assert rows(later) == [(1, "Unmanaged")]
    assert rows(offers.offer_lock_meta(offer_log, date(2024, 2, 1)), "offer_id") == [(1,)]


def _state(event_id, context, hour=1):
    return {"campaign_id": "a", "run_date": "2024-01-01", "event_id": event_id,
            "run_ts": f"2024-01-01T{hour:02d}:00:00", "campaign_context": context}


def _document(pack_id, total_burn="1.5"):
    return ('{"burn":{"total_burn":%s},"stores":[{"store_id":"7","pack_selections":[{"pack_id":"%s",'
            '"segment":"S1","slot":"lunch","store_seg":"RTR","emit_segment":"E"}]}]}'
            % (total_burn, pack_id))


def test_context_documents(spark):
    state = frame(spark, "campaign_state", [
        _state(1, None), _state(2, ""), _state(3, "{bad"), _state(4, '{"stores":[]}'),
        _state(5, '{"burn":{}}'), _state(6, '{"stores":[{"store_id":"1"}]}'),
        _state(7, '{"stores":[{"store_id":8,"pack_selections":[{"pack_id":"T1"}]}]}'),
        _state(8, _document("T2_O")), _state(9, _document("T3_O", '"text"'))])
    got = rows(packs.explode_context(state), "event_id", "store_id", "pack_id", "total_burn")
    assert got == [(7, "8", "T1", None), (8, "7", "T2_O", 1.5), (9, "7", "T3_O", None)]


def test_mapping_keeps_the_newest_run_and_carries_the_variant(spark):
    state = frame(spark, "campaign_state", [
        _state(1, _document("T2_O", "1"), 1), _state(2, _document("T2_O", "2"), 2),
        _state(3, _document("T3_O", "3"), 1)])
    plain = packs.pack_mapping(state)
    assert rows(plain, "pack_id", "total_burn", "variant") == [
        ("T2_O", 2.0, None), ("T3_O", 3.0, None)]
    assert len(plain.columns) == 11 + len(BURN_FIELDS)
    variants = spark.createDataFrame([("a", date(2024, 1, 1), "x")],
                                     "campaign_id STRING, run_date DATE, variant STRING")
    assert rows(packs.pack_mapping(state, variants=variants), "variant") == [("x",), ("x",)]
    assert packs.pack_mapping(state, date(2024, 1, 2)).count() == 0


def test_identities_are_the_mapping_keys(spark):
    state = frame(spark, "campaign_state", [
        _state(1, _document("T2_O", "1"), 1), _state(2, _document("T2_O", "2"), 2),
        _state(3, _document("T3_O", "3"), 1)])
    assert rows(packs.pack_identities(state)) == \
        rows(packs.pack_mapping(state), *packs.PACK_KEYS)

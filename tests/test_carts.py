from __future__ import annotations

from datetime import date, datetime, timezone

from promolens.operators import carts
from promolens.operators.orders import money_as_double
from promolens.params import ReportParams
from promolens.plans import cart_funnel_by_pack, cart_funnel_by_variant
from promolens.plans.efficiency import efficiency
from promolens.operators.packs import pack_mapping
from promolens.sources import Frames, write_pack_mapping
from tests.builders import frame, rows

DAY = "2024-05-10"
PARAMS = ReportParams(start=date(2024, 5, 9), end=date(2024, 5, 10), month=date(2024, 5, 1),
                      as_of=datetime(2024, 5, 11, 12, tzinfo=timezone.utc))


def cart(cart_id, **changes):
    return {"dt": DAY, "cart_id": cart_id, "cart_state": "CART_UPDATED", "customer_id": 1,
            "store_id": "1", "ts": f"{DAY}T12:00:00", "item_total": 150, "coupon_discount": 0,
            "item_store_discount": 0, "item_platform_discount": 0} | changes


def prior(order_id, day, **changes):
    return {"dt": day, "order_id": order_id, "customer_id": 1, "store_id": "1", "gmv": 10,
            "excluded_flag": 0, "ignore_flag": 0, "post_status": "Completed"} | changes


def test_grain_sums_and_flags(spark):
    log = frame(spark, "carts", [
        cart(1, coupon_discount=5), cart(1, item_total=100, coupon_discount=None),
        cart(2, ts=f"{DAY}T23:00:00", item_store_discount=1, item_platform_discount=None),
        cart(3, item_store_discount=1, item_platform_discount=2),
        cart(4, dt="2024-05-08")])
    grain = carts.cart_grain(log, PARAMS.start, PARAMS.end)
    assert rows(money_as_double(grain), "cart_id", "slot", "cart_value", "coupon_flag",
                "item_discount", "item_flag", "cart_bucket") == [
        (1, "lunch", 250.0, 1, 0.0, 0, "c_200_300"),
        (2, "latenight_breakfast", 150.0, 0, None, 0, "b_100_200"),
        (3, "lunch", 150.0, 0, 3.0, 1, "b_100_200")]


def repeats_for(spark, priors, cart_rows=None, lookback=90):
    log = frame(spark, "carts", cart_rows or [cart(1)])
    before = carts.prior_orders(frame(spark, "orders", priors), PARAMS.start, PARAMS.end, lookback)
    return rows(carts.repeat_carts(log, before, lookback), "cart_id")


def test_lookback_bounds(spark):
    """From 90 days before up to the day before, same customer and store."""
    assert repeats_for(spark, [prior(1, "2024-05-10")]) == []
    assert repeats_for(spark, [prior(1, "2024-05-09")]) == [(1,)]
    assert repeats_for(spark, [prior(1, "2024-02-10")]) == [(1,)]
    assert repeats_for(spark, [prior(1, "2024-02-09")]) == []
    assert repeats_for(spark, [prior(1, "2024-05-09", store_id="2")]) == []
    assert repeats_for(spark, [prior(1, "2024-05-09", customer_id=2)]) == []
    assert repeats_for(spark, [prior(1, "2024-05-09", post_status="Cancelled")]) == []
    assert repeats_for(spark, [prior(1, "2024-05-09", ignore_flag=None)]) == []
    assert repeats_for(spark, [prior(1, "2024-05-09", excluded_flag=None)]) == [(1,)]


def test_missing_customers_never_repeat(spark):
    assert repeats_for(spark, [prior(1, "2024-05-09", customer_id=None)],
                       [cart(1, customer_id=None)]) == []


def test_one_repeat_customer_marks_the_whole_cart(spark):
    log = frame(spark, "carts", [cart(1), cart(1, customer_id=2), cart(2, customer_id=2),
                                 cart(None)])
    grain = carts.cart_grain(log, PARAMS.start, PARAMS.end)
    repeats = spark.createDataFrame([(date(2024, 5, 10), 1)], "dt DATE, cart_id BIGINT")
    assert rows(carts.with_repeat_flag(grain, repeats), "cart_id", "customer_id",
                "repeat_flag") == [(1, 1, "RTR"), (1, 2, "RTR"), (2, 2, "NTR")]


def document(*picks):
    chosen = ",".join(
        '{"pack_id":"%s","segment":"S3","slot":"lunch","store_seg":"NTR","emit_segment":"%s"}' % p
        for p in picks)
    return '{"stores":[{"store_id":"1","pack_selections":[%s]}]}' % chosen


def funnel_frames(spark):
    def state(campaign_id, event_id, *picks):
        return {"campaign_id": campaign_id, "run_date": DAY, "run_ts": f"{DAY}T01:00:00",
                "event_id": event_id, "campaign_context": document(*picks)}

    return Frames(
        campaign_state=frame(spark, "campaign_state", [
            state("a", 1, ("T1_O", "E0"), ("T1_O", "E1"), ("T2", "E0")),
            state("b", 2, ("T1_O", "E0"))]),
        carts=frame(spark, "carts", [
            cart(1, coupon_discount=5), cart(1, cart_state="PLACE_ORDER", coupon_discount=2),
            cart(2)]),
        orders=frame(spark, "orders", [prior(1, "2024-05-10", customer_id=4)]),
        customer_tiers=frame(spark, "customer_tiers", [
            {"customer_id": 1, "dt": "2024-05-01", "tier": "P2"}]),
        segment_override=frame(spark, "segment_override", [
            {"customer_id": 8, "segment": "S7", "dt": "2024-05-01"}]),
        assignments=frame(spark, "assignments", [
            {"campaign_id": "a", "run_date": DAY, "run_ts": f"{DAY}T01:00:00", "variant": "x",
             "event_id": 1}]),
        offer_lines=frame(spark, "offer_lines", [
            {"dt": DAY, "hr": 12, "order_id": 1, "store_id": "1", "order_status": "completed",
             "city_code": "1", "store_discount": 4},
            {"dt": DAY, "hr": 12, "order_id": 1, "store_id": "2", "order_status": "completed",
             "city_code": "1", "store_discount": 4}]))


def test_funnel_counts_carts_once_and_sums_per_mapping_row(spark):
    report = cart_funnel_by_pack(funnel_frames(spark), PARAMS)
    assert rows(report, "pack_id", "tier", "mode_part", "cart_count", "order_carts",
                "coupon_carts", "coupon_order_carts", "coupon_discount_value",
                "coupon_cart_value") == [
        ("T1_O", "T1", "O", 2, 1, 1, 1, 21.0, 900.0), ("T2", "T2", None, 2, 1, 1, 1, 7.0, 300.0)]


def test_funnel_by_variant_keeps_choices_without_carts(spark):
    frames = funnel_frames(spark)
    report = cart_funnel_by_variant(frames, PARAMS)
    assert rows(report, "tier", "mode", "variant", "cart_count", "placed_cart_count") == [
        ("T1", "5_O", "x", 2, 1), ("T1", "5_O", None, 2, 1), ("T2", None, "x", 2, 1)]
    empty = Frames(**{**frames.__dict__, "carts": frames.carts.limit(0)})
    assert rows(cart_funnel_by_variant(empty, PARAMS), "cart_count") == [(0,)] * 3


def test_stored_mapping_gives_the_same_reports(spark, tmp_path):
    frames = funnel_frames(spark)
    tiers = frame(spark, "customer_tiers", [{"customer_id": 4, "dt": "2024-05-01", "tier": "P2"}])
    frames = Frames(**{**frames.__dict__, "customer_tiers": tiers.union(frames.customer_tiers)})
    path = str(tmp_path / "mapping")
    for _ in range(2):
        write_pack_mapping(pack_mapping(frames.campaign_state), path=path)
    stored = spark.read.parquet(path)
    assert stored.count() == 4
    assert rows(cart_funnel_by_pack(frames, PARAMS, mapping=stored)) == \
        rows(cart_funnel_by_pack(frames, PARAMS))
    fresh = rows(efficiency(frames, PARAMS))
    assert len(fresh) == 2
    assert rows(efficiency(frames, PARAMS, mapping=stored)) == fresh
    unpruned = ReportParams(**{**PARAMS.__dict__, "max_broadcast_rows": 0})
    assert rows(efficiency(frames, unpruned, mapping=stored)) == fresh


def counted(carts_rows, pack_rows):
    """The funnel's counts by hand: carts and sums per (pack, bucket), a cart once however many days."""
    found = {}
    for r in carts_rows:
        for dt, pack, copies in pack_rows:
            if dt != r["dt"]:
                continue
            key = (pack, r["cart_bucket"])
            seen, sums = found.setdefault(key, ({}, [None]))
            marks = seen.setdefault(r["cart_id"], [0] * 5)
            placed, coupon, item = r["cart_state"] == "PLACE_ORDER", r["coupon_flag"] == 1, r["item_flag"] == 1
            for i, mark in enumerate((placed, coupon, coupon and placed, item, item and placed)):
                marks[i] |= mark
            if coupon:
                sums[0] = (sums[0] or 0) + r["cart_value"] * copies
    return [(*key, len(seen), *[sum(m[i] for m in seen.values()) for i in range(5)], sums[0])
            for key, (seen, sums) in found.items()]


def test_carts_of_several_days_count_once_per_pack(spark):
    """Packs are chosen on some days only, and a cart has other marks on other days."""
    days = [date(2024, 5, d) for d in (1, 2, 3)]
    made = [{"dt": days[(i * k + k) % 3], "cart_id": i // 2 if i % 20 else None, "cart_state": ("PLACE_ORDER", "X")[(i + k) % 2],
             "coupon_flag": i * k % 3 % 2, "item_flag": (i + k) % 5 % 2, "store_id": "1",
             "customer_segment": "S3", "repeat_flag": "NTR", "slot": "lunch", "cart_bucket": (None, "a", "b")[i // 7 % 3],
             "cart_value": float(i), "coupon_discount": 1.0} for i in range(120) for k in (1, 2, 3, 4)]
    packs = [(days[0], "T1", 2), (days[1], "T1", 1), (days[1], "T2", 3), (days[2], "T3", 1)]
    log = spark.createDataFrame(made, "dt date, cart_id long, cart_state string, coupon_flag int, item_flag int, "
                                "store_id string, customer_segment string, repeat_flag string, slot string, "
                                "cart_bucket string, cart_value double, coupon_discount double")
    chosen = spark.createDataFrame([(d, "1", "S3", "NTR", "lunch", p, c) for d, p, c in packs],
                                   "dt date, store_id string, customer_segment string, repeat_flag string, "
                                   "slot string, pack_id string, copies int")
    want = counted(made, packs)
    for bucketed in (False, True):
        got = carts.cart_funnel(log, chosen, bucketed=bucketed).select(
            "pack_id", "cart_bucket", "cart_count", "order_carts", "coupon_carts", "coupon_order_carts",
            "item_discount_carts", "item_discount_order_carts", "coupon_cart_value").collect()
        order = lambda r: (r[0], r[1] or "")
        assert sorted(map(tuple, got), key=order) == sorted(want, key=order)

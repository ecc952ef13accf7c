"""The forms built for scale give the rows of the direct ones."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from promolens.operators import carts
from promolens.operators.cdc import asof_snapshot
from promolens.operators.orders import order_measures, sum_measures
from tests.builders import rows

FIRST = date(2024, 1, 1)


def _day(rng, days):
    return FIRST + timedelta(days=rng.randrange(days))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_snapshot_is_the_ranked_theta_join(spark, seed):
    rng = random.Random(seed)
    log = spark.createDataFrame(
        [(rng.choice("abcdefgh"), rng.randrange(5, 40) * 86_400 + rng.randrange(86_400), i)
         for i in range(300)], "id STRING, at BIGINT, event_id BIGINT")
    log = log.withColumn("day", F.date_add(F.lit(FIRST), (F.col("at") / 86_400).cast("int")))
    spine = spark.createDataFrame(
        [(FIRST + timedelta(days=d),) for d in rng.sample(range(60), 12)], "as_of_dt DATE")
    log.createOrReplaceTempView("log_of_test")
    spine.createOrReplaceTempView("spine_of_test")
    direct = spark.sql("""
        SELECT as_of_dt, id, event_id FROM (
            SELECT s.as_of_dt, l.*, row_number() OVER (
                PARTITION BY s.as_of_dt, l.id ORDER BY l.at DESC, l.event_id DESC) AS place
            FROM spine_of_test s LEFT JOIN log_of_test l ON l.day <= s.as_of_dt)
        WHERE place = 1""")
    scaled = asof_snapshot(log, spine, ["id"], "day", ["at", "event_id"])
    assert rows(scaled, "as_of_dt", "id", "event_id") == rows(direct)
    assert scaled.groupBy("as_of_dt", "id").count().where("count > 1").count() == 0


@pytest.mark.parametrize("lookback", [1, 7, 90])
def test_repeat_flag_is_the_range_join(spark, lookback):
    rng = random.Random(lookback)
    visits = spark.createDataFrame(
        [(_day(rng, 40), rng.randrange(400), rng.choice([1, 2, 3, 4, None]),
          str(rng.randrange(6))) for _ in range(600)],
        "dt DATE, cart_id BIGINT, customer_id BIGINT, store_id STRING")
    prior = spark.createDataFrame(
        {(rng.randrange(1, 6), str(rng.randrange(6)), _day(rng, 40)) for _ in range(80)},
        "customer_id BIGINT, store_id STRING, order_dt DATE")
    visits.createOrReplaceTempView("visits_of_test")
    prior.createOrReplaceTempView("prior_of_test")
    direct = spark.sql(f"""
        SELECT dt, cart_id FROM (
            SELECT c.dt, c.cart_id, max(if(p.customer_id IS NULL, 0, 1)) AS seen
            FROM visits_of_test c LEFT JOIN prior_of_test p
              ON p.customer_id = c.customer_id AND p.store_id = c.store_id
             AND p.order_dt < c.dt AND datediff(c.dt, p.order_dt) <= {lookback}
            GROUP BY c.dt, c.cart_id)
        WHERE seen = 1""")
    assert rows(carts.repeat_carts(visits, prior, lookback)) == rows(direct)
    days = prior.groupBy("customer_id", "store_id").agg(F.collect_set("order_dt").alias("order_days"))
    flagged = carts.flag_repeats(visits, days, lookback)
    assert rows(flagged) == rows(carts.with_repeat_flag(visits, carts.repeat_carts(
        visits, prior, lookback)).select(*flagged.columns))


def test_funnel_is_six_distinct_counts(spark):
    rng = random.Random(5)
    labelled = spark.createDataFrame(
        [(FIRST + timedelta(days=rng.randrange(2)), str(rng.randrange(2)), "S1", "NTR", "lunch",
          rng.choice(["a", "b", None]), rng.randrange(60), rng.choice(["PLACE_ORDER", "OTHER"]),
          rng.randrange(2), rng.randrange(2), float(rng.randrange(9)), float(rng.randrange(99)))
         for _ in range(500)],
        "dt DATE, store_id STRING, customer_segment STRING, repeat_flag STRING, slot STRING, "
        "cart_bucket STRING, cart_id BIGINT, cart_state STRING, coupon_flag INT, item_flag INT, "
        "coupon_discount DOUBLE, cart_value DOUBLE")
    mapping = spark.createDataFrame(
        [(FIRST + timedelta(days=rng.randrange(2)), str(rng.randrange(3)), "S1",
          rng.choice(["NTR", "RTR"]), "lunch", rng.choice(["T1_O", "T2_A"])) for _ in range(25)],
        "run_date DATE, store_id STRING, segment STRING, store_seg STRING, slot STRING, "
        "pack_id STRING")
    labelled.createOrReplaceTempView("labelled_of_test")
    mapping.createOrReplaceTempView("mapping_of_test")
    direct = spark.sql("""
        SELECT c.store_id, m.pack_id, c.cart_bucket,
               count(DISTINCT cart_id) AS a,
               count(DISTINCT cart_id) FILTER (WHERE cart_state = 'PLACE_ORDER') AS b,
               count(DISTINCT cart_id) FILTER (WHERE coupon_flag = 1) AS c,
               count(DISTINCT cart_id) FILTER (
                   WHERE coupon_flag = 1 AND cart_state = 'PLACE_ORDER') AS d,
               count(DISTINCT cart_id) FILTER (WHERE item_flag = 1) AS e,
               count(DISTINCT cart_id) FILTER (
                   WHERE item_flag = 1 AND cart_state = 'PLACE_ORDER') AS f,
               sum(coupon_discount) FILTER (WHERE coupon_flag = 1) AS g,
               sum(cart_value) FILTER (WHERE coupon_flag = 1) AS h
        FROM labelled_of_test c JOIN mapping_of_test m
          ON c.dt = m.run_date AND c.store_id = m.store_id AND c.customer_segment = m.segment
         AND c.repeat_flag = m.store_seg AND c.slot = m.slot
        GROUP BY ALL""")
    funnel = carts.cart_funnel(labelled, carts.pack_multiplicity(mapping))
    assert rows(funnel, "store_id", "pack_id", "cart_bucket", "cart_count", "order_carts",
                "coupon_carts", "coupon_order_carts", "item_discount_carts",
                "item_discount_order_carts", "coupon_discount_value",
                "coupon_cart_value") == rows(direct)


def test_order_flags_are_distinct_counts(spark):
    rng = random.Random(6)
    grain = spark.createDataFrame(
        [(_day(rng, 2), str(rng.randrange(2)), rng.randrange(4), rng.randrange(30),
          float(rng.randrange(5)), float(rng.randrange(-1, 3))) for _ in range(300)],
        "dt DATE, store_id STRING, customer_id BIGINT, order_id BIGINT, gmv DOUBLE, "
        "total_discount DOUBLE")
    grain.createOrReplaceTempView("grain_of_test")
    direct = spark.sql("""
        SELECT dt, store_id, customer_id, count(DISTINCT order_id),
               count(DISTINCT CASE WHEN total_discount > 0 THEN order_id END),
               sum(gmv), sum(total_discount)
        FROM grain_of_test GROUP BY ALL""")
    keys = ["dt", "store_id", "customer_id"]
    flagged = sum_measures(order_measures(grain, keys), keys)
    assert rows(flagged) == rows(direct)

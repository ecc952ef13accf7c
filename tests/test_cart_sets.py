"""Distinct carts from bitmaps against plain distinct counts."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from promolens.operators.cart_sets import TASK, cart_set_counts, cart_sets, number_carts, stored_cart_numbers

SCHEMA = "dt date, cart_id {}, cart_state string, store_id long"


def _rows(days, text):
    """Carts of several days and stores; store 1 has a third of all rows."""
    out = []
    for i in range(3000):
        cart = i // 3 if i % 50 else None
        out.append((date(2024, 1, 1) + timedelta(i * 7 % days), f"c{cart}" if text and cart is not None else cart,
                    "PLACE_ORDER" if i % 4 == 0 else "CART_UPDATED", 1 if i % 3 == 0 else i % 11))
    return out


def _exact(carts, group):
    placed = F.when(F.col("cart_state") == "PLACE_ORDER", F.col("cart_id"))
    return carts.where("cart_id IS NOT NULL").groupBy(*group).agg(
        F.countDistinct("cart_id").alias("cart_count"), F.countDistinct(placed).alias("placed_cart_count"))


@pytest.mark.parametrize("text", [False, True])
def test_counts_over_days_come_from_daily_sets(spark, tmp_path, text):
    carts = spark.createDataFrame(_rows(20, text), SCHEMA.format("string" if text else "long"))
    numbers, stored = str(tmp_path / "numbers"), str(tmp_path / "sets")
    for part in (F.col("dt") <= "2024-01-05", F.col("dt") > "2024-01-05", F.lit(False)):
        some = carts.where(part)
        number_carts(some, numbers)
        cart_sets(some, stored_cart_numbers(spark, numbers), ["dt", "store_id"]).write.mode("append").parquet(stored)
    given = stored_cart_numbers(spark, numbers)
    ids = carts.where("cart_id IS NOT NULL").select("cart_id").distinct().count()
    assert given.count() == ids == given.select("cart_number").distinct().count()
    assert given.select("cart_id").distinct().count() == ids
    sets = spark.read.parquet(stored)
    for group in (["dt", "store_id"], ["store_id"], ["dt"], []):
        assert sorted(cart_set_counts(sets, group).collect()) == sorted(_exact(carts, group).collect())


def test_numbering_again_gives_no_new_numbers(spark, tmp_path):
    carts = spark.createDataFrame(_rows(5, False), SCHEMA.format("long"))
    path = str(tmp_path / "numbers")
    number_carts(carts, path)
    before = sorted(stored_cart_numbers(spark, path).collect())
    number_carts(carts, path)
    assert sorted(stored_cart_numbers(spark, path).collect()) == before
    assert len({number // TASK for _, number in before}) <= 8


def test_carts_of_a_store_share_bitmaps(spark, tmp_path):
    carts = spark.createDataFrame(_rows(1, False), SCHEMA.format("long"))
    path = str(tmp_path / "numbers")
    number_carts(carts, path)
    sets = cart_sets(carts, stored_cart_numbers(spark, path), ["dt", "store_id"])
    assert sets.count() <= 11 * 8
    assert sets.where("length(carts) != 4096").count() == 0


def test_no_carts(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA.format("long"))
    path = str(tmp_path / "numbers")
    assert stored_cart_numbers(spark, path) is None
    number_carts(none, path)
    sets = cart_sets(none, stored_cart_numbers(spark, path), ["dt", "store_id"])
    assert cart_set_counts(sets, ["store_id"]).collect() == []

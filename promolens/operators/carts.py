"""Carts: grain, flags, repeat customers and funnel counts."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from promolens.functions import cart_value_bucket, slot_of
from promolens.operators.joins import split_join
from promolens.operators.orders import eligible_orders
from promolens.vocabulary import DEFAULT_VOCABULARY, Vocabulary


def carts_between(carts: DataFrame, start: date, end: date) -> DataFrame:
    return carts.where(F.col("dt").between(F.lit(start), F.lit(end)))


def cart_grain(carts: DataFrame, start: date, end: date,
               vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Sums per (dt, cart, state, customer, store, slot), with flags and value bucket."""
    item_level = F.sum("item_store_discount") + F.sum("item_platform_discount")
    return (carts_between(carts, start, end)
            .groupBy("dt", "cart_id", "cart_state", "customer_id", "store_id",
                     slot_of(F.hour("ts"), vocab).alias("slot"))
            .agg(F.sum("item_total").alias("cart_value"),
                 F.sum("coupon_discount").alias("coupon_discount"),
                 item_level.alias("item_discount"))
            .withColumn("coupon_flag", F.when(F.col("coupon_discount") > 0, 1).otherwise(0))
            .withColumn("item_flag", F.when(F.col("item_discount") > 0, 1).otherwise(0))
            .withColumn("cart_bucket", cart_value_bucket(F.col("cart_value"), vocab)))


def prior_orders(orders: DataFrame, start: date, end: date, lookback_days: int = 90,
                 vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Distinct (customer, store, order date) of completed orders, lookback included."""
    kept = eligible_orders(orders, start - timedelta(days=lookback_days), end,
                           completed_only=True, vocab=vocab)
    return kept.select("customer_id", "store_id", F.col("dt").alias("order_dt")).distinct()


def repeat_carts(carts: DataFrame, prior: DataFrame, lookback_days: int = 90) -> DataFrame:
    """Distinct (dt, cart) whose customer ordered from the store in the days before.

    An existence test as a semi join: nothing fans out, ``prior`` has at most
    one row per customer, store and calendar day, and Spark can split a hot
    customer-store pair on the cart side.
    """
    visits = carts.select("dt", "cart_id", "customer_id", "store_id").alias("cart")
    seen = ((F.col("cart.customer_id") == F.col("prior.customer_id"))
            & (F.col("cart.store_id") == F.col("prior.store_id"))
            & (F.col("prior.order_dt") < F.col("cart.dt"))
            & (F.col("prior.order_dt") >= F.date_add("cart.dt", -lookback_days)))
    return (visits.join(prior.alias("prior"), seen, "left_semi")
            .select("dt", "cart_id").distinct())


def order_days(orders: DataFrame, start: date, end: date, lookback_days: int = 90,
               vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Per customer and store the days with completed orders, lookback included, as one array.

    Days fold before the one shuffle, and an array has at most one entry per
    calendar day of the window, however often a customer orders.
    """
    kept = eligible_orders(orders, start - timedelta(days=lookback_days), end,
                           completed_only=True, vocab=vocab)
    return (kept.where(F.col("customer_id").isNotNull() & F.col("store_id").isNotNull())
            .groupBy("customer_id", "store_id")
            .agg(F.collect_set("dt").alias("order_days")))


def flag_repeats(grain: DataFrame, days: DataFrame, lookback_days: int = 90,
                 vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Cart rows with the repeat/new label of their (dt, cart); rows without a cart id go.

    Equal to ``with_repeat_flag`` over ``repeat_carts``, but the carts are read
    once: each row meets the array of its customer and store in an equi join
    that adds no rows and whose hot pairs Spark can split, looks its days up
    there, and a window spreads the answer over the cart, as one repeat
    customer marks all its rows. ``grain`` should be folded by then
    (``cart_grain``), since the rows of one cart and day meet in one task.
    """
    def before(day: Column) -> Column:
        return (day < F.col("dt")) & (day >= F.date_add("dt", -lookback_days))

    known = split_join(grain.where(F.col("cart_id").isNotNull()), days,
                       ["customer_id", "store_id"], "left")
    cart = Window.partitionBy("dt", "cart_id")
    own = F.coalesce(F.exists("order_days", before), F.lit(False))
    return (known.withColumn("_repeat", own).drop("order_days")
            .withColumn("repeat_flag", F.when(F.max("_repeat").over(cart), vocab.repeat)
                        .otherwise(vocab.new))
            .drop("_repeat"))


def with_repeat_flag(grain: DataFrame, repeats: DataFrame,
                     vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Cart rows with the repeat/new label of their (dt, cart); rows without a cart id go.

    One repeat customer marks all rows of a cart, as the flag belongs to the cart.
    """
    marked = repeats.withColumn("_repeat", F.lit(True))
    return (split_join(grain.where(F.col("cart_id").isNotNull()), marked, ["dt", "cart_id"],
                       "left")
            .withColumn("repeat_flag", F.when(F.col("_repeat"), vocab.repeat)
                        .otherwise(vocab.new))
            .drop("_repeat"))


def pack_multiplicity(mapping: DataFrame) -> DataFrame:
    """Packs per (date, store, segment, repeat flag, slot) with their number of rows.

    Campaigns and emit segments repeat a pack; joining them one by one would
    multiply cart rows, so their number travels as ``copies`` instead.
    """
    return (mapping.groupBy(F.col("run_date").alias("dt"), "store_id",
                            F.col("segment").alias("customer_segment"),
                            F.col("store_seg").alias("repeat_flag"), "slot", "pack_id")
            .agg(F.count(F.lit(1)).cast("int").alias("copies")))


def matched_packs(carts: DataFrame, packs: DataFrame) -> DataFrame:
    """Carts with their packs, by a join on the columns a bucketed mapping is dealt by.

    Packs travel as one array per (date, store, segment, slot), at most the
    pack rows of that choice, which each cart then filters by its repeat flag.
    On a bucketed mapping both steps and the join keep its layout.
    """
    lookup = ["dt", "store_id", "customer_segment", "slot"]
    choices = packs.groupBy(*lookup).agg(F.collect_list(
        F.struct("repeat_flag", "pack_id", "copies")).alias("_packs"))
    own = F.filter("_packs", lambda pack: pack["repeat_flag"] == F.col("repeat_flag"))
    return (carts.join(choices, lookup).withColumn("_pack", F.explode(own))
            .select("*", "_pack.pack_id", "_pack.copies").drop("_packs", "_pack"))


def carts_by_day(carts: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Carts folded per (lookup columns of their packs, value bucket, ``several``).

    A cart seen on one day of its (store, segment, repeat flag, slot, bucket)
    has no ``several`` and is counted in one row of that day. A cart seen on
    several days carries them, with what was marked on each, and meets the
    carts of the same days and marks: all of them match a pack on the same
    days, so a pack counts them at most once by the largest of its days' rows.
    """
    choice = ["store_id", "customer_segment", "repeat_flag", "slot", "cart_bucket"]
    placed = F.col("cart_state") == vocab.placed_state
    coupon = F.col("coupon_flag") == 1
    item = F.col("item_flag") == 1
    marks = {"cart_count": F.lit(True), "order_carts": placed,
             "coupon_carts": coupon, "coupon_order_carts": coupon & placed,
             "item_discount_carts": item, "item_discount_order_carts": item & placed}
    sums = {"coupon_discount_value": "coupon_discount", "coupon_cart_value": "cart_value"}
    # Dealt by what both the rows per day and the window ask for: one shuffle for the two.
    per_day = carts.repartition("cart_id", *choice).groupBy("cart_id", *choice, "dt").agg(
        *[F.max(F.when(test, 1).otherwise(0)).alias(name) for name, test in marks.items()],
        *[F.sum(F.when(coupon, F.col(name))).alias(alias) for alias, name in sums.items()])
    cart = Window.partitionBy("cart_id", *choice)
    days = F.array_sort(F.collect_list(F.struct("dt", *marks)).over(cart))
    return (per_day.withColumn("several", F.when(F.count(F.lit(1)).over(cart) > 1, days))
            .groupBy("dt", *choice, "several")
            .agg(*[F.sum(name).alias(name) for name in (*marks, *sums)]))


def cart_funnel(carts: DataFrame, packs: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY,
                bucketed: bool = False) -> DataFrame:
    """Distinct cart counts and sums per pack, segment, repeat flag, slot and value bucket.

    ``carts`` carries the labels, ``packs`` comes from ``pack_multiplicity``;
    ``bucketed`` says that its mapping is stored in buckets.
    Carts are folded before they meet the packs, so a cart is not copied for
    each pack of its store and day, and the six distinct counts are sums.
    """
    group = ["store_id", "pack_id", "customer_segment", "repeat_flag", "slot", "cart_bucket"]
    counts = ["cart_count", "order_carts", "coupon_carts", "coupon_order_carts",
              "item_discount_carts", "item_discount_order_carts"]
    sums = ["coupon_discount_value", "coupon_cart_value"]
    folded = carts_by_day(carts, vocab)
    matched = matched_packs(folded, packs) if bucketed else folded.join(
        packs, ["dt", "store_id", "customer_segment", "repeat_flag", "slot"])
    once = F.col("several").isNull()
    per_days = matched.groupBy(*group, "several").agg(
        *[F.when(once, F.sum(name)).otherwise(F.max(name)).alias(name) for name in counts],
        *[F.sum(F.col(name) * F.col("copies")).alias(name) for name in sums])
    return per_days.groupBy(*group).agg(*[F.sum(name).alias(name) for name in (*counts, *sums)])


def cart_counts(carts: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Distinct carts and distinct placed carts per (dt, store, segment)."""
    group = ["dt", "store_id", "customer_segment"]
    placed = F.max(F.when(F.col("cart_state") == vocab.placed_state, 1).otherwise(0))
    return (carts.where(F.col("cart_id").isNotNull())
            .groupBy(*group, "cart_id").agg(placed.alias("placed"))
            .groupBy(*group).agg(F.count(F.lit(1)).alias("cart_count"),
                                 F.sum("placed").alias("placed_cart_count")))

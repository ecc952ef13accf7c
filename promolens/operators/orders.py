"""Orders and their discount lines: eligibility, order grain, metrics."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolens.functions import is_unset
from promolens.vocabulary import DEFAULT_VOCABULARY, Vocabulary

DISCOUNTS = ("store_discount", "platform_discount", "total_discount")
TAGGED = ("tagged_store_discount", "tagged_platform_discount", "tagged_discount")
COUNTS = ("completed_orders", "discounted_orders")


def _in_dates(start: date | None, end: date | None, dates: Sequence[date] | None) -> Column:
    test = F.lit(True)
    if start is not None:
        test &= F.col("dt") >= F.lit(start)
    if end is not None:
        test &= F.col("dt") <= F.lit(end)
    if dates is not None:
        test &= F.col("dt").isin(list(dates))
    return test


def eligible_lines(lines: DataFrame, start: date | None = None, end: date | None = None,
                   dates: Sequence[date] | None = None, hour_cutoff: int | None = None,
                   vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Completed offer lines in the dates, outside the excluded city.

    A line without a city is dropped too, as is one without an hour when
    there is an hour cutoff.
    """
    kept = lines.where(_in_dates(start, end, dates)
                       & (F.col("order_status") == vocab.line_completed)
                       & (F.col("city_code") != vocab.excluded_city))
    return kept if hour_cutoff is None else kept.where(F.col("hr") <= hour_cutoff)


def eligible_orders(orders: DataFrame, start: date | None = None, end: date | None = None,
                    dates: Sequence[date] | None = None, check_ignored: bool = True,
                    completed_only: bool = False,
                    vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Orders in the dates whose excluded flag is 0 or missing.

    ``check_ignored`` also asks for an ignore flag of exactly 0, which the
    intraday orders do not have; ``completed_only`` for the completed status.
    """
    kept = orders.where(_in_dates(start, end, dates) & is_unset(F.col("excluded_flag")))
    if check_ignored:
        kept = kept.where(F.col("ignore_flag") == 0)
    if completed_only:
        kept = kept.where(F.col("post_status") == vocab.order_completed)
    return kept


def order_discount_grain(lines: DataFrame, orders: DataFrame, line_keys: Sequence[str] = (),
                         order_keys: Sequence[str] = ("gmv", "customer_id"),
                         tagged: bool = False) -> DataFrame:
    """Discount sums per (dt, order_id, store_id, line keys, order keys).

    Lines are summed per order before they meet the orders, so an order with
    very many lines reaches the join as a handful of rows. The sums after the
    join only matter if an order occurs several times; their keys contain the
    join keys, so they need no further shuffle. With ``tagged`` the lines must
    carry ``is_tagged``; the tagged sums stay NULL without a tagged line.
    """
    line_grain = ["dt", "order_id", "store_id", *line_keys]
    sums = {
        "store_discount": F.coalesce(F.col("store_discount"), F.lit(0)),
        "platform_discount": F.coalesce(F.col("platform_discount"), F.lit(0)),
    }
    if tagged:
        marked = F.col("is_tagged") == 1
        sums |= {f"tagged_{name}": F.when(marked, value) for name, value in sums.items()}
    per_line_grain = lines.groupBy(*line_grain).agg(
        *[F.sum(value).alias(name) for name, value in sums.items()])
    joined = per_line_grain.join(orders.select("order_id", "dt", *order_keys), ["order_id", "dt"])
    grain = (joined.groupBy(*line_grain, *order_keys)
             .agg(*[F.sum(name).alias(name) for name in sums])
             .withColumn("total_discount", F.col("store_discount") + F.col("platform_discount")))
    if tagged:
        grain = grain.withColumn(
            "tagged_discount",
            F.col("tagged_store_discount") + F.col("tagged_platform_discount"))
    return grain


def order_measures(grain: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (keys, order) with 0/1 order counts and the sums of the grain.

    Distinct order counts over ``keys`` are then plain sums of these flags,
    which combine before a shuffle; ``keys`` must contain ``dt`` so that this
    step reuses the partitioning of the order join.
    """
    values = [name for name in ("gmv", *DISCOUNTS, *TAGGED) if name in grain.columns]
    return (grain.groupBy(*keys, "order_id")
            .agg(F.max(F.when(F.col("total_discount") > 0, 1).otherwise(0))
                 .alias("discounted_orders"),
                 *[F.sum(name).alias(name) for name in values])
            .drop("order_id")
            .withColumn("completed_orders", F.lit(1)))


def measure_columns(df: DataFrame) -> list[str]:
    """The additive measures present in ``df``, in report order."""
    return [name for name in (*COUNTS, "gmv", *DISCOUNTS, *TAGGED) if name in df.columns]


def sum_measures(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in measure_columns(df)])


def store_customer_metrics(grain: DataFrame,
                           keys: Sequence[str] = ("dt", "store_id", "customer_id")) -> DataFrame:
    """Distinct orders, distinct discounted orders and sums per ``keys``."""
    return sum_measures(order_measures(grain, keys), keys)


def money_as_double(df: DataFrame) -> DataFrame:
    """Decimal columns as DOUBLE, for output only; sums run on exact decimals."""
    return df.select(*[F.col(name).cast("double").alias(name) if kind.startswith("decimal")
                       else F.col(name) for name, kind in df.dtypes])

"""Change-log operators: newest version per key, now or as of given dates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_per_key(log: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """Newest row per key; end ``order_cols`` with a unique column to break ties.

    The ``rank = 1`` shape lets Spark cut every map task down to one row per
    key before the shuffle, so a key holding most of the log stays cheap.
    """
    newest_first = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order_cols])
    return (log.withColumn("_rank", F.row_number().over(newest_first))
            .where(F.col("_rank") == 1)
            .drop("_rank"))


def date_spine(fact: DataFrame, dates: Sequence[date] | None = None, start: date | None = None,
               end: date | None = None, name: str = "as_of_dt") -> DataFrame:
    """Distinct fact dates in a list and/or an inclusive range; with a list, one bound may be open."""
    if dates is None and (start is None or end is None):
        raise ValueError("give a list of dates or both bounds")
    spine = fact.select(F.col("dt").alias(name))
    if dates is not None:
        spine = spine.where(F.col(name).isin(list(dates)))
    if start is not None:
        spine = spine.where(F.col(name) >= F.lit(start))
    if end is not None:
        spine = spine.where(F.col(name) <= F.lit(end))
    return spine.distinct()


def asof_snapshot(log: DataFrame, spine: DataFrame, keys: Sequence[str], version_date: str,
                  order_cols: Sequence[str], date_col: str = "as_of_dt") -> DataFrame:
    """For each spine date and key, the newest version dated on or before it.

    ``order_cols`` must start with the column ``version_date`` is derived
    from. A spine date older than every version keeps one row of NULLs.

    No join of dates with versions: each version is first reduced to the
    spine date that sees it first, one row per (key, spine date) survives the
    shuffle, and each survivor is then repeated for the dates up to the next
    survivor of its key. The spine is at most one row per calendar day, so it
    travels as one array.
    """
    calendar = spine.agg(F.array_sort(F.collect_set(date_col)).alias("_days"))
    days = calendar.scalar()
    seen = (log
            .withColumn("_days", days)
            .withColumn("_from", F.get(F.filter("_days", lambda day: day >= F.col(version_date)),
                                       F.lit(0)))
            .where(F.col("_from").isNotNull())
            .drop("_days"))
    newest = latest_per_key(seen, [*keys, "_from"], order_cols)
    until = F.lead("_from").over(Window.partitionBy(*keys).orderBy("_from"))

    def visible(day):
        return (day >= F.col("_from")) & (F.col("_until").isNull() | (day < F.col("_until")))

    matched = (newest
               .withColumn("_until", until)
               .withColumn("_days", days)
               .withColumn(date_col, F.explode(F.filter("_days", visible)))
               .drop("_days", "_from", "_until"))
    first_version = log.agg(F.min(version_date)).scalar()
    before_all = (calendar.select(F.explode("_days").alias(date_col))
                  .where(first_version.isNull() | (F.col(date_col) < first_version)))
    return (matched.select(date_col, *log.columns)
            .unionByName(before_all, allowMissingColumns=True))

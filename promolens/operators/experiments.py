"""Experiment variants per campaign and day."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolens.operators.cdc import latest_per_key
from promolens.operators.joins import split_join


def latest_variant(assignments: DataFrame, dates: Sequence[date] | None = None) -> DataFrame:
    """Newest variant per (run_date, campaign_id)."""
    if dates is not None:
        assignments = assignments.where(F.col("run_date").isin(list(dates)))
    return (latest_per_key(assignments, ["run_date", "campaign_id"], ["run_ts", "event_id"])
            .select("run_date", "campaign_id", "variant", "run_ts"))


def distinct_variants(assignments: DataFrame) -> DataFrame:
    """Every variant a campaign had on a day; joining it can multiply rows."""
    return assignments.select("campaign_id", "run_date", "variant").distinct()


def with_variant(rows: DataFrame, variants: DataFrame) -> DataFrame:
    """Rows with the variant of their (campaign_id, run_date), NULL where there is none."""
    return split_join(rows, variants.select("campaign_id", "run_date", "variant"),
                      ["campaign_id", "run_date"], "left")

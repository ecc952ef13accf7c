"""Small input frames for tests."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.schemas import FRAMES


def epoch(text: str) -> int:
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp())


def frame(spark: SparkSession, name: str, rows: list[dict]) -> DataFrame:
    """``rows`` as the named frame; columns a row leaves out are NULL.

    Values pass through JSON text, so write dates and decimals as text.
    """
    kinds = FRAMES[name]
    unknown = {key for row in rows for key in row} - set(kinds)
    assert not unknown, unknown
    schema = ", ".join(f"{column}: {kind}" for column, kind in kinds.items())
    texts = spark.createDataFrame([(json.dumps(row),) for row in rows], "row STRING")
    options = {"mode": "FAILFAST"}
    return texts.select(F.from_json("row", f"STRUCT<{schema}>", options).alias("r")).select("r.*")


def campaign(campaign_id: str, stores, updated: str, event_id: int, **changes) -> dict:
    """A campaign version running from a day before to a day after its update."""
    seconds = epoch(updated)
    row = {
        "campaign_id": campaign_id, "store_ids": stores, "updated_at": seconds,
        "created_at": seconds, "start_time": seconds - 86_400, "end_time": seconds + 86_400,
        "campaign_status": "Growth_CAMPAIGN_STATUS_ACTIVE", "smart_discount_enabled": True,
        "dt": updated[:10], "hr": int(updated[11:13] or 0), "event_id": event_id,
    }
    return row | changes


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(row) for row in picked.collect()), key=repr)

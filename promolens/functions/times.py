from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_text(seconds: Column) -> Column:
    """Epoch seconds as ``yyyy-MM-dd HH:mm:ss`` text in the session zone."""
    return F.from_unixtime(seconds)


def epoch_date(seconds: Column) -> Column:
    """Calendar date of epoch seconds in the session zone."""
    return F.to_date(F.timestamp_seconds(seconds))

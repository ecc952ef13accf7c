from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_unset(flag: Column) -> Column:
    """True for a 0 or missing integer flag."""
    return F.coalesce(flag, F.lit(0)) == 0

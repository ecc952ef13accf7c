"""One type boundary: whatever a table stores, the library sees ``schemas.FRAMES``."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolens.schemas import FLAG_COLUMNS, FRAMES, ID_COLUMNS


def _flag(col: Column) -> Column:
    """0 for a number or text equal to zero, 1 for any other value, NULL for NULL."""
    return (F.when(col.isNull(), F.lit(None).cast("int"))
            .when(col.try_cast("int") == 0, F.lit(0))
            .otherwise(F.lit(1)))


def _within(source: Column, stored: T.DataType, start: date | None, end: date | None) -> Column:
    """Both bounds in the type the table stores, so that they reach its scan."""
    after = None if end is None else end + timedelta(days=1)
    if isinstance(stored, T.StringType):
        low, high = start and start.isoformat(), after and after.isoformat()
    elif isinstance(stored, (T.TimestampType, T.TimestampNTZType)):
        low, high = (day and F.lit(datetime.combine(day, time())).cast(stored) for day in (start, after))
    else:
        source, low, high = source.cast("date"), start, after
    test = F.lit(True)
    if low is not None:
        test &= source >= (low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        test &= source < (high if isinstance(high, Column) else F.lit(high))
    return test


def normalise(df: DataFrame, frame: str, columns: Mapping[str, str] | None = None,
              text_ids: bool = False,
              between: Mapping[str, tuple[date | None, date | None]] | None = None) -> DataFrame:
    """Select and cast the columns of ``frame``.

    ``columns`` maps the library's column names to the names (or SQL
    expressions) of the table at hand; unnamed columns keep their name.
    A date or hour delivered as text becomes DATE or INT here, once, so no
    later comparison or ordering sees text. ``text_ids`` makes ids STRING, for
    tables whose ids are not numbers; give it for all frames that meet.

    ``between`` keeps the rows whose date column lies in an inclusive range, a
    bound may be open. A date that is stored as text must be ISO text there
    (``2024-01-05``, with or without a time behind it): the bounds are then
    compared as text, which the scan understands, whereas later bounds meet
    the cast column and skip no files or row groups.
    """
    columns = columns or {}
    for name, (start, end) in (between or {}).items():
        source = F.expr(columns.get(name, f"`{name}`"))
        stored = df.select(source.alias(name)).schema[0].dataType
        df = df.where(_within(source, stored, start, end))
    selected = []
    for name, kind in FRAMES[frame].items():
        source = F.expr(columns.get(name, f"`{name}`"))
        if text_ids and name in ID_COLUMNS:
            kind = "STRING"
        value = _flag(source) if name in FLAG_COLUMNS else source.cast(kind)
        selected.append(value.alias(name))
    return df.select(*selected)


def read_frame(spark: SparkSession, source: str, frame: str,
               columns: Mapping[str, str] | None = None, fmt: str | None = None,
               text_ids: bool = False,
               between: Mapping[str, tuple[date | None, date | None]] | None = None) -> DataFrame:
    """Read a catalog table, or a path when ``fmt`` names a file format."""
    df = spark.read.format(fmt).load(source) if fmt else spark.table(source)
    return normalise(df, frame, columns, text_ids, between)

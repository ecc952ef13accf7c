"""Result sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What all reports look packs up by; a bucketed mapping is dealt by it.
LOOKUP = ("run_date", "store_id", "segment", "slot")
#: How rows are sorted inside the files of a mapping that is stored by date.
FILE_ORDER = ("run_date", "store_id", "segment", "slot", "campaign_id")


def date_file(files_per_date: int) -> Column:
    """Which of its date's files a store's rows go to."""
    return F.pmod(F.xxhash64("store_id"), F.lit(files_per_date))


def write_bucketed_mapping(mapping: DataFrame, table: str, buckets: int, path: str | None = None,
                           fmt: str = "parquet", dealt: bool = False) -> None:
    """Replace the stored pack mapping by a table bucketed and sorted by ``LOOKUP``.

    Reports that look packs up by these columns then read each bucket where
    the join needs it: the mapping is shuffled once, when it is written, and
    not by its readers. ``buckets`` should be no less than the session's
    shuffle partitions, or Spark shuffles the mapping after all. Dates are the
    first sort column instead of folders, so a date window skips row groups.
    With a ``path`` the files lie there. ``dealt`` says that the mapping comes
    straight from ``pack_mapping(buckets=)`` with the same number, so that it
    is not shuffled again.
    """
    laid_out = (mapping if dealt else mapping.repartition(buckets, *LOOKUP)).sortWithinPartitions(*LOOKUP)
    writer = laid_out.write.mode("overwrite").format(fmt).bucketBy(buckets, *LOOKUP).sortBy(*LOOKUP)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def write_pack_mapping(mapping: DataFrame, table: str | None = None, path: str | None = None,
                       fmt: str = "parquet", files_per_date: int = 8,
                       only_dates: bool = False, dealt: bool = False) -> None:
    """Replace the stored pack mapping, to be built once and shared by the reports.

    One folder per run date, so a report's date window prunes folders. Rows
    are dealt by date and one of ``files_per_date`` store buckets: a day is
    spread over that many tasks and has at most that many files. Inside a file
    rows are sorted the way the reports look them up, which keeps row-group
    statistics selective.

    ``only_dates`` (paths only) replaces the dates that ``mapping`` holds and
    keeps the others. Spark drops what is replaced before the new files are
    all there, so a reader needs another copy while a write runs or has failed.
    ``dealt`` says that the mapping comes straight from
    ``pack_mapping(files_per_date=)`` with the same number, so that it is not
    shuffled again.
    """
    if (table is None) == (path is None):
        raise ValueError("name either a table or a path")
    if only_dates and table is not None:
        raise ValueError("single dates are replaced below a path only")
    laid_out = (mapping if dealt else mapping.repartition("run_date", date_file(files_per_date))
                ).sortWithinPartitions(*FILE_ORDER)
    writer = laid_out.write.mode("overwrite").format(fmt).partitionBy("run_date")
    writer = writer.option("partitionOverwriteMode", "dynamic" if only_dates else "static")
    if table:
        writer.saveAsTable(table)
    else:
        writer.save(path)


def publish_view(df: DataFrame, name: str) -> None:
    """Make ``df`` queryable by name in this session; nothing is computed here."""
    df.createOrReplaceTempView(name)

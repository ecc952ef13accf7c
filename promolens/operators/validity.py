"""Stored validity intervals of a change log, brought up to date with new rows only.

A version of a key is its newest row of a date; it is valid from that date to
the key's next version (``valid_to``, not included; NULL while it is the last).
As-of snapshots then read versions instead of ranking the whole log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from promolens.operators.cdc import latest_per_key
from promolens.operators.joins import staged

BUCKET = "key_bucket"


def merge_versions(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str],
                   version_date: str, order_cols: Sequence[str], buckets: int = 64) -> None:
    """Add log rows to the versions below ``path``, made if there are none.

    Versions lie in folders by a hash of the key. Only folders of keys with
    new rows are read and replaced, so a day's rows cost what their keys'
    versions cost, however long the log; more ``buckets`` make that finer.
    Late rows find their place, and rows that are merged again change nothing.
    A busy key is one row a date before it meets its stored versions. Spark
    drops a folder before its new files are there: keep readers away meanwhile,
    and merge the rows again after a failure, into a copy of the versions.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    dated = rows.where(F.col(version_date).isNotNull())
    fresh = staged(latest_per_key(dated, [*keys, version_date], order_cols).withColumn(BUCKET, place))
    touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]  # at most ``buckets``
    if not touched:
        return
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        stored = stored_versions(spark, path).where(F.col(BUCKET).isin(touched)).drop("valid_to")
        fresh = stored.unionByName(fresh)
    newest = latest_per_key(fresh, [*keys, version_date], order_cols)
    until = F.lead(version_date).over(Window.partitionBy(*keys).orderBy(version_date))
    # Staged, as what is read here is replaced by what is written.
    merged = staged(newest.withColumn("valid_to", until))
    (merged.repartition(BUCKET).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path))


def stored_versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def asof_versions(versions: DataFrame, spine: DataFrame, version_date: str,
                  date_col: str = "as_of_dt") -> DataFrame:
    """The rows of ``asof_snapshot`` over the log, from its stored versions.

    Each version is repeated for the spine dates of its interval; nothing is
    ranked or shuffled. A spine date older than every version keeps one row of NULLs.
    """
    columns = [c for c in versions.columns if c not in ("valid_to", BUCKET)]
    calendar = spine.agg(F.array_sort(F.collect_set(date_col)).alias("_days"))

    def visible(day):
        return (day >= F.col(version_date)) & (F.col("valid_to").isNull() | (day < F.col("valid_to")))

    matched = (versions.withColumn("_days", calendar.scalar())
               .withColumn(date_col, F.explode(F.filter("_days", visible)))
               .select(date_col, *columns))
    first_version = versions.agg(F.min(version_date)).scalar()
    before_all = (calendar.select(F.explode("_days").alias(date_col))
                  .where(first_version.isNull() | (F.col(date_col) < first_version)))
    return matched.unionByName(before_all, allowMissingColumns=True)

"""Session settings the plans rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when an aggregation right after the join then
    # needs one more shuffle; the alternative is one task holding the key.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession, time_zone: str | None = None) -> SparkSession:
    """Apply the runtime settings; sizing stays with the cluster's own conf.

    The session's time zone decides dates of epochs and day-parts. It is left
    as it is unless ``time_zone`` names one.
    """
    if time_zone:
        spark.conf.set("spark.sql.session.timeZone", time_zone)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def use_shared_checkpoints(spark: SparkSession) -> None:
    """Make checkpoints go to the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a scratch folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="promolens-")
    context.setCheckpointDir(folder)

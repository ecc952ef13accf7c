"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from promolens.session import use_shared_checkpoints


#: Folders made since the innermost ``owned`` of this thread began.
_owner: ContextVar[list[str] | None] = ContextVar("owner", default=None)


@contextmanager
def owned() -> Iterator[list[str]]:
    """Collects the folders made inside; what is still there at the end goes to the one around."""
    around, made = _owner.get(), []
    before = _owner.set(made)
    try:
        yield made
    finally:
        _owner.reset(before)
        if around is not None:
            around += made


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, removed when the application ends at the latest."""
    use_shared_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    target, files = _files(spark, path)
    files.deleteOnExit(target)
    made = _owner.get()
    if made is not None:
        made.append(path)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back; a lost executor costs a reread."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _files(spark, path)
    return files.exists(target)


def release(spark: SparkSession, made: list[str], unless: DataFrame | None = None) -> None:
    """Remove the folders ``made`` names and forget them, but for those that ``unless`` reads.

    Only for folders of one's own whose results are written elsewhere by now.
    """
    read = unless.inputFiles() if unless is not None else []
    for path in list(made):
        name = path.rsplit("/", 1)[-1]
        if not any(f"/{name}/" in file for file in read):
            target, files = _files(spark, path)
            files.delete(target, True)
            made.remove(path)


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())

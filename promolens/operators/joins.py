"""Joins with lists derived from change logs, which may or may not be small."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolens.session import use_shared_checkpoints


def staged(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder.

    For a short list that a plan reads several times. The files are reliable
    storage, so a lost executor costs nothing but a reread.
    """
    use_shared_checkpoints(df.sparkSession)
    return df.checkpoint()


def broadcast_if_small(side: DataFrame, max_rows: int) -> DataFrame:
    """``side`` staged, counted, and hinted for broadcast up to ``max_rows`` rows.

    Catalyst's own size estimate of a list derived from a change log is the
    size of the log, so without the count the far larger fact side would be
    shuffled to meet a list of a few megabytes. A longer list gets no hint and
    meets the facts in a shuffle join. Use it for narrow rows only. Calling it
    runs the job that stages and counts the list.
    """
    side = staged(side)
    return F.broadcast(side) if side.count() <= max_rows else side


def split_join(facts: DataFrame, side: DataFrame, keys: Sequence[str],
               how: str = "inner") -> DataFrame:
    """Equi join whose hot keys Spark can split at run time.

    Adaptive execution splits a hot partition only where a join reads two
    shuffles directly. ``side`` often comes out of a window, aggregation or
    join on the same keys, and Spark then reuses that partitioning. Matching a
    hash of the keys as well asks for another partitioning, so both sides are
    shuffled for this join; the rows matched are the same.
    """
    names = {key: f"_side_{key}" for key in keys}
    typed = side.withColumns({key: F.col(key).cast(facts.schema[key].dataType) for key in keys})
    tests = [F.col(key) == F.col(name) for key, name in names.items()]
    tests.append(F.xxhash64(*names) == F.xxhash64(*names.values()))
    return (facts.join(typed.withColumnsRenamed(names), reduce(and_, tests), how)
            .drop(*names.values()))


def keep_listed(facts: DataFrame, listed: DataFrame, keys: Sequence[str],
                max_rows: int) -> DataFrame:
    """Drop facts whose keys are not listed; the list's size only decides how they meet.

    A list of up to ``max_rows`` narrow rows is broadcast, so that facts are
    dropped before any shuffle; a longer one meets them in a shuffle join.
    """
    listed = staged(listed)
    if listed.count() <= max_rows:
        return facts.join(F.broadcast(listed), list(keys), "left_semi")
    return split_join(facts, listed, keys, "left_semi")

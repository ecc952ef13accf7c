"""Stored validity intervals against snapshots of the whole log."""

from __future__ import annotations

import random
from datetime import date, timedelta
from pathlib import Path

from promolens.operators.cdc import asof_snapshot
from promolens.operators.validity import BUCKET, asof_versions, merge_versions, stored_versions
from tests.builders import rows
from tests.test_plans import plan

FIRST = date(2024, 1, 1)
TYPES = "id STRING, at INT, event_id INT, day DATE, state STRING"


def _rows(rng, numbers, days, keys):
    found = []
    for n in numbers:
        day = rng.choice(days)
        found.append((rng.choice(keys), 10 * day, n, FIRST + timedelta(days=day), f"s{n}"))
    return found


def _merge(spark, path, some):
    merge_versions(spark, path, spark.createDataFrame(some, TYPES), ["id"], "day", ["at", "event_id"], 16)


def test_merged_days_give_the_snapshot_of_the_log(spark, tmp_path):
    rng, path, seen = random.Random(3), str(tmp_path / "versions"), []
    keys = [str(k) for k in range(30)] + [None]
    spine = spark.createDataFrame([(FIRST + timedelta(days=d),) for d in range(-2, 40, 3)], "as_of_dt DATE")
    batches = [_rows(rng, range(100), range(10), keys), _rows(rng, range(100, 130), range(10, 12), keys),
               _rows(rng, range(130, 150), range(0, 30), keys), [], _rows(rng, range(150, 152), [31], ["3"])]
    for some in batches:
        seen += some
        _merge(spark, path, some)
    _merge(spark, path, batches[2])  # again
    log = spark.createDataFrame(seen + [("x", 1, 999, None, "undated")], TYPES)
    want = asof_snapshot(log.where("day is not null"), spine, ["id"], "day", ["at", "event_id"])
    got = asof_versions(stored_versions(spark, path), spine, "day")
    assert rows(got, *want.columns) == rows(want)
    assert "Exchange hash" not in plan(got)


def test_only_folders_of_keys_with_new_rows_are_touched(spark, tmp_path):
    rng, path = random.Random(4), tmp_path / "versions"
    _merge(spark, str(path), _rows(rng, range(200), range(10), [str(k) for k in range(60)]))
    before = {p.name: sorted(f.name for f in p.glob("*.parquet")) for p in path.glob(f"{BUCKET}=*")}
    _merge(spark, str(path), _rows(rng, [300], [20], ["7"]))
    after = {p.name: sorted(f.name for f in p.glob("*.parquet")) for p in Path(path).glob(f"{BUCKET}=*")}
    assert len(before) > 10 and sum(before[name] != after[name] for name in before) == 1


def test_a_table_without_rows(spark, tmp_path):
    _merge(spark, str(tmp_path / "versions"), [])
    assert not (tmp_path / "versions").exists()

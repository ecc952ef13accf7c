from __future__ import annotations

from datetime import date
from functools import reduce

from promolens.operators.cdc import latest_per_key
from promolens.operators.orders import money_as_double
from promolens.operators.orders import order_discount_grain
from promolens.streaming import (
    drain,
    drain_rows,
    hourly_discounts,
    latest_state,
    lines_with_orders,
    newest_updates,
    order_sums,
)
from tests.builders import campaign, frame, rows

KEYS, ORDER = ["campaign_id"], ["updated_at", "event_id"]


def arrive(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def test_latest_state_follows_the_log(spark, tmp_path):
    source, folder = str(tmp_path / "log"), str(tmp_path / "state")
    batches = [
        [campaign("a", ["1"], "2024-01-10 09:00", 1), campaign("b", ["2"], "2024-01-10 09:00", 2)],
        [campaign("a", ["3"], "2024-01-11 09:00", 3), campaign("c", None, "2024-01-10 09:00", 4),
         campaign("b", ["9"], "2024-01-09 09:00", 5)],
    ]
    seen = []
    for batch in batches:
        seen += batch
        log = frame(spark, "campaign_events", batch)
        arrive(log, source)
        stream = spark.readStream.schema(log.schema).parquet(source)
        drain(latest_state(stream, KEYS, ORDER), folder)
        state = newest_updates(spark, folder, KEYS)
        newest = latest_per_key(frame(spark, "campaign_events", seen), KEYS, ORDER)
        assert rows(state, *newest.columns) == rows(newest)


def test_hours_add_up_and_late_lines_are_dropped(spark, tmp_path):
    source, folder = str(tmp_path / "lines"), str(tmp_path / "state")

    def lines(*items):
        return frame(spark, "offer_lines", [
            {"dt": day, "hr": hour, "store_id": "1", "store_discount": value}
            for day, hour, value in items])

    for batch in (lines(("2024-01-01", 9, 1), ("2024-01-01", 9, None), ("2024-01-01", 10, 2)),
                  lines(("2024-01-01", 10, 3), ("2024-01-02", 9, 5)),
                  lines(("2024-01-01", 9, 7), ("2024-01-02", 9, 1))):
        arrive(batch, source)
        stream = spark.readStream.schema(batch.schema).parquet(source)
        drain(hourly_discounts(stream, "2 hours"), folder)
    state = money_as_double(newest_updates(spark, folder, ["dt", "hr", "store_id"]))
    assert rows(state, "dt", "hr", "lines", "store_discount") == [
        (date(2024, 1, 1), 10, 2, 5.0), (date(2024, 1, 1), 9, 2, 1.0),
        (date(2024, 1, 2), 9, 2, 6.0)]


def test_folding_bounds_what_a_reader_meets(spark, tmp_path):
    source, folder = tmp_path / "log", str(tmp_path / "state")
    seen = []
    for n in range(50):
        seen.append(campaign("abcdefg"[n * n % 7], [str(n)], "2024-01-10 09:00", n))
        arrive(frame(spark, "campaign_events", seen[-1:]), str(source))
    log = frame(spark, "campaign_events", seen)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        drain(latest_state(stream, KEYS, ORDER), folder, KEYS, fold_every=8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    updates = list((tmp_path / "state" / "updates").glob("batch_id=*"))
    assert len(updates) <= 16 and len(list((tmp_path / "state" / "base").glob("upto=*"))) == 2
    newest = latest_per_key(log, KEYS, ORDER)
    assert rows(newest_updates(spark, folder, KEYS), *newest.columns) == rows(newest)


def test_lines_meet_orders_in_any_order_and_late_rows_are_dropped(spark, tmp_path):
    def lines(*items):
        return frame(spark, "offer_lines", [
            {"dt": day, "hr": hour, "order_id": order, "store_id": "1", "store_discount": value}
            for day, hour, order, value in items])

    def placed(*items):
        return frame(spark, "orders", [
            {"dt": day, "order_id": order, "customer_id": 5, "gmv": 10} for day, order in items])

    batches = [
        (lines(("2024-01-01", 9, 1, 1), ("2024-01-01", 9, 2, 2)), placed(("2024-01-01", 1))),
        (lines(("2024-01-01", 12, 1, 4), ("2024-01-02", 9, 1, 100)), placed(("2024-01-01", 2))),
        (lines(("2024-01-09", 1, 3, 8)), placed(("2024-01-09", 3))),
        (lines(("2024-01-09", 2, 3, 16)), placed(("2024-01-09", 4))),
        (lines(("2024-01-01", 13, 1, 1000)), placed(("2024-01-01", 1))),
    ]
    paths = [str(tmp_path / name) for name in ("lines", "orders")]
    keys = ["dt", "order_id", "store_id", "gmv", "customer_id"]
    for batch in batches:
        for df, path in zip(batch, paths):
            arrive(df, path)
        streams = [spark.readStream.schema(df.schema).parquet(path) for df, path in zip(batch, paths)]
        drain_rows(lines_with_orders(*streams, "2 days"), str(tmp_path / "pairs"))
        stored = str(tmp_path / "pairs" / "rows")
        pairs = spark.readStream.schema(spark.read.parquet(stored).schema).parquet(stored)
        drain(order_sums(pairs, "5 days"), str(tmp_path / "grain"), keys)
    grain = newest_updates(spark, str(tmp_path / "grain"), keys)
    batch = [batches[0], batches[1], batches[2], batches[3]]
    want = order_discount_grain(*(reduce(lambda a, b: a.unionByName(b), side) for side in zip(*batch)))
    assert rows(grain) == rows(want.select(*grain.columns)) and len(rows(grain)) == 3

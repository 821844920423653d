"""The fold of events against one event at a time, in batches and in streams."""

from __future__ import annotations

import random
from datetime import datetime

import pytest

from orrery.streaming import events as EV


def one_by_one(rows: dict, events: list) -> dict:
    state = dict(rows)
    for asset, event, _ in sorted(events, key=lambda e: (e[2], e[1] or "")):
        if asset is not None:
            state[asset] = EV.step_status(*state.get(asset, (None, None, False)), event)
    return {a: s[:2] for a, s in state.items() if s[0] is not None}


def made(seed: int, n: int = 400) -> list:
    rng = random.Random(seed)
    # One asset has a third of all events; some order numbers are equal.
    return [(1 if rng.random() < 0.33 else rng.choice([None, *range(2, 30)]), rng.choice([*EV.EVENTS, None, "unheard"]), rng.randrange(n)) for _ in range(n)]


@pytest.mark.parametrize("partitions", [1, 13])
def test_apply_events(spark, partitions):
    rng = random.Random(4)
    rows = {a: (rng.choice(["pending", "processing", "completed", "failed"]), rng.choice([None, "completed", "failed"]), rng.random() < 0.5) for a in range(1, 40, 2)}
    df = spark.createDataFrame([(a, s, p, datetime(2024, 1, 1) if had else None, "x") for a, (s, p, had) in rows.items()], "assetId long, status string, previousStatus string, processedAt timestamp, more string")
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        events = made(partitions)
        out = EV.apply_events(df, spark.createDataFrame(events, "assetId long, event string, seq long").repartition(5))
        assert out.columns == df.columns
        assert {r.assetId: (r.status, r.previousStatus) for r in out.collect()} == one_by_one(rows, events)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)
    none = spark.createDataFrame([], "assetId long, event string, seq long")
    assert EV.apply_events(df, none).count() == len(rows) and EV.apply_events(df.limit(0), none).count() == 0


def test_all_events_of_a_batch_count(spark):
    df = spark.createDataFrame([(1, "pending", None, None)], "assetId long, status string, previousStatus string, processedAt timestamp")
    events = spark.createDataFrame([(1, "start", 1), (1, "succeed", 2), (2, "queue", 1), (2, "start", 2), (3, "queue", 1), (3, "cancel", 2)], "assetId long, event string, seq long")
    assert {r.assetId: r.status for r in EV.apply_events(df, events).collect()} == {1: "completed", 2: "processing"}


def test_stream_and_batch_agree(spark, tmp_path):
    events = made(9, 120)
    events = [e for e in events if e[0] is not None]
    df = spark.createDataFrame(events, "assetId long, event string, seq long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    streamed = {r.assetId: r.status for r in EV.run_to_memory(EV.stateful_status(stream), "all_statuses", "update").collect() if r.status}
    empty = spark.createDataFrame([], "assetId long, status string, previousStatus string, processedAt timestamp")
    assert streamed == {r.assetId: r.status for r in EV.apply_events(empty, df).collect()} == {a: s for a, (s, _) in one_by_one({}, events).items()}
    counted = EV.run_to_folder(stream.groupBy("event").count(), str(tmp_path / "out"))
    assert {r.event: r["count"] for r in counted.collect()} == {r.event: r["count"] for r in df.groupBy("event").count().collect()}

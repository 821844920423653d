"""Events in any split and order against one event at a time."""

from __future__ import annotations

import random
from datetime import datetime

import pytest

from orrery.segments import Segments
from orrery.streaming import events as EV
from orrery.streaming.status import StatusFold

EVENT = "assetId long, event string, seq long"
ROW = "assetId long, status string, previousStatus string, processedAt timestamp"


def one_by_one(rows: dict, events: list) -> dict:
    state = dict(rows)
    for asset, event, _ in sorted(events, key=lambda e: (e[2] is not None, e[2] or 0, e[1] or "")):
        if asset is not None:
            state[asset] = EV.step_status(*state.get(asset, (None, None, False)), event)
    return {a: s for a, s in state.items() if s[0] is not None}


def made(seed: int, n: int = 200) -> list:
    rng = random.Random(seed)
    return [(1 if rng.random() < 0.33 else rng.choice([None, *range(2, 20)]), rng.choice([*EV.EVENTS, "queue", "start", None, "unheard"]), rng.choice([None, *range(n)])) for _ in range(n)]


def start_of(spark, rows: dict):
    return spark.createDataFrame([(a, s, p, datetime(2024, 1, 1) if had else None) for a, (s, p, had) in rows.items()], ROW)


def statuses(fold: StatusFold) -> dict:
    return {r.assetId: (r.status, r.previous, r.had) for r in fold.statuses().collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_gives_one_result(spark, tmp_path, seed):
    rng, events = random.Random(seed), made(seed)
    rows = {a: (rng.choice(["pending", "processing", "completed", "failed"]), rng.choice([None, "completed", "failed"]), rng.random() < 0.5) for a in range(1, 30, 2)}
    want = one_by_one(rows, events)
    shuffled = rng.sample(events, len(events))
    for k, split in enumerate(([events], [shuffled[:70], shuffled[70:71], [], shuffled[71:]])):
        fold = StatusFold(spark, str(tmp_path / f"fold{k}"), block=16)
        fold.start(start_of(spark, rows))
        for number, part in enumerate(split, 1):
            df = spark.createDataFrame(part, EVENT)
            assert fold.merge(df, number) and not fold.merge(df, number)  # a repeated batch is harmless
            if number == 2:
                fold.compact()
        assert statuses(fold) == want


def test_a_batch_that_broke_off_is_taken_in_again(spark, tmp_path):
    events = made(5, 60)
    fold = StatusFold(spark, str(tmp_path / "fold"), block=8)
    fold.start(start_of(spark, {}))
    fold.merge(spark.createDataFrame(events[:30], EVENT), 1)
    second = spark.createDataFrame(events[30:], EVENT)
    keep = {name: getattr(fold, name).add for name in ("events", "blocks", "states")}
    for name in ("events", "blocks", "states"):
        broken = getattr(fold, name)
        broken.add = lambda *_: (_ for _ in ()).throw(OSError("lost"))
        with pytest.raises(OSError):
            fold.merge(second, 2)
        broken.add = keep[name]
    assert statuses(fold) == one_by_one({}, events[:30])
    assert fold.merge(second, 2) and statuses(fold) == one_by_one({}, events)


def test_cancel_flow_over_batches(spark, tmp_path):
    """An analysis that failed after data was there is completed; a cancelled first one loses its row; each event in a batch of its own."""
    rows = {1: ("pending", None, False), 2: ("completed", None, True), 3: ("pending", None, False)}
    steps = [(1, "start"), (1, "succeed"), (1, "queue"), (1, "start"), (1, "fail"), (2, "queue"), (2, "cancel"), (3, "start"), (3, "cancel")]
    events = [(a, e, i) for i, (a, e) in enumerate(steps)]
    fold = StatusFold(spark, str(tmp_path / "fold"))
    fold.start(start_of(spark, rows))
    for number, own in enumerate((events[0::3], events[2::3], events[1::3]), 1):
        fold.merge(spark.createDataFrame(own, EVENT), number)
    assert statuses(fold) == {1: ("completed", "completed", True), 2: ("completed", None, True)} == one_by_one(rows, events)
    # apply_events, one batch after the other, agrees too, as none comes late here.
    table = start_of(spark, rows)
    for i in (0, 4):
        done = EV.apply_events(table, spark.createDataFrame(events[i : i + 4] if i == 0 else events[4:], EVENT))
        table = spark.createDataFrame(done.collect(), ROW)
    assert {r.assetId: (r.status, r.previousStatus, r.processedAt is not None) for r in table.collect()} == one_by_one(rows, events)


def test_stream_of_files(spark, tmp_path):
    events = [e for e in made(9, 90) if e[0] is not None and e[2] is not None]
    for i in range(3):
        spark.createDataFrame(events[i::3], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    fold = StatusFold(spark, str(tmp_path / "fold"), block=8)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = fold.follow(stream, str(tmp_path / "checkpoint"))
        q.awaitTermination()
    assert fold.states.last() == 3 and statuses(fold) == one_by_one({}, events)
    stateful = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    streamed = {r.assetId: r.status for r in EV.run_to_memory(EV.stateful_status(stateful), "fold_statuses", "update").collect() if r.status}
    assert streamed == {a: s for a, (s, _, _) in statuses(fold).items()}


def test_segments(spark, tmp_path):
    table = Segments(spark, str(tmp_path / "s"), "k long, v string, deleted boolean", ["k"])
    assert table.last() is None and table.latest().collect() == []
    put = lambda number, *rows: table.add(spark.createDataFrame(list(rows), "k long, v string, deleted boolean"), number)
    assert put(1, (1, "a", None), (2, "b", None)) and put(2, (2, None, True), (3, "c", False)) and not put(2, (9, "z", None))
    got = lambda: sorted((r.k, r.v) for r in table.latest().collect())
    assert got() == [(1, "a"), (3, "c")]
    table.compact()
    assert got() == [(1, "a"), (3, "c")] and not put(1, (7, "x", None)) and put(4, (2, "again", None), (1, None, True))
    assert got() == [(2, "again"), (3, "c")] and sorted(r.k for r in table.latest(2).collect()) == [1, 3]
    table.compact()
    assert got() == [(2, "again"), (3, "c")] and set(table.sizes()) == {"base=2", "base=4", "number=4"}
    assert not put(3, (1, "late", None)) and put(6, (5, "e", None))
    with pytest.raises(ValueError):
        put(5, (1, "late", None))


def test_rows_of_many_keys_share_a_batch():
    import pyarrow as pa

    keys = [i // 2 for i in range(20000)]
    given = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 5000]), pa.array(["queue", "start"] * 2500)], names=["assetId", "event"]) for i in range(0, 20000, 5000)]
    out = list(EV.fold_batches(iter(given), ["assetId"], 3))
    assert len(out) <= 3 and [k for b in out for k in b.column(0).to_pylist()] == list(range(10000))
    new, running = EV.STATES.index((0, 0, 0)), EV.STATES.index((2, 0, 0))
    assert all(steps[new] == running and len(steps) == len(EV.STATES) for b in out for steps in b.column(2).to_pylist())
    assert list(EV.fold_batches(iter([]), ["assetId"], 0)) == []

"""Deadlines and sessions of a stream against one key at a time, however the events are cut in batches."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from orrery.streaming import timers as TM

START = datetime(2024, 3, 1)
EVENT = "assetId long, status string, at timestamp, seq long"
POLL = "session long, at timestamp, seq long, done int"


def slices(spark, rows: list, schema: str, cuts: int, at: int):
    rows = sorted(rows, key=lambda r: (r[at] is None, r[at] or START))
    size = -(-len(rows) // cuts)
    return [spark.createDataFrame(rows[i : i + size], schema) for i in range(0, len(rows), size)]


@pytest.mark.parametrize("cuts", [1, 3])
def test_stuck_rows(spark, tmp_path, cuts):
    rng = random.Random(4)
    rows = [(1 if rng.random() < 0.3 else rng.choice([None, 2, 3, 4, 5]), rng.choice(["pending", "processing", "completed", "failed", None]), START + timedelta(minutes=rng.randrange(0, 2000)), i) for i in range(200)]
    rows += [(9, "pending", START, 900), (9, "completed", START + timedelta(minutes=10), 901), (8, "pending", START, 902), (8, "completed", START + timedelta(minutes=10, milliseconds=1), 903), (7, "processing", None, 904)]
    out = TM.run_slices(slices(spark, rows, EVENT, cuts, 2), TM.stuck_rows, str(tmp_path / "s"))
    mark = max(r[2] for r in rows if r[2] and r[0]) - timedelta(hours=1)
    want, by_asset = [], {}
    for a, status, at, seq in rows:
        if a is not None and at is not None:
            by_asset.setdefault(a, []).append((at, seq, status))
    for a, own in by_asset.items():
        own.sort()
        for (at, _, status), after in zip(own, [*own[1:], None], strict=True):
            if status in TM.C.STUCK_MINUTES:
                deadline = at + timedelta(minutes=TM.C.STUCK_MINUTES[status])
                if (after and after[0] > deadline) or (not after and deadline < mark):
                    want.append((a, status, deadline))
    got = sorted((r.assetId, r.was, r.failedAt) for r in out.collect())
    assert got == sorted(want) and (8, "pending", START + timedelta(minutes=10)) in got and 9 not in {r[0] for r in got}


@pytest.mark.parametrize("cuts", [1, 4])
def test_sessions(spark, tmp_path, cuts):
    rng = random.Random(6)
    at, rows = START, []
    for i in range(150):
        at += timedelta(seconds=rng.choice([0, 5, 60, 1200, 3600, 3601, 9000]))
        rows.append((rng.choice([1, 1, 2, None]), at, i, rng.choice([0, 0, 1, 3, None])))
    out = TM.run_slices(slices(spark, rows, POLL, cuts, 1), TM.sessions, str(tmp_path / "s"))
    mark = max(r[1] for r in rows if r[0]) - timedelta(hours=1)
    want = []
    for key in (1, 2):
        now = None
        for _, at, _, done in [*[r for r in rows if r[0] == key], (key, None, 0, 0)]:
            if now and (at is None or at > now["last"] + timedelta(hours=1)):
                end = now["last"] + timedelta(hours=1)
                if at is not None or end < mark:
                    want.append((key, now["began"], end, now["polls"], now["completed"], now["rate"] and round(now["rate"], 9)))
                now = None
            if at is None:
                break
            now = now or {"began": at, "polls": 0, "completed": 0, "recorded": 0, "rate": None}
            now |= {"last": at, "polls": now["polls"] + 1, "completed": now["completed"] + (done or 0)}
            elapsed = (at - now["began"]).total_seconds()
            if now["completed"] > now["recorded"] and elapsed > 0:
                now |= {"recorded": now["completed"], "rate": now["completed"] / elapsed}
    got = sorted((r.session, r.startedAt, r.endedAt, r.polls, r.completed, r.rate and round(r.rate, 9)) for r in out.collect())
    assert got == sorted(want) and len(got) > 5


def test_sessions_take_arrays_of_polls():
    from types import SimpleNamespace

    import pandas as pd

    now, timers = [None], []
    s = TM.Sessions(3600)
    s.handle = SimpleNamespace(registerTimer=timers.append, deleteTimer=timers.remove)
    s.state = SimpleNamespace(get=lambda: now[0], update=lambda v: now.__setitem__(0, v), clear=lambda: now.__setitem__(0, None))
    polls = lambda *rows: iter([pd.DataFrame([r], columns=["ms", "seq", "done"]) for r in rows])
    # In any order; at the start nothing is sampled; what was undone isn't sampled again; a gap of exactly the time to live ends nothing.
    assert list(s.handleInputRows((7,), polls((1000, 2, 0), (0, 1, 2), (0, 0, 1), (3000, 4, -1), (2000, 3, 1)), None)) == []
    assert now[0] == (0, 3000, 5, 3, 4, 2.0) and timers == [3603000]
    (out,) = s.handleInputRows((7,), polls((3603000, 5, 1), (7203001, 6, 0)), None)
    assert out.drop(columns=["startedAt", "endedAt"]).values.tolist() == [[7, 6, 4, 2.0]] and out.endedAt[0] == pd.Timestamp(7203000, unit="ms", tz="UTC")
    assert now[0] == (7203001, 7203001, 1, 0, 0, None) and timers == [10803001]

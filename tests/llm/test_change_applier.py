"""The stream against one client at a time in plain Python."""

from __future__ import annotations

import json
import math
import os
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from orrery.llm import change_applier
from orrery.llm.change_applier import COLUMNS, ChangeApplier, apply_changes, prepare
from orrery.llm.ranks import numbered

SCHEMA = "change_id long, client_id long, seq long, op string, valid_at timestamp, source string, segment string, city string, balance double"


def one_by_one(rows, batches: int = 12) -> list[tuple]:
    by_client, top, feed = defaultdict(list), {}, defaultdict(lambda: defaultdict(list))
    for r in set(rows):
        by_client[r[1]].append(r)
    for client, own in by_client.items():
        rank = {s: i for i, s in enumerate(sorted({r[2] for r in own}, key=lambda s: (s is not None, s or 0)), 1)}
        for r in own:
            h = zlib.crc32(b"" if r[0] is None else str(r[0]).encode())
            if r[4] is None or h % 11 == 0:
                continue
            day = (r[4] - datetime(1970, 1, 1)).days + 9 * (h % 4)
            b = max(1, min(batches, 1 + math.floor((day - 19723) * 12 / 160)))
            feed[client][b].append((day, r[0], rank[r[2]], r))
            top[b] = max(top.get(b, day), day)
    out = []
    for client, of in feed.items():
        state = {"next": 1, "city": None, "cents": None, "final": None}
        held, mine = {}, []

        def drain(b, missed, client=client, state=state, held=held, mine=mine):
            while state["next"] in held:
                _, change, _, r = held.pop(state["next"])
                cents = None if r[8] is None else math.floor(100 * r[8] + 0.5)
                if r[3] == "I":
                    state |= {"city": r[7], "cents": cents}
                elif r[3] == "U":
                    state |= {"city": state["city"] if r[7] is None else r[7], "cents": state["cents"] if cents is None else cents}
                elif r[3] == "D":
                    state |= {"city": None, "cents": None}
                mine.append([change, client, "applied", b, missed, state["city"], state["cents"], False])
                state |= {"final": (len(mine) - 1, r[3]), "next": state["next"] + 1}
                missed = 0

        for b in range(1, batches + 2):
            clock = max([top[x] for x in top if x < b], default=-(10**9))
            while held and (b > batches or min(x[0] for x in held.values()) + 3 <= clock):
                jumped = min(held) - state["next"]
                state["next"] = min(held)
                drain(b, jumped)
            for x in sorted(of.get(b, []), key=lambda x: x[:2]):
                if x[2] in held or x[2] < state["next"]:
                    mine.append([x[1], client, "rejected", b, 0, None, None, False])
                else:
                    held[x[2]] = x
                    drain(b, 0)
        if state["final"] and state["final"][1] != "D":
            mine[state["final"][0]][7] = True
        out += map(tuple, mine)
    return out


def made(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        client = 7 if rng.random() < 0.33 else rng.choice([None, *range(1, 12)])
        at = None if rng.random() < 0.03 else datetime(2024, 1, 1) + timedelta(hours=min(24 * 119, max(0, int(i * 24 * 119 / n + rng.gauss(0, 60)))))
        seq = rng.choice([None, *range(60)]) if rng.random() < 0.3 else i // 2
        rows.append((i, client, seq, rng.choice(["I", "U", "U", "U", "D", None, "X"]), at, "web", None, rng.choice([None, "Ilar", "Börl"]), rng.choice([None, 1.005, -2.675, 12.5])))
    return rows + rng.sample(rows, n // 5) + [(None, 3, 1, "I", datetime(2024, 1, 5), "web", None, "x", 1.0)]


def order(rows) -> list:
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_against_one_by_one(spark):
    rows = made(3, 500)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("who", F.lit("extra")).withColumn("lane", F.lit(1)).repartition(3)
    out = apply_changes(df)
    assert out.columns == ["change_id", "client_id", "status", "batch", "missed", "city", "cents", "current"]
    got, want = order(out.collect()), order(one_by_one(rows))
    assert got == want
    assert any(r[4] for r in got) and {r[2] for r in got} == {"applied", "rejected"} and 13 in {r[3] for r in got}


def test_given_table(spark, sf):
    df = spark.read.parquet(f"{sf}/client_changes.parquet").select(COLUMNS)
    assert order(apply_changes(df).collect()) == order(one_by_one([tuple(r) for r in df.collect()]))


def test_empty(spark):
    assert apply_changes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_numbers_of_a_hot_group(spark):
    rows = [("a", i) for i in range(2000)] + [(None, i) for i in range(30)] + [("b", None), ("b", 5)]
    out = numbered(spark.createDataFrame(rows, "g string, x long").repartition(7), ["g"], ["x"], "n")
    got = {(r.g, r.x): r.n for r in out.collect()}
    assert got == {(g, x): x + 1 if g != "b" else (1 if x is None else 2) for g, x in rows}


def test_clients_share_keys_and_all_get_the_clock(spark):
    rows = made(5, 300)
    feed = prepare(spark.createDataFrame(rows, SCHEMA), 12, 19723, 160, 3).where("lane = 0").toPandas()
    # A key costs as much as many rows: there are fewer of them than clients (here a hundred to a bucket), and each gets every batch's clock.
    many = spark.range(20000).selectExpr("id change_id", "id client_id", "1L seq", "'I' op", "timestamp'2024-01-03' + make_interval(0, 0, 0, int(id % 90)) valid_at", "'' source", "'' segment", "'' city", "1D balance")
    keys = prepare(many, 12, 19723, 160, 3).where("lane = 0").agg(F.count_distinct("who")).first()[0]
    assert keys <= 20000 / 100
    assert feed[~feed.line.str.contains('"n":')].groupby("who").batch.agg(sorted).map(lambda x: x == list(range(1, 14))).all()


def test_few_blocks_in_memory(spark, monkeypatch):
    monkeypatch.setattr(change_applier, "ChangeApplier", lambda patience: ChangeApplier(patience, chunk=7, width=2, blocks=2))
    rows = made(8, 400)
    assert order(apply_changes(spark.createDataFrame(rows, SCHEMA)).collect()) == order(one_by_one(rows))


def test_no_store_stays_open_after_its_task(spark):
    jvm = spark._jvm.java.lang.ProcessHandle.current().pid()
    files = lambda: [os.readlink(f"/proc/{jvm}/fd/{x}") for x in os.listdir(f"/proc/{jvm}/fd") if os.path.islink(f"/proc/{jvm}/fd/{x}")]
    before = {x for x in files() if x.endswith("/LOCK")}
    apply_changes(spark.createDataFrame(made(4, 60), SCHEMA), batches=1)
    assert not {x for x in files() if x.endswith("/LOCK")} - before


def test_no_store_opens_a_native_database(spark):
    # Each RocksDB that is opened leaves its statistics in the executor's memory; it writes zip files, the store on the heap writes delta files.
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    files = lambda: {f"{d}/{x}" for d, _, names in os.walk(root) for x in names if "/state/0/" in d and x[0] != "."}
    before = files()
    apply_changes(spark.createDataFrame(made(6, 60), SCHEMA), batches=1)
    kinds = {os.path.splitext(x)[1] for x in files() - before}
    assert ".delta" in kinds and ".zip" not in kinds


def test_what_a_hot_client_holds_is_small():
    class State:
        exists = False

        def update(self, value):
            self.value = value

    n, state = 20000, State()
    line = lambda i: json.dumps({"client_id": 1, "batch": 1, "clock": -(2**31), "change_id": 7 * i, "n": i, "day": 19723 + i % 9, "op": "U", "city": "Ilar", "cents": 31 * i})
    out = list(ChangeApplier(3).step((0, 0), iter([pd.DataFrame({"line": [line(i) for i in range(2, n + 2)]})]), state))
    assert not out and sum(map(len, state.value[2].values())) < 20 * n

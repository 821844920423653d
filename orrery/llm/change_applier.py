"""Numbered changes of clients, applied in sequence by a stateful stream.

Changes arrive out of order and with gaps. A client's state is the number it waits for, its current values, and the changes that came too early.
Every batch brings a clock, the largest day of earlier batches, to all clients. A client whose oldest early change has waited too long gives up the missing numbers and goes on with the
smallest it holds.

A key costs Python most of a millisecond, whatever it does, so that clients share keys: a bucket has about 128 of them, by a hash. Its state is what they wait for, and their early changes as a map from
a block of 64 numbers to the changes of those numbers, compressed. Every bucket gets one clock row a batch.

**What is prepared before the stream.** Numbers are dense ranks, found over ranges of (client, seq), so that a client with much of the table lies in many
tasks. Of the changes of one batch that share client and number only the first can be held or applied; this is settled by an aggregate with partial sums before the
stream, and the others go through it under keys of their own (`lane` > 0), spread over all tasks, as rejected. What is left for one client are distinct numbers, whose
order within a batch no longer matters: they are read as an iterator and put into state, of which 32 blocks are unpacked at a time, so what grows with a client is what it holds, not what it gets: its compressed blocks, and twelve bytes for each
held number while it gives up.

**Defined results.** Rows equal in the nine columns count once, whatever other columns hold. A null change_id hashes as empty text, which vanishes. A null client is a client, a
null seq is the smallest. Rows without a day vanish. Days before the first belong to batch 1. An unknown or null op changes no value. An empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import astuple, dataclass
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from .ranks import numbered
from .storage import shared_folder, store

COLUMNS = ["change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance"]
#: What goes through the stream is one text column each way: a key costs Python several times as much with eleven columns in and eight out.
FEED = "who long, lane int, batch int, line string"
OUT = "change_id long, client_id long, status string, batch int, missed long, city string, cents long, n long, op string"
_NEVER, _ALWAYS = -(2**31), 2**31 - 1
STATE = "batch int, clients string, held map<long, binary>"
#: A start looks into each partition's store once, so that a store is closed with its task, and its threads with it, and nothing of it is kept for later: in memory are as many as an executor has cores. Not RocksDB:
#: for each store that it opens, so for each partition of each start, Spark leaves native statistics behind for good (0.5 MB on 8 CPUs).
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    "spark.sql.streaming.maxBatchesToRetainInMemory": "0",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def _out(change, client, status: str, batch: int, n: int, missed: int = 0, city=None, cents=None, op=None) -> str:
    return json.dumps({"change_id": change, "client_id": client, "status": status, "batch": batch, "missed": missed, "city": city, "cents": cents, "n": n, "op": op})


@dataclass(slots=True)
class Client:
    """The number it waits for; how many changes it holds, their least day (or an earlier one) and greatest number; current values."""

    next: int = 1
    waiting: int = 0
    oldest: int = _ALWAYS
    farthest: int = 0
    city: str | None = None
    cents: int | None = None


class ChangeApplier:
    """A bucket of clients: `clients` has them all, `held` the changes that came too early."""

    def __init__(self, patience: int, chunk: int = 4096, width: int = 64, blocks: int = 32):
        self.patience, self.chunk, self.width, self.most = patience, chunk, width, blocks

    def step(self, key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lines = (json.loads(line) for part in parts for line in part["line"])
        out = self._rejected(lines) if key[1] else self._bucket(lines, state)
        while some := list(islice(out, self.chunk)):
            yield pd.DataFrame({"line": some})

    def _rejected(self, lines: Iterator[dict]) -> Iterator[str]:
        for r in lines:
            yield _out(r.get("change_id"), r.get("client_id"), "rejected", r["batch"], r["n"])

    def _bucket(self, lines: Iterator[dict], state: GroupState) -> Iterator[str]:
        first = next(lines)
        batch, clock = first["batch"], first["clock"]
        # Rows of both are JSON: a row of columns for each client or change costs several times as much.
        seen, text, self.held = state.get if state.exists else (0, "[]", {})
        self.clients = {key: Client(*values) for key, *values in json.loads(text)}
        self.blocks, self.changed = {}, set()
        if seen < batch:
            for client, c in self.clients.items():
                if c.waiting and c.oldest + self.patience <= clock:
                    yield from self._give_up(client, c, batch, clock)
        lines = chain([first], lines)
        while part := list(islice(lines, self.chunk)):
            new = {}
            for r in part:
                if "n" in r:
                    new.setdefault(r.get("client_id"), {})[r["n"]] = (r["day"], r["change_id"], r.get("op"), r.get("city"), r.get("cents"))
            for client, own in new.items():
                yield from self._take_in(client, self.clients.setdefault(client, Client()), batch, own)
        self._save()
        if self.clients:
            state.update((batch, json.dumps([[key, *astuple(c)] for key, c in self.clients.items()]), self.held))

    def _block(self, n: int) -> dict:
        """The held changes of the block of a number, by client and number."""
        b = n // self.width
        if b not in self.blocks:
            if len(self.blocks) >= self.most:
                self._save()
            found = self.held.get(b)
            self.blocks[b] = {(client, n): tuple(row) for client, n, *row in json.loads(zlib.decompress(found))} if found else {}
        return self.blocks[b]

    def _save(self) -> None:
        for b in self.changed:
            if self.blocks[b]:
                self.held[b] = zlib.compress(json.dumps([[*key, *row] for key, row in self.blocks[b].items()]).encode(), 1)
            else:
                self.held.pop(b, None)
        self.blocks, self.changed = {}, set()

    def _take_in(self, client, c: Client, batch: int, new: dict[int, tuple]) -> Iterator[str]:
        # A number that is held or behind next is rejected; among the new ones each is the first of its number.
        for n in sorted(new):
            if n < c.next or (c.waiting and n <= c.farthest and (client, n) in self._block(n)):
                yield _out(new.pop(n)[1], client, "rejected", batch, n)
        while new or c.waiting:
            row = new.pop(c.next, None) or self._take(client, c, c.next)
            if row is None:
                break
            yield self._apply(client, c, batch, c.next, row)
        for n in sorted(new):
            self._block(n)[client, n] = row = new[n]
            self.changed.add(n // self.width)
            c.waiting, c.oldest, c.farthest = c.waiting + 1, min(c.oldest, row[0]), max(c.farthest, n)

    def _take(self, client, c: Client, n: int) -> tuple | None:
        """The held change of a number, which leaves the state."""
        if not c.waiting or n > c.farthest:
            return None
        row = self._block(n).pop((client, n), None)
        if row is not None:
            self.changed.add(n // self.width)
            c.waiting -= 1
            if not c.waiting:
                c.oldest, c.farthest = _ALWAYS, 0
        return row

    def _apply(self, client, c: Client, batch: int, n: int, row: tuple) -> str:
        _, change, op, city, cents = row
        if op in ("I", "D"):
            c.city, c.cents = (city, cents) if op == "I" else (None, None)
        elif op == "U":
            c.city, c.cents = c.city if city is None else city, c.cents if cents is None else cents
        missed, c.next = n - c.next, n + 1
        return _out(change, client, "applied", batch, n, missed, c.city, c.cents, op)

    def _waiting(self, client, c: Client) -> Iterator[tuple[int, int]]:
        """Number and day of what a client holds, in order of numbers."""
        for start in range(c.next // self.width * self.width, c.farthest + 1, self.width):
            block = self._block(start)
            yield from [(n, block[client, n][0]) for n in range(start, start + self.width) if (client, n) in block]

    def _give_up(self, client, c: Client, batch: int, clock: int) -> Iterator[str]:
        """Jumps to the smallest held number while the oldest held change has waited too long: all up to the last that has, and what follows without a gap."""
        both = np.fromiter(self._waiting(client, c), np.dtype("i8,i4"), c.waiting)
        late = both["f1"] + np.int64(self.patience) <= clock
        upto = int(both["f0"][late].max()) if late.any() else 0
        at = 0
        for n in both["f0"].tolist():
            if n > upto and n != c.next:
                break
            yield self._apply(client, c, batch, n, self._take(client, c, n))
            at += 1
        if c.waiting:
            c.oldest = int(both["f1"][at:].min())


def _day(hashed: Column) -> Column:
    return (F.unix_date(F.col("valid_at").cast("date")) + 9 * (hashed % 4)).cast("int")


def prepare(changes: DataFrame, batches: int, start_day: int, days: int, patience: int, share: int = 128) -> DataFrame:
    """The rows of all batches (FEED): changes, of which the first of a client and number has lane 0, and the clock for each bucket of about `share` clients.

    The batch after the last has the clock that no day exceeds.
    """
    spark = changes.sparkSession
    hashed = F.crc32(F.coalesce(F.col("change_id").cast("string"), F.lit("")).cast("binary"))
    distinct = changes.select(*COLUMNS).distinct()
    ranks = numbered(changes.select("client_id", "seq").distinct(), ["client_id"], ["seq"], "n", "client-numbers").toDF("_client", "_seq", "n")
    kept = distinct.where(F.col("valid_at").isNotNull() & (hashed % 11 != 0))
    kept = kept.join(ranks, kept.client_id.eqNullSafe(F.col("_client")) & kept.seq.eqNullSafe(F.col("_seq")))
    kept = kept.withColumns({"day": _day(hashed), "cents": F.floor(100 * F.col("balance") + 0.5).cast("long")})
    number = F.floor((F.col("day") - start_day) * F.lit(batches) / F.lit(days))
    kept = store(spark, kept.withColumn("batch", F.greatest(F.lit(1), F.least(F.lit(batches), 1 + number)).cast("int")).drop("_client", "_seq"), "changes")
    # The largest day of the batches before each: one row for each batch.
    top = {r["batch"]: r["m"] for r in kept.groupBy("batch").agg(F.max("day").alias("m")).collect()}
    clocks, now = {}, _NEVER + patience
    for b in range(1, batches + 1):
        clocks[b] = now
        now = max(now, top.get(b, now))
    clocks[batches + 1] = _ALWAYS
    clock = lambda b: F.element_at(F.create_map(*[F.lit(x) for kv in clocks.items() for x in kv]), b)
    clients = kept.agg(F.approx_count_distinct("client_id")).first()[0]
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-clients // share))
    bucket = lambda client: F.pmod(F.xxhash64(client), F.lit(buckets))
    order = F.struct("day", "change_id", *[c for c in COLUMNS if c != "change_id"])
    key = ["client_id", "n", "batch"]
    first = kept.groupBy(*key).agg(F.min(order).alias("_first")).select(*[F.col(c).alias(f"_{c}") for c in key], "_first")
    same = [kept[c].eqNullSafe(first[f"_{c}"]) for c in key]
    rows = kept.join(first, same[0] & same[1] & same[2]).withColumn("_is", order.eqNullSafe(F.col("_first")))
    rows = rows.select(
        F.when(F.col("_is"), bucket("client_id")).alias("who"), F.when(F.col("_is"), 0).otherwise(1 + F.pmod(F.xxhash64("change_id"), F.lit(1024))).cast("int").alias("lane"),
        "batch", F.to_json(F.struct("client_id", "batch", clock(F.col("batch")).alias("clock"), "change_id", "n", "day", "op", "city", "cents")).alias("line"),
    )
    ticks = spark.range(buckets).select(F.col("id").alias("who"), F.lit(0).alias("lane"), F.explode(F.sequence(F.lit(1), F.lit(batches + 1))).alias("batch"))
    ticks = ticks.withColumn("line", F.to_json(F.struct("batch", clock(F.col("batch")).alias("clock"))))
    return rows.unionByName(ticks)


def applied(stream: DataFrame, patience: int) -> DataFrame:
    """A stream of FEED rows, as lines (OUT) of the changes that were applied or rejected."""
    applier = ChangeApplier(patience)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from applier.step(key, parts, state)

    return stream.groupBy("who", "lane").applyInPandasWithState(step, "line string", STATE, "append", "NoTimeout")


def apply_changes(changes: DataFrame, batches: int = 12, start_day: int = 19723, days: int = 160, patience: int = 3) -> DataFrame:
    """What became of each change: change_id, client_id, status, batch, missed, city, cents, current.

    Batches are written to a new folder one after the other, and the stream is started anew for each, on one checkpoint.
    """
    spark = changes.sparkSession
    feed, home = shared_folder(spark, "change-feed"), shared_folder(spark, "change-stream")
    staged = shared_folder(spark, "change-batches")
    prepare(changes, batches, start_day, days, patience).hint("rebalance", "batch").write.partitionBy("batch").parquet(staged)
    schema = spark.createDataFrame([], FEED).schema
    rows = spark.read.schema(schema).parquet(staged).select(schema.names)
    with _settings(spark, _STORE):
        for b in range(1, batches + 2):
            rows.where(F.col("batch") == b).write.mode("append").parquet(feed)
            stream = applied(spark.readStream.schema(schema).parquet(feed), patience)
            q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start(f"{home}/out")
            try:
                q.awaitTermination()
            finally:
                q.stop()
    out = spark.read.schema("line string").parquet(f"{home}/out").select(F.from_json("line", OUT).alias("r")).select("r.*")
    out = out.withColumn("_at", F.when(F.col("status") == "applied", F.col("n")))
    last = out.groupBy("client_id").agg(F.max("_at").alias("_n")).withColumnRenamed("client_id", "_client")
    done = out.join(last, out.client_id.eqNullSafe(F.col("_client")) & (F.col("_at") == F.col("_n")), "left")
    current = F.col("_n").isNotNull() & ~F.col("op").eqNullSafe("D")
    return done.select("change_id", "client_id", "status", "batch", "missed", "city", "cents", current.alias("current"))


class _settings:
    """Settings of the session for the time of the stream."""

    def __init__(self, spark: SparkSession, values: dict[str, str]):
        self.conf, self.values = spark.conf, values

    def __enter__(self) -> None:
        self.before = {k: self.conf.get(k, None) for k in self.values}
        for k, v in self.values.items():
            self.conf.set(k, v)

    def __exit__(self, *_) -> None:
        for k, v in self.before.items():
            self.conf.unset(k) if v is None else self.conf.set(k, v)

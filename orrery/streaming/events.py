"""Streams of asset events and logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S


def read_events(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    """A file stream; the schema comes from the files that are there."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def window_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and totals by event-time window and type; rows later than `late` are left out."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    given = events.withWatermark("ts", late) if events.isStreaming else events
    return given.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(20,6)")).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_to_memory(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Processes what is there and returns the result table, which the driver holds: for tests."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return stream.sparkSession.table(name)


def run_to_folder(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Processes what is there and returns the result table of the last batch, written by the executors below `folder`, which they share."""

    def write(batch: DataFrame, number: int) -> None:
        # A batch that is repeated writes the same place again.
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    last = q.lastProgress["batchId"] if q.lastProgress else 0
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/batch={last}")


def asset_event_action(kind, hash_changed, has_analysis):
    """What an event asks for: queue, purge, or nothing. A replaced file is processed again only if its content hash differs."""
    return F.when(kind == "save", "queue").when(kind == "delete", "purge").when((kind == "replace") & hash_changed, "queue").when((kind == "restore") & ~has_analysis, "queue")


EVENTS = ("queue", "start", "succeed", "fail", "cancel")
STATE_NAMES = (None, "pending", "processing", "completed", "failed")
STATES = tuple((s, p, had) for s in range(5) for p in range(5) for had in (0, 1))


def state_number(status: Column, previous: Column, had: Column) -> Column:
    """The place of a state among STATES."""
    number = lambda c: sum((F.when(c == x, i).otherwise(0) for i, x in enumerate(STATE_NAMES) if x), F.lit(0))
    return number(status) * 10 + number(previous) * 2 + had.cast("int")


def step_status(status: str | None, previous: str | None, had: bool, event: str) -> tuple[str | None, str | None, bool]:
    """Status, status before the last queueing, and whether there is data of an earlier analysis, after one event."""
    if event == "queue" and status != "processing":
        return "pending", status, had
    if event == "start" and status == "pending":
        return "processing", previous, had
    if event == "succeed" and status == "processing":
        return "completed", None, True
    if status in ("pending", "processing"):
        if event == "fail":
            return "completed" if had else "failed", previous, had
        if event == "cancel":
            return previous, None, had and previous is not None
    return status, previous, had


def _step_tables() -> dict[str, bytes]:
    """For each event the number of the state that follows each state: a sequence of events is the composition of its tables, which `bytes.translate` makes."""
    number = {s: i for i, s in enumerate(STATES)}

    def after(state: tuple, event: str) -> int:
        s, p, had = step_status(STATE_NAMES[state[0]], STATE_NAMES[state[1]], bool(state[2]), event)
        return number[STATE_NAMES.index(s), STATE_NAMES.index(p), int(had)]

    return {e: bytes(after(s, e) for s in STATES).ljust(256, b"\0") for e in EVENTS}


def fold_batches(batches: Iterator, keys: list[str], part: int, most: int = 8192) -> Iterator:
    """Arrow batches of keys and event, in order, as batches of keys, part and steps: rows of many keys to a batch, since a batch costs as much as a hundred rows."""
    import pyarrow as pa

    tables, n = _step_tables(), len(STATES)
    same, own, steps = bytes(range(n)), None, b""
    found: list[tuple[list, bytes]] = []

    def rows():
        flat = pa.array(np.frombuffer(b"".join(steps for _, steps in found), np.int8))
        lists = pa.ListArray.from_arrays(pa.array(range(0, n * len(found) + 1, n), pa.int32()), flat)
        own = [pa.array(c, pa.int64()) for c in zip(*(key for key, _ in found), strict=True)]
        return pa.RecordBatch.from_arrays([*own, pa.array([part] * len(found), pa.int32()), lists], names=[*keys, "part", "steps"])

    for batch in batches:
        for *key, e in zip(*(batch.column(i).to_pylist() for i in range(len(keys) + 1)), strict=True):
            if key != own:
                if own is not None:
                    found.append((own, steps))
                    if len(found) >= most:
                        yield rows()
                        found.clear()
                own, steps = key, same
            if e in tables:
                steps = steps.translate(tables[e])
    if own is not None:
        found.append((own, steps))
        yield rows()


def fold_events(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The keys (the asset, or others that are whole numbers) and steps: what all events of a key (event, seq), in their order, make of each state.

    Events are dealt out by ranges of key and order, so that those of one key may lie in many tasks; each task composes what it
    has, and a key's parts, one for each of its tasks, are composed in order. Unknown and null events change nothing, nor do those whose first key is null.
    """
    keys = keys or ["assetId"]

    def run(batches):
        return fold_batches(batches, keys, TaskContext.get().partitionId())

    given = events.select(*[F.col(k).cast("long") for k in keys], "event", F.col("seq").cast("long")).where(F.col(keys[0]).isNotNull())
    parts = given.repartitionByRange(*keys, "seq", "event").sortWithinPartitions(*keys, "seq", "event").mapInArrow(run, f"{', '.join(f'{k} long' for k in keys)}, part int, steps array<tinyint>")
    # At most one part for each task, in the order of the ranges.
    ordered = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("part", "steps"))).alias("parts"))
    rest = F.expr("slice(parts, 2, size(parts))")
    return ordered.select(*keys, F.aggregate(rest, F.col("parts")[0]["steps"], lambda now, part: F.transform(now, lambda s: F.element_at(part["steps"], s.cast("int") + 1))).alias("steps"))


def apply_events(analyses: DataFrame, events: DataFrame, at: Column | None = None) -> DataFrame:
    """Analyses after all events of each asset (assetId, event, seq), in their order; assets without a row begin at null. A null status removes the row.

    processedAt follows whether there is data: null where a cancellation has lost it, `at` (now) where an analysis has brought the first. So later events can be applied to
    the result; for events that may come late, and batches that may be repeated, see `status.StatusFold`.
    """
    both = analyses.join(fold_events(events), "assetId", "full_outer")
    had = F.col("processedAt").isNotNull()
    after = F.element_at("steps", (state_number(F.col("status"), F.col("previousStatus"), had) + 1).cast("int")).cast("int")
    name = lambda i: F.element_at(F.array(*[F.lit(x) for x in STATE_NAMES]), (i + 1).cast("int"))
    changed = lambda c, new: F.when(F.col("steps").isNull(), F.col(c)).otherwise(new)
    both = both.withColumn("_after", after)
    processed = F.when(F.col("_after") % 2 == 1, F.coalesce("processedAt", F.current_timestamp() if at is None else at)).cast(analyses.schema["processedAt"].dataType)
    return (
        both.withColumns({"status": changed("status", name(F.floor(F.col("_after") / 10))), "previousStatus": changed("previousStatus", name(F.floor(F.col("_after") / 2) % 5)), "processedAt": changed("processedAt", processed)})
        .where(F.col("status").isNotNull()).select(*analyses.columns)
    )


def merge_stream(events: DataFrame, load: Callable[[], DataFrame], store: Callable[[DataFrame, int], None], checkpoint: str):
    """Merges each micro-batch into a table that the caller keeps, if no event comes late. `store` gets the batch number, so that a repeated batch can be told."""

    def step(batch: DataFrame, number: int) -> None:
        store(apply_events(load(), batch), number)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stateful_status(events: DataFrame) -> DataFrame:
    """The status of each asset by all its events in order, kept as streaming state. `events`: assetId, event, seq."""
    import pandas as pd

    out = S.StructType([S.StructField("assetId", S.LongType()), S.StructField("status", S.StringType())])
    state_type = S.StructType([S.StructField("status", S.StringType()), S.StructField("previous", S.StringType()), S.StructField("had", S.BooleanType())])

    def step(key, batches, state):
        now = state.get if state.exists else (None, None, False)
        for e in pd.concat(list(batches)).sort_values(["seq", "event"])["event"]:
            now = step_status(*now, e)
        state.update(now)
        yield pd.DataFrame({"assetId": [key[0]], "status": [now[0]]})

    return events.groupBy("assetId").applyInPandasWithState(step, out, state_type, "update", "NoTimeout")

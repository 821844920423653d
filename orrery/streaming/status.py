"""The status of assets by events that come in batches, in any order and split.

Kept are the events, and for each asset and block of order numbers what its events make of every state (a table of steps). A batch whose events of a block all come after
those that the block has is composed with its steps; a block that gets a late event is folded again from its events. A changed asset's blocks are then composed in order over the
state it had before any event. So the result depends on the events alone, as if all were folded at once.

Tables only grow by the rows of what a batch touches; a batch that is repeated, or broke off at any point and is repeated, changes nothing else. Events without an asset are ignored, those without an order
number come first; equal order numbers are taken by name of the event. Unknown events change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..segments import Segments
from .events import STATE_NAMES, fold_events, state_number

_STATE = "status string, previous string, had boolean"
_BEFORE_ALL = -(1 << 62)


def _compose(first: Column, then: Column) -> Column:
    return F.transform(first, lambda s: F.element_at(then, s.cast("int") + 1))


class StatusFold:
    """The tables of one installation below `folder`."""

    def __init__(self, spark: SparkSession, folder: str, block: int = 1024):
        self.spark, self.block = spark, block
        self.events = Segments(spark, f"{folder}/events", "assetId long, block long, seq long, event string", ["assetId", "block"])
        self.blocks = Segments(spark, f"{folder}/blocks", "assetId long, block long, steps array<tinyint>, last struct<seq: bigint, event: string>", ["assetId", "block"])
        self.states = Segments(spark, f"{folder}/states", f"assetId long, {_STATE}, start struct<status: string, previous: string, had: boolean>, lastSeq long", ["assetId"])

    def start(self, analyses: DataFrame) -> None:
        """The states before any event, from assetId, status, previousStatus and processedAt."""
        own = analyses.select("assetId", "status", F.col("previousStatus").alias("previous"), F.col("processedAt").isNotNull().alias("had"))
        self.states.add(own.select("*", F.struct("status", "previous", "had").alias("start"), F.lit(None).cast("long").alias("lastSeq")), 0)

    def merge(self, batch: DataFrame, number: int) -> bool:
        """Takes in a batch of events (assetId, event, seq). Numbers rise from 1; false if this one has been taken in."""
        if (last := self.states.last()) is not None and number <= last:
            return False
        block = F.coalesce(F.floor(F.col("seq") / self.block), F.lit(_BEFORE_ALL)).cast("long")
        self.events.add(batch.where(F.col("assetId").isNotNull()).select(F.col("assetId").cast("long"), F.col("seq").cast("long"), "event").withColumn("block", block).sort("assetId", "seq"), number)
        new = self.events.rows(number).where(F.col("number") == number)
        key = ["assetId", "block"]
        at = F.struct("seq", "event")
        ends = new.groupBy(*key).agg(F.min(at).alias("first"), F.max(at).alias("end"))
        stored = self.blocks.latest(number - 1, ends.select(*key))
        both = ends.join(stored, key, "left")
        late = both.where(F.col("last").isNotNull() & (F.col("first") < F.col("last"))).select(*key, F.greatest("last", "end").alias("last"))
        in_order = both.where(F.col("last").isNull() | (F.col("first") >= F.col("last"))).select(*key, "steps", F.col("end").alias("last"))
        added = fold_events(new, key).withColumnRenamed("steps", "more")
        composed = in_order.join(added, key).select(*key, F.when(F.col("steps").isNull(), F.col("more")).otherwise(_compose(F.col("steps"), F.col("more"))).alias("steps"), "last")
        if late.isEmpty():
            self.blocks.add(composed, number)
        else:
            again = fold_events(self.events.rows(number).join(late.select(*key), key, "left_semi"), key)
            self.blocks.add(composed.unionByName(late.join(again, key).select(*key, "steps", "last")), number)
        touched = ends.select("assetId").distinct()
        parts = self.blocks.latest(number, touched).groupBy("assetId").agg(F.sort_array(F.collect_list(F.struct("block", "steps", "last"))).alias("parts"))
        seq = F.element_at("parts", -1)["last"]["seq"]
        known = self.states.latest(number - 1, touched).select("assetId", "start")
        start = parts.select("assetId", "parts", seq.alias("lastSeq")).join(known, "assetId", "left")
        before = lambda c: F.col("start")[c]
        # One state goes through the blocks: composing their tables would take as many times longer as there are states.
        first = state_number(before("status"), before("previous"), F.coalesce(before("had"), F.lit(False))).cast("int")
        after = F.aggregate("parts", first, lambda now, part: F.element_at(part["steps"], now + 1).cast("int"))
        name = lambda i: F.element_at(F.array(*[F.lit(x) for x in STATE_NAMES]), (i + 1).cast("int"))
        done = start.withColumn("_n", after).select("assetId", name(F.floor(F.col("_n") / 10)).alias("status"), name(F.floor(F.col("_n") / 2) % 5).alias("previous"), (F.col("_n") % 2 == 1).alias("had"), "start", "lastSeq")
        return self.states.add(done, number)

    def statuses(self) -> DataFrame:
        """assetId, status, previous, had and the last order number of every asset that has a status."""
        return self.states.latest().where(F.col("status").isNotNull()).drop("start")

    def compact(self) -> None:
        """One base for each table; to be called between batches."""
        self.events.compact(merged=False)
        self.blocks.compact()
        self.states.compact()

    def follow(self, events: DataFrame, checkpoint: str):
        """Takes in each micro-batch of a stream until what is there has been read."""
        return events.writeStream.foreachBatch(lambda batch, number: self.merge(batch, number + 1) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

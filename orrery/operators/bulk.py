"""Bulk processing: counters, progress, failures, stuck rows, and the state of a session."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.labels import duration_text
from ..plans.asset_query import in_volumes


def bulk_stats(assets: DataFrame, analyses: DataFrame, volumes: Sequence[int] | None = None) -> DataFrame:
    """Images and their states in one left join and one pass."""
    images = in_volumes(assets.where((F.col("kind") == "image") & F.col("dateDeleted").isNull()), volumes).select(F.col("id").alias("assetId"))
    s = F.col("status")
    return images.join(analyses.select("assetId", "status"), "assetId", "left").agg(
        F.count("*").alias("total"), F.count_if(s == "completed").alias("analyzed"),
        F.count_if(s.isNull() | s.isin("pending", "failed")).alias("unprocessed"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "processing").alias("processing"),
    )


def page_model(stats: DataFrame) -> DataFrame:
    """Unprocessed includes failed, so failed counts twice in what can be acted on, as the page shows it."""
    return stats.withColumn("actionable", F.col("unprocessed") + F.col("failed")).withColumn("percent", F.least(F.lit(100), F.when(F.col("total") > 0, F.round(F.col("analyzed") * 100.0 / F.col("total"))).otherwise(0)).cast("int"))


@dataclass(frozen=True)
class Session:
    """A bulk run. Times are seconds."""

    started: int
    initial_unprocessed: int = 0
    initial_terminal: int = 0
    volume: int | None = None
    retried: tuple[int, ...] = ()
    last_completed: int = 0
    last_rate: float | None = None
    completed_at: int | None = None

    def sample(self, completed: int, now: int) -> Session:
        """The rate changes only when more has been completed."""
        elapsed = now - self.started
        if completed > self.last_completed and elapsed > 0:
            return replace(self, last_completed=completed, last_rate=completed / elapsed)
        return self


def determine_state(session: Session | None, now: int, processing: int, queued: int, failed: int) -> tuple[str, Session | None]:
    """ready, processing or complete. A session ends after its time to live; complete shows for a while, or as long as there are failures."""
    if session is not None and now - session.started > C.SESSION_TTL and session.completed_at is None and not (processing or queued):
        session = None
    if processing or queued:
        return "processing", session
    if session is None:
        return "ready", None
    if session.completed_at is None:
        return "complete", replace(session, completed_at=now)
    if failed > 0 or now - session.completed_at < C.COMPLETE_WINDOW:
        return "complete", session
    return "ready", session


def transition_message(before: str, after: str) -> str | None:
    return {("processing", "complete"): "Bulk processing complete!", ("ready", "processing"): "Processing started"}.get((before, after))


def progress(analyses: DataFrame, session: Session, now: int) -> DataFrame:
    """One row: total, completed, remaining, failed in this session, percent, rate and time left."""
    began = F.timestamp_seconds(F.lit(session.started))
    own = analyses if not session.retried else analyses.join(_among(session.retried, analyses), "assetId", "left_semi")
    base = own.agg(F.count_if(F.col("status").isin("pending", "processing")).alias("open"), F.count_if(F.col("status").isin(*C.TERMINAL)).alias("ended"))
    failed = analyses.agg(F.count_if((F.col("status") == "failed") & (F.col("processedAt") >= began)).alias("failed"), F.sum(F.when(F.col("processedAt") >= began, F.col("actualCost"))).alias("cost"))
    first = len(session.retried) or session.initial_unprocessed
    if session.retried:
        completed = F.greatest(F.lit(0), F.lit(first) - F.col("open"))
    else:
        completed = F.greatest(F.lit(0), F.least(F.lit(first), F.col("ended") - session.initial_terminal))
    out = base.crossJoin(failed).select(F.lit(max(first, 1)).cast("long").alias("total"), completed.cast("long").alias("completed"), "failed", "cost")
    out = out.withColumn("remaining", F.greatest(F.lit(0), F.lit(first) - F.col("completed")).cast("long")).withColumn("percent", F.round(F.col("completed") * 100.0 / F.col("total"), 1))
    elapsed = now - session.started
    fresh = (F.col("completed") > session.last_completed) & F.lit(elapsed > 0)
    rate = F.when(fresh, F.col("completed") / F.lit(float(max(elapsed, 1)))).otherwise(F.lit(session.last_rate).cast("double"))
    out = out.withColumn("rate", rate).withColumn("eta_seconds", F.when((F.col("rate") > 0) & (F.col("remaining") > 0), F.floor(F.col("remaining") / F.col("rate"))).cast("int"))
    return out.withColumn("eta", duration_text(F.col("eta_seconds")))


def failure_reasons(analyses: DataFrame, content: DataFrame, assets: DataFrame, first: int = 10) -> DataFrame:
    """Failed analyses by error code, the most frequent first, with the first assets of each. Unknown codes count as `unknown`."""
    codes = [str(c) for c in C.ErrorCode]
    failed = analyses.where(F.col("status") == "failed").select(F.col("id").alias("analysisId"), "assetId").join(content, "analysisId")
    failed = failed.withColumn("code", F.when(F.col("errorCode").isin(codes), F.col("errorCode")).otherwise("unknown"))
    total = failed.groupBy("code").agg(F.count("*").alias("n"))
    ranked = failed.withColumn("rn", F.row_number().over(Window.partitionBy("code").orderBy("assetId"))).where(F.col("rn") <= first)
    named = ranked.join(assets.select(F.col("id").alias("assetId"), "filename"), "assetId", "left")
    shown = named.groupBy("code").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "assetId", "filename"))), lambda x: F.struct(x["assetId"].alias("assetId"), x["filename"].alias("filename"))).alias("assets"))
    return total.join(shown, "code").select("code", "n", "assets", (F.col("n") > first).alias("has_more")).orderBy(F.desc("n"), "code")


def queue_info(queue: DataFrame) -> DataFrame:
    """Waiting and running jobs, and what the first one says it does. `queue`: id, reserved, description."""
    return queue.agg(F.count_if(~F.col("reserved")).alias("pending"), F.count_if(F.col("reserved")).alias("running"), F.min_by("description", "id").alias("description"))


def stuck(analyses: DataFrame, now: datetime, status: str, minutes: int | None = None) -> DataFrame:
    minutes = C.STUCK_MINUTES[status] if minutes is None else minutes
    return analyses.where((F.col("status") == status) & (F.col("dateUpdated") < F.lit(now) - F.make_interval(mins=F.lit(minutes))))


def reset_stuck(analyses: DataFrame, now: datetime, status: str, minutes: int | None = None) -> DataFrame:
    """All rows, stuck ones as failed."""
    minutes = C.STUCK_MINUTES[status] if minutes is None else minutes
    old = (F.col("status") == status) & (F.col("dateUpdated") < F.lit(now) - F.make_interval(mins=F.lit(minutes)))
    return analyses.withColumn("status", F.when(old, "failed").otherwise(F.col("status")))


def retry_failed(analyses: DataFrame) -> DataFrame:
    return analyses.withColumn("status", F.when(F.col("status") == "failed", "pending").otherwise(F.col("status")))


def cancel_bulk(analyses: DataFrame, retried: Sequence[int]) -> DataFrame:
    """Pending rows that were retried are failed again; rows in processing go."""
    rest = analyses.where(F.col("status") != "processing")
    if not retried:
        return rest
    tried = _among(retried, analyses).withColumn("_tried", F.lit(True))
    again = (F.col("status") == "pending") & F.coalesce("_tried", F.lit(False))
    return rest.join(tried, "assetId", "left").withColumn("status", F.when(again, "failed").otherwise(F.col("status"))).select(*analyses.columns)


def orphaned(analyses: DataFrame, queue: DataFrame) -> DataFrame:
    """Pending or running analyses whose job has left the queue. `queue`: assetId."""
    return analyses.where(F.col("status").isin("pending", "processing")).join(queue.select("assetId"), "assetId", "left_anti")


def eligible(assets: DataFrame, analyses: DataFrame, volumes: Sequence[int] | None = None) -> DataFrame:
    """Images of enabled volumes without an analysis, or with a pending or failed one."""
    images = in_volumes(assets.where(F.col("kind") == "image"), volumes)
    return images.join(analyses.where(~F.col("status").isin("pending", "failed")).select(F.col("assetId").alias("id")), "id", "left_anti")


def selection_split(assets: DataFrame, analyses: DataFrame, volumes: Sequence[int] | None = None) -> DataFrame:
    """How many of a selection are eligible, and how many are skipped."""
    ok = eligible(assets, analyses, volumes).select("id", F.lit(True).alias("ok"))
    return assets.select("id").join(ok, "id", "left").groupBy(F.coalesce("ok", F.lit(False)).alias("eligible")).agg(F.count("*").alias("n"))


def batches(assets: DataFrame, size: int = 20) -> DataFrame:
    """Batch numbers by ascending id, without one task for all rows: ranges are numbered by their counts."""
    from pyspark.sql import Window as W

    ranged = assets.select("id").repartitionByRange("id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id())
    inside = F.row_number().over(W.partitionBy("part").orderBy("id"))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    out = ranged.withColumn("rn", inside).join(F.broadcast(before), "part")
    return out.select("id", F.floor((F.col("before") + F.col("rn") - 1) / size).cast("long").alias("batch"))


def single_job(analyses: DataFrame, assets: DataFrame, asset: int) -> tuple[DataFrame, DataFrame]:
    """The asset to analyse, if it is still there, and the analyses: without its own if it isn't."""
    one = assets.where(F.col("id") == asset)
    gone = analyses.where(F.col("assetId") == asset).select("assetId").join(one.select(F.col("id").alias("assetId")), "assetId", "left_anti")
    return one, analyses.join(F.broadcast(gone.distinct()), "assetId", "left_anti")  # one row at most


def selected_job(assets: DataFrame, chosen: DataFrame) -> DataFrame:
    """A selection (id, position) in its order: position, assetId, whether it is still there (others are skipped), and how many were chosen."""
    total = chosen.agg(F.count("*").alias("total"))
    known = assets.select("id", F.lit(True).alias("_known"))
    return chosen.join(known, "id", "left").crossJoin(F.broadcast(total)).select(F.col("position").cast("long").alias("position"), F.col("id").alias("assetId"), F.coalesce("_known", F.lit(False)).alias("found"), "total")  # one row


def _among(ids: Sequence[int], df: DataFrame) -> DataFrame:
    """A table of ids, so that a long list isn't a part of the plan."""
    return df.sparkSession.createDataFrame([(int(i),) for i in sorted(set(ids))], "assetId long")

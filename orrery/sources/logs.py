"""The structured log: append, pages, retention."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as C
from ..config import LOG_RETENTION_DAYS
from ..functions.labels import truncated
from ..plans.keyset import OrderedPages
from ..schemas import schema


def append_logs(rows: DataFrame, path: str) -> None:
    """Long contexts are cut; files are partitioned by day, so that retention drops folders."""
    cut = rows.withColumn("context", truncated(F.col("context"), 5000)) if "context" in rows.columns else rows
    cut.withColumn("day", F.to_date("dateCreated")).write.mode("append").partitionBy("day").parquet(path)


def filter_logs(logs: DataFrame, level: str | None = None, category: str | None = None, asset: int | None = None) -> DataFrame:
    for column, value in (("level", level), ("category", category), ("assetId", asset)):
        if value is not None:
            logs = logs.where(F.col(column) == value)
    return logs


def log_page(logs: DataFrame, page: int = 1, per_page: int = 50, **filters) -> DataFrame:
    """Newest first."""
    cols = [c for c in ("id", "level", "category", "message", "assetId", "dateCreated") if c in logs.columns]
    return filter_logs(logs, **filters).select(*cols).orderBy(F.desc("dateCreated"), F.desc("id")).offset((max(1, page) - 1) * per_page).limit(per_page)


def page_model(logs: DataFrame, page: int = 1, per_page: int = 50, **filters) -> DataFrame:
    """Total, pages, and the numbers of the first and last row shown."""
    n = filter_logs(logs, **filters).agg(F.count("*").alias("total"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)).cast("long")
    first = F.when(F.col("total") > 0, F.lit((page - 1) * per_page + 1)).otherwise(0).cast("long")
    return n.select("total", pages.alias("pages"), first.alias("first"), F.least(F.col("total"), F.lit(page * per_page)).cast("long").alias("last"))


def expired(logs: DataFrame, now: datetime, days: int = LOG_RETENTION_DAYS) -> DataFrame:
    return logs.where(F.col("dateCreated") < F.lit(now) - F.make_interval(days=F.lit(days)))


def retained(logs: DataFrame, now: datetime, days: int = LOG_RETENTION_DAYS) -> DataFrame:
    return logs.where(F.col("dateCreated") >= F.lit(now) - F.make_interval(days=F.lit(days)))


# --- Pages by key -----------------------------------------------------------------------------------------------------


def keep_pages(logs: DataFrame, folder: str, blocks: int | None = None) -> OrderedPages:
    """The log in the order of its pages, newest first."""
    keyed = logs.withColumns({"k1": -F.unix_micros(F.col("dateCreated").cast("timestamp")), "k2": -F.col("id")})
    return OrderedPages(logs.sparkSession, folder, ["k1", "k2"]).write(keyed, blocks)


def level_is(level: str) -> Column:
    return F.col("level") == level


# --- A log in days ------------------------------------------------------------------------------------------------------

#: Part of a log that was stored as a whole, before it was kept in days.
WHOLE = ""


def _day(column: str) -> Column:
    """Days of universal time, so that folders don't depend on a session's zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(column) / 86400).cast("int"))


def _write_days(rows: DataFrame, folder: str, version: int) -> dict[str, str]:
    """Writes rows beside the others; the paths by day."""
    own = f"version={version + 1}-{uuid.uuid4().hex[:8]}/logs.parquet"
    rows.withColumn("day", _day("dateCreated")).write.partitionBy("day").parquet(f"{folder}/{own}")
    fs, path = C._file_system(rows.sparkSession, folder)
    return {name[4:]: f"{own}/{name}" for name in C._named(fs, path, f"{folder}/{own}", "day=*")}


def _parts(spark: SparkSession, folder: str, places: dict[str, C.Place]) -> dict[str, list[str]]:
    place = places.get("logs")
    if place is None:
        fs, path = C._file_system(spark, folder)
        place = "logs.parquet" if fs.exists(path(f"{folder}/logs.parquet")) else {}
    return {WHOLE: [place]} if isinstance(place, str) else place


def read_days(spark: SparkSession, folder: str) -> DataFrame:
    """The log of the current version."""
    return C.table_at(spark, folder, schema("logs"), _parts(spark, folder, C.current_version(spark, folder)[1]))


def append_days(rows: DataFrame, folder: str) -> int:
    """Adds rows to the log of the catalog in `folder` as its next version; other writers' rows stay. Nothing that is there is read or written again."""
    spark = rows.sparkSession
    cut = rows.withColumn("context", truncated(F.col("context"), 5000)) if "context" in rows.columns else rows
    cut = cut.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema("logs") if f.name in rows.columns))
    own = _write_days(cut, folder, C.current_version(spark, folder)[0])

    def edit(_: int, places: dict[str, C.Place]) -> dict[str, C.Place]:
        parts = _parts(spark, folder, places)
        return places | {"logs": parts | {d: [*parts.get(d, []), p] for d, p in own.items()}}

    return C.commit(spark, folder, edit, list(own.values()))


def drop_expired(spark: SparkSession, folder: str, now: datetime, days: int = LOG_RETENTION_DAYS) -> int:
    """A version of the log without what has expired; its number, or that of the current one if nothing has.

    Whole days go by their names. Only the day in which the limit lies is written again, if it holds expired rows, and a part that isn't in days yet. Rows without a
    date stay. Rows that others add meanwhile stay too, to the next call if they have expired. Files go with `remove_old_versions`.
    """
    begins = F.unix_micros(F.lit(now) - F.make_interval(days=F.lit(days)))
    limit, border = spark.range(1).select(begins, F.date_from_unix_date(F.floor(begins / 86_400_000_000).cast("int")).cast("string")).first()
    version, places = C.current_version(spark, folder)
    parts = _parts(spark, folder, places)
    old = F.unix_micros("dateCreated") < limit
    dated = lambda d: d not in (WHOLE, "__HIVE_DEFAULT_PARTITION__")
    gone = {d: ps for d, ps in parts.items() if dated(d) and d < border}
    torn, own = {d: parts[d] for d in (WHOLE, border) if d in parts}, {}
    rows = C.table_at(spark, folder, schema("logs"), torn)
    if torn and (WHOLE in torn or not rows.where(old).isEmpty()):
        own = _write_days(rows.where(~F.coalesce(old, F.lit(False))), folder, version)
    else:
        torn = {}
    if not gone and not torn:
        return version

    def edit(n: int, places: dict[str, C.Place]) -> dict[str, C.Place]:
        now_there = _parts(spark, folder, places)
        if any(now_there.get(d, [])[: len(ps)] != ps for d, ps in (gone | torn).items()):
            raise RuntimeError(f"another writer has written version {n} of {folder} with days of this one")
        left = {d: ps[len((gone | torn).get(d, [])) :] for d, ps in now_there.items()}
        for d, p in own.items():
            left[d] = [p, *left.get(d, [])]
        return places | {"logs": {d: ps for d, ps in left.items() if ps}}

    return C.commit(spark, folder, edit, list(own.values()))

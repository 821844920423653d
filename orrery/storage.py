"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset, a local one in local mode, as in tests, and an error on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not (spark.sparkContext.master or "").split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{(base or tempfile.mkdtemp(prefix='orrery-')).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def store(spark: SparkSession, df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """Writes a table and returns it as read: this cuts the lineage, and a lost executor loses nothing of it."""
    path = shared_folder(spark, purpose)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that are saved inside are deleted at the end, but for the paths that are put into the list it gives.

    For callers that write their result inside; results that are still to be computed need their tables.
    """
    at, keep = len(_MADE), []
    try:
        yield keep
    finally:
        for path in _MADE[at:]:
            if path not in keep:
                delete(spark, path)
        _MADE[at:] = [path for path in _MADE[at:] if path in keep]

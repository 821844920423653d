"""Pages by key, over a table that is kept in the order of its pages."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Blocks of the directory that are summed together, so that a place is found from one row for each so many blocks.
_FAN = 1024


def after_key(keys: Sequence[str], key: Sequence[Any], prefix: str = "") -> Column:
    """Rows that come after a key. Nested, so that the condition on the first column alone reaches the statistics of files and row groups."""
    name, value = F.col(prefix + keys[0]), F.lit(key[0])
    if len(keys) == 1:
        return name > value
    return (name >= value) & ((name > value) | after_key(keys[1:], key[1:], prefix))


def token_of(keys: Sequence[str], row: Row) -> str:
    """What a caller sends back for the next page."""
    return json.dumps([row[k] for k in keys])


def key_of(token: str) -> list[Any]:
    return json.loads(token)


class OrderedPages:
    """Rows below `folder` in ascending order of `keys`, cut in blocks of a folder each, and a directory: first and last key and number of rows of each block.

    Keys are numbers, never null, and together tell rows apart; a descending order is one of negative numbers. Rows are dealt out by ranges of all keys, so many ties of the first one
    spread over blocks. A page reads the blocks it lies in, whatever comes before. The table is a picture of the moment it was written: write it anew, in a new folder, for a new version.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), list(keys)

    def write(self, rows: DataFrame, blocks: int | None = None) -> OrderedPages:
        """`blocks`: about how many; the number of shuffle partitions if not given, joined where they are small."""
        by = [F.col(k) for k in self.keys]
        dealt = rows.repartitionByRange(blocks, *by) if blocks else rows.repartitionByRange(*by)
        dealt.withColumn("_block", F.spark_partition_id()).sortWithinPartitions("_block", *by).write.partitionBy("_block").parquet(f"{self.folder}/rows")
        rows.limit(0).write.parquet(f"{self.folder}/empty")  # the columns, also where there is no block
        kept = self.spark.read.schema(rows.select(*self.keys).schema.add("_block", IntegerType())).parquet(f"{self.folder}/rows")
        ends = kept.groupBy("_block").agg(F.min(F.struct(*by)).alias("first"), F.max(F.struct(*by)).alias("last"), F.count("*").alias("n"))
        named = [F.col(f"{end}.{k}").alias(f"{end}_{k}") for end in ("first", "last") for k in self.keys]
        ends.select("_block", *named, "n").repartitionByRange(F.col("_block")).sortWithinPartitions("_block").write.parquet(f"{self.folder}/directory")
        return self

    def directory(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/directory")

    def total(self) -> int:
        return self.directory().agg(F.sum("n")).first()[0] or 0

    def rows(self, blocks: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some blocks, without listing the others."""
        base, empty = f"{self.folder}/rows", self.spark.read.parquet(f"{self.folder}/empty")
        if blocks is not None and not blocks:
            return empty
        paths = [base] if blocks is None else [f"{base}/_block={b}" for b in blocks]
        return self.spark.read.schema(empty.schema).parquet(*paths)

    def page(self, limit: int, after: Sequence[Any] | None = None, where: Column | None = None) -> DataFrame:
        """The first rows after a key, of those that pass a filter if one is given. With a filter twice as many blocks are read in each turn until the page is full."""
        follows = self.directory() if after is None else self.directory().where(after_key(self.keys, after, "last_"))
        test = F.lit(True) if after is None else after_key(self.keys, after)
        if where is not None:
            test = test & where
        take = 2
        while True:
            blocks = follows.orderBy("_block").limit(take).select("_block", "n").collect()
            found = self.rows([b["_block"] for b in blocks]).where(test)
            # Of the first block any number of rows may lie before the key.
            if len(blocks) < take or (sum(b["n"] for b in blocks[1:]) >= limit if where is None else found.limit(limit).count() >= limit):
                return found.orderBy(*self.keys).limit(limit)
            take *= 2

    def at(self, offset: int, limit: int) -> DataFrame:
        """The page at a number of rows from the start: the directory tells its blocks, and nothing before them is read."""
        part = F.floor(F.col("_block") / _FAN)
        before, start = 0, None
        for p in self.directory().groupBy(part.alias("part")).agg(F.sum("n").alias("n")).orderBy("part").collect():
            start = p["part"]
            if before + p["n"] > offset:
                break
            before += p["n"]
        else:
            return self.rows([])
        blocks, skip, have = [], offset - before, 0
        for b in self.directory().where(part == start).orderBy("_block").select("_block", "n").collect():
            if not blocks and skip >= b["n"]:
                skip -= b["n"]
                continue
            blocks.append(b["_block"])
            have += b["n"]
            if have >= skip + limit:
                return self.rows(blocks).orderBy(*self.keys).offset(skip).limit(limit)
        # The page goes on in the next part of the directory.
        take = 2
        while True:
            later = self.directory().where(F.col("_block") > blocks[-1]).orderBy("_block").limit(take).select("_block", "n").collect()
            if len(later) < take or have + sum(b["n"] for b in later) >= skip + limit:
                return self.rows([*blocks, *(b["_block"] for b in later)]).orderBy(*self.keys).offset(skip).limit(limit)
            take *= 2

"""A table as numbered additions: new rows beside old ones, deletions as rows, merged when read and from time to time in storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .storage import delete


class Segments:
    """Rows below `folder`, in a folder for each number. The row of the greatest number is the one that counts for its key; a key whose last row has `deleted` is gone.

    An addition counts once it is written as a whole; the same number is written once only, so that a repeated one is harmless, and one that broke off is written anew.
    A compaction makes one base of all additions up to a number; what it replaces stays until the next one, for readers that began before it.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str | S.StructType, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        self.schema = schema if isinstance(schema, S.StructType) else S._parse_datatype_string(schema)

    def _complete(self, kind: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.globStatus(path(f"{self.folder}/{kind}=*/_SUCCESS")) or []
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)

    def last(self) -> int | None:
        """The number of the last addition that was written as a whole."""
        return max([*self._complete("number"), *self._complete("base")], default=None)

    def add(self, rows: DataFrame, number: int) -> bool:
        """Adds rows under a number; false if that number is there already."""
        last = self.last()
        if number in self._complete("number") or (bases := self._complete("base")) and number <= bases[-1]:
            return False
        if last is not None and number < last:
            raise ValueError(f"addition {number} comes after {last} in {self.folder}")
        rows.select(self.schema.names).write.mode("overwrite").parquet(f"{self.folder}/number={number}")
        return True

    def rows(self, upto: int | None = None) -> DataFrame:
        """All rows with their `number`, those of one key from before the last compaction but for the last left out."""
        end = self.last() if upto is None else upto
        base = max((b for b in self._complete("base") if end is not None and b <= end), default=None)
        read = self.spark.read.schema(S.StructType([*self.schema.fields, S.StructField("number", S.LongType())]))
        parts = [read.parquet(f"{self.folder}/base={base}")] if base is not None else []
        later = [f"{self.folder}/number={n}" for n in self._complete("number") if end is not None and n <= end and (base is None or n > base)]
        if later:
            parts.append(read.option("basePath", self.folder).parquet(*later))
        if not parts:
            return self.spark.createDataFrame([], S.StructType([*self.schema.fields, S.StructField("number", S.LongType())]))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def latest(self, upto: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """The row that counts for each key, or for the keys that are among those of `of` (some key columns, once each)."""
        rows = self.rows(upto)
        if of is not None:
            rows = rows.join(of, [c for c in of.columns if c in self.keys], "left_semi")
        values = [c for c in self.schema.names if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "number").alias("_v")).select(*self.keys, "_v.*")
        return (newest.where(~F.coalesce(F.col("deleted"), F.lit(False))) if "deleted" in values else newest).select(self.schema.names)

    def compact(self, merged: bool = True, rows: DataFrame | None = None, upto: int | None = None) -> None:
        """Writes a base of all additions, or those up to a number: of each key the row that counts, or all rows if not `merged`, or the `rows` given with their numbers. Removes what the base before it had replaced."""
        number, before = self.last() if upto is None else upto, self._complete("base")
        if number is None or (before and before[-1] == number):
            return
        if rows is not None:
            base = rows.select(*self.schema.names, "number")
        elif merged:
            base = self.latest(number).withColumn("number", F.lit(number).cast("long"))
        else:
            base = self.rows(number)
        base.write.mode("overwrite").parquet(f"{self.folder}/base={number}")
        for b in before:
            for n in self._complete("number"):
                if n <= b:
                    delete(self.spark, f"{self.folder}/number={n}")
            if b != before[-1]:
                delete(self.spark, f"{self.folder}/base={b}")

    def sizes(self) -> dict[str, int]:
        """Bytes of each base and addition."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        return {f"{kind}={n}": fs.getContentSummary(path(f"{self.folder}/{kind}={n}")).getLength() for kind in ("base", "number") for n in self._complete(kind)}

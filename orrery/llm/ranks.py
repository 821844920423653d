"""Numbers of rows in an order, found without putting a whole group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import store


def numbered(df: DataFrame, by: list[str], order: list, name: str, purpose: str = "numbered") -> DataFrame:
    """`df` with `name`: the number, from 1, of each row among those that share the columns `by`, in the given order.

    Rows are dealt out by ranges of `by` and `order`, and saved with the number of their range, so that no later step depends on how ranges are
    drawn again. Rows are numbered within their range; to this comes how many rows earlier ranges have of the same group, a table of one row for each
    group and range. Rows that are equal in both are numbered in any order: give an order that is total. Nulls form a group, and come where the
    order puts them.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = store(df.sparkSession, df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), purpose)
    keys = [F.col(c) for c in by]
    before = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col("_range").alias("_r"), "_before")
    own = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)).cast("long"))
    same = own["_range"] == before["_r"]
    for i, c in enumerate(by):
        same = same & own[c].eqNullSafe(before[f"_b{i}"])
    return own.join(before, same).withColumn(name, F.col(name) + F.col("_before")).select(*df.columns, name)

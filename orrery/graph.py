"""Connected components of an edge table, for clusters of any size and any number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _with_least(pairs: DataFrame) -> DataFrame:
    """Each (a, b) with the least b of its a; grouped before it is joined, so that no task holds a node's whole neighbourhood.

    The second key has both sides of the join shuffled for it: only then can Spark split the rows of a node that has very many.
    """
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("_h", F.xxhash64("a"))
    return pairs.withColumn("_h", F.xxhash64("a")).join(least, ["a", "_h"]).drop("_h")


def connected_components(edges: DataFrame, save: Callable[[DataFrame], DataFrame], *, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014), which take a number of rounds
    logarithmic in the longest path. `save` must cut the lineage reliably: it writes the table and
    returns it as read. Loops and repeated edges are allowed; edges with a null end are ignored.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes_alone = both.where("a = b").select("a").distinct()
    now = save(both.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        mirrored = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: each neighbour beyond a node goes to the least of the node and its neighbours.
        large = _with_least(mirrored).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a != b").distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        small = _with_least(large)
        small = small.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        now = save(small)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Every node now points at its component's smallest node.
    found = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = found.unionByName(roots)
    alone = nodes_alone.join(out, nodes_alone.a == out.node, "left_anti").select(F.col("a").alias("node"), F.col("a").alias("component"))
    return out.unionByName(alone)

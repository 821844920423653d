"""Semi and anti joins on pairs of near duplicates, without disjunctions that would need a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unresolved(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("resolution").isNull())


def endpoints(pairs: DataFrame) -> DataFrame:
    """One row for each side of each pair: the asset and the other one."""
    side = lambda a, b: F.struct(F.col(a).alias("assetId"), F.col(b).alias("otherId"))
    rest = [c for c in pairs.columns if c not in ("canonicalAssetId", "duplicateAssetId", "assetId", "otherId")]
    both = pairs.select(*rest, F.explode(F.array(side("canonicalAssetId", "duplicateAssetId"), side("duplicateAssetId", "canonicalAssetId"))).alias("s"))
    return both.select("s.assetId", "s.otherId", *rest)


def with_duplicates(assets: DataFrame, pairs: DataFrame, flag: bool = True, key: str = "id") -> DataFrame:
    ids = endpoints(unresolved(pairs)).select(F.col("assetId").alias(key)).distinct()
    return assets.join(ids, key, "left_semi" if flag else "left_anti")


def neighbours(pairs: DataFrame, asset: int) -> DataFrame:
    """Assets in an unresolved pair with `asset`, with the pair's similarity and distance."""
    near = unresolved(pairs).where((F.col("canonicalAssetId") == asset) | (F.col("duplicateAssetId") == asset))
    return near.select(F.when(F.col("canonicalAssetId") == asset, F.col("duplicateAssetId")).otherwise(F.col("canonicalAssetId")).alias("assetId"), "similarity", "hammingDistance", "id")


def similar_to(assets: DataFrame, pairs: DataFrame, anchor: int, key: str = "id") -> DataFrame:
    """The anchor and its direct neighbours; an anchor of 0 or less filters nothing."""
    if anchor <= 0:
        return assets
    ids = neighbours(pairs, anchor).select(F.col("assetId").alias(key)).unionByName(assets.sparkSession.range(1).select(F.lit(anchor).cast("long").alias(key)))
    return assets.join(ids.distinct(), key, "left_semi")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Unresolved pairs of each asset that has one."""
    return endpoints(unresolved(pairs)).groupBy("assetId").agg(F.count("*").alias("n_pairs"))


def cluster_keys(pairs: DataFrame) -> DataFrame:
    """The smallest cluster key of each asset's unresolved pairs."""
    return endpoints(unresolved(pairs)).groupBy("assetId").agg(F.min("clusterKey").alias("clusterKey"))

"""The wide view behind an asset's panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions import labels as L
from ..operators import pairs as P


def top_tags(tags: DataFrame, n: int = 5) -> DataFrame:
    """analysisId and its `n` most confident tags, joined with commas."""
    w = Window.partitionBy("analysisId").orderBy(F.desc("confidence"), "tag")
    first = tags.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    return first.groupBy("analysisId").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "tag"))), lambda x: x["tag"]), ", ").alias("tags"))


def brand_names(brands, n: int = 5):
    return F.array_join(F.slice(F.filter(F.transform(F.coalesce(brands, F.array()), lambda b: b["brand"]), lambda b: F.coalesce(b, F.lit("")) != ""), 1, n), ", ")


def similar_top(pairs: DataFrame, n: int = 3) -> DataFrame:
    """assetId, number of similar assets and the `n` most similar."""
    both = P.endpoints(P.unresolved(pairs))
    w = Window.partitionBy("assetId").orderBy(F.desc("similarity"), "otherId")
    counts = both.groupBy("assetId").agg(F.count("*").alias("n_similar"))
    first = both.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).groupBy("assetId").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "otherId"))), lambda x: x["otherId"]).alias("similar"))
    return counts.join(first, "assetId")


def asset_panel(catalog: Catalog) -> DataFrame:
    """One row for each asset: analysis, tags, similar assets, readiness and quality verdicts."""
    own = catalog.analyses.withColumnRenamed("id", "analysisId")
    a = catalog.assets
    df = a.join(own.select(*[c for c in own.columns if c not in a.columns]), a.id == own.assetId, "left").drop("assetId")
    df = df.join(top_tags(catalog.asset_tags), "analysisId", "left").join(similar_top(catalog.duplicate_groups).withColumnRenamed("assetId", "id"), "id", "left")
    checks = L.readiness(F.col("size"), F.col("width"), F.col("filename"))
    return df.select(
        "id", "filename", L.status_label(F.col("status"))["text"].alias("status"), F.coalesce("tags", F.lit("")).alias("tags"), brand_names(F.col("detectedBrands")).alias("brands"),
        L.people_label(F.col("containsPeople"), F.col("faceCount")).alias("people"), L.watermark_label(F.col("hasWatermark"), F.col("watermarkType"), F.col("watermarkDetails.stockProvider")).alias("watermark"),
        L.duplicates_label(F.col("n_similar")).alias("duplicates"), F.coalesce("similar", F.array().cast("array<bigint>")).alias("similar"), L.overall(checks).alias("readiness"), F.size(F.filter(L.quality_checks(), lambda c: c["status"] != "pass")).alias("n_quality_warnings"),
    )

"""From parsed model results to the updated tables, and their storage as one step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog, open_catalog, write_version
from . import mutations as M
from . import search_index as S
from .duplicates import new_pairs, without_assets


def stock_provider_of(has: Column, kind: Column, details: Column) -> Column:
    """Only of a stock watermark."""
    return F.when(has & (kind == "stock"), F.nullif(F.trim(details["stockProvider"]), F.lit("")))


def ingest(catalog: Catalog, results: DataFrame, now) -> dict[str, DataFrame]:
    """New analyses, tags and error rows from `results` (assetId, provider, inputTokens, outputTokens and the normalised values).

    Effective values that people edited stay; the model's tags are replaced, people's stay; errors of these assets go.
    """
    rows = results.withColumns({"status": F.lit("completed"), "processedAt": F.lit(now).cast("timestamp"), "extractedTextAi": F.col("extractedText")})
    pending = M.create_pending(catalog.analyses, results.select(F.col("assetId").alias("id")), now)
    # A new row's id follows its asset's, so that the merge can be repeated.
    pending = pending.withColumn("id", F.coalesce("id", F.xxhash64("assetId").bitwiseAND(F.lit((1 << 62) - 1))))
    analyses = M.dual_write(pending, rows)
    key = analyses.select("assetId", F.col("id").alias("analysisId"))
    fresh = results.select("assetId", F.posexplode("tags").alias("pos", "t")).join(key, "assetId").select("assetId", "analysisId", "pos", "t.tag", "t.confidence")
    out = {"analyses": analyses, "asset_tags": M.sync_tags(catalog.asset_tags, fresh)}
    if "analysis_content" in catalog.tables:
        done = results.select("assetId").join(key, "assetId").select("analysisId")
        out["analysis_content"] = catalog.analysis_content.join(done, "analysisId", "left_anti")
    return out


def save_errors(stored: DataFrame, refused: DataFrame, analyses: DataFrame) -> DataFrame:
    """Error rows merged by analysis. `refused`: assetId, errorCode, errorMessage."""
    new = refused.join(analyses.select("assetId", F.col("id").alias("analysisId")), "assetId").select("analysisId", "errorMessage", "errorCode")
    return M.keyed_merge(stored, new, ["analysisId"])


def rehash(pairs: DataFrame, before: DataFrame, after: DataFrame, found: DataFrame, save) -> DataFrame:
    """Pairs after hashes changed: those of changed assets go, newly found ones come, clusters follow. `before`, `after`: assetId, hash."""
    changed = after.join(before.withColumnRenamed("hash", "old"), "assetId").where(~F.col("hash").eqNullSafe(F.col("old"))).select("assetId")
    rest = without_assets(pairs, changed, save)
    fresh = new_pairs(found, rest).withColumn("id", F.xxhash64("canonicalAssetId", "duplicateAssetId"))
    return without_assets(rest.unionByName(fresh.select(*[c for c in fresh.columns if c in rest.columns]), allowMissingColumns=True), changed.limit(0), save)


def apply_to_assets(assets: DataFrame, analyses: DataFrame, chosen: DataFrame, what: str) -> DataFrame:
    """Writes title, alt or focal point of the analyses into the chosen assets (id), whatever they hold."""
    source = {"title": F.nullif("suggestedTitle", F.lit("")), "alt": F.nullif("altText", F.lit("")), "focalPoint": F.nullif(F.concat_ws(";", "focalPointX", "focalPointY"), F.lit(""))}[what]
    new = analyses.select(F.col("assetId").alias("id"), source.alias("_v")).join(chosen.select("id"), "id", "left_semi")
    return assets.join(new, "id", "left").select(*[F.coalesce("_v", what).alias(what) if c == what else F.col(c) for c in assets.columns])


def write_tables(tables: dict[str, DataFrame], folder: str) -> int:
    """Replaces all of these tables in one step; returns the number of the new version."""
    return write_version(tables, folder)


def rebuild_index(catalog: Catalog, folder: str, language: str = "en") -> int:
    """Replaces the stored index from processed analyses in one step, so that searches never see a half of it; returns its number of postings."""
    index = S.build_index(catalog.analyses, catalog.asset_tags, catalog.assets, language=language)
    write_version({"search_index": S.by_token(index)}, folder)
    return open_catalog(catalog.spark, folder).search_index.count()

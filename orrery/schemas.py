"""Table schemas, and checks that stand for a database's constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

_DDL = {
    "assets": "id long not null, volumeId long not null, filename string, mimeType string, kind string not null, alt string, width int, height int, size long, focalPoint string, title string, dateCreated timestamp, dateDeleted timestamp",
    "analyses": "id long not null, assetId long not null, status string not null, previousStatus string, provider string, providerModel string, altText string, altTextAi string, altTextConfidence decimal(3,2), suggestedTitle string, suggestedTitleAi string, titleConfidence decimal(3,2), longDescription string, longDescriptionAi string, longDescriptionConfidence decimal(3,2), faceCount int, faceCountAi int, containsPeople boolean, containsPeopleAi boolean, containsPeopleConfidence decimal(3,2), nsfwScore decimal(5,4), nsfwScoreAi decimal(5,4), nsfwConfidence decimal(5,4), nsfwCategories array<struct<category: string, confidence: double>>, hasWatermark boolean, hasWatermarkAi boolean, watermarkConfidence decimal(3,2), watermarkType string, watermarkDetails struct<stockProvider: string>, containsBrandLogo boolean, containsBrandLogoAi boolean, containsBrandLogoConfidence decimal(3,2), detectedBrands array<struct<brand: string, confidence: double>>, sharpnessScore decimal(5,4), exposureScore decimal(5,4), shadowClipRatio decimal(5,4), highlightClipRatio decimal(5,4), noiseScore decimal(5,4), compressionQuality short, colorProfile string, focalPointX decimal(5,4), focalPointY decimal(5,4), focalPointXAi decimal(5,4), focalPointYAi decimal(5,4), focalPointConfidence decimal(5,4), perceptualHash string, fileContentHash string, extractedTextAi array<string>, inputTokens int, outputTokens int, actualCost decimal(10,6), processedAt timestamp, dateCreated timestamp, dateUpdated timestamp",
    "asset_tags": "assetId long not null, analysisId long not null, tag string not null, tagNormalized string not null, confidence decimal(5,4), isAi boolean not null",
    "duplicate_groups": "id long not null, canonicalAssetId long not null, duplicateAssetId long not null, hammingDistance int not null, similarity decimal(5,4) not null, clusterKey long, resolution string, resolvedAt timestamp, resolvedBy long",
    "search_index": "assetId long not null, analysisId long, token string not null, tokenRaw string not null, field string not null, fieldWeight decimal(3,2) not null, tf int not null",
    "analysis_site_content": "analysisId long not null, siteId long not null, language string not null, altText string, altTextAi string, altTextConfidence decimal(3,2), suggestedTitle string, suggestedTitleAi string, titleConfidence decimal(3,2)",
    "analysis_content": "analysisId long not null, errorMessage string, errorCode string",
    "logs": "id long not null, level string not null, category string not null, message string not null, assetId long, provider string, jobType string, isRetryable boolean, httpStatusCode short, responseTimeMs int, inputTokens int, outputTokens int, context string, dateCreated timestamp not null",
}
UNIQUE = {"analyses": ["assetId"], "duplicate_groups": ["canonicalAssetId", "duplicateAssetId"], "analysis_site_content": ["analysisId", "siteId"], "analysis_content": ["analysisId"]}


def schema(name: str) -> StructType:
    return _parse_datatype_string(_DDL[name])


def violations(df: DataFrame, name: str) -> DataFrame:
    """Rows that break a unique key, with how many share it."""
    keys = UNIQUE[name]
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows of `child` whose parent is gone: what a cascading delete takes."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def cascade(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_semi")


def quarantine(df: DataFrame, name: str = "analyses") -> tuple[DataFrame, DataFrame]:
    """Rows that keep the record rules, and those that break one, with the reasons."""
    limits = {"altText": 500, "suggestedTitle": 255, "longDescription": 5000}
    reasons = [F.when(F.length(c) > n, F.lit(f"{c} longer than {n}")) for c, n in limits.items() if c in df.columns]
    unit = [c for c in df.columns if c.endswith("Confidence") or c in ("nsfwScore", "sharpnessScore", "exposureScore")]
    reasons += [F.when(~F.col(c).between(0, 1), F.lit(f"{c} outside 0..1")) for c in unit]
    given = df.withColumn("reasons", F.filter(F.array(*reasons), lambda r: r.isNotNull()))
    return given.where(F.size("reasons") == 0).drop("reasons"), given.where(F.size("reasons") > 0)

"""Merges of new results into the stored tables, as pure transforms old + new -> table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .predicates import edited, edited_focal_point


def keyed_merge(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `new` replace or add to those of `old`; columns that `new` lacks keep their values."""
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_new"))
    both = old.join(n, list(keys), "full_outer")
    out = [F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in new.columns and c not in keys else F.col(c) for c in old.columns]
    return both.select(*out)


def create_pending(analyses: DataFrame, assets: DataFrame, now) -> DataFrame:
    """A pending row for each asset without one; existing rows stay."""
    fresh = assets.select(F.col("id").alias("assetId")).join(analyses.select("assetId"), "assetId", "left_anti")
    fresh = fresh.select("assetId", F.lit("pending").alias("status"), F.lit(now).alias("dateUpdated"))
    return analyses.unionByName(fresh, allowMissingColumns=True)


#: Value, model's value: written alike but guarded by an edit.
_GUARDED = ("faceCount", "containsPeople", "nsfwScore", "hasWatermark", "containsBrandLogo")
_PLAIN = ("containsPeopleConfidence", "nsfwConfidence", "nsfwCategories", "watermarkConfidence", "watermarkType", "watermarkDetails", "containsBrandLogoConfidence", "detectedBrands", "longDescriptionConfidence", "focalPointConfidence", "extractedTextAi", "inputTokens", "outputTokens", "actualCost", "processedAt", "status")


def dual_write(old: DataFrame, new: DataFrame, key: str = "assetId") -> DataFrame:
    """The model's values always, the effective ones unless edited. Blank titles and alternative texts change nothing.

    `new` has the effective names (altText, ...); a row that isn't stored yet is added.
    """
    have = set(new.columns)
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c != key], F.lit(True).alias("_new"))
    both = old.join(n, key, "full_outer")
    given = F.coalesce(F.col("_new"), F.lit(False))
    out: dict[str, Column] = {}

    def put(name: str, when: Column, value: Column) -> None:
        if name in old.columns:
            out[name] = F.when(when, value.cast(old.schema[name].dataType)).otherwise(F.col(name))

    for c, conf in (("altText", "altTextConfidence"), ("suggestedTitle", "titleConfidence")):
        if c in have:
            some = given & (F.coalesce(F.col(f"_n_{c}"), F.lit("")) != "")
            put(f"{c}Ai", some, F.col(f"_n_{c}"))
            put(c, some & ~edited(F.col(c), F.col(f"{c}Ai")), F.col(f"_n_{c}"))
            if conf in have:
                put(conf, some, F.col(f"_n_{conf}"))
    for c in (*_GUARDED, "longDescription"):
        if c in have:
            put(f"{c}Ai", given, F.col(f"_n_{c}"))
            put(c, given & ~edited(F.col(c), F.col(f"{c}Ai")), F.col(f"_n_{c}"))
    if {"focalPointX", "focalPointY"} <= have and "focalPointXAi" in old.columns:
        for c in ("focalPointX", "focalPointY"):
            put(f"{c}Ai", given, F.col(f"_n_{c}"))
            put(c, given & ~edited_focal_point(), F.col(f"_n_{c}"))
    for c in _PLAIN:
        if c in have:
            put(c, given, F.col(f"_n_{c}"))
    return both.select(*[out.get(c, F.col(c)).alias(c) for c in old.columns])


def sync_tags(tags: DataFrame, fresh: DataFrame, merge: bool = False) -> DataFrame:
    """Replaces the model's tags of the analyses in `fresh` (assetId, analysisId, pos, tag, confidence); users' tags stay.

    Of equal normalised tags the first counts, and none that is there already is added. With `merge` the old ones stay too.
    """
    touched = fresh.select("analysisId").distinct()
    kept = tags if merge else tags.join(touched, "analysisId", "left_semi").where(~F.col("isAi")).unionByName(tags.join(touched, "analysisId", "left_anti"))
    new = fresh.where(F.coalesce(F.trim("tag"), F.lit("")) != "").withColumn("tagNormalized", F.lower(F.trim("tag")))
    first = new.groupBy("analysisId", "tagNormalized").agg(F.min(F.struct("pos", "assetId", F.trim("tag").alias("tag"), "confidence")).alias("r"))
    first = first.join(kept.select("analysisId", "tagNormalized").distinct(), ["analysisId", "tagNormalized"], "left_anti")
    rows = first.select("r.assetId", "analysisId", "r.tag", "tagNormalized", F.col("r.confidence").cast(tags.schema["confidence"].dataType).alias("confidence"), F.lit(True).alias("isAi"))
    return kept.select(*tags.columns).unionByName(rows.select(*tags.columns))


def replace_tags(tags: DataFrame, fresh: DataFrame, most: int = 50) -> DataFrame:
    """All tags of the analyses in `fresh` (assetId, analysisId, pos, tag, confidence, isAi); a user's have confidence 1. More than `most` are an error."""
    n = F.count("*").over(Window.partitionBy("analysisId"))
    rows = fresh.where(F.coalesce(F.trim("tag"), F.lit("")) != "").withColumn("n", n)
    tag = F.when(F.col("n") > most, F.raise_error(F.lit(f"more than {most} tags")).cast("string")).otherwise(F.trim("tag"))
    conf = F.when(F.col("isAi"), F.col("confidence")).otherwise(1).cast(tags.schema["confidence"].dataType)
    rows = rows.select("assetId", "analysisId", tag.alias("tag"), F.lower(F.trim("tag")).alias("tagNormalized"), conf.alias("confidence"), "isAi")
    return tags.join(fresh.select("analysisId").distinct(), "analysisId", "left_anti").select(*tags.columns).unionByName(rows.select(*tags.columns))


def edit_field(analyses: DataFrame, analysis_id: int, field: str, value) -> DataFrame:
    hit = F.col("id") == analysis_id
    return analyses.withColumn(field, F.when(hit, F.lit(value).cast(analyses.schema[field].dataType)).otherwise(F.col(field)))


def revert_field(analyses: DataFrame, analysis_id: int, field: str) -> DataFrame:
    """Back to the model's value, if there is one."""
    hit = (F.col("id") == analysis_id) & F.col(f"{field}Ai").isNotNull()
    return analyses.withColumn(field, F.when(hit, F.col(f"{field}Ai")).otherwise(F.col(field)))


def save_site_content(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Translations replace the stored ones, users' edits too. `fresh`: analysisId, siteId, language, altText, suggestedTitle and confidences."""
    new = fresh.withColumns({"altTextAi": F.col("altText"), "suggestedTitleAi": F.col("suggestedTitle")})
    return keyed_merge(stored, new, ["analysisId", "siteId"])


def resolve_site_value(content: DataFrame, analyses: DataFrame, site: int, field: str, primary: int) -> DataFrame:
    """analysisId and the value shown on a site: its own if it has one, else the primary site's."""
    own = content.where(F.col("siteId") == site).select("analysisId", F.nullif(F.col(field), F.lit("")).alias("own")) if site != primary else content.limit(0).select("analysisId", F.lit(None).cast("string").alias("own"))
    return analyses.select(F.col("id").alias("analysisId"), F.col(field).alias("base")).join(own, "analysisId", "left").select("analysisId", F.coalesce("own", F.nullif(F.col("base"), F.lit(""))).alias("value"))


def match_locale(content: DataFrame, sites: DataFrame) -> DataFrame:
    """For each site (siteId, locale) the content (locale, pos, ...) of its locale, else the first of its base language."""
    c, s = content.alias("c"), sites.alias("s")
    base = lambda x: F.lower(F.substring(x, 1, 2))
    j = s.join(c, base(F.col("s.locale")) == base(F.col("c.locale")))
    exact = F.lower("s.locale") == F.lower("c.locale")
    rest = [x for x in content.columns if x not in ("locale", "pos")]
    best = F.min_by(F.struct(F.col("c.locale").alias("contentLocale"), *[F.col(f"c.{x}") for x in rest]), F.struct((~exact).alias("e"), F.col("c.pos")))
    return j.groupBy("s.siteId", "s.locale").agg(best.alias("b")).select("siteId", "locale", "b.*")


def sites_needing_content(sites: DataFrame, primary: int) -> DataFrame:
    """Sites beside the primary one whose base language is another. `sites`: siteId, language, position."""
    base = F.lower(F.substring("language", 1, 2))
    main = sites.where(F.col("siteId") == primary).select(base.alias("main")).limit(1)
    return sites.where(F.col("siteId") != primary).crossJoin(F.broadcast(main)).where(base != F.col("main")).drop("main")


def additional_languages(sites: DataFrame, primary: int) -> DataFrame:
    """Distinct languages of those sites, each at its first position."""
    return sites_needing_content(sites, primary).groupBy(F.lower(F.substring("language", 1, 2)).alias("language")).agg(F.min("position").alias("position")).orderBy("position")


def auto_apply(assets: DataFrame, analyses: DataFrame, automatic_title: Column) -> DataFrame:
    """Fills empty native fields from the analysis: alternative text, automatic title, focal point."""
    a = analyses.select(F.col("assetId").alias("id"), "altTextAi", "suggestedTitleAi", F.concat_ws(";", "focalPointX", "focalPointY").alias("_focal") if "focalPointX" in analyses.columns else F.lit("").alias("_focal"))
    blank = lambda c: F.nullif(c, F.lit(""))
    j = assets.join(a, "id", "left")
    return j.select(*[
        F.coalesce(blank(F.col("alt")), blank(F.col("altTextAi")), F.col("alt")).alias("alt") if c == "alt"
        else F.when(automatic_title, F.coalesce(blank(F.col("suggestedTitleAi")), F.col("title"))).otherwise(F.col("title")).alias("title") if c == "title"
        else F.coalesce("focalPoint", blank(F.col("_focal"))).alias("focalPoint") if c == "focalPoint"
        else F.col(c) for c in assets.columns
    ])


def transition(status: Column, event: Column, had_data: Column, previous: Column) -> Column:
    """The status after an event: queue, start, succeed, fail, cancel. A failure keeps `completed` if there was data; null removes the row."""
    open_ = status.isin("pending", "processing")
    return (
        F.when((event == "queue") & (status.isNull() | status.isin("pending", "failed", "completed")), "pending")
        .when((event == "start") & (status == "pending"), "processing").when((event == "succeed") & (status == "processing"), "completed")
        .when((event == "fail") & open_, F.when(had_data, "completed").otherwise("failed")).when((event == "cancel") & open_, previous).otherwise(status)
    )


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Without the rows for which the condition is true; unknown keeps."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def upsert_parquet(spark, path: str, new: DataFrame, keys: Sequence[str], stage: Callable[[str], str] = lambda p: p + ".next") -> None:
    """Merges into a stored table: the result is staged beside it and takes its place when complete."""
    merged = keyed_merge(spark.read.parquet(path), new, keys)
    merged.write.mode("overwrite").parquet(stage(path))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    old, nxt, gone = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, stage(path), path + ".old"))
    fs = old.getFileSystem(conf)
    fs.delete(gone, True)
    if not fs.rename(old, gone):
        raise OSError(f"can't move {path}")
    if not fs.rename(nxt, old):
        fs.rename(gone, old)  # as it was
        raise OSError(f"can't move {stage(path)}")
    fs.delete(gone, True)

"""Dashboard statistics. Counts of one table are fused into one pass of conditional aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..catalog import Catalog
from ..plans.asset_query import in_volumes
from . import pairs as P
from . import predicates as p
from .duplicates import affected_assets


def _zero(c: Column, kind: str = "decimal(20,6)") -> Column:
    return F.coalesce(c, F.lit(0)).cast(kind)


def percentage(n: Column, total: Column) -> Column:
    """One decimal; 0 of nothing."""
    return F.when(total > 0, F.round(n * 100.0 / total, 1)).otherwise(0.0)


def overview(analyses: DataFrame) -> DataFrame:
    """Analyses of every status count for the cost."""
    s = F.col("status")
    return analyses.agg(F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"), _zero(F.sum("actualCost")).alias("total_cost"))


def global_counts(analyses: DataFrame) -> DataFrame:
    done = F.col("status") == "completed"
    return analyses.agg(
        F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(done & p.nsfw_flagged(True)).alias("nsfw_flagged"),
        F.count_if(done & F.col("hasWatermark")).alias("watermarked"), _zero(F.sum("actualCost")).alias("total_cost"),
    )


def coverage(assets: DataFrame, volumes: Sequence[int] | None = None) -> DataFrame:
    """Of images in enabled volumes: those with alternative text and with a focal point."""
    images = in_volumes(assets.where((F.col("kind") == "image") & F.col("dateDeleted").isNull()), volumes)
    n = images.agg(F.count("*").alias("total"), F.count_if(p.missing_alt(False)).alias("with_alt"), F.count_if(p.has_focal_point(True)).alias("with_focal"))
    return n.select("*", percentage(F.col("with_alt"), F.col("total")).alias("alt_pct"), percentage(F.col("with_focal"), F.col("total")).alias("focal_pct"))


def quality_issue_counts(analyses: DataFrame, assets: DataFrame, volumes: Sequence[int] | None = None) -> DataFrame:
    """Completed analyses of assets in enabled volumes, in one pass."""
    own = analyses.where(F.col("status") == "completed")
    if volumes is not None:
        own = own.join(in_volumes(assets, volumes).select(F.col("id").alias("assetId")), "assetId", "left_semi")
    return own.agg(*[F.count_if(make()).alias(name) for name, make in p.QUALITY.items()])


def _usage(df: DataFrame, *keys) -> DataFrame:
    cost = _zero(F.sum("actualCost"))
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    return grouped.agg(F.count("*").alias("n"), cost.alias("total_cost")).withColumn("avg_cost", F.when(F.col("n") > 0, F.round(F.col("total_cost").cast("double") / F.col("n"), 6)).otherwise(0.0))


def usage_between(analyses: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Analyses processed from `start` on and before `end`."""
    df = analyses.where(F.col("processedAt").isNotNull())
    if start is not None:
        df = df.where(F.col("processedAt") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("processedAt") < F.lit(end))
    return _usage(df)


def month_start(now: datetime, back: int = 0) -> datetime:
    m = now.year * 12 + now.month - 1 - back
    return datetime(m // 12, m % 12 + 1, 1)


def this_month(analyses: DataFrame, now: datetime) -> DataFrame:
    return usage_between(analyses, month_start(now))


def last_month(analyses: DataFrame, now: datetime) -> DataFrame:
    return usage_between(analyses, month_start(now, 1), month_start(now))


def monthly_history(analyses: DataFrame, now: datetime, months: int = 12) -> DataFrame:
    """The last months that have analyses, oldest first. Calendar months are counted from their first day."""
    df = analyses.where((F.col("processedAt") >= F.lit(month_start(now, months - 1))) & (F.col("processedAt") < F.lit(month_start(now, -1))))
    out = _usage(df, F.date_trunc("month", "processedAt").alias("month"))
    return out.withColumn("label", F.date_format("month", "MMM yyyy")).orderBy("month")


def token_usage(analyses: DataFrame) -> DataFrame:
    n = analyses.agg(_zero(F.sum("inputTokens"), "long").alias("input_tokens"), _zero(F.sum("outputTokens"), "long").alias("output_tokens"))
    return n.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def provider_breakdown(analyses: DataFrame) -> DataFrame:
    """By provider and model, the most expensive first."""
    out = analyses.where(F.col("provider").isNotNull()).groupBy("provider", "providerModel").agg(F.count("*").alias("n"), _zero(F.sum("actualCost")).alias("total_cost"))
    return out.orderBy(F.desc("total_cost"), "provider", "providerModel")


def pricing_table(spark) -> DataFrame:
    """Nine rows at most times: safe to broadcast."""
    rows = [(a, b, Decimal(x), Decimal(y), i, o) for a, b, x, y, i, o in C.PRICING]
    return spark.createDataFrame(rows, "provider string, model string, price_in decimal(10,2), price_out decimal(10,2), est_in long, est_out long")


def token_cost(tokens_in: Column, tokens_out: Column) -> Column:
    return (tokens_in * F.col("price_in") / 1_000_000 + tokens_out * F.col("price_out") / 1_000_000).cast("decimal(10,6)")


def computed_costs(analyses: DataFrame) -> DataFrame:
    """Cost by tokens; null where the model's prices aren't known."""
    prices = F.broadcast(pricing_table(analyses.sparkSession).withColumnRenamed("model", "providerModel"))
    return analyses.join(prices, ["provider", "providerModel"], "left").withColumn("cost", token_cost(F.col("inputTokens"), F.col("outputTokens")))


def estimated_unit_costs(spark) -> DataFrame:
    return pricing_table(spark).select("provider", "model", token_cost(F.col("est_in"), F.col("est_out")).alias("unit_cost"))


def estimated_unit_cost(model: str) -> Decimal:
    """Of one usual image; 0 for a model that isn't known."""
    for _, m, x, y, i, o in C.PRICING:
        if m == model:
            return (Decimal(x) * i + Decimal(y) * o) / 1_000_000
    return Decimal(0)


def remaining_assets(assets: DataFrame, analyses: DataFrame, volumes: Sequence[int] | None = None) -> DataFrame:
    """Images without a completed or running analysis."""
    images = in_volumes(assets.where((F.col("kind") == "image") & F.col("dateDeleted").isNull()), volumes)
    handled = analyses.where(F.col("status").isin("completed", "processing")).select(F.col("assetId").alias("id"))
    return images.join(handled, "id", "left_anti")


def cost_projection(assets: DataFrame, analyses: DataFrame, model: str, volumes: Sequence[int] | None = None) -> DataFrame:
    unit = F.lit(estimated_unit_cost(model)).cast("decimal(10,6)")
    return remaining_assets(assets, analyses, volumes).agg(F.count("*").alias("remaining")).select("remaining", unit.alias("unit_cost"), (F.col("remaining") * unit).cast("decimal(20,6)").alias("projected_cost"))


#: The order of the attention list.
_ATTENTION = ["failed", "nsfw_flagged", "watermarked", "blurry", "too_dark", "too_bright", "low_contrast", "has_duplicates"]


def attention_items(catalog: Catalog, volumes: Sequence[int] | None = None, pro: bool = True) -> DataFrame:
    """What needs attention, in a fixed order: kinds with a count above 0. Each input is one row."""
    a = global_counts(catalog.analyses).select("failed", "nsfw_flagged", "watermarked")
    q = quality_issue_counts(catalog.analyses, catalog.assets, volumes).toDF("blurry", "too_dark", "too_bright", "low_contrast")
    d = affected_assets(catalog.duplicate_groups).agg(F.count("*").alias("has_duplicates"))
    one = a.crossJoin(q).crossJoin(d)
    kinds = _ATTENTION if pro else _ATTENTION[:-1]
    out = one.select(F.posexplode(F.array(*[F.struct(F.lit(k).alias("type"), F.col(k).alias("count")) for k in kinds])).alias("position", "item"))
    return out.select("position", "item.type", "item.count").where("count > 0").orderBy("position")


def tag_counts(tags: DataFrame, analyses: DataFrame, assets: DataFrame, limit: int = 30, sort: str = "count", volumes: Sequence[int] | None = None) -> DataFrame:
    """Of completed analyses; by count or by name."""
    done = analyses.where(F.col("status") == "completed")
    if volumes is not None:
        done = done.join(in_volumes(assets, volumes).select(F.col("id").alias("assetId")), "assetId", "left_semi")
    out = tags.join(done.select(F.col("id").alias("analysisId")), "analysisId", "left_semi").groupBy("tagNormalized", "tag").agg(F.count("*").alias("n"))
    order = [F.desc("n"), "tagNormalized", "tag"] if sort == "count" else ["tagNormalized", "tag"]
    return out.orderBy(*order).limit(limit)


def search_tags(tags: DataFrame, q: str, limit: int = 10) -> DataFrame:
    out = tags.where(F.contains("tagNormalized", F.lit(q.strip().lower()))).groupBy("tagNormalized", "tag").agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "tagNormalized", "tag").limit(limit)


def recent_activity(analyses: DataFrame, assets: DataFrame, limit: int = 10) -> DataFrame:
    """The latest analyses that ended, with their assets: top k before the join."""
    top = analyses.where(F.col("status").isin(*C.TERMINAL)).orderBy(F.desc("dateUpdated"), "id").limit(limit)
    return top.select("assetId", "status", "dateUpdated").join(assets.select(F.col("id").alias("assetId"), "filename"), "assetId", "left")


def recent_errors(logs: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    since = F.lit(now) - F.make_interval(hours=F.lit(hours))
    return logs.where(F.col("level").isin("error", "critical") & (F.col("dateCreated") >= since)).agg(F.count("*").alias("n"))


def stock_providers(analyses: DataFrame) -> DataFrame:
    """Distinct providers with a label whose words begin with a capital; other letters stay."""
    name = F.col("watermarkDetails.stockProvider")
    label = F.array_join(F.transform(F.split(name, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")
    return analyses.where(F.coalesce(name, F.lit("")) != "").select(name.alias("value"), label.alias("label")).distinct().orderBy("value")


def duplicate_counts(pairs: DataFrame) -> DataFrame:
    return P.pair_counts(pairs)


def analysis_of(analyses: DataFrame, asset: int) -> DataFrame:
    """The analysis of one asset; the filter reaches the files' statistics."""
    return analyses.where(F.col("assetId") == asset)


def analyses_of(analyses: DataFrame, assets: DataFrame) -> DataFrame:
    """Analyses of the assets of a table (id), of any number."""
    return analyses.join(assets.select(F.col("id").alias("assetId")).distinct(), "assetId", "left_semi")

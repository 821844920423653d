"""Condition rules: a predicate that filters a query and, as a column, marks single rows.

A rule set ANDs its rules. `matches` is the row side: it left-joins analyses and gives a boolean column, in
which a missing analysis counts as no match unless the rule itself says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..config import MIB
from ..plans.asset_query import AssetQuery
from . import pairs as P
from . import predicates as p

_EPS = 1e-6


@dataclass(frozen=True)
class Condition:
    """`query` adds to a query; `row` is the row's predicate over assets left-joined with analyses."""

    query: Callable[[AssetQuery, Any], AssetQuery]
    row: Callable[[Any], Column] | None
    pro: bool = False


def _nsfw(q: AssetQuery, v) -> AssetQuery:
    op, value, high = v["op"], v["value"], v.get("high")
    low = {"=": value, ">=": value, ">": value + _EPS, "between": value}.get(op)
    top = {"=": value, "<=": value, "<": value - _EPS, "between": high}.get(op)
    return q.where(nsfw_min=low, nsfw_max=top)


def _size(q: AssetQuery, v) -> AssetQuery:
    op, value, high = v["op"], v["value"], v.get("high")
    low = {"=": value, ">=": value, ">": value + _EPS, "between": value}.get(op)
    top = {"=": value, "<=": value, "<": value - _EPS, "between": high}.get(op)
    return q.where(size_min_mib=low, size_max_mib=top)


def _set(name: str) -> Callable[[AssetQuery, Any], AssetQuery]:
    return lambda q, v: q.where(**{name: v})


RULES: dict[str, Condition] = {
    "nsfw_flagged": Condition(_set("nsfw_flagged"), p.nsfw_flagged),
    "nsfw_score": Condition(_nsfw, lambda v: p.number_matches(F.col("nsfwScore"), v["op"], v["value"], v.get("high"))),
    "has_focal_point": Condition(_set("has_focal_point"), p.has_focal_point),
    "contains_people": Condition(_set("contains_people"), lambda v: F.col("containsPeople") == v),
    "face_count": Condition(_set("face_preset"), p.face_preset),
    "watermark_flagged": Condition(_set("has_watermark"), lambda v: F.col("hasWatermark") == v),
    "brand_logo": Condition(_set("contains_brand"), lambda v: F.col("containsBrandLogo") == v),
    "watermark_type": Condition(_set("watermark_type"), lambda v: F.col("hasWatermark") & F.col("watermarkType").isin(v)),
    "too_large": Condition(_set("too_large"), lambda v: p.too_large() == v),
    "file_size": Condition(_size, lambda v: p.number_matches(F.col("size") / F.lit(MIB), v["op"], v["value"], v.get("high"))),
    "quality_issue": Condition(lambda q, v: q.where_raw(p.any_quality_issue(v)), p.any_quality_issue),
    "processed_date": Condition(lambda q, v: q.where(processed_from=v.get("from"), processed_to=v.get("to")), lambda v: (F.col("processedAt") >= F.lit(v.get("from") or "0001-01-01").cast("timestamp")) & (F.col("processedAt") <= F.lit(v.get("to") or "9999-12-31").cast("timestamp"))),
    "unprocessed": Condition(_set("unprocessed"), lambda v: p.unprocessed() if v else ~F.col("status").isin("pending", "failed")),
    "provider": Condition(_set("provider"), lambda v: F.col("provider").isin(v)),
    "provider_model": Condition(_set("provider_model"), lambda v: F.col("providerModel").isin(v)),
    "status": Condition(_set("status"), lambda v: p.unprocessed() if v == "untagged" else p.status_is(v), pro=True),
    "stock_provider": Condition(_set("stock_provider"), lambda v: F.col("hasWatermark") & (F.col("watermarkType") == "stock") & p.stock_provider(v), pro=True),
    "has_text": Condition(_set("has_text"), p.has_text, pro=True),
    "tags_any": Condition(_set("tag"), None, pro=True),
    "tags_all": Condition(_set("tags_all"), None, pro=True),
    "has_duplicates": Condition(_set("has_duplicates"), None, pro=True),
    "similar_to": Condition(_set("similar_to"), None, pro=True),
}


def available(pro: bool) -> list[str]:
    return [k for k, c in RULES.items() if pro or not c.pro]


def apply_conditions(query: AssetQuery, conditions: dict[str, Any]) -> AssetQuery:
    return reduce(lambda q, kv: RULES[kv[0]].query(q, kv[1]), conditions.items(), query)


def matches(catalog: Catalog, conditions: dict[str, Any]) -> DataFrame:
    """Every asset's id and whether it meets all conditions."""
    own = catalog.analyses.withColumnRenamed("id", "analysisId")
    assets = catalog.assets
    df = assets.join(own.select(*[c for c in own.columns if c not in assets.columns]), assets.id == own.assetId, "left")
    hits = []
    for i, (name, v) in enumerate(conditions.items()):
        rule, mark = RULES[name], f"_m{i}"
        if rule.row is not None:
            df = df.withColumn(mark, F.coalesce(rule.row(v), F.lit(False)))
        else:
            ids = rule.query(AssetQuery(catalog), v).ids() if name != "similar_to" else within_two_hops(catalog, v)
            df = df.join(ids.distinct().withColumn(mark, F.lit(True)), "id", "left").withColumn(mark, F.coalesce(mark, F.lit(False)))
        hits.append(F.col(mark))
    return df.select("id", reduce(lambda a, b: a & b, hits, F.lit(True)).alias("matches"))


def within_two_hops(catalog: Catalog, anchor: int) -> DataFrame:
    """The row side of similarity: the anchor, its neighbours, and theirs."""
    near = P.neighbours(catalog.duplicate_groups, anchor).select(F.col("assetId").alias("id"))
    edges = P.endpoints(P.unresolved(catalog.duplicate_groups)).select(F.col("assetId").alias("id"), "otherId")
    further = edges.join(near, "id", "left_semi").select(F.col("otherId").alias("id"))
    return near.unionByName(further).unionByName(catalog.spark.range(1).select(F.lit(anchor).cast("long").alias("id"))).distinct()

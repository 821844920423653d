"""The fluent asset query: filters are collected first, then planned with the joins they need.

The analyses are joined once, and only if a filter asks for them. The join is inner unless the filter that comes
first in the fixed order of application keeps assets without an analysis (`untagged`, or `unprocessed` on its own).
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..config import EngineConfig
from ..operators import pairs as P
from ..operators import predicates as p


def _strings(v) -> list[str]:
    return [x for x in ([v] if isinstance(v, str) else list(v)) if x != ""]


@dataclass(frozen=True)
class Rule:
    """`needs`: inner, left or none, for the join with analyses; `column` gives a predicate, `frame` a plan."""

    needs: str
    column: Callable[[Any], Column | None] | None = None
    frame: Callable[[DataFrame, Catalog, Any], DataFrame] | None = None
    off: Callable[[Any], bool] = lambda v: False
    feature: str = ""


def _tags(df: DataFrame, cat: Catalog, values: Sequence[str]) -> DataFrame:
    return df.join(cat.asset_tags.where(F.col("tagNormalized").isin([v.lower() for v in values])).select("analysisId").distinct(), "analysisId", "left_semi")


def any_tag(df: DataFrame, cat: Catalog, v) -> DataFrame:
    values = _strings(v)
    return _tags(df, cat, values) if values else df


def all_tags(df: DataFrame, cat: Catalog, v) -> DataFrame:
    """Relational division in one pass: analyses that hold as many different wanted tags as there are."""
    wanted = sorted({x.lower() for x in _strings(v)})
    if not wanted:
        return df
    held = cat.asset_tags.where(F.col("tagNormalized").isin(wanted)).groupBy("analysisId").agg(F.countDistinct("tagNormalized").alias("_n")).where(F.col("_n") == len(wanted))
    return df.join(held.select("analysisId"), "analysisId", "left_semi")


def _if_true(make: Callable[[], Column]) -> Rule:
    """False filters nothing."""
    return Rule("inner", lambda v: make(), off=lambda v: not v, feature="quality")


def _one_of(column: str) -> Rule:
    """A blank list joins but filters nothing."""
    return Rule("inner", lambda v: F.col(column).isin(_strings(v)) if _strings(v) else None)


#: In the order of application.
RULES: dict[str, Rule] = {
    "status": Rule("inner", p.status_is, feature="status"),
    "contains_people": Rule("inner", lambda v: F.col("containsPeople") == v),
    "confidence_below": Rule("inner", lambda v: F.col("altTextConfidence") < p.dec(v)),
    "confidence_above": Rule("inner", lambda v: p.at_least("altTextConfidence", v)),
    "nsfw_flagged": Rule("inner", p.nsfw_flagged),
    "nsfw_min": Rule("inner", lambda v: p.at_least("nsfwScore", v)),
    "nsfw_max": Rule("inner", lambda v: p.at_most("nsfwScore", v)),
    "has_watermark": Rule("inner", lambda v: F.col("hasWatermark") == v),
    "watermark_type": Rule("inner", lambda v: F.col("watermarkType").isin(_strings(v)), off=lambda v: not _strings(v)),
    "contains_brand": Rule("inner", lambda v: F.col("containsBrandLogo") == v),
    "detected_brand": Rule("inner", p.detected_brand),
    "stock_provider": Rule("inner", lambda v: p.stock_provider(_strings(v)), feature="stock_provider"),
    "tag": Rule("inner", frame=any_tag, feature="tags"),
    "tags_all": Rule("inner", frame=all_tags, off=lambda v: not list(v), feature="tags"),
    "face_preset": Rule("inner", p.face_preset, off=lambda v: v == ""),
    "processed_from": Rule("inner", lambda v: p.processed_between(start=v)),
    "processed_to": Rule("inner", lambda v: p.processed_between(end=v)),
    "provider": _one_of("provider"),
    "provider_model": _one_of("providerModel"),
    "unprocessed": Rule("left", lambda v: p.unprocessed() if v else ~F.col("status").isin("pending", "failed")),
    "text_search": Rule("inner", p.text_contains, off=lambda v: v == "", feature="text_search"),
    "sharpness_below": Rule("inner", lambda v: p.below("sharpnessScore", v), feature="quality"),
    "exposure_issues": Rule("inner", p.exposure_issue, feature="quality"),
    "blurry": _if_true(p.QUALITY["blurry"]),
    "too_dark": _if_true(p.QUALITY["tooDark"]),
    "too_bright": _if_true(p.QUALITY["tooBright"]),
    "low_contrast": _if_true(p.QUALITY["lowContrast"]),
    "has_text": Rule("inner", p.has_text, feature="text_search"),
    "size_min_mib": Rule("none", lambda v: p.size_between_mib(low=v)),
    "size_max_mib": Rule("none", lambda v: p.size_between_mib(high=v)),
    "too_large": Rule("none", lambda v: p.too_large(), off=lambda v: not v),
    "has_focal_point": Rule("none", p.has_focal_point),
    "has_duplicates": Rule("none", frame=lambda df, cat, v: P.with_duplicates(df, cat.duplicate_groups, v), feature="duplicates"),
    "similar_to": Rule("none", frame=lambda df, cat, v: P.similar_to(df, cat.duplicate_groups, v), feature="similar"),
}


@dataclass(frozen=True)
class AssetQuery:
    """Immutable: every setter returns a new query, the last value of a filter counts, None takes it away."""

    catalog: Catalog
    config: EngineConfig = EngineConfig()
    filters: dict[str, Any] = field(default_factory=dict)
    raw: tuple[Column, ...] = ()
    on_error: str = "raise"

    def where(self, **filters: Any) -> AssetQuery:
        unknown = filters.keys() - RULES.keys()
        if unknown:
            raise ValueError(f"no such filter: {', '.join(sorted(unknown))}")
        known = {k: v for k, v in filters.items() if not RULES[k].feature or self.config.feature_available(RULES[k].feature)}
        return replace(self, filters={k: v for k, v in {**self.filters, **known}.items() if v is not None})

    def where_raw(self, *conditions: Column) -> AssetQuery:
        """Conditions on columns of assets and analyses, all of which must hold; they ask for an analysis."""
        return replace(self, raw=self.raw + conditions)

    def active(self) -> dict[str, Any]:
        return {k: self.filters[k] for k in RULES if k in self.filters and not RULES[k].off(self.filters[k])}

    def join_kind(self) -> str | None:
        """inner, left, or None if analyses aren't needed."""
        active = self.active()
        if active.get("status") == "untagged":
            return "left"
        for name, value in active.items():
            if RULES[name].needs == "inner":
                return "inner"
            if name == "unprocessed":
                return "left" if value else "inner"
        return "inner" if self.raw else None

    def is_joined(self) -> bool:
        return self.join_kind() is not None

    def frame(self) -> DataFrame:
        """Assets that pass all filters, with the columns of assets."""
        assets = self.catalog.assets
        try:
            return self._plan(assets)
        except Exception:
            if self.on_error != "ignore":
                raise
            warnings.warn("the filters could not be applied; the query is unfiltered", stacklevel=2)
            return assets

    def _plan(self, df: DataFrame) -> DataFrame:
        names, kind = df.columns, self.join_kind()
        if kind:
            own = self.catalog.analyses.withColumnRenamed("id", "analysisId")
            own = own.select(*[c for c in own.columns if c not in names or c == "assetId"])
            df = df.join(own, df.id == own.assetId, kind)
        for name, value in self.active().items():
            rule = RULES[name]
            if name == "status" and value == "untagged":
                df = df.where(p.unprocessed())
            elif rule.frame:
                df = rule.frame(df, self.catalog, value)
            elif (condition := rule.column(value)) is not None:
                df = df.where(condition)
        for condition in self.raw:
            df = df.where(condition)
        return df.select(*names)

    def ids(self) -> DataFrame:
        return self.frame().select("id")


#: Ready views of the asset list, by name.
SOURCES: dict[str, dict[str, Any]] = {
    "all": {}, "not-analysed": {"unprocessed": True}, "failed": {"status": ["failed"]}, "missing-alt-text": {}, "nsfw-flagged": {"nsfw_flagged": True},
    "missing-focal-point": {"has_focal_point": False}, "contains-people": {"contains_people": True}, "has-watermark": {"has_watermark": True},
    "has-brand-logo": {"contains_brand": True}, "has-duplicates": {"has_duplicates": True},
}


def in_volumes(df: DataFrame, volumes: Sequence[int] | None) -> DataFrame:
    """No volumes at all give an empty table; None stands for every volume."""
    return df if volumes is None else df.where(p.in_list(F.col("volumeId"), volumes))


def live_assets(assets: DataFrame) -> DataFrame:
    """Without those that were deleted, each once."""
    return assets.where(F.col("dateDeleted").isNull()).dropDuplicates(["id"])


def source(catalog: Catalog, config: EngineConfig, name: str) -> DataFrame:
    """A ready view: images of enabled volumes."""
    df = AssetQuery(catalog, config).where(**SOURCES[name]).frame()
    if name == "missing-alt-text":
        df = df.where(p.missing_alt(True))
    return in_volumes(df.where(F.col("kind") == "image"), config.volumes)


def register_sources(catalog: Catalog, config: EngineConfig) -> list[str]:
    """A temporary view for each source; returns their names."""
    names = []
    for name in SOURCES:
        view = "source_" + name.replace("-", "_")
        source(catalog, config, name).createOrReplaceTempView(view)
        names.append(view)
    return names

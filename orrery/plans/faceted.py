"""Faceted, ranked search: request parameters, filters over a left join, four orders, pages."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..catalog import Catalog
from ..config import EngineConfig
from ..operators import pairs as P
from ..operators import predicates as p
from ..operators.search_index import bm25, expand, match_tokens, native_hits, native_ids, search, search_terms, union_first_wins
from .asset_query import in_volumes, live_assets
from .keyset import OrderedPages

_BOOLEANS = ("hasWatermark", "containsBrandLogo", "hasFocalPoint", "unprocessed", "hasTextInImage", "missingAltText")
# Presets that requests may name.
FACE_PRESETS, SIZE_PRESETS = ("0", "1", "2-5", "6+"), ("1", "5", "10", "25", "50")
#: Filters on analyses or images: with one of these a text query no longer returns files that aren't images.
METADATA_KEYS = frozenset({"tags", "status", "containsPeople", "faceCountPreset", "nsfwScoreMin", "nsfwScoreMax", "nsfwFlagged", "processedFrom", "processedTo", "hasDuplicates", "hasWatermark", "watermarkType", "containsBrandLogo", "hasFocalPoint", "missingAltText", "unprocessed", "qualityIssue", "fileSizePreset", "provider", "providerModel", "hasTextInImage", "similarTo"})


def _truth(v: Any) -> bool:
    return v is True or str(v).strip().lower() in ("1", "true", "on", "yes")


def _number(v: Any) -> float | None:
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def _date(v: Any) -> datetime | None:
    if isinstance(v, Mapping):
        v = v.get("date")
    if isinstance(v, datetime):
        return v
    try:
        return datetime.fromisoformat(str(v).strip()) if v and str(v).strip() else None
    except ValueError:
        return None


def parse_request(params: Mapping[str, Any], config: EngineConfig = EngineConfig()) -> dict[str, Any]:
    """Filters from request parameters. What isn't valid is left out."""
    out: dict[str, Any] = {}
    if str(params.get("q") or "").strip():
        out["query"] = str(params["q"]).strip()
    for key in ("tags", "status"):
        v = params.get(key)
        v = [x for x in v.split(",") if x] if isinstance(v, str) else v
        if v:
            out[key] = list(dict.fromkeys(v))
    if params.get("tagOperator") in ("and", "or"):
        out["tagOperator"] = params["tagOperator"]
    if params.get("containsPeople") not in (None, ""):
        out["containsPeople"] = _truth(params["containsPeople"])
    if params.get("faceCountPreset") in FACE_PRESETS:
        out["faceCountPreset"] = params["faceCountPreset"]
    for key in ("nsfwScoreMin", "nsfwScoreMax"):
        if (n := _number(params.get(key))) is not None:
            out[key] = max(0.0, min(1.0, n))
    for key in ("processedFrom", "processedTo"):
        if (d := _date(params.get(key))) is not None:
            out[key] = d
    for key in (*_BOOLEANS, *(["hasDuplicates"] if config.has_duplicates else [])):
        if params.get(key) not in (None, ""):
            out[key] = _truth(params[key])
    lists = {"watermarkType": [str(t) for t in C.WatermarkType], "fileSizePreset": SIZE_PRESETS} | ({"qualityIssue": list(p.QUALITY)} if config.has_quality else {})
    for key, allowed in lists.items():
        v = params.get(key)
        if isinstance(v, (list, tuple)):
            v = list(dict.fromkeys(x for x in v if x in allowed))
            if v:
                out[key] = v
        elif v in allowed:
            out[key] = v
    for key in ("provider", "providerModel"):
        if isinstance(params.get(key), str) and params[key].strip():
            out[key] = params[key].strip()[:50]
    if (n := _number(params.get("offset"))) is not None:
        out["offset"] = max(0, int(n))
    if (n := _number(params.get("limit"))) is not None:
        out["limit"] = min(C.PAGE_MAX, max(1, int(n)))
    if _truth(params.get("nsfwFlagged")) and "nsfwScoreMin" not in out:
        out["nsfwScoreMin"], out["nsfwFlagged"] = 0.5, True
    if (n := _number(params.get("similarTo"))) is not None and int(n) > 0:
        out["similarTo"] = int(n)
    return out


def _list(v) -> list:
    return list(v) if isinstance(v, (list, tuple)) else [v]


def _quality(v) -> Column | None:
    return p.any_quality_issue([v]) if isinstance(v, str) else p.any_quality_issue(v[:1])


#: Predicates over assets left-joined with analyses, by filter; None filters nothing.
PREDICATES: dict[str, Callable[[Any], Column | None]] = {
    "status": lambda v: F.col("status").isin(_list(v)) if _list(v) else None,
    "containsPeople": lambda v: F.col("containsPeople") == v,
    "faceCountPreset": p.face_preset,
    "nsfwScoreMin": lambda v: p.at_least("nsfwScore", v),
    "nsfwScoreMax": lambda v: p.at_most("nsfwScore", v),
    "processedFrom": lambda v: p.processed_between(start=v),
    "processedTo": lambda v: p.processed_between(end=v),
    "hasWatermark": lambda v: F.col("hasWatermark") == v,
    "watermarkType": lambda v: F.col("watermarkType").isin(_list(v)),
    "containsBrandLogo": lambda v: F.col("containsBrandLogo") == v,
    "hasFocalPoint": p.has_focal_point,
    "missingAltText": p.missing_alt,
    "unprocessed": lambda v: p.unprocessed() if v else None,
    "qualityIssue": _quality,
    "fileSizePreset": lambda v: F.col("size") >= int(v) * C.MIB if int(v if isinstance(v, str) else v[0]) > 0 else None,
    "provider": lambda v: F.col("provider") == v,
    "providerModel": lambda v: F.col("providerModel") == v,
    "hasTextInImage": p.has_text,
}


def matching(catalog: Catalog, filters: Mapping[str, Any], config: EngineConfig = EngineConfig()) -> DataFrame:
    """Assets (with processedAt) that pass every filter but the ranking ones. Analyses are always left-joined; Catalyst makes that an inner join where a predicate needs an analysis."""
    assets = in_volumes(live_assets(catalog.assets), config.volumes)
    if not ("query" in filters and not METADATA_KEYS & filters.keys()):
        assets = assets.where(F.col("kind") == "image")
    own = catalog.analyses.withColumnRenamed("id", "analysisId")
    df = assets.join(own.select(*[c for c in own.columns if c not in assets.columns]), assets.id == own.assetId, "left")
    for key, make in PREDICATES.items():
        if key in filters and (c := make(filters[key])) is not None:
            df = df.where(c)
    if filters.get("tags"):
        df = _tags(df, catalog, _list(filters["tags"]), filters.get("tagOperator", "or"))
    if "hasDuplicates" in filters:
        df = P.with_duplicates(df, catalog.duplicate_groups, filters["hasDuplicates"])
    if filters.get("similarTo"):
        df = P.similar_to(df, catalog.duplicate_groups, filters["similarTo"])
    return df.select(*assets.columns, "processedAt")


def _tags(df: DataFrame, catalog: Catalog, tags: list[str], operator: str) -> DataFrame:
    wanted = sorted({t.lower() for t in tags})
    held = catalog.asset_tags.where(F.col("tagNormalized").isin(wanted)).groupBy(F.col("assetId").alias("id")).agg(F.countDistinct("tagNormalized").alias("n"))
    return df.join(held.where(F.col("n") == len(wanted) if operator == "and" else F.lit(True)).select("id"), "id", "left_semi")


def ranked_ids(catalog: Catalog, index: DataFrame | None, query: str, config: EngineConfig, stemmed: bool = True) -> DataFrame:
    """assetId, src, rank: index hits by score first, then hits of the plain text search among live assets of the enabled volumes."""
    native = native_ids(in_volumes(live_assets(catalog.assets), config.volumes), query).withColumn("rank", F.row_number().over(Window.orderBy("assetId")))
    if index is None or not search_terms(query):
        return native.select("assetId", F.lit(1).alias("src"), "rank")
    return union_first_wins(search(index, query, config.languages, stemmed=stemmed).select("assetId", "rank"), native)


def all_ranked(df: DataFrame, catalog: Catalog, index: DataFrame | None, query: str, config: EngineConfig, stemmed: bool = True) -> DataFrame:
    """Rows of `df` (id) that a query finds, with k1 and k2: all of them, by score and then those of the plain text search. Without the caps of `ranked_ids` nothing is ranked
    before it is filtered, so a page costs a sort of what passes the filters."""
    native = native_hits(in_volumes(live_assets(catalog.assets), config.volumes), query).select("id")
    if index is None or not search_terms(query):
        return df.join(native, "id", "left_semi").withColumns({"k1": F.lit(1.0), "k2": F.col("id").cast("double")})
    scores = bm25(index, match_tokens(index, expand(search_terms(query), config.languages, stemmed))).select(F.col("assetId").alias("id"), "score")
    both = df.join(scores, "id", "left").join(native.withColumn("_native", F.lit(True)), "id", "left").where("score IS NOT NULL OR _native")
    found = F.col("score").isNotNull()
    return both.withColumns({"k1": F.when(found, 0.0).otherwise(1.0), "k2": F.when(found, -F.round("score", 9)).otherwise(F.col("id").cast("double"))}).drop("score", "_native")


def ordered(catalog: Catalog, filters: Mapping[str, Any], config: EngineConfig = EngineConfig(), index: DataFrame | None = None, stemmed: bool = True, exact: bool = False) -> DataFrame:
    """All matches with their sort keys k1, k2: by relevance, similarity, duplicate cluster, or last processed. A query ranks 500 hits of either kind before filters, or all if `exact`."""
    df = matching(catalog, filters, config)
    if "query" in filters and exact:
        return all_ranked(df, catalog, index, filters["query"], config, stemmed)
    if "query" in filters:
        ranks = ranked_ids(catalog, index, filters["query"], config, stemmed).select(F.col("assetId").alias("id"), F.col("src").cast("double").alias("k1"), F.col("rank").cast("double").alias("k2"))
        return df.join(ranks, "id")
    if filters.get("similarTo"):
        near = P.neighbours(catalog.duplicate_groups, filters["similarTo"]).groupBy(F.col("assetId").alias("id")).agg(F.max("similarity").alias("s"))
        return df.join(near, "id", "left").withColumn("k1", F.when(F.col("id") == filters["similarTo"], F.lit(-2.0)).otherwise(-F.col("s").cast("double"))).withColumn("k2", F.col("id").cast("double")).drop("s")
    if filters.get("hasDuplicates"):
        keys = P.cluster_keys(catalog.duplicate_groups) if "clusterKey" in catalog.duplicate_groups.columns else P.endpoints(P.unresolved(catalog.duplicate_groups)).groupBy("assetId").agg(F.least(F.min("assetId"), F.min("otherId")).alias("clusterKey"))
        return df.join(keys.withColumnRenamed("assetId", "id"), "id", "left").withColumn("k1", F.coalesce(F.col("clusterKey").cast("double"), F.lit(float("inf")))).withColumn("k2", F.col("id").cast("double")).drop("clusterKey")
    return df.withColumn("k1", F.coalesce(-F.unix_timestamp("processedAt").cast("double"), F.lit(float("inf")))).withColumn("k2", F.col("id").cast("double"))


def page(catalog: Catalog, filters: Mapping[str, Any], config: EngineConfig = EngineConfig(), index: DataFrame | None = None, stemmed: bool = True, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """One page in order, and a one-row table with the total: of the hits that are ranked before filters, or of all that match if `exact`."""
    rows = ordered(catalog, filters, config, index, stemmed, exact)
    limit = min(C.PAGE_MAX, max(1, filters.get("limit", C.PAGE_SIZE)))
    return rows.orderBy("k1", "k2", "id").offset(filters.get("offset", 0)).limit(limit), rows.agg(F.count("*").alias("total"))


def keep_pages(catalog: Catalog, filters: Mapping[str, Any], folder: str, config: EngineConfig = EngineConfig(), index: DataFrame | None = None, blocks: int | None = None) -> OrderedPages:
    """All that match, in the order of `page`, for pages by key or by number that read what they show."""
    return OrderedPages(catalog.spark, folder, ["k1", "k2", "id"]).write(ordered(catalog, filters, config, index, exact=True), blocks)


def order_by_list(df: DataFrame, ids: list[int], key: str = "id") -> DataFrame:
    """Rows of a given list of ids, in its order."""
    order = df.sparkSession.createDataFrame([(int(x), i) for i, x in enumerate(ids)], f"{key} long, position int")
    return df.join(order, key).orderBy("position")


#: Sorts of the asset list: column over assets left-joined with analyses, and default direction.
SORTS = {"nsfw": ("nsfwScore", "desc"), "sharpness": ("sharpnessScore", "asc"), "faces": ("faceCount", "desc"), "processed": ("processedAt", "desc"), "altConfidence": ("altTextConfidence", "asc"), "duplicates": ("clusterKey", "asc")}


def sorted_assets(catalog: Catalog, sort: str, direction: str | None = None) -> DataFrame:
    """A join instead of a scalar subquery in the order. Ascending puts null first, descending last."""
    column, default = SORTS[sort]
    if sort == "duplicates":
        side = P.cluster_keys(catalog.duplicate_groups).withColumnRenamed("assetId", "id")
    else:
        side = catalog.analyses.select(F.col("assetId").alias("id"), column)
    c = F.col(column)
    order = c.desc_nulls_last() if (direction or default) == "desc" else c.asc_nulls_first()
    return catalog.assets.join(side, "id", "left").orderBy(order, "id")


def option_list(analyses: DataFrame, column: str, provider: str | None = None) -> DataFrame:
    """Distinct non-empty values, ascending."""
    df = analyses if provider is None else analyses.where(F.col("provider") == provider)
    return df.where(F.coalesce(F.col(column), F.lit("")) != "").select(F.col(column).alias("value")).distinct().orderBy("value")


#: Quick filters: named sets of filters.
QUICK = {
    "missing-alt-text": {"missingAltText": True}, "unprocessed": {"unprocessed": True}, "failed": {"status": ["failed"]}, "with-people": {"containsPeople": True},
    "has-watermark": {"hasWatermark": True}, "nsfw": {"nsfwScoreMin": 0.5}, "has-duplicates": {"hasDuplicates": True}, "needs-focal-point": {"hasFocalPoint": False},
}


def toggle_quick(filters: Mapping[str, Any], name: str) -> dict[str, Any]:
    """Adds a quick filter, or takes it away if all of it is set."""
    own = QUICK[name]
    if all(filters.get(k) == v for k, v in own.items()):
        return {k: v for k, v in filters.items() if k not in own}
    return {**filters, **own}


def active_count(filters: Mapping[str, Any]) -> int:
    """Filters shown as chips: paging, operators and the query itself don't count."""
    return sum(k in METADATA_KEYS and k != "nsfwFlagged" for k in filters)


def resolve_site(requested: Any, sites: list[int], primary: int) -> int:
    n = _number(requested)
    return int(n) if n is not None and int(n) in sites else primary


#: What a filter asks for, by the section of the page it stands in.
SECTIONS = {
    "content": ("tags", "hasTextInImage", "missingAltText"), "people": ("containsPeople", "faceCountPreset"), "safety": ("nsfwScoreMin", "nsfwScoreMax", "nsfwFlagged"),
    "rights": ("hasWatermark", "watermarkType", "containsBrandLogo"), "quality": ("qualityIssue", "fileSizePreset", "hasFocalPoint"), "state": ("status", "unprocessed", "processedFrom", "processedTo", "provider", "providerModel"), "duplicates": ("hasDuplicates", "similarTo"),
}


def filter_registry(current: Mapping[str, Any] | None = None) -> list[dict[str, Any]]:
    """Every filter with its section, kind of value, choices and current value."""
    choices = {"faceCountPreset": FACE_PRESETS, "fileSizePreset": SIZE_PRESETS, "qualityIssue": tuple(p.QUALITY), "watermarkType": tuple(map(str, C.WatermarkType)), "status": tuple(map(str, C.AnalysisStatus))}
    kind = lambda k: "boolean" if k in _BOOLEANS or k in ("hasDuplicates", "containsPeople", "nsfwFlagged") else "choice" if k in choices else "date" if k.startswith("processed") else "number" if k.startswith("nsfwScore") or k == "similarTo" else "text"
    return [{"key": k, "section": s, "kind": kind(k), "choices": choices.get(k, ()), "value": (current or {}).get(k)} for s, keys in SECTIONS.items() for k in keys]


def section_counts(filters: Mapping[str, Any]) -> dict[str, int]:
    """Active filters of each section."""
    return {s: sum(k in filters and k != "nsfwFlagged" for k in keys) for s, keys in SECTIONS.items()}

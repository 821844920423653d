"""Registered queries over the test tables, each beside the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import Catalog, test_catalog, with_standins
from .config import EngineConfig
from .functions import image as I
from .functions import labels as L
from .functions import normalize as N
from .functions.text import base_language, same_language, stem_tokens, tokenize
from .graph import connected_components
from .operators import bulk as B
from .operators import conditions as CND
from .operators import duplicates as D
from .operators import hash_store as HS
from .operators import ingest as G
from .operators import mutations as M
from .operators import pairs as P
from .operators import predicates as p
from .operators import search_index as SIX
from .operators import search_store as SS
from .operators import statistics as ST
from .plans import faceted as FC
from .plans import keyset as KS
from .plans.asset_query import AssetQuery, source
from .plans.panel import asset_panel, brand_names, similar_top, top_tags
from .schemas import orphans
from .sources import logs as LG
from .sources.responses import parse_responses
from .storage import shared_folder, store
from .streaming import events as EV
from .streaming import timers as TM
from .streaming.status import StatusFold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = datetime(2024, 6, 30, 12)
LATE = datetime(2024, 1, 30, 12)


def query(name: str, sql: str | None = None):
    """Registers a query over the driver's tables; the oracle is used as it is."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def on_catalog(name: str, sql: str | None = None):
    """Registers a query over the engine's tables, for which stand-ins are made."""

    def add(f: Callable[[Catalog], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(test_catalog(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = with_standins(sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_save(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Writes to the folder that the cluster shares and reads again."""
    return lambda df: store(spark, df, "cut")


# --- Fluent filters ---------------------------------------------------------------------------------------------


def fluent(name: str, filters: dict, where: str, join: str = "JOIN", config: EngineConfig = EngineConfig()) -> None:
    on_clause = f"{join} analyses l ON l.assetId = a.id" if join else ""
    on_catalog(name, f"SELECT a.id FROM assets a {on_clause} WHERE {where}")(lambda c: AssetQuery(c, config).where(**filters).ids())


fluent("filter_status_in", {"status": ["analyzed", "failed"]}, "l.status IN ('completed', 'failed')")
fluent("filter_status_empty", {"status": []}, "1 = 0")
fluent("filter_untagged_left", {"status": "untagged"}, "l.id IS NULL OR l.status IN ('pending', 'failed')", "LEFT JOIN")
fluent("filter_contains_people_false", {"contains_people": False}, "l.containsPeople = false")
fluent("filter_conf_below", {"confidence_below": 0.5}, "l.altTextConfidence < 0.5")
fluent("filter_conf_above", {"confidence_above": 0.5}, "l.altTextConfidence >= 0.5")
fluent("filter_nsfw_flagged_true", {"nsfw_flagged": True}, "l.nsfwScore >= 0.5")
fluent("filter_nsfw_flagged_false_null", {"nsfw_flagged": False}, "l.nsfwScore < 0.5 OR l.nsfwScore IS NULL")
fluent("filter_nsfw_range", {"nsfw_min": 0.2, "nsfw_max": 0.6}, "l.nsfwScore BETWEEN 0.2 AND 0.6")
fluent("filter_watermark", {"has_watermark": True, "watermark_type": ["stock", "logo"]}, "l.hasWatermark AND l.watermarkType IN ('stock', 'logo')")
fluent("filter_brand_logo", {"contains_brand": True}, "l.containsBrandLogo")
fluent("json_array_exists", {"detected_brand": "Nik"}, "len(list_filter(l.detectedBrands, lambda b: b.brand = 'Nik')) > 0")
fluent("json_path_eq", {"stock_provider": ["shutterstock", "ISTOCK PHOTO"]}, "lower(l.watermarkDetails.stockProvider) IN ('shutterstock', 'istock photo')")
fluent("json_array_len", {"has_text": True}, "len(l.extractedTextAi) > 0")
fluent("json_array_len_false", {"has_text": False}, "coalesce(len(l.extractedTextAi), 0) = 0")
fluent("ocr_substring", {"text_search": "Invoice"}, "len(list_filter(l.extractedTextAi, lambda x: contains(x, 'Invoice'))) > 0")
fluent("tags_any_semi", {"tag": ["Sunset", "city"]}, "l.id IN (SELECT analysisId FROM asset_tags WHERE tagNormalized IN ('sunset', 'city'))")
fluent("tags_all_division", {"tags_all": ["sunset", "portrait"]}, "l.id IN (SELECT analysisId FROM asset_tags WHERE tagNormalized = 'sunset') AND l.id IN (SELECT analysisId FROM asset_tags WHERE tagNormalized = 'portrait')")
for _preset, _sql in {"0": "NOT l.containsPeople", "1": "l.faceCount = 1", "2-5": "l.faceCount BETWEEN 2 AND 5", "6+": "l.faceCount >= 6"}.items():
    fluent(f"face_preset_{_preset.replace('-', '_').replace('+', '_up')}", {"face_preset": _preset}, _sql)
fluent("size_range_mib", {"size_min_mib": 0.5, "size_max_mib": 2.5}, "a.size BETWEEN 524288 AND 2621440", "")
fluent("size_too_large", {"too_large": True}, "a.size >= 1000000", "")
fluent("date_range_inclusive_day", {"processed_from": datetime(2024, 1, 3), "processed_to": datetime(2024, 1, 9)}, "l.processedAt >= TIMESTAMP '2024-01-03' AND l.processedAt < TIMESTAMP '2024-01-10'")
fluent("filter_provider", {"provider": ["openai", ""], "provider_model": "gpt-5.4"}, "l.provider = 'openai' AND l.providerModel = 'gpt-5.4'")
fluent("filter_provider_blank", {"provider": []}, "true")
fluent("filter_unprocessed", {"unprocessed": True}, "l.id IS NULL OR l.status IN ('pending', 'failed')", "LEFT JOIN")
fluent("filter_unprocessed_false", {"unprocessed": False}, "l.status NOT IN ('pending', 'failed')")
fluent("filter_unprocessed_after_inner", {"unprocessed": True, "has_watermark": False}, "l.status IN ('pending', 'failed') AND NOT l.hasWatermark")
fluent("filter_untagged_not_flagged", {"status": "untagged", "nsfw_flagged": False}, "(l.id IS NULL OR l.status IN ('pending', 'failed')) AND (l.nsfwScore < 0.5 OR l.nsfwScore IS NULL)", "LEFT JOIN")
fluent("filter_sharpness_below", {"sharpness_below": 0.45}, "l.sharpnessScore < 0.45")
fluent("filter_between_issue", {"exposure_issues": True}, "l.exposureScore < 0.3 OR l.exposureScore > 0.7")
fluent("filter_between_fine", {"exposure_issues": False}, "l.exposureScore BETWEEN 0.3 AND 0.7")
fluent("filter_focal_point", {"has_focal_point": True}, "a.focalPoint IS NOT NULL", "")
fluent("filter_blurry", {"blurry": True}, "l.sharpnessScore < 0.3")
fluent("filter_blurry_false_is_off", {"blurry": False}, "true", "")
fluent("filter_too_dark", {"too_dark": True}, "l.exposureScore < 0.22 AND l.shadowClipRatio > 0.4")
fluent("filter_too_bright", {"too_bright": True}, "l.exposureScore > 0.85 AND l.highlightClipRatio > 0.4")
fluent("filter_low_contrast", {"low_contrast": True}, "l.noiseScore < 0.45")
fluent("filter_edition_gate", {"tag": ["sunset"]}, "true", "", EngineConfig(pro=False))
on_catalog("filter_raw", "SELECT a.id FROM assets a JOIN analyses l ON l.assetId = a.id WHERE l.inputTokens > 3000 AND a.width < 2000")(lambda c: AssetQuery(c).where_raw(F.col("inputTokens") > 3000, F.col("width") < 2000).ids())
_UNRESOLVED = "(SELECT canonicalAssetId AS x, duplicateAssetId AS y FROM duplicate_groups WHERE resolution IS NULL)"
on_catalog("semi_or_endpoints", f"SELECT a.id FROM assets a WHERE EXISTS (SELECT 1 FROM {_UNRESOLVED} u WHERE u.x = a.id OR u.y = a.id)")(lambda c: AssetQuery(c).where(has_duplicates=True).ids())
on_catalog("anti_or_endpoints", f"SELECT a.id FROM assets a WHERE NOT EXISTS (SELECT 1 FROM {_UNRESOLVED} u WHERE u.x = a.id OR u.y = a.id)")(lambda c: AssetQuery(c).where(has_duplicates=False).ids())
on_catalog("similar_to_anchor", f"SELECT a.id FROM assets a WHERE a.id = 13 OR a.id IN (SELECT y FROM {_UNRESOLVED} WHERE x = 13 UNION SELECT x FROM {_UNRESOLVED} WHERE y = 13)")(lambda c: AssetQuery(c).where(similar_to=13).ids())

for _name, _where in {
    "all": "true", "not-analysed": "l.id IS NULL OR l.status IN ('pending', 'failed')", "failed": "l.status = 'failed'", "missing-alt-text": "coalesce(a.alt, '') = ''", "nsfw-flagged": "l.nsfwScore >= 0.5",
    "missing-focal-point": "a.focalPoint IS NULL", "contains-people": "l.containsPeople", "has-watermark": "l.hasWatermark", "has-brand-logo": "l.containsBrandLogo",
    "has-duplicates": f"a.id IN (SELECT x FROM {_UNRESOLVED} UNION SELECT y FROM {_UNRESOLVED})",
}.items():
    on_catalog(f"source_{_name.replace('-', '_')}", f"SELECT a.id FROM assets a LEFT JOIN analyses l ON l.assetId = a.id WHERE a.kind = 'image' AND a.volumeId IN (1, 2, 3, 5, 8) AND ({_where})")(
        lambda c, n=_name: source(c, EngineConfig(volumes=(1, 2, 3, 5, 8)), n).select("id")
    )

# --- Conditions, as marks on every row ---------------------------------------------------------------------------

_TWO_HOPS = f"""WITH e AS (SELECT x, y FROM {_UNRESOLVED} UNION ALL SELECT y, x FROM {_UNRESOLVED}), n AS (SELECT y AS id FROM e WHERE x = 13)"""
for _name, _value, _where in [
    ("nsfw_flagged", True, "l.nsfwScore >= 0.5"), ("nsfw_score", {"op": ">", "value": 0.25}, "l.nsfwScore > 0.25"), ("nsfw_score", {"op": "between", "value": 0.25, "high": 0.5}, "l.nsfwScore BETWEEN 0.25 AND 0.5"),
    ("has_focal_point", False, "a.focalPoint IS NULL"), ("contains_people", True, "l.containsPeople"), ("face_count", "2-5", "l.faceCount BETWEEN 2 AND 5"), ("watermark_flagged", False, "NOT l.hasWatermark"),
    ("brand_logo", True, "l.containsBrandLogo"), ("watermark_type", ["stock"], "l.hasWatermark AND l.watermarkType = 'stock'"), ("too_large", False, "a.size < 1000000"),
    ("file_size", {"op": "<=", "value": 2}, "a.size <= 2097152"), ("quality_issue", ["blurry", "tooDark", "nonsense"], "l.sharpnessScore < 0.3 OR (l.exposureScore < 0.22 AND l.shadowClipRatio > 0.4)"),
    ("processed_date", {"from": datetime(2024, 1, 2), "to": datetime(2024, 1, 5)}, "l.processedAt BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-05'"), ("unprocessed", True, "l.id IS NULL OR l.status IN ('pending', 'failed')"),
    ("provider", ["gemini"], "l.provider = 'gemini'"), ("provider_model", ["gpt-5.4"], "l.providerModel = 'gpt-5.4'"), ("status", ["failed"], "l.status = 'failed'"),
    ("stock_provider", ["Shutterstock"], "l.hasWatermark AND l.watermarkType = 'stock' AND lower(l.watermarkDetails.stockProvider) = 'shutterstock'"), ("has_text", False, "coalesce(len(l.extractedTextAi), 0) = 0"),
    ("tags_any", ["city"], "a.id IN (SELECT assetId FROM asset_tags WHERE tagNormalized = 'city')"), ("tags_all", ["city", "night"], "a.id IN (SELECT assetId FROM asset_tags WHERE tagNormalized = 'city') AND a.id IN (SELECT assetId FROM asset_tags WHERE tagNormalized = 'night')"),
    ("has_duplicates", True, f"a.id IN (SELECT x FROM {_UNRESOLVED} UNION SELECT y FROM {_UNRESOLVED})"),
    ("similar_to", 13, "a.id = 13 OR a.id IN (SELECT id FROM n) OR a.id IN (SELECT y FROM e WHERE x IN (SELECT id FROM n))"),
]:
    _key = f"condition_{_name}" + ("_between" if isinstance(_value, dict) and _value.get("op") == "between" else "")
    on_catalog(_key, f"{_TWO_HOPS if _name == 'similar_to' else ''} SELECT a.id, coalesce(({_where}), false) AS matches FROM assets a LEFT JOIN analyses l ON l.assetId = a.id")(lambda c, n=_name, v=_value: CND.matches(c, {n: v}))
on_catalog("condition_set", "SELECT a.id FROM assets a JOIN analyses l ON l.assetId = a.id WHERE l.containsPeople AND (l.sharpnessScore < 0.3 OR l.noiseScore < 0.45) AND l.nsfwScore >= 0.1")(
    lambda c: CND.apply_conditions(AssetQuery(c), {"contains_people": True, "quality_issue": ["blurry", "lowContrast"], "nsfw_score": {"op": ">=", "value": 0.1}}).ids()
)

# --- Faceted search ----------------------------------------------------------------------------------------------


def faceted(name: str, params: dict, where: str) -> None:
    on_catalog(name, f"SELECT a.id FROM assets a LEFT JOIN analyses l ON l.assetId = a.id WHERE a.dateDeleted IS NULL AND a.kind = 'image' AND ({where})")(lambda c: FC.matching(c, FC.parse_request(params)).select("id"))


faceted("facet_tags_or", {"tags": "city,night,city"}, "a.id IN (SELECT assetId FROM asset_tags WHERE tagNormalized IN ('city', 'night'))")
faceted("facet_tags_and", {"tags": ["city", "night"], "tagOperator": "and"}, "a.id IN (SELECT assetId FROM asset_tags WHERE tagNormalized = 'city') AND a.id IN (SELECT assetId FROM asset_tags WHERE tagNormalized = 'night')")
faceted("facet_status", {"status": "failed,pending"}, "l.status IN ('failed', 'pending')")
faceted("facet_people", {"containsPeople": "1", "faceCountPreset": "2-5"}, "l.containsPeople AND l.faceCount BETWEEN 2 AND 5")
faceted("facet_nsfw", {"nsfwFlagged": "true", "nsfwScoreMax": "7"}, "l.nsfwScore >= 0.5 AND l.nsfwScore <= 1")
faceted("facet_dates", {"processedFrom": "2024-01-03", "processedTo": {"date": "2024-01-09"}}, "l.processedAt >= TIMESTAMP '2024-01-03' AND l.processedAt < TIMESTAMP '2024-01-10'")
faceted("facet_duplicates_false", {"hasDuplicates": "false"}, f"a.id NOT IN (SELECT x FROM {_UNRESOLVED} UNION SELECT y FROM {_UNRESOLVED})")
faceted("facet_watermark", {"hasWatermark": "yes", "watermarkType": ["stock", "nonsense", "text"]}, "l.hasWatermark AND l.watermarkType IN ('stock', 'text')")
faceted("facet_brand", {"containsBrandLogo": "0"}, "NOT l.containsBrandLogo")
faceted("facet_focal", {"hasFocalPoint": "0"}, "a.focalPoint IS NULL")
faceted("facet_missing_alt", {"missingAltText": "on"}, "coalesce(a.alt, '') = ''")
faceted("facet_has_alt", {"missingAltText": "off"}, "coalesce(a.alt, '') <> ''")
faceted("facet_unprocessed", {"unprocessed": "true"}, "l.id IS NULL OR l.status IN ('pending', 'failed')")
faceted("facet_quality", {"qualityIssue": "lowContrast"}, "l.noiseScore < 0.45")
faceted("facet_size", {"fileSizePreset": "1"}, "a.size >= 1048576")
faceted("facet_provider", {"provider": " claude ", "providerModel": "claude-opus-4-6"}, "l.provider = 'claude' AND l.providerModel = 'claude-opus-4-6'")
faceted("facet_no_text_left", {"hasTextInImage": "0"}, "coalesce(len(l.extractedTextAi), 0) = 0")
faceted("facet_similar", {"similarTo": "13"}, f"a.id = 13 OR a.id IN (SELECT y FROM {_UNRESOLVED} WHERE x = 13 UNION SELECT x FROM {_UNRESOLVED} WHERE y = 13)")
on_catalog("facet_text_query_any_kind", "SELECT id FROM assets WHERE dateDeleted IS NULL AND contains(lower(concat_ws(' ', title, filename, alt)), 'img') QUALIFY row_number() OVER (ORDER BY id) <= 500")(
    lambda c: FC.matching(c, {"query": "img"}).join(SIX.native_ids(FC.live_assets(c.assets), "img").select(F.col("assetId").alias("id")), "id", "left_semi").select("id")
)
for _column in ("provider", "providerModel"):
    on_catalog(f"options_{_column}", f"SELECT DISTINCT {_column} AS value FROM analyses WHERE coalesce({_column}, '') <> ''")(lambda c, k=_column: FC.option_list(c.analyses, k))
on_catalog("options_model_of_provider", "SELECT DISTINCT providerModel AS value FROM analyses WHERE coalesce(providerModel, '') <> '' AND provider = 'openai'")(lambda c: FC.option_list(c.analyses, "providerModel", "openai"))


def _positions(df: DataFrame, n: int, *order) -> DataFrame:
    """At most `n` rows: the window runs over a page."""
    return df.limit(n).withColumn("position", F.row_number().over(Window.orderBy(*order))).select("id", F.col("position").cast("long").alias("position"))


on_catalog("page_latest_processed", "SELECT a.id, row_number() OVER (ORDER BY l.processedAt DESC NULLS LAST, a.id) - 10 AS position FROM assets a LEFT JOIN analyses l ON l.assetId = a.id WHERE a.dateDeleted IS NULL AND a.kind = 'image' QUALIFY position BETWEEN 1 AND 25")(
    lambda c: _positions(FC.page(c, FC.parse_request({"offset": "10", "limit": "25"}))[0], 25, "k1", "k2", "id")
)
on_catalog("page_total", "SELECT count(*) AS total FROM assets a WHERE a.dateDeleted IS NULL AND a.kind = 'image' AND a.size >= 1048576")(lambda c: FC.page(c, {"fileSizePreset": "1"})[1])


@on_catalog("page_deep", "SELECT a.id, row_number() OVER (ORDER BY l.processedAt DESC NULLS LAST, a.id) - (count(*) OVER ()) // 2 AS position FROM assets a LEFT JOIN analyses l ON l.assetId = a.id WHERE a.dateDeleted IS NULL AND a.kind = 'image' QUALIFY position BETWEEN 1 AND 100")
def page_deep(c: Catalog) -> DataFrame:
    """The page in the middle, found by the directory of blocks, and the one after it, by the key of its last row."""
    kept = FC.keep_pages(c, {}, shared_folder(c.spark, "pages"), blocks=16)
    middle = kept.at(kept.total() // 2, 50)
    last = middle.select(*kept.keys).tail(1)
    both = middle.union(kept.page(50, KS.key_of(KS.token_of(kept.keys, last[0])))) if last else middle
    return _positions(both, 100, *kept.keys)


on_catalog("sort_cluster", f"""WITH e AS (SELECT x AS id, least(x, y) AS k FROM {_UNRESOLVED} UNION ALL SELECT y, least(x, y) FROM {_UNRESOLVED}), m AS (SELECT id, min(k) AS k FROM e GROUP BY id)
SELECT a.id, row_number() OVER (ORDER BY m.k, a.id) AS position FROM assets a JOIN m USING (id) WHERE a.dateDeleted IS NULL AND a.kind = 'image' QUALIFY position <= 100""")(lambda c: _positions(FC.page(c, {"hasDuplicates": True, "limit": 100})[0], 100, "k1", "k2", "id"))
for _sort, (_column, _direction) in FC.SORTS.items():
    if _sort != "duplicates":
        _order = f"l.{_column} {_direction} NULLS {'LAST' if _direction == 'desc' else 'FIRST'}, a.id"
        on_catalog(f"sort_{_sort.lower()}", f"SELECT a.id, row_number() OVER (ORDER BY {_order}) AS position FROM assets a LEFT JOIN analyses l ON l.assetId = a.id QUALIFY position <= 60")(
            lambda c, s=_sort: _positions(FC.sorted_assets(c, s), 60, F.col(FC.SORTS[s][0]).desc_nulls_last() if FC.SORTS[s][1] == "desc" else F.col(FC.SORTS[s][0]).asc_nulls_first(), "id")
        )
on_catalog("sort_field_list", "SELECT id, list_position([9, 4, 77, 5], id) - 1 AS position FROM assets WHERE id IN (9, 4, 77, 5)")(lambda c: FC.order_by_list(c.assets.select("id"), [9, 4, 77, 5]).select("id", F.col("position").cast("int").alias("position")))

# --- Full text -----------------------------------------------------------------------------------------------------

_TOKENS = "SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower(text), '[^\\p{L}\\s]', ' ', 'g')), '\\s+'), lambda x: length(x) BETWEEN 2 AND 40))) AS token FROM documents"


_STORED: dict[tuple[str, str], str] = {}


def doc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_doc_index(spark, sf_dir)[0]


def stored_doc_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Postings of the documents' own words, one field of weight 1, and their totals: written once for a session, then read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = shared_folder(spark, "index")
        SIX.write_index(made_doc_index(spark, sf_dir), path)
        _STORED[key] = path
    return SIX.read_index(spark, _STORED[key])


def made_doc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = docs.select(F.col("doc_id").alias("assetId"), F.explode_outer(tokenize(F.col("text"))).alias("token")).where("token IS NOT NULL")  # a plain explode has texts tokenised for a filter on their number of words too
    # Words of a document are distinct; frequencies from 1 to 3 stand for those of stems.
    tf = (1 + (F.col("assetId") + F.char_length("token")) % 3).cast("int")
    return words.select("assetId", "token", tf.alias("tf"), F.lit(1).cast("decimal(3,2)").alias("fieldWeight"))


def _exact(spark: SparkSession, terms: list[str]) -> DataFrame:
    return spark.createDataFrame([(t, t) for t in terms], "term string, token string")


_TERMS = ["the", "that", "ontion", "en", "para"]
_BM25 = f"""WITH ix AS (SELECT *, 1 + (doc_id + length(token)) % 3 AS tf FROM ({_TOKENS})), n AS (SELECT count(DISTINCT doc_id) AS n FROM ix), hits AS (SELECT * FROM ix WHERE token IN ('the', 'that', 'ontion', 'en', 'para')),
df AS (SELECT token, count(DISTINCT doc_id) AS df FROM hits GROUP BY token),
s AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2) / (tf + 1.2)) AS score FROM hits JOIN df USING (token), n GROUP BY doc_id)"""


@query("bm25_topk", f"{_BM25} SELECT doc_id, lang, round(score, 6) AS score FROM s JOIN documents USING (doc_id) QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) <= 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, total = stored_doc_index(spark, sf_dir)
    best = SIX.top_k(SIX.bm25(index, _exact(spark, _TERMS), total=total).withColumn("score", F.round("score", 9)), 20)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(F.broadcast(best), F.col("doc_id") == F.col("assetId")).select("doc_id", "lang", F.round("score", 6).alias("score"))


@query("bm25_all_scores", f"{_BM25} SELECT doc_id, round(score, 6) AS score FROM s")
def bm25_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, total = stored_doc_index(spark, sf_dir)
    return SIX.bm25(index, _exact(spark, _TERMS), total=total).select(F.col("assetId").alias("doc_id"), F.round("score", 6).alias("score"))


@query("score_merge_max100", f"{_BM25}, r AS (SELECT doc_id, CAST(round(score / max(score) OVER () * 100) AS BIGINT) AS b FROM s), nat AS (SELECT doc_id, doc_id % 100 AS score FROM documents WHERE doc_id % 3 = 0) SELECT coalesce(r.doc_id, nat.doc_id) AS doc_id, greatest(coalesce(nat.score, 0), coalesce(b, 0)) AS score FROM r FULL JOIN nat ON r.doc_id = nat.doc_id")
def score_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, total = stored_doc_index(spark, sf_dir)
    ranked = SIX.bm25(index, _exact(spark, _TERMS), total=total)
    native = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("assetId"), (F.col("doc_id") % 100).alias("score"))
    return SIX.merge_scores(native, ranked).withColumnRenamed("assetId", "doc_id")


@query("index_term_lookup", f"SELECT doc_id, token, 1 + (doc_id + length(token)) % 3 AS tf FROM ({_TOKENS}) WHERE token IN ('para', 'ontion')")
def index_term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read from the stored index by its order."""
    return SIX.term_postings(doc_index(spark, sf_dir), ["para", "ontion"]).select(F.col("assetId").alias("doc_id"), "token", "tf")


@query("index_build", f"SELECT doc_id AS assetId, token, 1 + (doc_id + length(token)) % 3 AS tf, 1::DECIMAL(3,2) AS fieldWeight FROM ({_TOKENS})")
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made, written, and read again."""
    path = shared_folder(spark, "index")
    SIX.write_index(made_doc_index(spark, sf_dir), path)
    return SIX.read_index(spark, path)[0]


@query("tokens_df", f"SELECT token, count(*) AS df FROM ({_TOKENS}) GROUP BY token")
def tokens_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_index(spark, sf_dir).groupBy("token").agg(F.count("*").alias("df"))


@query("index_stats", f"SELECT count(*) AS postings, count(DISTINCT doc_id) AS docs, count(DISTINCT token) AS tokens FROM ({_TOKENS})")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of postings by token; how many documents have any is stored beside them."""
    index, total = stored_doc_index(spark, sf_dir)
    sizes = index.groupBy("token").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("postings"), F.count("*").alias("tokens"))
    return sizes.crossJoin(F.broadcast(total)).select("postings", F.when(F.col("postings") > 0, F.col("n_assets")).otherwise(0).alias("docs"), "tokens")  # one row each


@query("fuzzy_prefix", f"SELECT DISTINCT token FROM ({_TOKENS}) WHERE starts_with(token, 'ontio')")
def fuzzy_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_index(spark, sf_dir).where(SIX.prefix_matches(F.col("token"), F.lit("ontio"))).select("token").distinct()


@query("fuzzy_levenshtein", f"""SELECT DISTINCT token FROM ({_TOKENS}) WHERE substr(token, 1, 2) = 'on' AND length(token) BETWEEN 5 AND 7 AND len(list_filter(range(0, 7), lambda i: substr(token, 1, i) = substr('ontion', 1, i) AND (
    substr(token, i + 2) = substr('ontion', i + 2) OR substr(token, i + 1) = substr('ontion', i + 2) OR substr(token, i + 2) = substr('ontion', i + 1)))) > 0""")
def fuzzy_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_index(spark, sf_dir).where(SIX.near_token(F.lit("ontion"))).select("token").distinct()


@query("search_term_fallback", f"""WITH ix AS (SELECT DISTINCT token FROM ({_TOKENS})), t AS (SELECT unnest(['the', 'ontio', 'zzzz']) AS term),
ex AS (SELECT term, token FROM t JOIN ix ON token = term) SELECT * FROM ex UNION SELECT term, token FROM t JOIN ix ON starts_with(token, term) WHERE term NOT IN (SELECT term FROM ex)""")
def term_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SIX.match_tokens(doc_index(spark, sf_dir), SIX.expand(["the", "ontio", "zzzz"], [], stemmed=False))


_DICTIONARY = f"WITH v AS (SELECT DISTINCT token FROM ({_TOKENS}))"


def doc_dictionary(spark: SparkSession, sf_dir: str) -> SS.Dictionary:
    made = SS.Dictionary(spark, shared_folder(spark, "dictionary"))
    made.write(doc_index(spark, sf_dir))
    return made


# DuckDB's levenshtein counts bytes: four at most for a letter.
@query("near_tokens", f"""{_DICTIONARY} SELECT a.token AS word, b.token FROM v a JOIN v b ON substr(a.token, 1, 2) = substr(b.token, 1, 2) AND abs(length(a.token) - length(b.token)) < 2 WHERE length(a.token) >= 4 AND levenshtein(a.token, b.token) <= 4
    AND len(list_filter(range(0, length(a.token) + 1), lambda i: substr(a.token, 1, i) = substr(b.token, 1, i) AND (
        substr(a.token, i + 2) = substr(b.token, i + 2) OR substr(a.token, i + 1) = substr(b.token, i + 2) OR substr(a.token, i + 2) = substr(b.token, i + 1)))) > 0""")
def near_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token's near ones, by joins of equal words less one letter; the oracle compares all."""
    made = doc_dictionary(spark, sf_dir)
    return made.near_words(made.tokens().select(F.col("token").alias("word")))


@query("dictionary_match", f"""{_DICTIONARY}, t AS (SELECT unnest(['the', 'ontio', 'ontixn', 'pa', 'zzzz']) AS term),
ex AS (SELECT term, token FROM t JOIN v ON token = term), pre AS (SELECT term, token FROM t JOIN v ON starts_with(token, term) WHERE term NOT IN (SELECT term FROM ex))
SELECT * FROM ex UNION ALL SELECT * FROM pre UNION ALL
SELECT term, token FROM t JOIN v ON substr(token, 1, 2) = substr(term, 1, 2) AND levenshtein(token, term) <= 1 WHERE length(term) >= 4 AND term NOT IN (SELECT term FROM ex UNION ALL SELECT term FROM pre)""")
def dictionary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_dictionary(spark, sf_dir).match(SIX.expand(["the", "ontio", "ontixn", "pa", "zzzz"], [], stemmed=False))


@query("bm25_bounded_top", f"{_BM25} SELECT doc_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) <= 500")
def bm25_bounded_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 500 without reading blocks that can't hold any of them."""
    made = SS.BoundedPostings(spark, shared_folder(spark, "bounded"), block=64)
    made.write(doc_index(spark, sf_dir))
    return made.search(_TERMS, 500).select(F.col("assetId").alias("doc_id"), F.round("score", 6).alias("score"))


@on_catalog("substring_search", """WITH t AS (SELECT a.id, lower(concat_ws(' ', a.title, a.filename, a.alt, array_to_string(l.extractedTextAi, ' '), (SELECT string_agg(tag, ' ') FROM asset_tags g WHERE g.assetId = a.id))) AS text FROM assets a LEFT JOIN analyses l ON l.assetId = a.id)
SELECT 'oliday hoto' AS query, id FROM t WHERE contains(text, 'oliday') AND contains(text, 'hoto') UNION ALL SELECT 'nvoice beac', id FROM t WHERE contains(text, 'nvoice') AND contains(text, 'beac')
UNION ALL SELECT '#1', id FROM t WHERE contains(text, '#1') UNION ALL SELECT 'no such text', id FROM t WHERE contains(text, 'no') AND contains(text, 'such') AND contains(text, 'text')""")
def substring_search(c: Catalog) -> DataFrame:
    """Words anywhere in titles, file names, alternative texts, texts in images and tags, by an index of three letters."""
    tags = c.asset_tags.groupBy("assetId").agg(F.array_join(F.collect_list("tag"), " ").alias("tags"))
    own = c.analyses.select("assetId", F.array_join("extractedTextAi", " ").alias("ocr")).join(tags, "assetId", "full_outer")
    texts = c.assets.join(own, c.assets.id == own.assetId, "left").select("id", F.concat_ws(" ", "title", "filename", "alt", "ocr", "tags").alias("text"))
    index = SS.SubstringIndex(c.tables.spark, shared_folder(c.tables.spark, "substrings"), block=256)
    index.write(texts)
    out = None
    for q in ("oliday hoto", "nvoice beac", "#1", "no such text"):
        found = index.search(q).select(F.lit(q).alias("query"), "id")
        out = found if out is None else out.unionByName(found)
    return out


@query("index_segments", f"""WITH ix AS (SELECT doc_id AS assetId, token, 1 + (doc_id + length(token)) % 3 AS tf FROM ({_TOKENS}))
SELECT assetId, token, tf FROM ix WHERE assetId % 10 NOT IN (3, 7) UNION ALL SELECT DISTINCT assetId, 'second', 2 FROM ix WHERE assetId % 10 = 3 AND assetId % 4 <> 1 UNION ALL SELECT DISTINCT assetId, 'third', 1 FROM ix WHERE assetId % 20 = 7""")
def index_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits, deletions and a compaction in between: only rows of what changes are written, and reading gives the index as if it were made anew."""
    index = doc_index(spark, sf_dir).withColumn("field", F.lit("text"))
    store_ = SS.IndexSegments(spark, shared_folder(spark, "segments"))
    store_.start(index)
    ids = index.select("assetId", "field").distinct()
    fresh = lambda which, token, tf: ids.where(which).select("assetId", "field", F.lit(token).alias("token"), F.lit(tf).alias("tf"), F.lit(1).cast("decimal(3,2)").alias("fieldWeight"))
    store_.update(fresh("assetId % 10 = 3", "first", 1), 1)
    store_.update(fresh("assetId % 10 = 3 AND assetId % 4 <> 1", "second", 2), 2, ids.where("assetId % 10 = 3 AND assetId % 4 = 1"))
    store_.compact()
    store_.delete_assets(ids.where("assetId % 10 = 7"), 3)
    store_.update(fresh("assetId % 20 = 7", "third", 1), 4)
    return store_.read().select("assetId", "token", "tf")


_FIELD_IX = r"""WITH f AS (SELECT assetId, unnest([{'field': 'altText', 'w': 1.10, 'v': altText}, {'field': 'suggestedTitle', 'w': 1.20, 'v': suggestedTitle}, {'field': 'longDescription', 'w': 0.80, 'v': longDescription},
    {'field': 'altTextAi', 'w': 0.85, 'v': CASE WHEN altTextAi IS NOT NULL AND coalesce(altText, '') <> coalesce(altTextAi, '') THEN altTextAi END},
    {'field': 'suggestedTitleAi', 'w': 0.90, 'v': CASE WHEN suggestedTitleAi IS NOT NULL AND coalesce(suggestedTitle, '') <> coalesce(suggestedTitleAi, '') THEN suggestedTitleAi END},
    {'field': 'extractedTextAi', 'w': 0.70, 'v': array_to_string(extractedTextAi, chr(10))}]) AS c FROM analyses WHERE processedAt IS NOT NULL),
p AS (SELECT assetId, c.field AS field, c.w AS w, unnest(list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower(c.v), '[^\p{L}\s]', ' ', 'g')), '\s+'), lambda x: length(x) BETWEEN 2 AND 40))) AS token FROM f WHERE coalesce(c.v, '') <> ''),
g AS (SELECT t.assetId, 'tag' AS field, 1.50 AS w, unnest(list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower(tag), '[^\p{L}\s]', ' ', 'g')), '\s+'), lambda x: length(x) BETWEEN 2 AND 40))) AS token
      FROM (SELECT DISTINCT assetId, analysisId, tag FROM asset_tags) t JOIN analyses a ON a.id = t.analysisId WHERE a.processedAt IS NOT NULL),
ix AS (SELECT * FROM p UNION ALL SELECT * FROM g)"""
on_catalog("index_field_postings", f"{_FIELD_IX} SELECT field, count(*) AS n, count(DISTINCT token) AS tokens, count(DISTINCT assetId) AS assets FROM ix GROUP BY field")(
    lambda c: SIX.build_index(c.analyses, c.asset_tags, stemmed=False).groupBy("field").agg(F.count("*").alias("n"), F.countDistinct("token").alias("tokens"), F.countDistinct("assetId").alias("assets"))
)
on_catalog("search_filtered_page", f"""{_FIELD_IX}, n AS (SELECT count(DISTINCT assetId) AS n FROM ix), h AS (SELECT * FROM ix WHERE token IN ('the', 'invoice')), df AS (SELECT token, count(DISTINCT assetId) AS df FROM h GROUP BY token),
s AS (SELECT assetId, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * 2.2 / 2.2 * w), 9) AS score FROM h JOIN df USING (token), n GROUP BY assetId),
r AS (SELECT assetId, row_number() OVER (ORDER BY score DESC, assetId) AS rank FROM s QUALIFY rank <= 500),
live AS (SELECT * FROM assets WHERE dateDeleted IS NULL AND volumeId IN (1, 2, 3, 4, 5, 6)),
nat AS (SELECT id AS assetId, row_number() OVER (ORDER BY id) AS rank FROM live WHERE contains(lower(concat_ws(' ', title, filename, alt)), 'the') AND contains(lower(concat_ws(' ', title, filename, alt)), 'invoice') QUALIFY rank <= 500),
u AS (SELECT assetId, min(struct_pack(src := src, rank := rank)) AS o FROM (SELECT assetId, 0 AS src, rank FROM r UNION ALL SELECT assetId, 1, rank FROM nat) GROUP BY assetId),
m AS (SELECT a.id, u.o FROM live a JOIN analyses l ON l.assetId = a.id JOIN u ON u.assetId = a.id WHERE a.kind = 'image' AND l.containsPeople)
SELECT id, row_number() OVER (ORDER BY o.src, o.rank, id) - 10 AS position FROM m QUALIFY position BETWEEN 1 AND 25""")(
    lambda c: _positions(FC.page(c, {"query": "the invoice", "containsPeople": True, "offset": 10, "limit": 25}, EngineConfig(volumes=(1, 2, 3, 4, 5, 6)), store(c.spark, SIX.build_index(c.analyses, c.asset_tags, stemmed=False), "index"), stemmed=False)[0], 25, "k1", "k2", "id")
)
on_catalog("search_exact_page", f"""{_FIELD_IX}, n AS (SELECT count(DISTINCT assetId) AS n FROM ix), h AS (SELECT * FROM ix WHERE token IN ('the', 'invoice')), df AS (SELECT token, count(DISTINCT assetId) AS df FROM h GROUP BY token),
s AS (SELECT assetId, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * 2.2 / 2.2 * w), 9) AS score FROM h JOIN df USING (token), n GROUP BY assetId),
m AS (SELECT a.id, CASE WHEN score IS NULL THEN 1 ELSE 0 END AS src, CASE WHEN score IS NULL THEN a.id ELSE -score END AS k FROM assets a JOIN analyses l ON l.assetId = a.id LEFT JOIN s ON s.assetId = a.id
      WHERE a.dateDeleted IS NULL AND volumeId IN (1, 2, 3, 4, 5, 6) AND a.kind = 'image' AND l.containsPeople
        AND (score IS NOT NULL OR (contains(lower(concat_ws(' ', title, filename, alt)), 'the') AND contains(lower(concat_ws(' ', title, filename, alt)), 'invoice'))))
SELECT id, row_number() OVER (ORDER BY src, k, id) - 10 AS position, count(*) OVER () AS total FROM m QUALIFY position BETWEEN 1 AND 25""")(
    lambda c: (lambda page: _positions(page[0], 25, "k1", "k2", "id").crossJoin(page[1]))(FC.page(c, {"query": "the invoice", "containsPeople": True, "offset": 10, "limit": 25}, EngineConfig(volumes=(1, 2, 3, 4, 5, 6)), store(c.spark, SIX.build_index(c.analyses, c.asset_tags, stemmed=False), "index"), stemmed=False, exact=True))
)
on_catalog("search_native_scope", """WITH live AS (SELECT * FROM assets WHERE dateDeleted IS NULL AND volumeId IN (2, 3)) SELECT id AS assetId, row_number() OVER (ORDER BY id) AS rank FROM live WHERE contains(lower(concat_ws(' ', title, filename, alt)), 'img') QUALIFY rank <= 500""")(
    lambda c: FC.ranked_ids(c, None, "img", EngineConfig(volumes=(2, 3))).select("assetId", "rank")
)
on_catalog("bm25_field_weighted", f"""{_FIELD_IX}, n AS (SELECT count(DISTINCT assetId) AS n FROM ix), h AS (SELECT * FROM ix WHERE token IN ('sunset', 'invoice', 'the')), df AS (SELECT token, count(DISTINCT assetId) AS df FROM h GROUP BY token)
SELECT assetId, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * 2.2 / 2.2 * w), 6) AS score FROM h JOIN df USING (token), n GROUP BY assetId""")(
    lambda c: SIX.bm25(SIX.build_index(c.analyses, c.asset_tags, stemmed=False), _exact(c.spark, ["sunset", "invoice", "the"])).select("assetId", F.round("score", 6).alias("score"))
)
on_catalog("reindex_delta", f"{_FIELD_IX} SELECT field, count(*) AS n FROM (SELECT assetId, field, token FROM ix WHERE NOT (field = 'altText' AND assetId % 2 = 0) UNION ALL SELECT DISTINCT assetId, field, 'fresh' FROM ix WHERE field = 'altText' AND assetId % 2 = 0) GROUP BY field")(
    lambda c: (lambda ix: SIX.reindex(ix, ix.where("field = 'altText' AND assetId % 2 = 0").withColumn("token", F.lit("fresh")).dropDuplicates(["assetId", "field"])))(SIX.build_index(c.analyses, c.asset_tags, stemmed=False)).groupBy("field").agg(F.count("*").alias("n"))
)


@on_catalog("stemmed_search")
def stemmed_search(c: Catalog) -> DataFrame:
    return SIX.search(SIX.build_index(c.analyses, c.asset_tags), "sunsets portraits", ("en", "de"))


@query("stem_dictionary")
def stem_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(tokenize(F.col("text"))).alias("token"), base_language(F.col("lang")).alias("language"))
    return stem_tokens(words).groupBy("language", "stem").agg(F.countDistinct("token").alias("n_tokens"))


@query("union_ordered_first_wins", "WITH a AS (SELECT doc_id, 0 AS src, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE lang = 'fr'), b AS (SELECT doc_id, 1 AS src, doc_id AS r FROM documents WHERE doc_id % 5 = 0) SELECT doc_id, src, r AS rank FROM a UNION ALL SELECT doc_id, src, r FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)")
def union_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    a = docs.where("lang = 'fr'").select(F.col("doc_id").alias("assetId"), F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")).cast("long").alias("rank"))
    b = docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("assetId"), F.col("doc_id").alias("rank"))
    return SIX.union_first_wins(a, b).withColumnRenamed("assetId", "doc_id")


@query("intersect_keep_rank", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY doc_id IN (SELECT doc_id FROM labels)")
def intersect_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = table(spark, sf_dir, "documents").select("doc_id", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")).cast("long").alias("rank"))
    return ranked.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


# --- Statistics ------------------------------------------------------------------------------------------------------

on_catalog("overview_stats", "SELECT count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, CAST(sum(actualCost) AS DECIMAL(20,6)) AS total_cost FROM analyses")(lambda c: ST.overview(c.analyses))
on_catalog("global_counts", "SELECT count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'completed' AND nsfwScore >= 0.5) AS nsfw_flagged, count(*) FILTER (status = 'completed' AND hasWatermark) AS watermarked, CAST(sum(actualCost) AS DECIMAL(20,6)) AS total_cost FROM analyses")(lambda c: ST.global_counts(c.analyses))
on_catalog("coverage_pct", "SELECT count(*) AS total, count(*) FILTER (coalesce(alt, '') <> '') AS with_alt, count(*) FILTER (focalPoint IS NOT NULL) AS with_focal, CAST(round(100.0 * count(*) FILTER (coalesce(alt, '') <> '') / count(*), 1) AS DOUBLE) AS alt_pct, CAST(round(100.0 * count(*) FILTER (focalPoint IS NOT NULL) / count(*), 1) AS DOUBLE) AS focal_pct FROM assets WHERE kind = 'image' AND dateDeleted IS NULL AND volumeId IN (0, 1, 2)")(
    lambda c: (lambda d: d.withColumns({k: F.col(k).cast("double") for k in ("alt_pct", "focal_pct")}))(ST.coverage(c.assets, [0, 1, 2]))
)
on_catalog("quality_issue_counts", "SELECT count(*) FILTER (sharpnessScore < 0.3) AS blurry, count(*) FILTER (exposureScore < 0.22 AND shadowClipRatio > 0.4) AS tooDark, count(*) FILTER (exposureScore > 0.85 AND highlightClipRatio > 0.4) AS tooBright, count(*) FILTER (noiseScore < 0.45) AS lowContrast FROM analyses WHERE status = 'completed' AND assetId IN (SELECT id FROM assets WHERE volumeId < 10)")(
    lambda c: ST.quality_issue_counts(c.analyses, c.assets, list(range(10)))
)
on_catalog("attention_unpivot", f"""WITH g AS (SELECT count(*) FILTER (status = 'failed') AS a, count(*) FILTER (status = 'completed' AND nsfwScore >= 0.5) AS b, count(*) FILTER (status = 'completed' AND hasWatermark) AS c,
    count(*) FILTER (status = 'completed' AND sharpnessScore < 0.3) AS d, count(*) FILTER (status = 'completed' AND exposureScore < 0.22 AND shadowClipRatio > 0.4) AS e, count(*) FILTER (status = 'completed' AND exposureScore > 0.85 AND highlightClipRatio > 0.4) AS f,
    count(*) FILTER (status = 'completed' AND noiseScore < 0.45) AS h FROM analyses), dd AS (SELECT count(*) AS i FROM (SELECT x FROM {_UNRESOLVED} UNION SELECT y FROM {_UNRESOLVED}))
SELECT position, type, count FROM (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS position, unnest(['failed', 'nsfw_flagged', 'watermarked', 'blurry', 'too_dark', 'too_bright', 'low_contrast', 'has_duplicates']) AS type, unnest([a, b, c, d, e, f, h, i]) AS count FROM g, dd) WHERE count > 0""")(lambda c: ST.attention_items(c))
_USAGE = "count(*) AS n, CAST(coalesce(sum(actualCost), 0) AS DECIMAL(20,6)) AS total_cost, round(coalesce(CAST(sum(actualCost) AS DOUBLE) / count(*), 0), 6) AS avg_cost"
on_catalog("usage_period", f"SELECT {_USAGE} FROM analyses WHERE processedAt >= TIMESTAMP '2024-01-05' AND processedAt < TIMESTAMP '2024-01-15'")(lambda c: ST.usage_between(c.analyses, datetime(2024, 1, 5), datetime(2024, 1, 15)))
on_catalog("usage_alltime", f"SELECT {_USAGE} FROM analyses WHERE processedAt IS NOT NULL")(lambda c: ST.usage_between(c.analyses))
on_catalog("usage_this_month", f"SELECT {_USAGE} FROM analyses WHERE processedAt >= TIMESTAMP '2024-01-01'")(lambda c: ST.this_month(c.analyses, LATE))
on_catalog("usage_last_month", f"SELECT {_USAGE} FROM analyses WHERE processedAt >= TIMESTAMP '2024-01-01' AND processedAt < TIMESTAMP '2024-02-01'")(lambda c: ST.last_month(c.analyses, datetime(2024, 2, 15)))
on_catalog("monthly_usage", f"SELECT date_trunc('month', processedAt)::TIMESTAMP AS month, {_USAGE}, strftime(date_trunc('month', processedAt), '%b %Y') AS label FROM analyses WHERE processedAt >= TIMESTAMP '2023-07-01' AND processedAt < TIMESTAMP '2024-07-01' GROUP BY ALL")(lambda c: ST.monthly_history(c.analyses, NOW))


@query("monthly_orders", "WITH m AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY 1) SELECT *, n - lag(n) OVER (ORDER BY month) AS n_change FROM m")
def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    # A row for each month.
    return months.withColumn("n_change", F.col("n") - F.lag("n").over(Window.orderBy("month")))


on_catalog("token_usage", "SELECT CAST(sum(inputTokens) AS BIGINT) AS input_tokens, CAST(sum(outputTokens) AS BIGINT) AS output_tokens, CAST(sum(inputTokens) + sum(outputTokens) AS BIGINT) AS total_tokens FROM analyses")(lambda c: ST.token_usage(c.analyses))
on_catalog("provider_breakdown", "SELECT provider, providerModel, count(*) AS n, CAST(sum(actualCost) AS DECIMAL(20,6)) AS total_cost FROM analyses WHERE provider IS NOT NULL GROUP BY ALL")(lambda c: ST.provider_breakdown(c.analyses))
_PRICES = "(VALUES ('openai', 'gpt-5.4', 2.50, 15.00), ('openai', 'gpt-5.4-mini', 0.75, 4.50), ('gemini', 'gemini-2.5-flash', 0.30, 2.50), ('claude', 'claude-opus-4-6', 5.00, 25.00)) v(provider, providerModel, i, o)"
on_catalog("cost_with_pricing_dim", f"SELECT a.assetId, CAST(round(CAST(a.inputTokens * v.i + a.outputTokens * v.o AS DECIMAL(18,4)), 0) / 1000000 AS DECIMAL(10,6)) AS cost FROM analyses a LEFT JOIN {_PRICES} ON v.provider = a.provider AND v.providerModel = a.providerModel")(lambda c: ST.computed_costs(c.analyses).select("assetId", "cost"))
query("estimated_unit_costs", "SELECT * FROM (VALUES ('openai', 'gpt-5.4', 0.024335::DECIMAL(10,6)), ('openai', 'gpt-5.4-mini', 0.007166), ('openai', 'gpt-5.4-nano', 0.002061), ('gemini', 'gemini-2.5-flash', 0.003852), ('gemini', 'gemini-2.5-flash-lite', 0.000729), ('gemini', 'gemini-2.5-pro', 0.014855), ('claude', 'claude-sonnet-4-6', 0.026889), ('claude', 'claude-opus-4-6', 0.041250), ('claude', 'claude-haiku-4-5-20251001', 0.009080)) v(provider, model, unit_cost)")(lambda spark, sf_dir: ST.estimated_unit_costs(spark))
_OPEN = "kind = 'image' AND dateDeleted IS NULL AND id NOT IN (SELECT assetId FROM analyses WHERE status IN ('completed', 'processing'))"
on_catalog("unprocessed_anti_join", f"SELECT id FROM assets WHERE {_OPEN}")(lambda c: ST.remaining_assets(c.assets, c.analyses).select("id"))
on_catalog("cost_projection", f"SELECT count(*) AS remaining, CAST(0.041250 AS DECIMAL(10,6)) AS unit_cost, CAST(count(*) * 0.041250 AS DECIMAL(20,6)) AS projected_cost FROM assets WHERE {_OPEN}")(lambda c: ST.cost_projection(c.assets, c.analyses, "claude-opus-4-6"))
on_catalog("tag_counts", "SELECT * FROM (SELECT tagNormalized, tag, count(*) AS n FROM asset_tags WHERE analysisId IN (SELECT id FROM analyses WHERE status = 'completed') GROUP BY tagNormalized, tag) ORDER BY n DESC, tagNormalized, tag LIMIT 8")(lambda c: ST.tag_counts(c.asset_tags, c.analyses, c.assets, 8))
on_catalog("tag_counts_by_name", "SELECT tagNormalized, tag, count(*) AS n FROM asset_tags WHERE analysisId IN (SELECT l.id FROM analyses l JOIN assets a ON a.id = l.assetId WHERE status = 'completed' AND a.volumeId < 5) GROUP BY tagNormalized, tag ORDER BY tagNormalized, tag LIMIT 8")(lambda c: ST.tag_counts(c.asset_tags, c.analyses, c.assets, 8, "name", [0, 1, 2, 3, 4]))
on_catalog("tag_autocomplete", "SELECT tagNormalized, tag, count(*) AS n FROM asset_tags WHERE contains(tagNormalized, 'sun') GROUP BY ALL")(lambda c: ST.search_tags(c.asset_tags, " SUN "))


@query("part_name_counts", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name QUALIFY row_number() OVER (ORDER BY n DESC, p_name) <= 30")
def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_name").limit(30)


on_catalog("recent_activity", "SELECT l.assetId, l.status, l.dateUpdated, a.filename FROM (SELECT * FROM analyses WHERE status IN ('completed', 'failed') ORDER BY dateUpdated DESC, id LIMIT 10) l LEFT JOIN assets a ON a.id = l.assetId")(lambda c: ST.recent_activity(c.analyses, c.assets))
on_catalog("recent_error_count", "SELECT count(*) AS n FROM logs WHERE level IN ('error', 'critical') AND dateCreated >= TIMESTAMP '2024-01-29 12:00:00'")(lambda c: ST.recent_errors(c.logs, LATE))
on_catalog("distinct_stock_providers", "SELECT DISTINCT watermarkDetails.stockProvider AS value, array_to_string(list_transform(string_split(watermarkDetails.stockProvider, ' '), lambda w: concat(upper(w[1]), w[2:])), ' ') AS label FROM analyses WHERE coalesce(watermarkDetails.stockProvider, '') <> ''")(lambda c: ST.stock_providers(c.analyses))

# --- Bulk state and logs -----------------------------------------------------------------------------------------------

_IMAGES = "FROM assets a LEFT JOIN analyses l ON l.assetId = a.id WHERE a.kind = 'image' AND a.dateDeleted IS NULL"
on_catalog("bulk_stats", f"SELECT count(*) AS total, count(*) FILTER (l.status = 'completed') AS analyzed, count(*) FILTER (l.status IS NULL OR l.status IN ('pending', 'failed')) AS unprocessed, count(*) FILTER (l.status = 'failed') AS failed, count(*) FILTER (l.status = 'processing') AS processing {_IMAGES}")(lambda c: B.bulk_stats(c.assets, c.analyses))
on_catalog("bulk_page", f"SELECT count(*) FILTER (l.status IS NULL OR l.status IN ('pending', 'failed')) + count(*) FILTER (l.status = 'failed') AS actionable, CAST(least(100, round(count(*) FILTER (l.status = 'completed') * 100.0 / count(*))) AS INT) AS percent {_IMAGES} AND a.volumeId = 3")(lambda c: B.page_model(B.bulk_stats(c.assets, c.analyses, [3])).select("actionable", "percent"))
on_catalog("bulk_progress", "WITH e AS (SELECT greatest(0, least(300, count(*) FILTER (status IN ('completed', 'failed')) - 40)) AS done, count(*) FILTER (status = 'failed' AND processedAt >= TIMESTAMP '2024-01-03') AS failed, sum(actualCost) FILTER (processedAt >= TIMESTAMP '2024-01-03') AS cost FROM analyses) SELECT 300::BIGINT AS total, done AS completed, 300 - done AS remaining, failed, cost, CAST(round(done * 100.0 / 300, 1) AS DOUBLE) AS percent FROM e")(
    lambda c: B.progress(c.analyses, B.Session(started=1704240000, initial_unprocessed=300, initial_terminal=40), 1704243600).select("total", "completed", "remaining", "failed", F.col("cost").cast("decimal(38,6)").alias("cost"), F.col("percent").cast("double").alias("percent"))
)
on_catalog("first10_per_error_group", """WITH f AS (SELECT l.assetId, CASE WHEN c.errorCode IN ('rate_limit', 'timeout', 'invalid_response') THEN c.errorCode ELSE 'unknown' END AS code FROM analyses l JOIN analysis_content c ON c.analysisId = l.id WHERE l.status = 'failed'),
r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY assetId) AS rn, count(*) OVER (PARTITION BY code) AS n FROM f)
SELECT code, max(n) AS n, max(n) > 10 AS has_more, list(assetId ORDER BY assetId) AS ids FROM r WHERE rn <= 10 GROUP BY code""")(lambda c: B.failure_reasons(c.analyses, c.analysis_content, c.assets).select("code", "n", "has_more", F.transform("assets", lambda a: a["assetId"]).alias("ids")))
on_catalog("stuck_rows", "SELECT assetId, status FROM analyses WHERE status = 'processing' AND dateUpdated < TIMESTAMP '2024-01-08 11:30:00'")(lambda c: B.stuck(c.analyses, datetime(2024, 1, 8, 12), "processing").select("assetId", "status"))
on_catalog("stuck_reset", "SELECT CASE WHEN status = 'pending' AND dateUpdated < TIMESTAMP '2024-01-08 11:50:00' THEN 'failed' ELSE status END AS status, count(*) AS n FROM analyses GROUP BY 1")(lambda c: B.reset_stuck(c.analyses, datetime(2024, 1, 8, 12), "pending").groupBy("status").agg(F.count("*").alias("n")))
on_catalog("retry_failed", "SELECT CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status, count(*) AS n FROM analyses GROUP BY 1")(lambda c: B.retry_failed(c.analyses).groupBy("status").agg(F.count("*").alias("n")))
on_catalog("cancel_bulk", "SELECT CASE WHEN status = 'pending' AND assetId IN (10, 20, 30, 40, 50, 60, 70, 80, 90, 100) THEN 'failed' ELSE status END AS status, count(*) AS n FROM analyses WHERE status <> 'processing' GROUP BY 1")(lambda c: B.cancel_bulk(c.analyses, [10 * i for i in range(1, 11)]).groupBy("status").agg(F.count("*").alias("n")))
on_catalog("orphaned_jobs", "SELECT assetId FROM analyses WHERE status IN ('pending', 'processing') AND assetId NOT IN (SELECT id FROM assets WHERE id % 4 = 0)")(lambda c: B.orphaned(c.analyses, c.assets.where("id % 4 = 0").select(F.col("id").alias("assetId"))).select("assetId"))
on_catalog("selection_split", "SELECT eligible, count(*) AS n FROM (SELECT kind = 'image' AND id NOT IN (SELECT assetId FROM analyses WHERE status NOT IN ('pending', 'failed')) AS eligible FROM assets) GROUP BY eligible")(lambda c: B.selection_split(c.assets, c.analyses))
on_catalog("job_batches", "SELECT (row_number() OVER (ORDER BY id) - 1) // 20 AS batch, id FROM assets")(lambda c: B.batches(c.assets))
on_catalog("queue_info", "SELECT count(*) FILTER (assetId % 3 <> 0) AS pending, count(*) FILTER (assetId % 3 = 0) AS running, min_by('job ' || assetId, id) AS description FROM analyses WHERE status = 'pending'")(lambda c: B.queue_info(c.analyses.where("status = 'pending'").select("id", (F.col("assetId") % 3 == 0).alias("reserved"), F.concat(F.lit("job "), F.col("assetId")).alias("description"))))
on_catalog("log_page", "SELECT id, level, category, message, assetId, dateCreated FROM logs WHERE level = 'error' ORDER BY dateCreated DESC, id DESC LIMIT 50 OFFSET 50")(lambda c: LG.log_page(c.logs, 2, level="error"))
on_catalog("log_page_model", "SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 50.0) AS BIGINT)) AS pages, 51::BIGINT AS first, least(count(*), 100) AS last FROM logs WHERE level = 'error'")(lambda c: LG.page_model(c.logs, 2, level="error"))
on_catalog("log_retention", "SELECT level, count(*) AS n FROM logs WHERE dateCreated >= TIMESTAMP '2024-01-20 12:00:00' GROUP BY level")(lambda c: LG.retained(c.logs, datetime(2024, 2, 19, 12)).groupBy("level").agg(F.count("*").alias("n")))


@on_catalog("log_page_by_key", "SELECT id, row_number() OVER (ORDER BY dateCreated DESC, id DESC) AS position FROM logs WHERE level = 'error' QUALIFY position <= 100")
def log_page_by_key(c: Catalog) -> DataFrame:
    """Two pages of one level, the second after the key of the first one's last row."""
    kept = LG.keep_pages(c.logs, shared_folder(c.spark, "log-pages"), 16)
    first = kept.page(50, where=LG.level_is("error"))
    last = first.select(*kept.keys).tail(1)
    return _positions(first.union(kept.page(50, list(last[0]), LG.level_is("error"))) if last else first, 100, *kept.keys)


@on_catalog("log_retention_by_day", "SELECT id, level, dateCreated FROM logs WHERE dateCreated >= TIMESTAMP '2024-01-20 12:00:00'")
def log_retention_by_day(c: Catalog) -> DataFrame:
    """A log that came in two additions, and has lost its old days: only the day of the limit was written again."""
    folder = shared_folder(c.spark, "log-days")
    for part in (0, 1):
        LG.append_days(c.logs.where(F.col("id") % 2 == part), folder)
    LG.drop_expired(c.spark, folder, datetime(2024, 2, 19, 12))
    return LG.read_days(c.spark, folder).select("id", "level", "dateCreated")


on_catalog("log_json_context", "SELECT level, CAST(sum(CAST(context->>'$.k' AS BIGINT)) AS BIGINT) AS total FROM logs GROUP BY level")(lambda c: c.logs.groupBy("level").agg(F.sum(F.get_json_object("context", "$.k").cast("long")).alias("total")))

# --- Windows, labels, scalars ---------------------------------------------------------------------------------------------

_EIGHT_TAGS = "SELECT analysisId, tag, confidence FROM asset_tags UNION ALL SELECT analysisId, concat('x', tag), CAST(1 - confidence AS DECIMAL(5,4)) FROM asset_tags"
on_catalog("top5_tags_per_asset", f"SELECT analysisId, string_agg(tag, ', ' ORDER BY confidence DESC, tag) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY analysisId ORDER BY confidence DESC, tag) AS rn FROM ({_EIGHT_TAGS})) WHERE rn <= 5 GROUP BY analysisId")(
    lambda c: top_tags(c.asset_tags.select("analysisId", "tag", "confidence").unionByName(c.asset_tags.select("analysisId", F.concat(F.lit("x"), "tag").alias("tag"), (1 - F.col("confidence")).cast("decimal(5,4)").alias("confidence"))), 5)
)
on_catalog("brand_names", "SELECT assetId, coalesce(array_to_string(list_transform(detectedBrands, lambda b: b.brand), ', '), '') AS brands FROM analyses")(lambda c: c.analyses.select("assetId", brand_names(F.col("detectedBrands")).alias("brands")))
on_catalog("label_people", "SELECT assetId, CASE WHEN NOT containsPeople THEN 'No people' WHEN faceCount = 0 THEN 'People, no visible faces' WHEN faceCount = 1 THEN '1 person' WHEN faceCount = 2 THEN '2 people' WHEN faceCount <= 5 THEN '3-5 people' ELSE '6+ people' END AS label FROM analyses")(lambda c: c.analyses.select("assetId", L.people_label(F.col("containsPeople"), F.col("faceCount")).alias("label")))
on_catalog("label_nsfw_bucket", "SELECT assetId, CAST(round(nsfwScore * 100) AS INT) || '%' AS text, CASE WHEN nsfwScore >= 0.8 THEN 'red' WHEN nsfwScore >= 0.5 THEN 'orange' ELSE 'gray' END AS color FROM analyses WHERE nsfwScore IS NOT NULL")(lambda c: c.analyses.select("assetId", L.nsfw_label(F.col("nsfwScore")).alias("n")).where("n IS NOT NULL").select("assetId", "n.text", "n.color"))
on_catalog("label_status_provider", "SELECT a.id, CASE l.status WHEN 'completed' THEN 'Completed' WHEN 'failed' THEN 'Failed' WHEN 'pending' THEN 'Pending' WHEN 'processing' THEN 'Processing' ELSE 'Not analyzed' END AS status, CASE l.status WHEN 'completed' THEN 'green' WHEN 'failed' THEN 'red' WHEN 'pending' THEN 'blue' WHEN 'processing' THEN 'blue' ELSE 'gray' END AS color, CASE WHEN l.provider IS NULL THEN '' ELSE CASE l.provider WHEN 'openai' THEN 'OpenAI' WHEN 'gemini' THEN 'Gemini' ELSE 'Claude' END || coalesce(' / ' || l.providerModel, '') END AS provider FROM assets a LEFT JOIN analyses l ON l.assetId = a.id")(
    lambda c: c.assets.join(c.analyses.select(F.col("assetId").alias("id"), "status", "provider", "providerModel"), "id", "left").select("id", L.status_label(F.col("status")).alias("s"), L.provider_label(F.col("provider"), F.col("providerModel")).alias("provider")).select("id", F.col("s.text").alias("status"), "s.color", "provider")
)
on_catalog("label_watermark", "SELECT assetId, CASE WHEN NOT hasWatermark THEN '' ELSE upper(watermarkType[1]) || watermarkType[2:] || CASE WHEN watermarkType = 'stock' AND coalesce(watermarkDetails.stockProvider, '') <> '' THEN ' (' || watermarkDetails.stockProvider || ')' ELSE '' END END AS label FROM analyses")(lambda c: c.analyses.select("assetId", L.watermark_label(F.col("hasWatermark"), F.col("watermarkType"), F.col("watermarkDetails.stockProvider")).alias("label")))
on_catalog("fmt_size", "SELECT id, CASE WHEN size >= 1000000 THEN (size + 50000) // 1000000 || CASE WHEN (size + 50000) // 100000 % 10 > 0 THEN '.' || (size + 50000) // 100000 % 10 ELSE '' END || 'MB' ELSE (size + 500) // 1000 || 'KB' END AS text FROM assets")(lambda c: c.assets.select("id", L.file_size_text(F.col("size")).alias("text")))
on_catalog("fmt_duration", "SELECT id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' || CASE WHEN s % 60 > 0 THEN ' ' || s % 60 || 's' ELSE '' END ELSE s // 3600 || 'h' || CASE WHEN s // 60 % 60 > 0 THEN ' ' || s // 60 % 60 || 'm' ELSE '' END END AS text FROM (SELECT id, id * 37 AS s FROM assets)")(lambda c: c.assets.select("id", L.duration_text(F.col("id") * 37).alias("text")))
on_catalog("time_ago", "SELECT id, CASE WHEN s >= 86400 THEN CASE WHEN s // 86400 = 1 THEN '1 day ago' ELSE s // 86400 || ' days ago' END WHEN s >= 3600 THEN CASE WHEN s // 3600 = 1 THEN '1 hour ago' ELSE s // 3600 || ' hours ago' END WHEN s >= 60 THEN CASE WHEN s // 60 = 1 THEN '1 min ago' ELSE s // 60 || ' mins ago' END ELSE 'just now' END AS text FROM (SELECT id, CAST(abs(epoch(TIMESTAMP '2024-01-30 12:00:00') - epoch(dateCreated)) AS BIGINT) AS s FROM assets)")(lambda c: c.assets.select("id", L.time_ago(F.col("dateCreated"), LATE).alias("text")))
on_catalog("title_autogenerated", r"""WITH t AS (SELECT id, title, regexp_replace(filename, '\.[^.]*$', '') AS s FROM assets) SELECT id, coalesce(title, '') = '' OR lower(title) = lower(s) OR lower(title) = lower(trim(regexp_replace(s, '[-_.]+', ' ', 'g'))) AS automatic FROM t""")(lambda c: c.assets.select("id", L.title_is_automatic(F.col("title"), F.col("filename")).alias("automatic")))
on_catalog("readiness", r"""WITH t AS (SELECT id, size, width, lower(regexp_extract(filename, '\.([^.]+)$', 1)) AS e FROM assets) SELECT id, CASE WHEN (size >= 3000000) OR e = 'tiff' THEN 'error' WHEN size >= 1000000 OR (e <> 'svg' AND (width < 1200 OR width > 4096)) OR e NOT IN ('jpg', 'png', 'svg', 'webp') THEN 'warning' ELSE 'pass' END AS overall FROM t""")(lambda c: c.assets.select("id", L.overall(L.readiness(F.col("size"), F.col("width"), F.col("filename"))).alias("overall")))
on_catalog("quality_verdicts", """SELECT assetId, CASE WHEN sharpnessScore < 0.3 THEN 'Blurry' WHEN sharpnessScore < 0.6 THEN 'Soft' WHEN sharpnessScore IS NOT NULL THEN 'Sharp' END AS sharpness, CASE WHEN noiseScore < 0.25 THEN 'Very low contrast' WHEN noiseScore < 0.45 THEN 'Low contrast' ELSE 'Good' END AS contrast,
CASE WHEN exposureScore IS NULL THEN NULL WHEN exposureScore < 0.22 AND shadowClipRatio > 0.4 THEN 'Too dark' WHEN exposureScore > 0.85 AND highlightClipRatio > 0.4 THEN 'Too bright' ELSE 'Good' END AS brightness, CASE WHEN compressionQuality < 50 THEN 'Low quality' END AS compression, CASE colorProfile WHEN 'cmyk' THEN 'Not web-ready' WHEN 'srgb' THEN 'Good' WHEN 'grayscale' THEN 'Good' ELSE 'Colors may shift' END AS profile FROM analyses""")(
    lambda c: c.analyses.select("assetId", F.map_from_entries(F.transform(L.quality_checks(), lambda x: F.struct(x["name"], x["verdict"]))).alias("m")).select("assetId", *[F.try_element_at("m", F.lit(k)).alias(a) for k, a in (("sharpness", "sharpness"), ("contrast", "contrast"), ("brightness", "brightness"), ("compression", "compression"), ("colorProfile", "profile"))])
)
on_catalog("preprocess_skip", r"""SELECT id, CASE WHEN kind <> 'image' THEN 'not_image' WHEN mimeType = 'image/svg+xml' THEN 'mime_unsupported' WHEN size = 0 THEN 'empty_file' WHEN greatest(width, height) <= 1568 AND size <= 500000 THEN 'already_small' END AS reason FROM assets""")(lambda c: c.assets.select("id", L.skip_reason(F.col("kind"), F.col("mimeType"), F.col("filename"), F.col("size"), F.col("width"), F.col("height")).alias("reason")))
on_catalog("edited_fields", "SELECT assetId, altTextAi IS NOT NULL AND coalesce(altText, '') <> altTextAi AS alt_edited, suggestedTitleAi IS NOT NULL AND coalesce(suggestedTitle, '') <> suggestedTitleAi AS title_edited FROM analyses")(lambda c: c.analyses.select("assetId", p.edited(F.col("altText"), F.col("altTextAi")).alias("alt_edited"), p.edited(F.col("suggestedTitle"), F.col("suggestedTitleAi")).alias("title_edited")))
on_catalog("asset_panel", f"""WITH s AS (SELECT x AS id, count(*) AS n FROM (SELECT x, y FROM {_UNRESOLVED} UNION ALL SELECT y, x FROM {_UNRESOLVED}) GROUP BY x)
SELECT a.id, a.filename, CASE WHEN coalesce(n, 0) = 0 THEN '' WHEN n = 1 THEN '1 duplicate' ELSE n || ' duplicates' END AS duplicates, coalesce((SELECT string_agg(tag, ', ' ORDER BY confidence DESC, tag) FROM asset_tags t WHERE t.analysisId = l.id), '') AS tags
FROM assets a LEFT JOIN analyses l ON l.assetId = a.id LEFT JOIN s ON s.id = a.id""")(lambda c: asset_panel(c).select("id", "filename", "duplicates", "tags"))
query("language_base", "SELECT doc_id, lower(substr(lang, 1, 2)) AS base, lower(substr(lang, 1, 2)) = 'en' AS english FROM documents")(lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", base_language(F.col("lang")).alias("base"), same_language(F.col("lang"), F.lit("en-GB")).alias("english")))
query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")(lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash")))


@query("histogram_percentiles", """WITH b AS (SELECT l_returnflag AS img, l_quantity / 50 AS value, count(*) AS n FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY img ORDER BY value) AS cum, sum(n) OVER (PARTITION BY img) AS total FROM b)
SELECT img, min(value) FILTER (cum >= total * 0.5) AS median, round(sum(n) FILTER (value <= 0.05) / max(total), 6) AS shadow_ratio, round(sum(n) FILTER (value >= 0.95) / max(total), 6) AS highlight_ratio, round(min(value) FILTER (cum >= total * 0.95) - min(value) FILTER (cum >= total * 0.05), 6) AS contrast FROM c GROUP BY img""")
def histogram_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("img"), (F.col("l_quantity") / 50).alias("value"))
    m = I.tone_metrics(I.histogram(pixels, "img", "value"), "img")
    return m.select("img", "median", *[F.round(x, 6).alias(x) for x in ("shadow_ratio", "highlight_ratio", "contrast")])


@query("image_sharpness")
def image_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters of 640 by 640 repeated from the embeddings' 64 values: measured at 500 pixels, whole and by patches."""
    row = I.raster_column(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").repartition(4 * spark.sparkContext.defaultParallelism).select("vec_id", F.round(I.tiled_sharpness_udf(row, F.lit(640)), 6).alias("sharpness"))


@query("sha_of_files")
def sha_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every file of the tables."""
    return I.hash_files(spark, sf_dir, "*.parquet", shared_save(spark)).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "fileContentHash")


# --- Near duplicates --------------------------------------------------------------------------------------------------

_BITS = "SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x::DOUBLE >= list_sum(list_transform(embedding, lambda y: y::DOUBLE)) / 64 THEN 1 ELSE 0 END) AS b FROM embeddings"
_PAIRS = f"WITH h AS MATERIALIZED ({_BITS}), hp AS MATERIALIZED (SELECT p.vec_id AS x, q.vec_id AS y, CAST(list_sum(list_transform(list_zip(p.b, q.b), lambda z: abs(z[1] - z[2]))) AS INT) AS d FROM h p JOIN h q ON p.vec_id < q.vec_id), near AS MATERIALIZED (SELECT * FROM hp WHERE d <= 20)"


def vector_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("assetId"), D.bits_to_limbs(D.average_hash(F.col("embedding")), 64).alias("limbs"))


def vector_pairs(spark: SparkSession, sf_dir: str, expand: bool = True) -> DataFrame:
    return D.hamming_pairs(vector_hashes(spark, sf_dir), 20, 64, expand)


@query("average_hash", f"SELECT vec_id, array_to_string(b, '') AS bits FROM ({_BITS})")
def average_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", D.average_hash(F.col("embedding")).alias("bits"))


@query("dup_pairs_hamming", f"{_PAIRS} SELECT x AS canonicalAssetId, y AS duplicateAssetId, d AS hammingDistance FROM near")
def dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_pairs(spark, sf_dir).drop("similarity")


@query("dup_one_vs_all", f"WITH h AS MATERIALIZED ({_BITS}), d AS (SELECT q.vec_id AS assetId, CAST(list_sum(list_transform(list_zip(p.b, q.b), lambda z: abs(z[1] - z[2]))) AS INT) AS hammingDistance FROM h p, h q WHERE p.vec_id = 7 AND q.vec_id <> 7) SELECT * FROM d WHERE hammingDistance <= 24")
def dup_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.find_for_asset(vector_hashes(spark, sf_dir), 7, 24, 64).drop("similarity")


@query("dup_pair_counts", f"{_PAIRS} SELECT id AS assetId, count(*) AS n_pairs FROM (SELECT x AS id FROM near UNION ALL SELECT y FROM near) GROUP BY id")
def dup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.close_counts(vector_hashes(spark, sf_dir), 20, 64)


@query("dup_distinct_assets", f"{_PAIRS} SELECT count(*) AS n FROM (SELECT x FROM near UNION SELECT y FROM near)")
def dup_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.affected_assets(vector_pairs(spark, sf_dir, expand=False).withColumn("resolution", F.lit(None).cast("string"))).agg(F.count("*").alias("n"))


@query("dup_components", f"{_PAIRS.replace('WITH ', 'WITH RECURSIVE ', 1)}, e AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near), r AS (SELECT x AS a, x AS b FROM e UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b) SELECT a AS node, min(b) AS component FROM r GROUP BY a")
def dup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(vector_pairs(spark, sf_dir, expand=False), shared_save(spark), src="canonicalAssetId", dst="duplicateAssetId")


on_catalog("dup_unresolved_page", "SELECT id, hammingDistance FROM duplicate_groups WHERE resolution IS NULL ORDER BY hammingDistance, id LIMIT 20 OFFSET 20")(lambda c: D.unresolved_page(c.duplicate_groups, 20, 20).select("id", "hammingDistance"))
on_catalog("similar_to_ranked", f"SELECT CASE WHEN canonicalAssetId = 17 THEN duplicateAssetId ELSE canonicalAssetId END AS assetId, similarity FROM duplicate_groups WHERE resolution IS NULL AND 17 IN (canonicalAssetId, duplicateAssetId)")(lambda c: D.similar_ranked(c.duplicate_groups, 17).select("assetId", "similarity"))
on_catalog("similar_top3", f"WITH e AS (SELECT canonicalAssetId AS a, duplicateAssetId AS b, similarity AS s FROM duplicate_groups WHERE resolution IS NULL UNION ALL SELECT duplicateAssetId, canonicalAssetId, similarity FROM duplicate_groups WHERE resolution IS NULL), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rn, count(*) OVER (PARTITION BY a) AS n FROM e) SELECT a AS assetId, max(n) AS n_similar, list(b ORDER BY rn) AS similar FROM r WHERE rn <= 3 GROUP BY a")(lambda c: similar_top(c.duplicate_groups))
_CC = "e AS (SELECT canonicalAssetId AS x, duplicateAssetId AS y FROM {p} UNION ALL SELECT duplicateAssetId, canonicalAssetId FROM {p}), r AS (SELECT x AS a, x AS b FROM e UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b), k AS (SELECT a, min(b) AS k FROM r GROUP BY a)"
on_catalog("dup_cluster_keys", f"WITH RECURSIVE u AS (SELECT * FROM duplicate_groups WHERE resolution IS NULL), {_CC.format(p='u')} SELECT id, k AS clusterKey FROM u JOIN k ON k.a = u.canonicalAssetId")(lambda c: D.cluster(c.duplicate_groups, shared_save(c.spark)).where("resolution IS NULL").select("id", "clusterKey"))
on_catalog("dup_resolve_splits", f"WITH RECURSIVE u AS (SELECT * FROM duplicate_groups WHERE resolution IS NULL AND id <> 170), {_CC.format(p='u')} SELECT id, k AS clusterKey FROM u JOIN k ON k.a = u.canonicalAssetId")(
    lambda c: D.resolve(c.duplicate_groups, 170, "kept", NOW, shared_save(c.spark)).where("resolution IS NULL").select("id", "clusterKey")
)
on_catalog("dup_asset_deleted", f"WITH RECURSIVE u AS (SELECT * FROM duplicate_groups WHERE resolution IS NULL AND canonicalAssetId % 16 <> 1 AND duplicateAssetId % 16 <> 1), {_CC.format(p='u')} SELECT id, k AS clusterKey FROM u JOIN k ON k.a = u.canonicalAssetId")(
    lambda c: D.without_assets(c.duplicate_groups, c.assets.where("id % 16 = 1").select(F.col("id").alias("assetId")), shared_save(c.spark)).where("resolution IS NULL").select("id", "clusterKey")
)
on_catalog("dup_new_pairs", "SELECT a.id AS canonicalAssetId, a.id + 2 AS duplicateAssetId FROM assets a WHERE NOT EXISTS (SELECT 1 FROM duplicate_groups d WHERE d.canonicalAssetId = a.id AND d.duplicateAssetId = a.id + 2)")(lambda c: D.new_pairs(c.assets.select(F.col("id").alias("canonicalAssetId"), (F.col("id") + 2).alias("duplicateAssetId")), c.duplicate_groups))

# --- Normalisation and responses ------------------------------------------------------------------------------------------

_RESPONSE = """concat('```json\\n{"altText": "Text ', doc_id, '", "suggestedTitle": "Titel ', doc_id % 3, '", "nsfwScore": ', CASE doc_id % 4 WHEN 0 THEN '1.7' WHEN 1 THEN '"abc"' WHEN 2 THEN '0.25' ELSE '-3' END,
 ', "watermarkType": ', CASE doc_id % 3 WHEN 0 THEN '" Stock "' WHEN 1 THEN '"ai"' ELSE 'null' END, ', "tags": [{"tag": " Beach ", "confidence": 0.25}, {"tag": "SUN", "confidence": 0.75}, {"tag": " "}], "detectedBrands": ', CASE WHEN doc_id % 2 = 0 THEN '[{"name": "Acme"}]' ELSE '[]' END,
 ', "extractedText": [" a ", "", "b", "a"], "siteContent": {"de": {"suggestedTitle": "TITEL 1", "altText": ""}, "fr": {"altText": "", "suggestedTitle": ""}}}\\n```')"""


@query("parse_response", """SELECT doc_id, 'Text ' || doc_id AS altText, CASE WHEN doc_id % 3 = 1 THEN '' ELSE 'Titel ' || doc_id % 3 END AS suggestedTitle, CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 2 THEN 0.25 ELSE 0.0 END::DOUBLE AS nsfwScore,
CASE doc_id % 3 WHEN 0 THEN 'stock' WHEN 1 THEN 'unknown' END AS watermarkType, 'sun,beach' AS tags, doc_id % 2 = 0 AS containsBrandLogo, 'a|b' AS regions, 1 AS n_sites FROM documents""")
def parse_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = N.parse_response(F.expr(_RESPONSE.replace("\\n", "\n")))
    df = table(spark, sf_dir, "documents").select("doc_id", r.alias("r"))
    return df.select("doc_id", "r.altText", "r.suggestedTitle", "r.nsfwScore", "r.watermarkType", F.array_join(F.transform("r.tags", lambda t: t["tag"]), ",").alias("tags"), "r.containsBrandLogo", F.array_join("r.extractedText", "|").alias("regions"), F.size("r.siteContent").alias("n_sites"))


@query("provider_responses", "SELECT doc_id AS assetId, CASE doc_id % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'claude' ELSE 'other' END AS provider, CASE WHEN doc_id % 3 = 2 THEN 'provider_not_registered' WHEN doc_id % 5 = 0 THEN 'invalid_response' END AS errorCode FROM documents")
def provider_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = '{"altText": "x", "nsfwCategories": [{"category": "violence"}]}'
    openai = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit(content).alias("content")).alias("message"), F.when(F.col("doc_id") % 5 == 0, "length").otherwise("stop").alias("finish_reason"))).alias("choices")))
    claude = F.to_json(F.struct(F.array(F.struct(F.when(F.col("doc_id") % 5 == 0, "no json").otherwise(content).alias("text"))).alias("content")))
    raw = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("assetId"), F.when(F.col("doc_id") % 3 == 0, "openai").when(F.col("doc_id") % 3 == 1, "claude").otherwise("other").alias("provider"), F.when(F.col("doc_id") % 3 == 0, openai).otherwise(claude).alias("response"))
    good, bad = parse_responses(raw)
    return good.select("assetId", "provider", F.lit(None).cast("string").alias("errorCode")).unionByName(bad.select("assetId", "provider", "errorCode"))


_KEYS = "concat('call ', CASE doc_id % 3 WHEN 0 THEN concat('sk-', repeat('aB3', 8)) WHEN 1 THEN concat('AIza', repeat('Xy_-9', 7)) ELSE 'sk-short' END, ' of /v1?model=m&api_key=', CAST(doc_id AS VARCHAR(20)), '&key=k', CAST(doc_id AS VARCHAR(20)), ' ', text)"


@query("redact", rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(substr({_KEYS}, 1, 500), '\bsk-[a-zA-Z0-9]{{20,}}\b', '[REDACTED]', 'g'), '\bAIza[a-zA-Z0-9_-]{{30,}}\b', '[REDACTED]', 'g'), '[?&](key|api_key|apikey)=[^&\s]+', '\1=[REDACTED]', 'g') AS message FROM documents""")
def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", N.redact(F.expr(_KEYS.replace("VARCHAR(20)", "STRING"))).alias("message"))


@query("error_codes", "SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'invalid_api_key' WHEN 1 THEN 'access_denied' WHEN 2 THEN 'model_not_found' WHEN 3 THEN 'file_too_large' WHEN 4 THEN 'rate_limit' WHEN 5 THEN 'provider_unavailable' WHEN 6 THEN 'unknown' ELSE 'timeout' END AS code FROM events")
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(x) for x in (401, 403, 404, 413, 429, 503, 418)], F.lit(None).cast("int")), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", N.error_code(status, F.lit("Request timed out")).alias("code"))


@query("normalize_tags", "SELECT p_partkey, list_transform(list_sort(list_distinct(list_transform(string_split(p_name, ' '), lambda x: lower(trim(x))))), lambda x: x) AS tags FROM part")
def normalize_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.transform(F.split("p_name", " "), lambda x: F.struct(F.upper(x).alias("tag"), F.lit("0.5").alias("confidence")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_sort(F.array_distinct(F.transform(N.normalize_tags(tags), lambda t: t["tag"]))).alias("tags"))


@query("clamp_confidence", "SELECT event_id, greatest(0.0, least(1.0, value / 100)) AS c FROM events")
def clamp_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", N.clamp(F.col("value") / 100).alias("c"))


# --- Merges and state ------------------------------------------------------------------------------------------------------

on_catalog("dual_write_merge", """WITH n AS (SELECT id AS assetId, CASE WHEN id % 5 = 0 THEN '' ELSE 'new ' || id END AS alt, id % 7 AS faces FROM assets WHERE id % 2 = 0)
SELECT coalesce(l.assetId, n.assetId) AS assetId, CASE WHEN n.assetId IS NULL OR n.alt = '' OR coalesce(l.altText, '') <> coalesce(l.altTextAi, coalesce(l.altText, '')) THEN l.altText ELSE n.alt END AS altText,
CASE WHEN n.assetId IS NULL OR n.alt = '' THEN l.altTextAi ELSE n.alt END AS altTextAi FROM analyses l FULL JOIN n ON n.assetId = l.assetId""")(
    lambda c: M.dual_write(c.analyses, c.assets.where("id % 2 = 0").select(F.col("id").alias("assetId"), F.when(F.col("id") % 5 == 0, "").otherwise(F.concat(F.lit("new "), F.col("id"))).alias("altText"), (F.col("id") % 7).alias("faceCount")).drop("faceCount")).select("assetId", "altText", "altTextAi")
)
on_catalog("tag_sync", """WITH f AS (SELECT DISTINCT analysisId, assetId FROM asset_tags WHERE assetId % 2 = 0), n AS (SELECT analysisId, assetId, unnest(['beach', 'newtag', 'newtag']) AS t FROM f),
kept AS (SELECT analysisId, tagNormalized, isAi FROM asset_tags WHERE NOT (assetId % 2 = 0 AND isAi))
SELECT * FROM kept UNION ALL SELECT DISTINCT analysisId, t, true FROM n WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.analysisId = n.analysisId AND k.tagNormalized = n.t)""")(
    lambda c: M.sync_tags(c.asset_tags, c.asset_tags.where("assetId % 2 = 0").select("analysisId", "assetId").distinct().select("*", F.posexplode(F.array(F.lit(" Beach "), F.lit("NewTag"), F.lit("newtag"))).alias("pos", "tag"), F.lit(0.5).alias("confidence"))).select("analysisId", "tagNormalized", "isAi")
)
on_catalog("create_pending", "SELECT a.id AS assetId, coalesce(l.status, 'pending') AS status FROM assets a LEFT JOIN analyses l ON l.assetId = a.id")(lambda c: M.create_pending(c.analyses, c.assets, NOW).select("assetId", "status"))
on_catalog("keyed_merge", "SELECT coalesce(l.assetId, n.id) AS assetId, CASE WHEN n.id IS NOT NULL THEN 'merged' ELSE l.status END AS status FROM analyses l FULL JOIN (SELECT id FROM assets WHERE id % 9 = 0) n ON n.id = l.assetId")(lambda c: M.keyed_merge(c.analyses.select("assetId", "status"), c.assets.where("id % 9 = 0").select(F.col("id").alias("assetId"), F.lit("merged").alias("status")), ["assetId"]))
on_catalog("auto_apply_native", "SELECT a.id, coalesce(nullif(a.alt, ''), nullif(l.altTextAi, ''), a.alt) AS alt FROM assets a LEFT JOIN analyses l ON l.assetId = a.id")(lambda c: M.auto_apply(c.assets, c.analyses, L.title_is_automatic(F.col("title"), F.col("filename"))).select("id", "alt"))
@on_catalog("state_transition", """WITH e AS (SELECT assetId, list({'s': NULL::VARCHAR, 'p': NULL::VARCHAR, 'h': false, 'e': event} ORDER BY seq) AS ev
    FROM (SELECT assetId, ['queue', 'start', 'succeed', 'fail', 'cancel'][id % 5 + 1] AS event, id AS seq FROM logs WHERE assetId IS NOT NULL) GROUP BY assetId),
j AS (SELECT coalesce(l.assetId, e.assetId) AS assetId, list_prepend({'s': l.status, 'p': l.previousStatus, 'h': l.processedAt IS NOT NULL, 'e': ''}, coalesce(ev, [])) AS ev FROM analyses l FULL JOIN e ON e.assetId = l.assetId),
t AS (SELECT assetId, list_reduce(ev, lambda a, x: {
    's': CASE WHEN x.e = 'queue' AND coalesce(a.s, '') <> 'processing' THEN 'pending' WHEN x.e = 'start' AND a.s = 'pending' THEN 'processing' WHEN x.e = 'succeed' AND a.s = 'processing' THEN 'completed'
              WHEN x.e = 'fail' AND a.s IN ('pending', 'processing') THEN CASE WHEN a.h THEN 'completed' ELSE 'failed' END WHEN x.e = 'cancel' AND a.s IN ('pending', 'processing') THEN a.p ELSE a.s END,
    'p': CASE WHEN x.e = 'queue' AND coalesce(a.s, '') <> 'processing' THEN a.s WHEN x.e = 'succeed' AND a.s = 'processing' THEN NULL WHEN x.e = 'cancel' AND a.s IN ('pending', 'processing') THEN NULL ELSE a.p END,
    'h': CASE WHEN x.e = 'succeed' AND a.s = 'processing' THEN true WHEN x.e = 'cancel' AND a.s IN ('pending', 'processing') THEN a.h AND a.p IS NOT NULL ELSE a.h END, 'e': ''}) AS r FROM j)
SELECT assetId, r.s AS status FROM t WHERE r.s IS NOT NULL""")
def state_transition(c: Catalog) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("queue", "start", "succeed", "fail", "cancel")])
    events = c.logs.select("assetId", F.element_at(names, (F.col("id") % 5 + 1).cast("int")).alias("event"), F.col("id").alias("seq"))
    return EV.apply_events(c.analyses.select("assetId", "status", "previousStatus", "processedAt"), events).select("assetId", "status")


@on_catalog("status_over_batches", """WITH e AS (SELECT assetId, max(seq) AS last, list({'s': NULL::VARCHAR, 'p': NULL::VARCHAR, 'h': false, 'e': event} ORDER BY seq) AS ev
    FROM (SELECT assetId, ['queue', 'start', 'succeed', 'fail', 'queue', 'cancel', 'start'][(id * 5 + id // 7) % 7 + 1] AS event, id AS seq FROM logs WHERE assetId IS NOT NULL) GROUP BY assetId),
j AS (SELECT coalesce(l.assetId, e.assetId) AS assetId, last, list_prepend({'s': l.status, 'p': l.previousStatus, 'h': l.processedAt IS NOT NULL, 'e': ''}, coalesce(ev, [])) AS ev FROM analyses l FULL JOIN e ON e.assetId = l.assetId),
t AS (SELECT assetId, last, list_reduce(ev, lambda a, x: {
    's': CASE WHEN x.e = 'queue' AND coalesce(a.s, '') <> 'processing' THEN 'pending' WHEN x.e = 'start' AND a.s = 'pending' THEN 'processing' WHEN x.e = 'succeed' AND a.s = 'processing' THEN 'completed'
              WHEN x.e = 'fail' AND a.s IN ('pending', 'processing') THEN CASE WHEN a.h THEN 'completed' ELSE 'failed' END WHEN x.e = 'cancel' AND a.s IN ('pending', 'processing') THEN a.p ELSE a.s END,
    'p': CASE WHEN x.e = 'queue' AND coalesce(a.s, '') <> 'processing' THEN a.s WHEN x.e = 'succeed' AND a.s = 'processing' THEN NULL WHEN x.e = 'cancel' AND a.s IN ('pending', 'processing') THEN NULL ELSE a.p END,
    'h': CASE WHEN x.e = 'succeed' AND a.s = 'processing' THEN true WHEN x.e = 'cancel' AND a.s IN ('pending', 'processing') THEN a.h AND a.p IS NOT NULL ELSE a.h END, 'e': ''}) AS r FROM j)
SELECT assetId, r.s AS status, r.p AS previous, r.h AS had, last AS lastSeq FROM t WHERE r.s IS NOT NULL""")
def status_over_batches(c: Catalog) -> DataFrame:
    """Three batches that each hold events of all times, the second of them twice; the oracle folds all events of an asset at once."""
    names = F.array(*[F.lit(x) for x in ("queue", "start", "succeed", "fail", "queue", "cancel", "start")])
    event = F.element_at(names, ((F.col("id") * 5 + F.floor(F.col("id") / 7)) % 7 + 1).cast("int"))
    events = c.logs.select("assetId", event.alias("event"), F.col("id").alias("seq"))
    fold = StatusFold(c.tables.spark, shared_folder(c.tables.spark, "status"), block=256)
    fold.start(c.analyses)
    for number, part in enumerate((2, 0, 0, 1), 1):
        fold.merge(events.where(F.col("seq") % 3 == part), min(number, 2) if number < 4 else 3)
    return fold.statuses()


on_catalog("cascade_orphans", "SELECT t.assetId, t.tag FROM asset_tags t WHERE t.analysisId NOT IN (SELECT id FROM analyses WHERE status = 'completed')")(lambda c: orphans(c.asset_tags, "analysisId", c.analyses.where("status = 'completed'")).select("assetId", "tag"))
on_catalog("left_only_semi_join", "SELECT a.id, a.volumeId FROM assets a WHERE a.id IN (SELECT assetId FROM analyses)")(lambda c: c.assets.join(c.analyses.select(F.col("assetId").alias("id")), "id", "left_semi").select("id", "volumeId"))
on_catalog("cluster_key_lookup", "SELECT assetId, min(k) AS clusterKey FROM (SELECT canonicalAssetId AS assetId, least(canonicalAssetId, duplicateAssetId) AS k FROM duplicate_groups WHERE resolution IS NULL UNION ALL SELECT duplicateAssetId, least(canonicalAssetId, duplicateAssetId) FROM duplicate_groups WHERE resolution IS NULL) GROUP BY assetId")(
    lambda c: P.cluster_keys(c.duplicate_groups.withColumn("clusterKey", F.least("canonicalAssetId", "duplicateAssetId")))
)


@query("site_fallback", "SELECT c.conv_id, coalesce(nullif(max(text) FILTER (turn = 1), ''), nullif(max(text) FILTER (turn = 0), '')) AS value FROM conversations c WHERE turn IN (0, 1) GROUP BY conv_id")
def site_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").where("turn IN (0, 1)").groupBy("conv_id", "turn").agg(F.max("text").alias("altText"))
    base = conv.select("conv_id").distinct().join(conv.where("turn = 0").select("conv_id", "altText"), "conv_id", "left").withColumnRenamed("conv_id", "id")
    own = conv.where("turn = 1").select(F.col("conv_id").alias("analysisId"), F.lit(2).alias("siteId"), "altText")
    return M.resolve_site_value(own, base, 2, "altText", 1).withColumnRenamed("analysisId", "conv_id")


# --- Look-ups, jobs and edits ------------------------------------------------------------------------------------------------

on_catalog("point_lookup", "SELECT assetId, status, provider FROM analyses WHERE assetId = 7")(lambda c: ST.analysis_of(c.analyses, 7).select("assetId", "status", "provider"))
on_catalog("multi_get", "SELECT assetId, status, provider FROM analyses WHERE assetId IN (SELECT id FROM assets WHERE volumeId = 3)")(lambda c: ST.analyses_of(c.analyses, c.assets.where("volumeId = 3").select("id")).select("assetId", "status", "provider"))
on_catalog("job_selected", """WITH chosen AS (SELECT doc_id * 3 AS id, row_number() OVER (ORDER BY doc_id) AS position FROM labels WHERE doc_id % 5 = 0)
SELECT c.position, c.id AS assetId, a.id IS NOT NULL AS found, count(*) OVER () AS total FROM chosen c LEFT JOIN assets a USING (id)""")(
    lambda c: B.selected_job(c.assets, c.tables.spark.read.parquet(f"{c.tables.sf_dir}/labels.parquet").where("doc_id % 5 = 0").select((F.col("doc_id") * 3).alias("id"), F.row_number().over(Window.orderBy("doc_id")).alias("position")))
)
on_catalog("job_single_missing", "SELECT assetId FROM analyses WHERE assetId <> 9")(lambda c: B.single_job(c.analyses, c.assets.where("id <> 9"), 9)[1].select("assetId"))
on_catalog("replace_tags", """WITH n AS (SELECT DISTINCT analysisId, assetId, unnest([' Beach ', 'Own', '']) AS t FROM asset_tags WHERE assetId % 4 = 0)
SELECT analysisId, tag, tagNormalized, isAi FROM asset_tags WHERE analysisId NOT IN (SELECT analysisId FROM n) UNION ALL SELECT analysisId, trim(t), lower(trim(t)), t = ' Beach ' FROM n WHERE t <> ''""")(
    lambda c: M.replace_tags(c.asset_tags, c.asset_tags.where("assetId % 4 = 0").select("assetId", "analysisId").distinct().select("*", F.posexplode(F.array(F.lit(" Beach "), F.lit("Own"), F.lit(""))).alias("pos", "tag"), F.lit(0.5).alias("confidence")).withColumn("isAi", F.col("pos") == 0)).select("analysisId", "tag", "tagNormalized", "isAi")
)
on_catalog("edit_and_revert", "SELECT assetId, CASE WHEN assetId = 7 THEN 'by hand' WHEN assetId = 24 THEN altTextAi ELSE altText END AS altText FROM analyses")(lambda c: M.revert_field(M.edit_field(c.analyses, 1000007, "altText", "by hand"), 1000024, "altText").select("assetId", "altText"))
on_catalog("apply_titles", "SELECT a.id, CASE WHEN a.volumeId = 2 THEN coalesce(nullif(l.suggestedTitle, ''), a.title) ELSE a.title END AS title FROM assets a LEFT JOIN analyses l ON l.assetId = a.id")(lambda c: G.apply_to_assets(c.assets, c.analyses, c.assets.where("volumeId = 2"), "title").select("id", "title"))
on_catalog("site_postings", r"""WITH s AS (SELECT l.assetId, l.language, CASE WHEN f = 0 THEN 'siteTitle:' || l.language ELSE 'siteAltText:' || l.language END AS field, CASE WHEN f = 0 THEN title ELSE alt END AS v
    FROM (SELECT id AS assetId, language, title, alt FROM assets WHERE id % 3 = 0 AND id IN (SELECT assetId FROM analyses)) l, (SELECT unnest([0, 1]) AS f)),
p AS (SELECT field, unnest(list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower(v), '[^\p{L}\s]', ' ', 'g')), '\s+'), lambda x: length(x) BETWEEN 2 AND 40))) AS token FROM s WHERE coalesce(v, '') <> '')
SELECT field, count(*) AS n, count(DISTINCT token) AS tokens FROM p GROUP BY field""")(
    lambda c: SIX.postings(SIX.site_rows(c.assets.where("id % 3 = 0").select((F.col("id") + 1000000).alias("analysisId"), "language", F.col("title").alias("suggestedTitle"), F.lit(None).cast("string").alias("suggestedTitleAi"), F.col("alt").alias("altText"), F.lit(None).cast("string").alias("altTextAi")), c.analyses), stemmed=False)
    .groupBy("field").agg(F.count("*").alias("n"), F.countDistinct("token").alias("tokens"))
)
on_catalog("match_locale", """WITH c AS (SELECT * FROM (VALUES ('de-CH', 1, 'a'), ('de', 2, 'b'), ('en-GB', 3, 'c'), ('fr', 4, 'd')) t(locale, pos, title)), s AS (SELECT id AS siteId, CASE id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'de-AT' WHEN 2 THEN 'EN-gb' ELSE 'sv' END AS locale FROM assets)
SELECT siteId, s.locale, min_by(c.locale, struct_pack(e := lower(s.locale) <> lower(c.locale), p := c.pos)) AS contentLocale, min_by(c.title, struct_pack(e := lower(s.locale) <> lower(c.locale), p := c.pos)) AS title FROM s JOIN c ON lower(substr(s.locale, 1, 2)) = lower(substr(c.locale, 1, 2)) GROUP BY siteId, s.locale""")(
    lambda c: M.match_locale(c.spark.createDataFrame([("de-CH", 1, "a"), ("de", 2, "b"), ("en-GB", 3, "c"), ("fr", 4, "d")], "locale string, pos int, title string"), c.assets.select(F.col("id").alias("siteId"), F.when(F.col("id") % 4 == 0, "de").when(F.col("id") % 4 == 1, "de-AT").when(F.col("id") % 4 == 2, "EN-gb").otherwise("sv").alias("locale")))
)


@query("dup_find_among", f"{_PAIRS} SELECT x AS canonicalAssetId, y AS duplicateAssetId, d AS hammingDistance FROM near WHERE x % 2 = 0 AND y % 2 = 0")
def dup_among(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = vector_hashes(spark, sf_dir)
    return D.find_among(h, h.where("assetId % 2 = 0").select("assetId"), 20, 64).drop("similarity")


def cluster_around(c: Catalog) -> DataFrame:
    """Stored keys are those of all pairs, but for an asset's new pair: its cluster joins that of the seed."""
    stored = store(c.spark, D.cluster(c.duplicate_groups, shared_save(c.spark)), "pairs")
    seeds = c.assets.where("volumeId = 1").select(F.col("id").alias("assetId"))
    wrong = stored.withColumn("clusterKey", F.when(F.col("canonicalAssetId").isin(0, 1, 4, 5), F.lit(None).cast("long")).otherwise(F.col("clusterKey")))
    first = wrong.where(F.col("canonicalAssetId").isin(0, 1, 4, 5)).select(F.col("canonicalAssetId").alias("assetId"))
    return D.cluster_around(wrong, seeds.unionByName(first), shared_save(c.spark)).where("resolution IS NULL").select("id", "clusterKey")


on_catalog("dup_cluster_around", f"WITH RECURSIVE u AS (SELECT * FROM duplicate_groups WHERE resolution IS NULL), {_CC.format(p='u')} SELECT id, k AS clusterKey FROM u JOIN k ON k.a = u.canonicalAssetId")(cluster_around)


@on_catalog("dup_clusters_after_edits", f"WITH RECURSIVE u AS (SELECT * FROM duplicate_groups WHERE resolution IS NULL AND canonicalAssetId % 23 <> 6 AND duplicateAssetId % 23 <> 6), {_CC.format(p='u')} SELECT id, k AS clusterKey FROM u JOIN k ON k.a = u.canonicalAssetId")
def dup_clusters_after_edits(c: Catalog) -> DataFrame:
    """Clusters stored for two thirds of the pairs, before any was resolved; then the other pairs come, the resolved ones go, and so do some assets. The seeds are one end of each edited pair."""
    save, pairs = shared_save(c.spark), c.duplicate_groups
    old = D.cluster(pairs.where("id % 30 <> 10").withColumn("resolution", F.lit(None).cast("string")), save).select("id", "clusterKey")
    edited = store(c.spark, pairs.join(old, "id", "left"), "edited-pairs")
    seeds = edited.where("clusterKey IS NULL OR resolution IS NOT NULL").select(F.explode(F.when(F.col("resolution").isNotNull(), F.array("canonicalAssetId", "duplicateAssetId")).otherwise(F.array("canonicalAssetId"))).alias("assetId"))
    now = store(c.spark, D.cluster_around(edited, seeds, save), "clustered-pairs")
    gone = c.assets.where("id % 23 = 6").select(F.col("id").alias("assetId"))
    return D.without_assets(now, gone, save).where("resolution IS NULL").select("id", "clusterKey")



@query("dup_hash_store", f"""WITH h AS MATERIALIZED ({_BITS}), now AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN vec_id % 11 = 4 THEN list_transform(b, lambda x: 1 - x) ELSE b END AS b FROM h WHERE vec_id % 13 <> 5),
rep AS MATERIALIZED (SELECT b, min(id) AS rep FROM now GROUP BY b), near AS (SELECT least(p.rep, q.rep) AS x, greatest(p.rep, q.rep) AS y, CAST(list_sum(list_transform(list_zip(p.b, q.b), lambda z: abs(z[1] - z[2]))) AS INT) AS d FROM rep p JOIN rep q ON p.rep < q.rep)
SELECT x AS canonicalAssetId, y AS duplicateAssetId, d AS hammingDistance FROM near WHERE d <= 20 UNION ALL SELECT rep, id, 0 FROM now JOIN rep USING (b) WHERE rep <> id""")
def dup_hash_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes come in three additions, some then change to their complement and some assets go: the pairs are those of a scan of what there is then."""
    hashes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("assetId"), D.average_hash(F.col("embedding")).alias("hash"))
    kept = HS.HashStore(spark, shared_folder(spark, "hash-store"), bits=64, threshold=20)
    kept.update(hashes.where("assetId % 3 = 0"), 1)
    kept.update(hashes.where("assetId % 3 = 1"), 2)
    kept.compact()
    kept.update(hashes.where("assetId % 3 = 2"), 3)
    other = F.translate("hash", "01", "10")
    kept.update(hashes.where("assetId % 11 = 4").select("assetId", other.alias("hash")), 4, hashes.where("assetId % 13 = 5").select("assetId"))
    kept.update(hashes.limit(0), 5, hashes.where("assetId % 13 = 5").select("assetId"))
    return kept.pairs().drop("similarity")


# --- Streams (an addition) ---------------------------------------------------------------------------------------------------


@query("ext_stream_window_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS start, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(20,6))) AS total FROM events GROUP BY ALL")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's own result over all files that are there."""
    return EV.run_to_folder(EV.window_counts(EV.read_events(spark, sf_dir)), shared_folder(spark, "stream"))


@query("batch_window_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS start, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(20,6))) AS total FROM events GROUP BY ALL")
def batch_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.window_counts(table(spark, sf_dir, "events"))


def _time_slices(events: DataFrame) -> list[DataFrame]:
    """Three slices of the time that events span."""
    first, last = events.agg(F.min("at"), F.max("at")).first()
    if first is None:
        return [events]
    cut = [first + (last - first) * i / 3 for i in (1, 2)]
    return [events.where(F.col("at") < cut[0]), events.where((F.col("at") >= cut[0]) & (F.col("at") < cut[1])), events.where(F.col("at") >= cut[1])]


@query("stuck_timers", """WITH e AS (SELECT user_id AS id, epoch_us(ts) // 1000 AS ms, event_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status FROM events),
n AS (SELECT *, lead(ms) OVER (PARTITION BY id ORDER BY ms, event_id) AS next, max(ms) OVER () - 3600000 AS mark, ms + CASE status WHEN 'pending' THEN 600000 ELSE 1800000 END AS deadline FROM e)
SELECT id AS assetId, status AS was, make_timestamp(deadline * 1000) AS failedAt FROM n WHERE status IN ('pending', 'processing') AND id IS NOT NULL AND (next > deadline OR (next IS NULL AND deadline < mark))""")
def stuck_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending rows fail 10 minutes after their last event, processing ones 30, by timers of a stream that starts three times."""
    status = F.when(F.col("event_type").isin("signup", "view"), "pending").when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "error", "failed").otherwise("completed")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("assetId"), status.alias("status"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))
    out = TM.run_slices(_time_slices(events), TM.stuck_rows, shared_folder(spark, "stuck"))
    return out.withColumn("failedAt", F.col("failedAt").cast("timestamp_ntz"))


@query("session_timers", """WITH e AS (SELECT user_id % 20 AS id, epoch_us(ts) // 1000 AS ms, event_id, (event_type = 'purchase')::INT AS done FROM events WHERE user_id IS NOT NULL),
g AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY ms, event_id) AS s FROM (SELECT *, (ms > lag(ms) OVER (PARTITION BY id ORDER BY ms, event_id) + 3600000)::INT AS new FROM e)),
c AS (SELECT *, min(ms) OVER (PARTITION BY id, s) AS began, sum(done) OVER (PARTITION BY id, s ORDER BY ms, event_id) AS completed FROM (SELECT id, ms, event_id, done, coalesce(s, 0) AS s FROM g)),
p AS (SELECT *, ms > began AND completed > coalesce(max(CASE WHEN ms > began THEN completed END) OVER (PARTITION BY id, s ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sampled FROM c),
t AS (SELECT max(ms) - 3600000 AS mark FROM e)
SELECT id AS session, make_timestamp(began * 1000) AS startedAt, make_timestamp((max(ms) + 3600000) * 1000) AS endedAt, count(*) AS polls, max(completed)::BIGINT AS completed,
       round(arg_max(completed * 1000.0::DOUBLE / (ms - began), (ms, event_id)) FILTER (sampled), 9) AS rate
FROM p, t GROUP BY id, s, began, mark, HAVING max(ms) + 3600000 < mark OR s < (SELECT max(s) FROM p q WHERE q.id = p.id)""".replace("mark, HAVING", "mark HAVING"))
def session_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions end an hour after their last poll; their rate is that of the last poll that found more completed."""
    done = (F.col("event_type") == "purchase").cast("int")
    polls = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("session"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), done.alias("done"))
    out = TM.run_slices(_time_slices(polls), TM.sessions, shared_folder(spark, "sessions"))
    return out.withColumns({"startedAt": F.col("startedAt").cast("timestamp_ntz"), "endedAt": F.col("endedAt").cast("timestamp_ntz"), "rate": F.round("rate", 9)})

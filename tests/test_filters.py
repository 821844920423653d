"""Filters: boundaries, NULLs, gates, join kinds."""

from __future__ import annotations

import itertools
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from orrery.catalog import Catalog
from orrery.config import EngineConfig
from orrery.operators import conditions as CND
from orrery.plans import faceted as FC
from orrery.plans.asset_query import AssetQuery, RULES
from orrery.schemas import quarantine, schema, violations


@pytest.fixture(scope="module")
def make(spark):
    """A catalog of one asset for each dict of analysis values; None stands for an asset without analysis."""

    def build(rows, assets=None, tags=(), pairs=()):
        a = [{"id": i, "volumeId": 1, "kind": "image", **((assets or {}).get(i, {}))} for i in range(1, len(rows) + 1)]
        base = {"status": "completed", "containsPeople": False, "hasWatermark": False, "containsBrandLogo": False, "faceCount": 0}
        l = [{"id": 100 + i, "assetId": i, **base, **r} for i, r in enumerate(rows, 1) if r is not None]
        df = lambda name, data: spark.createDataFrame([tuple(d.get(f.name) for f in schema(name)) for d in data], schema(name))
        t = [{"assetId": i, "analysisId": 100 + i, "tag": x, "tagNormalized": x.lower(), "confidence": Decimal("0.9"), "isAi": True} for i, x in tags]
        p = [{"id": n, "canonicalAssetId": x, "duplicateAssetId": y, "hammingDistance": 0, "similarity": Decimal("0.99"), "resolution": r, "clusterKey": None if r else x} for n, (x, y, r) in enumerate(pairs)]
        return Catalog(spark, {"assets": df("assets", a), "analyses": df("analyses", l), "asset_tags": df("asset_tags", t), "duplicate_groups": df("duplicate_groups", p)})

    return build


def ids(catalog, config=EngineConfig(), **filters):
    return sorted(r.id for r in AssetQuery(catalog, config).where(**filters).ids().collect())


D = Decimal
CASES = [
    ("confidence_below", 0.5, "altTextConfidence", ["0.49", "0.50", "0.51", None], [1]),
    ("confidence_above", 0.5, "altTextConfidence", ["0.49", "0.50", "0.51", None], [2, 3]),
    ("nsfw_flagged", True, "nsfwScore", ["0.4999", "0.5", None], [2]),
    ("nsfw_flagged", False, "nsfwScore", ["0.4999", "0.5", None], [1, 3]),
    ("blurry", True, "sharpnessScore", ["0.29", "0.30", "0.9", None], [1]),
    ("blurry", False, "sharpnessScore", ["0.29", "0.30", "0.9", None], [1, 2, 3, 4]),
    ("exposure_issues", True, "exposureScore", ["0.29", "0.30", "0.50", "0.70", "0.71", None], [1, 5]),
    ("exposure_issues", False, "exposureScore", ["0.29", "0.30", "0.50", "0.70", "0.71", None], [2, 3, 4]),
    ("low_contrast", True, "noiseScore", ["0.44", "0.45", None], [1]),
    ("sharpness_below", 0.5, "sharpnessScore", ["0.49", "0.5", None], [1]),
]


@pytest.mark.parametrize("name,value,column,values,want", CASES)
def test_boundaries(make, name, value, column, values, want):
    assert ids(make([{column: None if v is None else D(v)} for v in values]), **{name: value}) == want


def test_status(make):
    c = make([None, {"status": "pending"}, {"status": "failed"}, {"status": "processing"}, {"status": "completed"}])
    assert ids(c, status="untagged") == [1, 2, 3] and ids(c, status="analyzed") == [5] and ids(c, status=[]) == []
    assert ids(c, status=["failed", "processing"]) == [3, 4]
    assert ids(c, unprocessed=True) == [1, 2, 3] and ids(c, unprocessed=False) == [4, 5]
    assert ids(c, unprocessed=True, contains_people=False) == [2, 3]
    assert ids(c, status="untagged", nsfw_flagged=False) == [1, 2, 3]
    assert ids(c, EngineConfig(pro=False), status="untagged") == [1, 2, 3, 4, 5]


def test_dark_large_text(make):
    c = make([{"exposureScore": D(e), "shadowClipRatio": D(s)} for e, s in (("0.15", "0.50"), ("0.25", "0.50"), ("0.15", "0.30"))])
    assert ids(c, too_dark=True) == [1]
    c = make([{}, {}, {}], assets={1: {"size": 999_999}, 2: {"size": 1_000_000}, 3: {"size": 1_500_000}})
    assert ids(c, too_large=True) == [2, 3] and ids(c, too_large=False) == [1, 2, 3] and ids(c, size_max_mib=1) == [1, 2]
    c = make([{"extractedTextAi": ["Invoice #123", "Total: $50"]}, {"extractedTextAi": []}, {"extractedTextAi": None}, None])
    assert ids(c, has_text=True) == [1] and ids(c, has_text=False) == [2, 3] and ids(c, text_search="Invoice") == [1] and ids(c, text_search="") == [1, 2, 3, 4]
    assert sorted(r.id for r in FC.matching(c, {"hasTextInImage": False}).collect()) == [2, 3, 4]


def test_json(make):
    c = make([{"detectedBrands": [("Nikon", 0.9), ("Canon", 0.1)]}, {"detectedBrands": [("Nik", 0.9)]}, {"detectedBrands": None}])
    assert ids(c, detected_brand="Nik") == [2] and ids(c, detected_brand="Canon") == [1]
    c = make([{"watermarkDetails": ("Shutterstock",)}, {"watermarkDetails": ("Getty",)}, {"watermarkDetails": None}])
    assert ids(c, stock_provider="SHUTTERSTOCK") == [1] and ids(c, stock_provider=["getty", "shutterstock"]) == [1, 2] and ids(c, stock_provider=[]) == []


def test_tags(make):
    c = make([{}, {}, {}], tags=[(1, "Sunset"), (1, "beach"), (2, "sunset-beach"), (3, "beach"), (3, "BEACH")])
    assert ids(c, tag="sunset") == [1] and ids(c, tag=["sunset", "beach"]) == [1, 3] and ids(c, tags_all=["sunset", "Beach"]) == [1] and ids(c, tags_all=[]) == [1, 2, 3] and ids(c, tag=[""]) == [1, 2, 3]


def test_duplicates(make):
    c = make([None] * 6, pairs=[(1, 2, None), (2, 3, None), (4, 5, "ignored")])
    assert ids(c, has_duplicates=True) == [1, 2, 3] and ids(c, has_duplicates=False) == [4, 5, 6]
    assert ids(c, similar_to=1) == [1, 2] and ids(c, similar_to=2) == [1, 2, 3] and ids(c, similar_to=6) == [6] and ids(c, similar_to=0) == [1, 2, 3, 4, 5, 6]
    rows = {r.id: r.matches for r in CND.matches(c, {"similar_to": 1}).collect()}
    assert [i for i in rows if rows[i]] == [1, 2, 3] or sorted(i for i in rows if rows[i]) == [1, 2, 3]
    assert ids(c, EngineConfig(has_duplicates=False), has_duplicates=True) == [1, 2, 3, 4, 5, 6]


def test_last_setter_wins_and_none_clears(make):
    c = make([{"hasWatermark": True}, {"hasWatermark": False}])
    q = AssetQuery(c).where(has_watermark=True).where(has_watermark=False)
    assert [r.id for r in q.ids().collect()] == [2] and q.where(has_watermark=None).ids().count() == 2
    with pytest.raises(ValueError):
        AssetQuery(c).where(no_such=1)


def test_joins_only_on_demand(make):
    c = make([{}])
    assert not AssetQuery(c).where(too_large=True).is_joined() and AssetQuery(c).where(has_watermark=True).join_kind() == "inner"
    assert AssetQuery(c).where(unprocessed=True).join_kind() == "left" and AssetQuery(c).where(unprocessed=True, too_large=True).join_kind() == "left"
    assert "Join" not in AssetQuery(c).where(too_large=True).ids()._jdf.queryExecution().optimizedPlan().toString()
    plan = AssetQuery(c).where(has_duplicates=True).ids()._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


def test_filters_commute(make):
    c = make([{"hasWatermark": bool(i % 2), "containsPeople": bool(i % 3), "nsfwScore": D(i) / 10} for i in range(8)])
    parts = {"has_watermark": True, "contains_people": True, "nsfw_min": 0.3}
    want = ids(c, **parts)
    for order in itertools.permutations(parts):
        q = AssetQuery(c)
        for k in order:
            q = q.where(**{k: parts[k]})
        assert sorted(r.id for r in q.ids().collect()) == want


def test_errors_can_leave_the_query_unfiltered(make):
    c = make([{}, {}])
    bad = AssetQuery(c, on_error="ignore").where_raw(F.col("no_such_column") == 1)
    with pytest.warns(UserWarning):
        assert bad.ids().count() == 2


def test_every_rule_has_a_plan(make):
    c = make([{}])
    values = {"status": "failed", "tag": "x", "tags_all": ["x"], "stock_provider": "x", "provider": "x", "provider_model": "x", "watermark_type": "x", "detected_brand": "x", "face_preset": "1", "processed_from": datetime(2024, 1, 1), "processed_to": datetime(2024, 1, 1), "text_search": "x", "similar_to": 1}
    for name in RULES:
        AssetQuery(c).where(**{name: values.get(name, 1 if "_m" in name or "confidence" in name or "sharp" in name else True)}).ids().collect()


def test_parser():
    p = FC.parse_request({"q": "  x ", "tags": "a,,b,a", "tagOperator": "xor", "nsfwScoreMin": "-2", "nsfwFlagged": "1", "limit": "500", "offset": "-3", "provider": " " + "p" * 60, "processedFrom": "no date", "fileSizePreset": "7", "watermarkType": ["stock", "x", "stock"], "similarTo": "0", "hasDuplicates": "yes", "containsPeople": ""})
    assert p == {"query": "x", "tags": ["a", "b"], "nsfwScoreMin": 0.0, "limit": 100, "offset": 0, "provider": "p" * 50, "watermarkType": ["stock"], "hasDuplicates": True}
    assert FC.parse_request({"nsfwFlagged": "true"}) == {"nsfwScoreMin": 0.5, "nsfwFlagged": True}
    assert "hasDuplicates" not in FC.parse_request({"hasDuplicates": "1"}, EngineConfig(has_duplicates=False))
    assert FC.toggle_quick({}, "failed") == {"status": ["failed"]} and FC.toggle_quick({"status": ["failed"]}, "failed") == {}
    assert FC.active_count({"tags": ["a"], "offset": 3, "query": "x"}) == 1 and FC.resolve_site("9", [1, 2], 1) == 1 and FC.resolve_site("2", [1, 2], 1) == 2


def test_cluster_order_keeps_siblings_together(make):
    c = make([{}] * 4, pairs=[(1, 3, None), (2, 4, None)])
    rows, total = FC.page(c, {"hasDuplicates": True})
    assert [r.id for r in rows.collect()] == [1, 3, 2, 4] and total.first().total == 4


def test_constraints(make, spark):
    c = make([{"altText": "x" * 501}, {}, {"altTextConfidence": D("0.5")}])
    good, bad = quarantine(c.analyses)
    assert good.count() == 2 and bad.first().reasons == ["altText longer than 500"]
    assert violations(c.analyses.unionByName(c.analyses), "analyses").count() == 3 and violations(c.analyses, "analyses").count() == 0

"""Search, duplicates, statistics, normalisation, merges, state, images, streams."""

from __future__ import annotations

import random
from datetime import datetime
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.config import EngineConfig, ErrorCode, options
from orrery.functions import image as I
from orrery.functions import labels as L
from orrery.functions import normalize as N
from orrery.functions.text import stem, tokenize
from orrery.graph import connected_components
from orrery.operators import bulk as B
from orrery.operators import duplicates as D
from orrery.operators import mutations as M
from orrery.operators import search_index as S
from orrery.queries import shared_save


@pytest.fixture(scope="module")
def save(spark):
    return shared_save(spark)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_tokens_and_stems(spark):
    assert one(spark, tokenize(F.lit("The Café-bar, the 2nd x CAFÉ!")).alias("t")).t == ["the", "café", "bar", "nd"]
    # Published sample pairs of the English stemmer.
    pairs = {"consistency": "consist", "consign": "consign", "knackeries": "knackeri", "knightly": "knight", "generate": "generat", "running": "run", "hopping": "hop", "happily": "happili", "flies": "fli", "dying": "die", "skies": "sky", "relational": "relat"}
    assert {w: stem(w, "en") for w in pairs} == pairs
    assert stem("Häuser", "de") == "haus" and stem("word", "xx") == "word"


def test_search(spark):
    rows = [(1, "altText", "A lighthouse on the coast"), (2, "altText", "Boats near lighthouses"), (3, "tag", "harbor")]
    f = spark.createDataFrame([(a, 100 + a, f, v, "en") for a, f, v in rows], "assetId long, analysisId long, field string, value string, language string")
    ix = S.postings(f)
    assert [r.assetId for r in S.search(ix, "lighthouse").orderBy("rank").collect()] == [1, 2]
    assert S.search(ix, "spaceship").count() == 0 and S.search(ix, "x").count() == 0
    assert {r.assetId for r in S.search(ix, "harb").collect()} == {3} and {r.assetId for r in S.search(ix, "harbar").collect()} == {3}
    gone = S.reindex(ix, ix.limit(0), gone=spark.createDataFrame([(3, "tag")], "assetId long, field string"))
    assert gone.where("assetId = 3").count() == 0 and gone.count() == ix.count() - 1
    more = ix.withColumn("tf", F.col("tf") + 1)
    before, after = ({r.assetId: r.score for r in S.bm25(x, S.match_tokens(x, {"boat": ["boat"]})).collect()} for x in (ix, more))
    assert after[2] > before[2] > 0


def test_hamming(spark):
    h = lambda a, b: one(spark, D.hamming_hex(F.lit(a), F.lit(b)).alias("d")).d
    assert h("0" * 64, "0" * 64) == 0 and h("0", "1") == 1 and h("3", "5") == 2 and h("0" * 64, "f" * 64) == 256
    with pytest.raises(Exception):
        h("00", "0")
    x = one(spark, D.hamming(D.hash_limbs(F.lit("0" * 63 + "f")), D.hash_limbs(F.lit("0" * 62 + "ff"))).alias("d"), D.similarity(F.lit(10)).alias("s"))
    assert x.d == 4 and x.s == Decimal("0.9609")


def test_banded_join_equals_naive(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(256) for _ in range(12)]
    made = [(i, format(b ^ sum(1 << rng.randrange(256) for _ in range(rng.randrange(14))), "064x")) for i, b in enumerate(base * 6)]
    h = spark.createDataFrame(made + [(900, made[0][1]), (901, made[0][1])], "assetId long, hash string").select("assetId", D.hash_limbs(F.col("hash")).alias("limbs"))
    key = lambda df: sorted((r.canonicalAssetId, r.duplicateAssetId, r.hammingDistance) for r in df.collect())
    got = key(D.hamming_pairs(h))
    assert got == key(D.hamming_pairs_naive(h, 10, 256)) and any(x[:2] == (900, 901) for x in got)
    thin = D.hamming_pairs(h, expand=False)
    assert thin.count() < len(got)
    parts = lambda df: {r.node: r.component for r in connected_components(df, shared_save(spark), src="canonicalAssetId", dst="duplicateAssetId").collect()}
    assert parts(thin) == parts(D.hamming_pairs(h))
    assert "NestedLoop" not in D.hamming_pairs(h)._jdf.queryExecution().executedPlan().toString()


def pairs_df(spark, edges):
    return spark.createDataFrame([(i, *sorted(e), None, None) for i, e in enumerate(edges)], "id long, canonicalAssetId long, duplicateAssetId long, clusterKey long, resolution string")


def test_clusters_merge_split_and_restamp(spark, save):
    p = D.cluster(pairs_df(spark, [(1, 2), (2, 3), (3, 4)]), save)
    assert {r.clusterKey for r in p.collect()} == {1}
    split = {r.id: r.clusterKey for r in D.resolve(p, 1, "kept", datetime(2024, 1, 1), save).collect()}
    assert split == {0: 1, 1: None, 2: 3}
    with pytest.raises(ValueError):
        D.resolve(p, 1, "no", None, save)
    tri = D.cluster(pairs_df(spark, [(1, 2), (2, 3), (1, 3)]), save)
    left = D.without_assets(tri, spark.createDataFrame([(1,)], "assetId long"), save).collect()
    assert [(r.canonicalAssetId, r.clusterKey) for r in left] == [(2, 2)]
    again = {r.id: r.clusterKey for r in D.cluster_around(p.unionByName(pairs_df(spark, [(10, 11)]).withColumn("id", F.lit(50).cast("long"))), spark.createDataFrame([(2,)], "assetId long"), save).collect()}
    assert again == {0: 1, 1: 1, 2: 1, 50: None}


def test_clusters_over_the_whole_pair_table(spark, sf):
    """The registered queries against brute force: pairs of every id get their key."""
    from pathlib import Path

    from orrery.catalog import test_catalog as catalog_of
    from orrery.queries import QUERIES

    sf = str(Path(sf).parent / "sf0.01")
    pairs = [r for r in catalog_of(spark, sf).duplicate_groups.collect() if r.resolution is None]
    deleted = {r.id for r in catalog_of(spark, sf).assets.select("id").collect() if r.id % 16 == 1}
    assert max(r.canonicalAssetId for r in pairs) >= 300

    def keys(rows):
        root = {}
        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for r in rows:
            a, b = sorted((find(r.canonicalAssetId), find(r.duplicateAssetId)))
            root[b] = a
        return {r.id: find(r.canonicalAssetId) for r in rows}

    want = {
        "dup_cluster_keys": pairs,
        "dup_resolve_splits": [r for r in pairs if r.id != 170],
        "dup_asset_deleted": [r for r in pairs if not {r.canonicalAssetId, r.duplicateAssetId} & deleted],
    }
    for name, rows in want.items():
        assert {r.id: r.clusterKey for r in QUERIES[name](spark, sf).collect()} == keys(rows), name


def test_file_sizes_round_halves_up(spark, sf):
    from orrery.catalog import test_catalog as catalog_of
    from orrery.queries import QUERIES

    want = {0: "0KB", 499: "0KB", 500: "1KB", 1500: "2KB", 2500: "3KB", 999_500: "1000KB", 1_000_000: "1MB", 1_050_000: "1.1MB", 1_150_000: "1.2MB", 1_250_000: "1.3MB", 1_949_999: "1.9MB", 1_950_000: "2MB", 12_345_678: "12.3MB"}
    df = spark.createDataFrame([(n,) for n in want], "n long")
    assert {r.n: r.t for r in df.select("n", L.file_size_text(F.col("n")).alias("t")).collect()} == want
    assert QUERIES["fmt_size"](spark, sf).count() == catalog_of(spark, sf).assets.count()


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(i, (i * 7 + 3) % 50) for i in range(50)], [(0, i) for i in range(1, 30)] + [(100, 101), (101, 101)], [(5, 5)]])
def test_components(spark, save, edges):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), save).collect()}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=3, max_size=3))
def test_bit_distance_is_a_metric(v):
    d = lambda a, b: bin(a ^ b).count("1")
    assert d(v[0], v[2]) <= d(v[0], v[1]) + d(v[1], v[2]) and d(v[0], v[0]) == 0


def test_normalisers(spark):
    text = '```json\n{"altText": "Tab\there", "suggestedTitle": "Haus", "nsfwScore": "x", "nsfwCategories": [{"category": "adult", "confidence": 0.2}, {"category": "hate", "confidence": 0.9}], "tags": [{"tag": " B "}, {"tag": "a", "confidence": 2}, {"tag": ""}], "watermarkType": "AI", "watermarkDetails": {"stockProvider": " Getty "}, "siteContent": {"de": {"suggestedTitle": "HAUS"}}, "extractedText": [" x ", "x", ""]}\n```'
    r = one(spark, N.parse_response(F.lit(text)).alias("r")).r
    assert (r.altText, r.suggestedTitle, r.nsfwScore, r.watermarkType, r.watermarkDetails.stockProvider) == ("Tabhere", "", 0.0, "unknown", "Getty")
    assert [(t.tag, t.confidence) for t in r.tags] == [("a", 1.0), ("b", 0.5)] and r.extractedText == ["x"] and not r.containsBrandLogo and r.focalPointX is None
    assert [c.category for c in r.nsfwCategories] == ["hate", "adult"]
    assert one(spark, N.parse_response(F.lit("no json")).alias("r")).r is None
    bad = F.from_json(F.lit('[{"category": "odd"}, {"category": "Hate"}]'), "array<struct<category: string, confidence: string>>")
    assert one(spark, N.unknown_categories(bad).alias("u")).u == ["odd"]
    key = "sk-" + "a" * 24
    assert one(spark, N.redact(F.lit(f"bad {key} at http://x/?key=abc&b=1")).alias("m")).m == "bad [REDACTED] at http://x/key=[REDACTED]&b=1"
    assert one(spark, N.error_code(F.lit(None).cast("int"), F.lit("Connection refused")).alias("c")).c == ErrorCode.CONNECTION_FAILED
    assert N.retry_delay(0) == 2 and N.retry_delay(1) == 4 and N.retry_delay(0, "99") == 30 and N.retry_delay(0, "soon") == 2
    assert one(spark, N.clean_text(F.lit(" ab "), 2).alias("t"), N.clean_int(F.lit("-4")).alias("i")) == ("ab", 0)


def test_labels(spark):
    r = one(spark, L.duration_text(F.lit(59)).alias("a"), L.duration_text(F.lit(120)).alias("b"), L.duration_text(F.lit(7260)).alias("c"), L.file_size_text(F.lit(1_250_000)).alias("d"), L.file_size_text(F.lit(2_000_000)).alias("e"), L.file_size_text(F.lit(999_400)).alias("f"),
            L.title_is_automatic(F.lit("my photo"), F.lit("my-photo_2026-03-31-145230_abcd.jpg")).alias("g"), L.title_is_automatic(F.lit("Other"), F.lit("my-photo.jpg")).alias("h"))
    assert tuple(r) == ("59s", "2m", "2h 1m", "1.3MB", "2MB", "999KB", True, False)
    checks = one(spark, L.readiness(F.lit(3_000_000), F.lit(5000), F.lit("a.TIF")).alias("c")).c
    assert [(c.status, c.verdict) for c in checks] == [("error", "Very large"), ("warning", "Oversized"), ("error", "Unsupported")]
    assert {o["value"] for o in options(ErrorCode)} >= {"timeout"} and not EngineConfig(pro=False).feature_available("duplicates")
    assert [x["severity"] for x in EngineConfig(volumes=(), has_quality=False).setup_problems("openai", None)] == ["critical", "critical", "warning"]


def test_merges(spark):
    old = spark.createDataFrame([(1, "mine", "ai", 2, 2), (2, "ai", "ai", 3, 2), (3, None, None, 0, None)], "assetId long, altText string, altTextAi string, faceCount int, faceCountAi int")
    new = spark.createDataFrame([(1, "n", 5), (2, "n", 5), (3, "", 5), (4, "n", 5)], "assetId long, altText string, faceCount int")
    got = {r.assetId: tuple(r)[1:] for r in M.dual_write(old, new).collect()}
    assert got == {1: ("mine", "n", 5, 5), 2: ("n", "n", 3, 5), 3: (None, None, 5, 5), 4: ("n", "n", 5, 5)}
    assert {r.assetId: r.altText for r in M.keyed_merge(old, new.select("assetId", "altText"), ["assetId"]).collect()} == {1: "n", 2: "n", 3: "", 4: "n"}
    reverted = M.revert_field(old.withColumn("id", F.col("assetId")), 1, "altText").where("assetId = 1").first().altText
    assert reverted == "ai" and M.edit_field(old.withColumn("id", F.col("assetId")), 2, "altText", "x").where("altText = 'x'").count() == 1
    content = spark.createDataFrame([(1, 2, "eigen"), (2, 2, "")], "analysisId long, siteId long, altText string")
    base = spark.createDataFrame([(1, "base"), (2, "base"), (3, "")], "id long, altText string")
    assert {r.analysisId: r.value for r in M.resolve_site_value(content, base, 2, "altText", 1).collect()} == {1: "eigen", 2: "base", 3: None}
    sites = spark.createDataFrame([(1, "en-US"), (2, "de-AT"), (3, "fr")], "siteId long, locale string")
    given_ = spark.createDataFrame([("de-DE", 0, "x"), ("de-at", 1, "y"), ("en", 2, "z")], "locale string, pos int, title string")
    assert {r.siteId: r.title for r in M.match_locale(given_, sites).collect()} == {1: "z", 2: "y"}


def test_stored_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(path)
    M.upsert_parquet(spark, path, spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_transitions(spark):
    cases = [("pending", "start", False, None, "processing"), ("processing", "succeed", False, None, "completed"), ("processing", "fail", True, None, "completed"), ("processing", "fail", False, None, "failed"), ("completed", "cancel", True, None, "completed"), ("pending", "cancel", False, "completed", "completed"), ("pending", "cancel", False, None, None), (None, "queue", False, None, "pending")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s string, e string, had boolean, prev string, want string")
    got = df.select("want", M.transition(F.col("s"), F.col("e"), F.col("had"), F.col("prev")).alias("g")).collect()
    assert all(r.want == r.g for r in got)


def test_sessions():
    s = B.Session(started=1000, initial_unprocessed=10)
    assert s.sample(5, 1010).last_rate == 0.5 and s.sample(5, 1010).sample(5, 2000).last_rate == 0.5
    assert B.determine_state(None, 0, 0, 0, 0)[0] == "ready" and B.determine_state(s, 1001, 1, 0, 0)[0] == "processing"
    state, done = B.determine_state(s, 1100, 0, 0, 0)
    assert state == "complete" and done.completed_at == 1100 and B.determine_state(done, 1399, 0, 0, 0)[0] == "complete"
    assert B.determine_state(done, 1400, 0, 0, 0)[0] == "ready" and B.determine_state(done, 1400, 0, 0, 2)[0] == "complete"
    assert B.transition_message("processing", "complete") and B.transition_message("ready", "ready") is None


def test_images(spark):
    rng = np.random.default_rng(0)
    sharp, flat = np.kron(rng.integers(0, 2, (30, 30)), np.ones((8, 8))).astype(float), np.full((240, 240), 0.4)
    assert I.sharpness(np.zeros((50, 200))) is None and I.sharpness(flat) == 0.0
    assert I.sharpness(sharp) > I.sharpness(I.gaussian(sharp, 2.0))
    assert I.compression_quality(b"x", "png") == 100 and I.compression_quality(b"RIFF0000WEBPVP8L", "webp") == 100 and I.compression_quality(b"RIFF0000WEBPVP8 ", "webp") is None
    assert I.color_profile(b"\0" * 60 + b"Adobe RGB", None) == "adobe-rgb" and I.color_profile(None, "CMYK") == "cmyk"
    assert I.trim_border(np.zeros((100, 50))).shape == (96, 48)
    df = spark.createDataFrame([(1, [0.0] * 200 + [9.0] * 56), (2, None)], "id int, v array<double>")
    assert {r.id: r.h for r in df.select("id", D.raster_hash("v", F.lit(16)).alias("h")).collect()} == {1: "0" * 50 + "f" * 14, 2: None}


def test_streams(spark, sf, tmp_path):
    from orrery.streaming import events as EV

    made = spark.createDataFrame([(1, "queue", 1), (1, "start", 2), (1, "succeed", 3), (2, "queue", 4), (2, "fail", 5)], "assetId long, event string, seq long")
    made.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))
    out = EV.run_to_memory(EV.stateful_status(stream), "statuses", "update")
    assert {r.assetId: r.status for r in out.collect()} == {1: "completed", 2: "failed"}
    table = {"df": spark.createDataFrame([(1, "pending", None, None)], "assetId long, status string, previousStatus string, processedAt timestamp")}
    q = EV.merge_stream(stream, lambda: table["df"], lambda df, n: table.update(df=df.sparkSession.createDataFrame(df.collect(), df.schema)), str(tmp_path / "ck"))
    q.awaitTermination()
    assert {r.assetId for r in table["df"].collect()} >= {1}


def test_logs(spark, tmp_path):
    from orrery.sources import logs as LG

    rows = spark.createDataFrame([(i, "error" if i % 2 else "info", "c", "m", None, "x" * 6000, datetime(2024, 1, 1 + i)) for i in range(10)], "id long, level string, category string, message string, assetId long, context string, dateCreated timestamp")
    LG.append_logs(rows, str(tmp_path / "logs"))
    logs = spark.read.parquet(str(tmp_path / "logs"))
    assert [r.id for r in LG.log_page(logs, 1, 2, level="error").collect()] == [9, 7] and LG.page_model(logs, 5, 2).first().asDict() == {"total": 10, "pages": 5, "first": 9, "last": 10}
    assert logs.agg(F.max(F.length("context"))).first()[0] == 5003 and LG.expired(logs, datetime(2024, 2, 5)).count() == 5


def test_entry_and_registry(spark, sf):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["doc_id", "lang", "score"] and out.count() == 20
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 200


def test_ingest_and_storage(spark, sf, tmp_path, save):
    from orrery import cli
    from orrery.catalog import Catalog
    from orrery.catalog import open_catalog
    from orrery.operators import ingest as G
    from orrery.plans import faceted as FC
    from orrery.schemas import _DDL, schema
    from orrery.sources.responses import parse_responses

    base = {n: spark.createDataFrame([], schema(n)) for n in _DDL}
    fill = lambda n, rows: spark.createDataFrame([tuple(r.get(f.name) for f in schema(n)) for r in rows], schema(n))
    day = datetime(2024, 1, 1)
    base["assets"] = fill("assets", [{"id": i, "volumeId": 1, "kind": "image", "filename": f"a{i}.jpg", "dateCreated": day} for i in (1, 2, 3)])
    h = "0" * 62
    base["analyses"] = fill("analyses", [{"id": 10 + i, "assetId": i, "status": "pending", "altText": "mine" if i == 1 else None, "altTextAi": "old" if i == 1 else None, "perceptualHash": h + x, "dateUpdated": day} for i, x in ((1, "00"), (2, "0f"))])
    base["asset_tags"] = fill("asset_tags", [{"assetId": 1, "analysisId": 11, "tag": "Mine", "tagNormalized": "mine", "confidence": Decimal(1), "isAi": False}, {"assetId": 1, "analysisId": 11, "tag": "Old", "tagNormalized": "old", "confidence": Decimal(1), "isAi": True}])
    base["analysis_content"] = fill("analysis_content", [{"analysisId": 11, "errorMessage": "m", "errorCode": "timeout"}])
    G.write_tables(base, str(tmp_path))
    text = '{"choices": [{"message": {"content": "{\\"altText\\": \\"boat on the lake\\", \\"tags\\": [{\\"tag\\": \\"Boat\\"}, {\\"tag\\": \\"mine\\"}]}"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 7}}'
    raw = spark.createDataFrame([(1, "openai", text), (3, "openai", text), (2, "openai", "{}")], "assetId long, provider string, response string")
    good, bad = parse_responses(raw)
    out = G.ingest(Catalog(spark, base), good, day)
    got = {r.assetId: (r.status, r.altText, r.altTextAi, r.inputTokens) for r in out["analyses"].collect()}
    assert got == {1: ("completed", "mine", "boat on the lake", 7), 2: ("pending", None, None, None), 3: ("completed", "boat on the lake", "boat on the lake", 7)}
    assert sorted((r.assetId, r.tagNormalized, r.isAi) for r in out["asset_tags"].collect()) == [(1, "boat", True), (1, "mine", False), (3, "boat", True), (3, "mine", True)]
    assert out["analysis_content"].count() == 0 and G.save_errors(out["analysis_content"], bad, out["analyses"]).first().errorCode == "invalid_response"
    G.write_tables(out, str(tmp_path))
    stored = open_catalog(spark, str(tmp_path))
    assert G.rebuild_index(stored, str(tmp_path)) > 0
    again = open_catalog(spark, str(tmp_path)).search_index
    assert [r.assetId for r in S.search(again, "boats").collect()] and again.where("assetId = 2").count() == 0
    cli.main([str(tmp_path), "scan-duplicates"])
    pair = open_catalog(spark, str(tmp_path)).duplicate_groups.collect()
    assert [(r.canonicalAssetId, r.duplicateAssetId, r.hammingDistance, r.clusterKey) for r in pair] == [(1, 2, 4, 1)]
    for command in ("stats", "volumes", "cleanup-stuck", "retry-failed"):
        cli.main([str(tmp_path), command])
    assert {r.status for r in open_catalog(spark, str(tmp_path)).analyses.collect()} == {"completed", "pending"}
    pairs = open_catalog(spark, str(tmp_path)).duplicate_groups
    hashes = lambda x: spark.createDataFrame([(1, "a"), (2, x)], "assetId long, hash string")
    assert G.rehash(pairs, hashes("b"), hashes("c"), pairs.limit(0).select("canonicalAssetId", "duplicateAssetId", "hammingDistance", "similarity"), save).count() == 0
    stored = open_catalog(spark, str(tmp_path))
    titled = G.apply_to_assets(stored.assets, stored.analyses, stored.assets.where("id = 3"), "alt")
    assert {r.id: r.alt for r in titled.collect()} == {1: None, 2: None, 3: "boat on the lake"}
    assert {x["section"] for x in FC.filter_registry({"tags": ["a"]})} == set(FC.SECTIONS) and FC.section_counts({"tags": ["a"]})["content"] == 1


def test_pairs_by_bands_and_by_blocks(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**32, (12, 2))
    rows = [(i, [int(v) for v in base[i % 12] ^ np.array([1 << int(rng.integers(32)) if rng.random() < 0.7 else 0, 1 << int(rng.integers(32)) if rng.random() < 0.5 else 0])]) for i in range(60)]
    h = spark.createDataFrame(rows, "assetId long, limbs array<long>")
    want = sorted((a, b, d) for a, x in rows for b, y in rows if a < b and (d := sum((p ^ q).bit_count() for p, q in zip(x, y))) <= 4)
    rep = D.representatives(h)
    for together in (1, 2, 3):
        got = {(r.a, r.b): r.hammingDistance for r in D._close_by_bands(rep, 4, 64, together).collect()}
        for block in (7, 1000):
            assert got == {(r.a, r.b): r.hammingDistance for r in D._close_by_blocks(rep, 4, rep.count(), block).collect()}
    assert sorted((r.canonicalAssetId, r.duplicateAssetId, r.hammingDistance) for r in D.hamming_pairs(h, 4, 64).collect()) == want
    count: dict = {}
    for a, b, _ in want:
        count[a], count[b] = count.get(a, 0) + 1, count.get(b, 0) + 1
    assert {r.assetId: r.n_pairs for r in D.close_counts(h, 4, 64).collect()} == count
    # Long hashes take one band, or two for very many; where a band has few bits, all pairs in blocks are less work.
    assert D.bands_together(10**6, 10, 256) == 1 and D.bands_together(10**9, 10, 256) == 2 and D.bands_together(10**4, 20, 64) == 0


def test_tables_are_replaced_together(spark, tmp_path):
    from orrery import catalog as CT

    folder, made = str(tmp_path), lambda *v: spark.createDataFrame([(x,) for x in v], "x long")
    read = lambda name: sorted(r.x for r in spark.read.parquet(f"{folder}/{CT.current_version(spark, folder)[1][name]}").collect())
    assert CT.current_version(spark, folder) == (0, {}) and CT.write_version({"a": made(1), "b": made(2)}, folder) == 1
    old = spark.read.parquet(f"{folder}/{CT.current_version(spark, folder)[1]['a']}")
    assert CT.write_version({"a": made(3, 4)}, folder) == 2
    # The other table stays, and a reader of the old version still reads.
    assert (read("a"), read("b")) == ([3, 4], [2]) and [r.x for r in old.collect()] == [1]
    # A table that can't be written leaves everything as it is, and so does a version that another has claimed.
    with pytest.raises(Exception, match="no such"):
        CT.write_version({"a": made(9), "b": made(5).select(F.raise_error(F.lit("no such")).alias("x"))}, folder)
    (tmp_path / "claim-3").touch()
    with pytest.raises(RuntimeError, match="another writer"):
        CT.write_version({"a": made(9)}, folder)
    assert (read("a"), read("b"), CT.current_version(spark, folder)[0]) == ([3, 4], [2], 2)
    (tmp_path / "claim-3").unlink()
    assert CT.write_version({"b": made(7)}, folder) == 3
    CT.remove_old_versions(spark, folder)
    assert (read("a"), read("b")) == ([3, 4], [7]) and len(list(tmp_path.glob("version=*"))) == 2

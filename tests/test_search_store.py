"""Stored structures of search against scans."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from orrery.operators import search_index as SIX
from orrery.operators import search_store as SS

ROW = "assetId long, field string, token string, tf int, fieldWeight decimal(3,2)"


def made(spark, seed: int, assets: int = 400):
    from decimal import Decimal

    rng = random.Random(seed)
    words = ["often"] * 8 + ["rare", "räre", "rar", "rarer", "oftne", "oft", "ab", "abc", "abcd", "abxd", "abdc", "𝒳yz", "über", "uber"]
    rows = [(a, f, w, rng.randrange(1, 4), Decimal(rng.choice(["1.00", "0.50", "2.00"]))) for a in range(assets) for f in ("title", "alt") for w in set(rng.sample(words, 4))]
    rows += [(7, "title", None, 1, Decimal("1.00"))]
    return spark.createDataFrame(rows, ROW)


def test_dictionary(spark, tmp_path):
    index = made(spark, 1)
    book = SS.Dictionary(spark, str(tmp_path / "d"))
    book.write(index)
    assert {r.token: r.df for r in book.tokens().collect()} == {r.token: r.n for r in index.where("token IS NOT NULL").groupBy("token").agg(F.countDistinct("assetId").alias("n")).collect()}
    tokens = [r.token for r in book.tokens().collect()]

    def far(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, left = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(left[j] + 1, row[j - 1] + 1, left[j - 1] + (x != y)))
        return row[-1]

    words = [*tokens, "rarre", "rere", "abcdd", "unheard", "ofte", "x", "", None]
    got = {(r.word, r.token) for r in book.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(w, t) for w in words if w and len(w) >= 4 for t in tokens if w[:2] == t[:2] and far(w, t) <= 1}
    for terms in (["often", "rarre", "ra", "zz", "abxx", "oftn"], ["über", "ube"], []):
        variants = SIX.expand(terms, [], stemmed=False)
        assert sorted(map(tuple, book.match(variants).collect())) == sorted(map(tuple, SIX.match_tokens(index.where("token IS NOT NULL"), variants).collect()))
    book.write(index.limit(0))
    assert book.match({"often": ["often"]}).collect() == [] and book.tokens().count() == 0
    plan = book.near()._jdf.queryExecution().toString() + book.near().where(F.col("less").isin(["rare"]))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(less" in plan or "EqualTo(less" in plan


def test_bounded_postings_are_exact_and_leave_blocks_out(spark, tmp_path):
    from decimal import Decimal

    one = Decimal("1.00")
    rows = [(a, "t", "often", 1 + a % 3, one) for a in range(4000)] + [(a, "t", "rare", 1, one) for a in range(100, 160)] + [(a, "u", "rare", 3, one) for a in range(120, 130)]
    index = spark.createDataFrame(rows, ROW)
    held = SS.BoundedPostings(spark, str(tmp_path / "p"), block=64)
    held.write(index)
    scores = SIX.bm25(index, spark.createDataFrame([("often", "often"), ("rare", "rare")], "term string, token string"))
    for k in (1, 10, 50, 60, 61, 5000):
        want = [(r.assetId, round(r.score, 8)) for r in SIX.top_k(scores, k).collect()]
        assert [(r.assetId, round(r.score, 8)) for r in held.search(["often", "rare"], k).collect()] == want
    assert held.read_for(["often", "rare"], 10).count() < 500 < held.read_for(["often", "rare"], 61).count()
    for seed in (3, 4):
        index = made(spark, seed)
        held.write(index)
        terms = ["often", "räre", "abcd", "nothing"]
        scores = SIX.bm25(index, spark.createDataFrame([(t, t) for t in terms], "term string, token string"))
        assert [(r.assetId, round(r.score, 8)) for r in held.search(terms, 25).collect()] == [(r.assetId, round(r.score, 8)) for r in SIX.top_k(scores, 25).collect()]
    assert held.search(["nothing"], 5).collect() == []


def test_substrings(spark, tmp_path):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("abAB ") for _ in range(rng.choice([0, 2, 3, 30])))) for i in range(300)] + [(1000, None), (1001, "Größe ÄÖ"), (1001, "another row"), (-5, "aab minus")]
    index = SS.SubstringIndex(spark, str(tmp_path / "s"), block=16)
    index.write(spark.createDataFrame(texts, "id long, text string"))
    for q in ("aba", "ab ba", "abab bbb", "zzz", "größe", "ÄÖ", "a", "", "bb aab minus"):
        want = sorted({i for i, t in texts if t is not None and all(w in t.lower() for w in q.lower().split())})
        assert sorted(r.id for r in index.search(q).collect()) == want, q
    assert index.candidates(["abab", "bbb"]).count() < 150 and index.candidates(["ab"]) is None


def test_index_segments(spark, tmp_path):
    index = made(spark, 6, 60)
    table = SS.IndexSegments(spark, str(tmp_path / "i"))
    table.start(index)
    state = {}
    for r in index.collect():
        state.setdefault((r.assetId, r.field), set()).add((r.token, r.tf))
    rng = random.Random(7)

    def same() -> bool:
        got = {}
        for r in table.read().collect():
            got.setdefault((r.assetId, r.field), set()).add((r.token, r.tf))
        return got == {k: v for k, v in state.items() if v}

    for number in range(1, 5):
        keys = rng.sample(sorted(state), 8)
        new = {k: {(f"n{number}", 1), ("often", 2)} for k in keys[:5]}
        gone = keys[5:]
        fresh = spark.createDataFrame([(*k, t, n, None) for k, v in new.items() for t, n in v], ROW)
        removed = spark.createDataFrame(gone, "assetId long, field string")
        if number == 3:  # a writer that ends after the postings leaves the index as it was
            table.postings.add(fresh, number)
            assert same()
            table.compact()
            assert same()
        assert table.update(fresh, number, removed) and not table.update(fresh, number)
        state |= new | {k: set() for k in gone}
        assert same()
        # Only rows of what changed are written.
        assert table.postings.spark.read.parquet(f"{table.postings.folder}/number={number}").count() == 10
    table.delete_assets(spark.createDataFrame([(3,), (4,), (999,)], "assetId long"), 5)
    state = {k: (set() if k[0] in (3, 4) else v) for k, v in state.items()}
    assert same()
    assert table.compact() and same() and not table.compact(share=0.5) and same()
    assert {(r.assetId, r.field) for r in table.read(["often"]).collect()} == {k for k, v in state.items() if any(t == "often" for t, _ in v)}

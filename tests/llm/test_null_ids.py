"""Groups of near duplicates that hold a row without an id."""

from __future__ import annotations


def test_a_null_id_keeps_one_named_document_of_its_group(spark, sf):
    import corpus_pipeline as cp
    from orrery.llm.jaccard_join import similarity_groups

    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (7, text), (3, text), (9, text + " tail"), (11, "all of this is another text"), (12, None), (None, "alone without an id")]
    rows += [(i, " ".join(f"own{i}x{j}" for j in range(9))) for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = cp.near_duplicates(spark, docs, sf).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in left) == [(False, 0), (False, 0), (True, 3), (True, 11), (True, 12), *((True, i) for i in range(100, 160))]
    got = similarity_groups(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and {r.component_id for r in got.where("doc_id in (3, 7, 9)").collect()} == {None}


def test_rows_of_one_id_are_judged_each(spark, sf):
    import corpus_pipeline as cp

    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    rows = [(3, a), (5, a), (5, b), (5, b), (6, a + " more"), (7, None), (7, ""), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id or 0, r.text or "") for r in cp.near_duplicates(spark, docs, sf).collect()))
    assert got == [(0, a), (3, a), (5, b), (5, b), (7, ""), (7, "")]


def test_all_stages_on_odd_rows(spark, sf):
    import corpus_pipeline as cp

    rows = [(None, "the house and the garden"), (1, "the house and the garden"), (1, "the house and the garden"), (2, None), (3, "x" * 100_000), (4, ""), (4, "some other words in a line of text")]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = docs
    for _, stage in cp.STAGES:
        out = stage(spark, out, sf)
        assert out.columns[:5] == docs.columns
    assert all(r.round_trip for r in out.collect())
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0

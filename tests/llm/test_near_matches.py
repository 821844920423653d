"""Proximity matches: what they hold, and that they don't depend on batches."""

from __future__ import annotations


def test_near_matches_do_not_depend_on_other_texts_of_the_slice(spark):
    from orrery.llm.decontaminate import find_contamination

    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet"
    copy = item.replace("echo", "other")  # one word replaced; no text holds the original
    common = " ".join(f"{w} {w}" for w in item.split() if w not in ("alpha", "golf", "juliet", "echo"))
    rows = [(1, "x y " + copy + " z"), (2, common), (3, "alpha bravo"), (4, "golf hotel india juliet"), (5, None), (6, item)]
    bench = spark.createDataFrame([("q", item), ("short", "nowhere"), (None, item)], "item_id string, text string")
    # (1) holds the rarest terms alpha, golf and juliet at their places.
    without = spark.createDataFrame(rows[:5], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in find_contamination(without, bench).collect()}
    assert got[1].items == [] and got[1].spans == [] and got[1].n_near == 1
    assert [tuple(m) for m in got[1].near] == [(None, 2, 12), ("q", 2, 12)]
    # Nothing is found over the border of two texts.
    assert all(not got[i].near and got[i].n_near == 0 for i in (2, 3, 4, 5))
    # The same however texts are batched, and with blocks of any size.
    key = lambda df, **kw: sorted((r.doc_id, r.n_near, [tuple(m) for m in r.near]) for r in find_contamination(df, bench, **kw).collect())
    assert key(without) == key(without.repartition(5, "doc_id"))
    assert key(without) == key(without, block_bytes=1)
    exact = {r.doc_id: r for r in find_contamination(spark.createDataFrame([rows[5], (7, "u v")], "doc_id long, text string"), bench).collect()}
    assert exact[6].items == ["q"] and [tuple(m) for m in exact[6].near] == [(None, 0, 10), ("q", 0, 10)] and exact[7].near == []


def test_near_matches_are_a_query(spark, sf):
    from orrery.llm.queries import QUERIES

    out = QUERIES["op7_near_matches"](spark, sf)
    assert out.columns == ["doc_id", "n_near", "near"]
    hit = {r.doc_id for r in QUERIES["op7_benchmark_decontamination"](spark, sf).where("contaminated").collect()}
    assert hit and hit <= {r.doc_id for r in out.where("size(near) > 0").collect()}

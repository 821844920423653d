"""The positional index against brute force, and bounded expansion of frequent terms."""

from __future__ import annotations

import collections
import random
import tracemalloc

import numpy as np
import pytest


def near_by_brute_force(texts: dict, items: list, width: int, slop: int) -> dict:
    words = {i: (t or "").split() for i, t in texts.items()}
    count = collections.Counter(w for own in words.values() for w in own)
    out = {i: (0, set()) for i in texts}
    windows = {}
    for name, t in items:
        w = t.split()
        for j in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[j : j + width]), set()).add(name)
    for window, names in windows.items():
        held = sorted((count[w], k) for k, w in enumerate(window) if count[w])
        if len(held) < min(3, len(window)):
            continue
        rare = [k for _, k in held[:3]]
        for i, own in words.items():
            for at in range(len(own)):
                if own[at] == window[rare[0]] and all(window[k] in own[max(0, at + k - rare[0] - slop) : max(0, at + k - rare[0] + slop + 1)] for k in rare[1:]):
                    s = at - rare[0]
                    out[i][1].update((n, max(0, s), min(len(own), s + len(window))) for n in names)
                    out[i] = (out[i][0] + 1, out[i][1])
    merged = {}
    for i, (n, ranges) in out.items():
        rows = []
        for name, s, e in sorted(ranges):
            if rows and rows[-1][0] == name and s <= rows[-1][2]:
                rows[-1] = (name, rows[-1][1], max(e, rows[-1][2]))
            else:
                rows.append((name, s, e))
        merged[i] = (n, rows)
    return merged


@pytest.mark.parametrize("block", [1, 300, 1 << 20])
def test_proximity_by_brute_force(spark, block):
    from orrery.llm.decontaminate import find_contamination

    rng = random.Random(block)
    words = [f"w{i}" for i in range(25)]
    texts = {i: " ".join(rng.choices(words, k=rng.randrange(0, 60))) for i in range(30)}
    items = [(f"i{k}", " ".join(rng.choices([*words, "unheard"], k=n))) for k, n in enumerate([1, 2, 5, 12, 30])]
    docs, bench = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: (r.n_near, [tuple(m) for m in r.near]) for r in find_contamination(docs, bench, width=4, block_bytes=block).collect()}
    assert got == near_by_brute_force(texts, items, 4, 2) and any(n for n, _ in got.values())


def test_repeated_rows_and_null_ids(spark):
    from orrery.llm.decontaminate import clean_documents, find_contamination

    item = " ".join(f"b{i}" for i in range(12))
    rows = [(1, item), (1, item), (1, "clean text"), (None, "x " + item), (None, None), (2, item), (2, "")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, mark string").repartition(3)
    bench = spark.createDataFrame([("q", item), ("q", item), (None, None)], "item_id string, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.items, [tuple(s) for s in r.spans]) for r in find_contamination(docs, bench, block_bytes=1).collect())
    hit = ["q"], [(0, 12)]
    assert got == [(False, 1, 2, [], []), (False, 1, 12, *hit), (False, 1, 12, *hit), (False, 2, 0, [], []), (False, 2, 12, *hit), (True, 0, 0, [], []), (True, 0, 13, ["q"], [(1, 13)])]
    for few in (10, 0):
        left = clean_documents(docs, bench, few=few)
        assert left.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, ""), (1, "clean text"), (2, "")]


def test_frequent_words_take_bounded_memory():
    from orrery.llm import textcore as T
    from orrery.llm.decontaminate import Postings, by_term, lower_words, pack_places

    rng = np.random.default_rng(3)
    text = " ".join(f"w{i}" for i in rng.integers(0, 12, 150_000)).encode()
    item = [f"w{i}" for i in rng.integers(0, 12, 809)]
    _, w, h = lower_words([text])
    order = by_term(h)
    s = h[order]
    heads = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    counts = np.diff(np.append(heads, len(s))).astype(np.uint32)
    own = lower_words([" ".join(item).encode()])[2]
    wanted = np.unique(own)
    terms = np.searchsorted(wanted, np.lib.stride_tricks.sliding_window_view(own, 10))
    tracemalloc.start()
    p = Postings(s[heads].tobytes(), counts.tobytes(), pack_places(order, heads), w.first, wanted)
    found = p.ranges(p.phrases(terms, np.full(len(terms), 10)), np.full(len(terms), 10))
    near = p.ranges(p.near(terms, np.tile([0, 4, 8], (len(terms), 1)), 2), np.full(len(terms), 10))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(terms) == 800 and peak < 500e6 and near[2].sum() > 1_000_000 and len(found) == 6
    assert T.find_words(T.join_texts([text])).counts[0] == 150_000


def test_terms_that_share_upper_bits_keep_their_order():
    from orrery.llm.decontaminate import by_term

    rng = np.random.default_rng(0)
    h = rng.choice(np.array([5, 6, 7, 1 << 60, (1 << 60) + 3], np.uint64), 1000)
    assert by_term(h).tolist() == np.argsort(h, kind="stable").tolist() and by_term(h[:0]).tolist() == []

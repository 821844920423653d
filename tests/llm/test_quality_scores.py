"""Scores and threshold of the quality rules by brute force."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
import pytest

BUCKETS = 1 << 12


def buckets(text: str | None, known: dict) -> list[int]:
    """Buckets of a text's words and word pairs, by the operator's own hash of each; `known` maps words to hashes."""
    from orrery.llm import textcore as T
    from orrery.llm.quality import _PAIR

    words = (text or "").split()
    for w in set(words) - known.keys():
        t = T.join_texts([w.encode()])
        known[w] = T.range_hashes(t.buf, t.starts, t.ends)[0]
    h = np.array([known[w] for w in words], np.uint64)
    own = [T.mix(h), T.mix(h[:-1] * _PAIR + h[1:])] if len(h) else [h, h]
    return (np.concatenate(own) % np.uint64(BUCKETS)).tolist()


@pytest.mark.parametrize("repeated", [False, True])
def test_scores_and_threshold(spark, repeated):
    from orrery.llm.quality import apply_rules, fit_quality

    rng = random.Random(9)
    good, bad = [f"fine{i}" for i in range(60)], [f"junk{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(good if i % 2 else bad, k=rng.randrange(1, 60)) + rng.choices(good + bad, k=12))) for i in range(120)] + [(None, "fine1 junk1 " * 12), (200, None), (201, "")]
    if repeated:
        rows += [(1, " ".join(rng.choices(bad, k=40))), (3, rows[3][1]), (3, rows[3][1])]
    labels = [(i, i % 2, 0) for i in range(60)] + [(4, 1, 0), (None, 1, 0), (500, 1, 0)]
    df = spark.createDataFrame([(*r, 0.0, True) for r in rows], "doc_id long, text string, score double, kept boolean").repartition(3)
    model = fit_quality(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), buckets=BUCKETS)

    known: dict = {}
    trusted = {i for i, q, _ in labels if q and i is not None}
    raw, target = collections.Counter(), collections.Counter()
    for i, t in rows:
        raw.update(buckets(t, known))
        if i in trusted:
            target.update(buckets(t, known))
    n_raw, n_target = sum(raw.values()) + BUCKETS, sum(target.values()) + BUCKETS
    ratio = lambda b: math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw)
    score = lambda t: sum(map(ratio, own)) / len(own) if (own := buckets(t, known)) else 0.0

    def failed(t: str | None) -> bool:
        w = (t or "").split()
        c = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        again = {k for j in range(len(w) - 7) if c[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
        return len(w) < 20 or 100 * len(again) > 30 * len(w)

    by_label = {1: {}, 0: {}}
    for i, t in rows:
        if i is not None and i < 60 and not failed(t):
            kind = int(i in trusted)
            by_label[kind][i] = min(by_label[kind].get(i, math.inf), score(t))
    best = max(((sum(s >= e for s in by_label[1].values()) / len(by_label[1]) - sum(s >= e for s in by_label[0].values()) / len(by_label[0])), e) for e in sorted({*by_label[1].values(), *by_label[0].values()}))
    edges = sorted({*by_label[1].values(), *by_label[0].values()})
    least = min(e for e in edges if round(sum(s >= e for s in by_label[1].values()) / len(by_label[1]) - sum(s >= e for s in by_label[0].values()) / len(by_label[0]), 12) == round(best[0], 12))
    k = edges.index(least)
    assert model.threshold == pytest.approx((edges[k] + edges[k - 1]) / 2 if k else edges[0] - 0.1, abs=1e-8)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "", r.score, r.kept) for r in apply_rules(df, model).collect()), key=str)
    want = sorted(((i is not None, i or 0, t or "", score(t), not failed(t) and score(t) >= model.threshold) for i, t in rows), key=str)
    assert len(got) == len(rows)
    for a, b in zip(sorted(got, key=lambda r: r[:3]), sorted(want, key=lambda r: r[:3]), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-8) and a[4] == b[4]
    assert any(r[4] for r in want) and any(not r[4] and r[0] and not failed(r[2]) for r in want)

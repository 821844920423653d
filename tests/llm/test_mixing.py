"""Shares, quotas by ranking every quotient, and spans of the mix."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from orrery.llm.mixing import apportion, mix_sources, mixed_texts, source_targets, taken_words


def shares(sizes: dict, weights=(3, 1, 2), most: int = 2) -> dict:
    """Handing out and taking back what is above the limit, until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        each = rest / sum(weight[s] for s in free)
        above = {s for s in free if each * weight[s] > most * sizes[s]}
        if not above:
            return out | {s: each * weight[s] for s in free}
        out |= {s: float(most * sizes[s]) for s in above}
        rest, free = rest - sum(most * sizes[s] for s in above), free - above


def test_targets(spark):
    rng = random.Random(1)
    for n in (1, 2, 7, 40):
        sizes = {None if i == 3 else f"s{i}": rng.choice([0, 5, 100, 10_000, rng.randrange(10**6)]) + (i == 0) for i in range(n)}
        out, total = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (3, 1, 2), (3, 2), 2)
        want = shares(sizes)
        assert total == sum(sizes.values())
        for r in out.collect():
            assert abs(r.target - want[r.source]) <= 1e-9 * max(1, want[r.source]) and r.target <= 2 * r.source_size


def test_quotas_are_those_of_all_quotients_ranked(spark):
    rng = random.Random(2)
    cells, want = [], {}
    for g in ("a", "b", None, "many"):
        own = [(g, i, rng.choice([0, 1, 7, 7, 500, rng.randrange(10**5)])) for i in range(60 if g == "many" else 5)]
        room = {i: rng.randrange(3, 40) for _, i, _ in own}
        seats = sum(room.values()) // 2
        quotients = sorted(((-v / (2 * k + 1), i, k) for _, i, v in own for k in range(room[i]) if v), key=lambda q: q)
        won = Counter(i for _, i, _ in quotients[:seats])
        want |= {(g, i): won[i] for _, i, _ in own}
        cells += [(g, i, v, 10**6, seats) for _, i, v in own]
        # without a limit the right divisor lies between the two that are tried
        quotients = sorted((-v / (2 * k + 1), i, k) for _, i, v in own for k in range(seats + 1) if v)
        free = Counter(i for _, i, _ in quotients[:seats])
        want |= {(g, i): free[i] for _, i, _ in own}
    df = spark.createDataFrame(cells, "g string, i long, v long, room long, seats long")
    out = apportion(df, ["g"], ["i"], "seats", "v", "room")
    assert {(r.g, r.i): r.quota for r in out.collect()} == want


def made(n: int) -> list[tuple]:
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(rng.choice([0, 1, 30, 200, 900]))), rng.choice(["hot"] * 5 + ["ä", "b", "c", None])) for i in range(n)]
    rows += [(None, None, "b"), (None, "", "b"), (5, None, None), (n + 1, " \t\r\n", "empty"), (n + 2, "no break one", "c")]
    return rows + [(9999, "the same row again and again", "hot")] * 300


def test_whole_mix(spark):
    rows = made(200)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("extra")).withColumn("target", F.lit(1))
    mix = mix_sources(df.repartition(5), block_words=16, shard_words=4000)
    out = mix.withColumn("taken", taken_words()).collect()
    size = {}
    for _, text, source in rows:
        size[source] = size.get(source, 0) + len((text or "").replace("\r", " ").split(" ") if text and text.strip(" \t\r\n") else [])
    assert len(out) == len(rows) and Counter(r.source for r in out) == Counter(r[2] for r in rows)
    want, taken = shares(size), defaultdict(int)
    for r in out:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert all(0 <= s["from"] < s["upto"] <= r.size for s in r.spans)
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 16 * (2 + size[s] / 4000), (s, taken[s], t)
    # The same rows in another order give the same mix.
    again = mix_sources(df.orderBy(F.rand(4)).repartition(2), block_words=16, shard_words=4000).withColumn("taken", taken_words())
    assert Counter(map(str, again.collect())) == Counter(map(str, out))
    # Texts of the mix have the words that are counted, in the order of their document.
    texts = mixed_texts(df, mix).collect()
    words = Counter()
    for r in texts:
        words[r.doc_id] += len(r.text.split(" "))
    counted = Counter()
    for r in out:
        counted[r.doc_id] += r.taken
    assert words == Counter({k: v for k, v in counted.items() if v})
    whole = {i: t for i, t, _ in rows if t}
    assert all(r.text in whole[r.doc_id] for r in texts if r.doc_id is not None and r.doc_id < 200)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(empty).collect() == []
    none = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.size, r.target, r.passes, r.spans) for r in mix_sources(none).collect()) == [(1, 0, 0.0, 0, []), (2, 0, 0.0, 0, [])]

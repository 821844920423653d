"""Clusters kept up to date by edits against clusters found anew."""

from __future__ import annotations

import random
import tempfile

import pytest

from orrery.graph import connected_components
from orrery.operators import duplicates as D
from orrery.storage import store

PAIR = "id long, canonicalAssetId long, duplicateAssetId long, resolution string, clusterKey long"


def keys_of(rows: dict) -> dict:
    """The smallest asset of each unresolved pair's component."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b, resolution, _ in rows.values():
        if resolution is None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(a) if r is None else None for i, (a, _, r, _) in rows.items()}


def frame(spark, rows: dict):
    return spark.createDataFrame([(i, *v) for i, v in rows.items()], PAIR)


@pytest.fixture()
def save(spark):
    return lambda df: store(spark, df, "test")


def test_one_seeded_end_joins_two_stored_clusters(spark, save):
    rows = {1: (1, 2, None, 1), 2: (3, 4, None, 3), 3: (2, 3, None, None), 4: (8, 9, None, 8)}
    for seed in (2, 3):
        seeds = spark.createDataFrame([(seed,)], "assetId long")
        assert {r.id: r.clusterKey for r in D.cluster_around(frame(spark, rows), seeds, save).collect()} == {1: 1, 2: 1, 3: 1, 4: 8}
        changed = {r.id for r in D.recluster(frame(spark, rows), seeds, save).collect()}
        assert changed == {2, 3}  # rows of other clusters, and those that keep their key, are not written


def test_chain_of_many_clusters_and_pairs_that_no_seed_reaches(spark, save):
    rows = {i: (10 * i + 1, 10 * i + 2, None, 10 * i + 1) for i in range(6)}
    rows |= {100 + i: (10 * i + 2, 10 * i + 11, None, None) for i in range(4)} | {200: (900, 901, None, None)}
    out = {r.id: r.clusterKey for r in D.cluster_around(frame(spark, rows), spark.createDataFrame([(2,)], "assetId long"), save).collect()}
    assert out == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 51, 100: 1, 101: 1, 102: 1, 103: 1, 200: None}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_edits_equal_a_recompute(spark, save, seed):
    rng = random.Random(seed)
    rows: dict = {}
    for i in range(60):
        a, b = sorted(rng.sample(range(70), 2))
        rows[i] = (a, b, None, None)
    rows = {i: (*v[:3], k) for (i, v), k in zip(rows.items(), keys_of(rows).values(), strict=True)}
    for step in range(2):
        seeds = set()
        for i in rng.sample(sorted(rows), 6):  # resolved or removed
            a, b, r, k = rows[i]
            seeds |= {a, b}
            if rng.random() < 0.5:
                rows[i] = (a, b, "ignored", k)
            else:
                del rows[i]
        for i in range(8):  # new, with a seed at either end
            a, b = sorted(rng.sample(range(90), 2))
            rows[1000 * (step + 1) + i] = (a, b, None, None)
            seeds.add(rng.choice((a, b)))
        out = D.cluster_around(frame(spark, rows), spark.createDataFrame([(s,) for s in seeds], "assetId long"), save)
        got = {r.id: r.clusterKey for r in out.collect()}
        assert got == keys_of(rows)
        rows = {i: (*rows[i][:3], k) for i, k in got.items()}
    gone = set(rng.sample(range(70), 5))
    left = {i: v for i, v in rows.items() if not gone & set(v[:2])}
    out = D.without_assets(frame(spark, rows), spark.createDataFrame([(g,) for g in gone], "assetId long"), save)
    assert {r.id: r.clusterKey for r in out.collect()} == keys_of(left)
    one = next(i for i, v in rows.items() if v[2] is None)
    out = D.resolve(frame(spark, rows), one, "ignored", None, save)
    assert {r.id: r.clusterKey for r in out.select("id", "clusterKey").collect()} == keys_of(rows | {one: (*rows[one][:2], "ignored", None)})


def test_rows_of_a_hub_are_split(spark):
    """Most edges at one node: the join that gives each row its node's least neighbour is split by Spark."""
    from orrery.graph import _with_least

    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        path = tempfile.mkdtemp(prefix="hub-")
        spark.range(400_000).selectExpr("if(id % 5 < 4, 7, id) AS a", "id AS b").repartition(12).write.mode("overwrite").parquet(path)
        out = _with_least(spark.read.parquet(path))
        assert out.agg({"m": "sum"}).first()[0] is not None
        joined = _with_least(spark.read.parquet(path))
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_components_of_a_star_and_a_path(spark, save):
    edges = [(0, i) for i in range(1, 500)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), save).collect()}
    assert all(got[i] == 0 for i in range(500)) and all(got[1000 + i] == 1000 for i in range(61))

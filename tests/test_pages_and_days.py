"""Pages by key equal the full sort and read what they show; retention drops days and writes only the one of the limit."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F


@pytest.fixture
def folder(spark):
    return f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/days-{uuid.uuid4().hex}"


def rows(spark, n):
    """A third of the rows ties in the first key, some in the second too."""
    return spark.range(n, numPartitions=3).select(F.when(F.col("id") % 3 == 0, F.lit(float("inf"))).otherwise(-(F.col("id") * 37 % 101).cast("double")).alias("k1"), (F.col("id") % 5).cast("double").alias("k2"), "id", F.concat(F.lit("v"), F.col("id") % 7).alias("v"))


def walk(kept, limit, where=None):
    from orrery.plans.keyset import key_of, token_of

    got, after = [], None
    while True:
        page = kept.page(limit, after, where).collect()
        if not page:
            return got
        got += page
        after = key_of(token_of(kept.keys, page[-1]))


def test_pages_joined_are_the_full_sort(spark, folder):
    from orrery.plans.keyset import OrderedPages

    df = rows(spark, 600)
    kept = OrderedPages(spark, folder, ["k1", "k2", "id"]).write(df, 9)
    assert kept.directory().count() > 4 and kept.total() == 600
    want = df.orderBy("k1", "k2", "id").collect()
    assert [tuple(r) for r in walk(kept, 130)] == [tuple(r) for r in want]
    some = F.col("v") == "v3"
    assert [r.id for r in walk(kept, 30, some)] == [r.id for r in want if r.v == "v3"]
    assert kept.page(5, where=F.col("v") == "none").collect() == []
    for offset in (0, 1, 255, 597, 600, 10_000):
        assert [r.id for r in kept.at(offset, 40).collect()] == [r.id for r in want[offset : offset + 40]]


def test_a_page_reads_its_blocks_and_the_key_reaches_the_files(spark, folder):
    from orrery.plans.keyset import OrderedPages

    kept = OrderedPages(spark, folder, ["k1", "k2", "id"]).write(rows(spark, 600), 12)
    blocks = kept.directory().count()
    deep = kept.at(400, 10)
    assert len(deep.inputFiles()) <= 2 < blocks
    last = deep.collect()[-1]
    following = kept.page(10, [last.k1, last.k2, last.id])
    assert len(following.inputFiles()) <= 2
    plan = following._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k1" in plan.split("PushedFilters")[1]


def test_a_directory_of_several_parts(spark, folder, monkeypatch):
    from orrery.plans import keyset

    monkeypatch.setattr(keyset, "_FAN", 2)
    df = rows(spark, 200)
    kept = keyset.OrderedPages(spark, folder, ["k1", "k2", "id"]).write(df, 9)
    want = [r.id for r in df.orderBy("k1", "k2", "id").collect()]
    for offset, limit in ((0, 200), (30, 100), (95, 3), (150, 500), (199, 1), (200, 1)):
        assert [r.id for r in kept.at(offset, limit).collect()] == want[offset : offset + limit]


def test_empty_table(spark, folder):
    from orrery.plans.keyset import OrderedPages

    kept = OrderedPages(spark, folder, ["k1", "k2", "id"]).write(rows(spark, 0), 4)
    assert (kept.total(), kept.page(5).collect(), kept.at(0, 5).collect(), kept.page(5, [0.0, 0.0, 0]).collect()) == (0, [], [], [])


def logs(spark, ids, start=datetime(2024, 1, 1)):
    made = [(i, "info", "c", "m", start + timedelta(hours=7 * i)) for i in ids]
    return spark.createDataFrame(made, "id long, level string, category string, message string, dateCreated timestamp")


def stamps(folder):
    return {p: p.stat().st_mtime_ns for p in Path(folder).glob("version=*/**/*.parquet") if p.is_file()}


def test_retention_writes_only_the_day_of_the_limit(spark, folder):
    from orrery import catalog as CT
    from orrery.sources import logs as LG

    Path(folder).mkdir()
    LG.append_days(logs(spark, range(0, 20)), folder)
    LG.append_days(logs(spark, range(20, 40)), folder)
    before, now = stamps(folder), datetime(2024, 1, 20, 12)
    version = LG.drop_expired(spark, folder, now, days=13)
    limit = now - timedelta(days=13)
    kept = {i for i in range(40) if datetime(2024, 1, 1) + timedelta(hours=7 * i) >= limit}
    assert version == 3 and {r.id for r in LG.read_days(spark, folder).collect()} == kept
    new = [p for p in stamps(folder) if p not in before]
    assert {p.parent.name for p in new} == {"day=2024-01-07"}
    assert {p: t for p, t in stamps(folder).items() if p in before} == before
    assert LG.drop_expired(spark, folder, now, days=13) == version  # nothing has expired since
    days = CT.current_version(spark, folder)[1]["logs"]
    assert min(days) == "2024-01-07" and all(d >= "2024-01-07" for d in days)
    CT.remove_old_versions(spark, folder, lease=0)
    left = {p.parent.name for p in stamps(folder)}
    assert left == {f"day={d}" for d in days} and {r.id for r in LG.read_days(spark, folder).collect()} == kept


def test_a_limit_at_midnight_writes_nothing(spark, folder):
    from orrery.sources import logs as LG

    Path(folder).mkdir()
    LG.append_days(logs(spark, range(40)), folder)
    before = stamps(folder)
    LG.drop_expired(spark, folder, datetime(2024, 1, 20), days=13)
    assert stamps(folder) == before and min(r.dateCreated for r in LG.read_days(spark, folder).collect()) >= datetime(2024, 1, 7)


def test_rows_that_come_meanwhile_stay_and_readers_keep_their_days(spark, folder, monkeypatch):
    from orrery import catalog as CT
    from orrery.sources import logs as LG

    Path(folder).mkdir()
    LG.append_days(logs(spark, range(40)), folder)
    _, pin = CT.pin(spark, folder)
    old = LG.read_days(spark, folder)
    commit, first = CT.commit, []

    def slow(*args):
        if not first:
            first.append(1)
            LG.append_days(logs(spark, [100, 101], datetime(2023, 12, 1)).unionByName(logs(spark, [22])), folder)
        return commit(*args)

    monkeypatch.setattr(CT, "commit", slow)
    LG.drop_expired(spark, folder, datetime(2024, 1, 20, 12), days=13)
    got = sorted(r.id for r in LG.read_days(spark, folder).collect())
    assert got == sorted([i for i in range(40) if 7 * i >= 6 * 24 + 12] + [22, 100, 101])
    CT.remove_old_versions(spark, folder, lease=0)
    assert old.count() == 40
    CT.unpin(spark, folder, pin)
    monkeypatch.setattr(CT, "commit", commit)
    LG.drop_expired(spark, folder, datetime(2024, 1, 20, 12), days=13)
    assert {100, 101}.isdisjoint(r.id for r in LG.read_days(spark, folder).collect())


def test_a_log_that_was_stored_as_a_whole_goes_into_days(spark, folder):
    from orrery import catalog as CT
    from orrery.sources import logs as LG

    logs(spark, range(40)).write.parquet(f"{folder}/logs.parquet")
    LG.append_days(logs(spark, [40]), folder)
    assert LG.read_days(spark, folder).count() == 41
    LG.drop_expired(spark, folder, datetime(2024, 1, 20, 12), days=13)
    assert LG.WHOLE not in CT.current_version(spark, folder)[1]["logs"]
    assert {r.id for r in LG.read_days(spark, folder).collect()} == {i for i in range(41) if 7 * i >= 6 * 24 + 12}

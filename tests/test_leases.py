"""Writers that end at any point, two writers, and readers of old versions."""

from __future__ import annotations

import threading

import pytest

from orrery import catalog as CT


def rows(spark, *v):
    return spark.createDataFrame([(x,) for x in v], "x long")


def read(spark, folder: str, name: str) -> list[int]:
    return sorted(r.x for r in spark.read.parquet(f"{folder}/{CT.current_version(spark, folder)[1][name]}").collect())


@pytest.mark.parametrize("step", ["_claim", "after_claim", "_move", "after_move"])
def test_a_writer_that_ends_at_any_step_blocks_nobody_for_longer_than_its_lease(spark, tmp_path, monkeypatch, step):
    folder = str(tmp_path)
    CT.write_version({"a": rows(spark, 1)}, folder)
    real = {"_claim": CT._claim, "_move": CT._move}

    def dies(*_args, **_kw):
        if step.startswith("after"):
            real[step.removeprefix("after")](*_args)
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(CT, step.removeprefix("after"), dies)
        with pytest.raises(KeyboardInterrupt):
            CT.write_version({"a": rows(spark, 2)}, folder)
    landed = step == "after_move"
    assert read(spark, folder, "a") == ([2] if landed else [1])
    if step in ("after_claim", "_move"):  # its claim holds for its lease, and no longer
        with pytest.raises(RuntimeError, match="another writer"):
            CT.write_version({"a": rows(spark, 3)}, folder)
    assert CT.write_version({"a": rows(spark, 3)}, folder, lease=0) == 2 + landed and read(spark, folder, "a") == [3]
    CT.remove_old_versions(spark, folder, lease=0)
    assert read(spark, folder, "a") == [3] and len(list(tmp_path.glob("version=*"))) == 1 and not list(tmp_path.glob("claim-*")) and not list(tmp_path.glob("writing-*"))


def test_a_slow_writer_whose_claim_was_taken_over_fails_at_the_fence(spark, tmp_path, monkeypatch):
    folder, real = str(tmp_path), CT._move
    CT.write_version({"a": rows(spark, 1)}, folder)

    def slow(*args):
        monkeypatch.setattr(CT, "_move", real)
        assert CT.write_version({"a": rows(spark, 5)}, folder, lease=0) == 2  # another comes in between
        return real(*args)

    monkeypatch.setattr(CT, "_move", slow)
    with pytest.raises(RuntimeError, match="tables of this one"):
        CT.write_version({"a": rows(spark, 2)}, folder)
    assert read(spark, folder, "a") == [5] and CT.current_version(spark, folder)[0] == 2


def test_writers_of_different_tables_come_on_top_of_each_other(spark, tmp_path, monkeypatch):
    folder, real = str(tmp_path), CT._claim
    CT.write_version({"a": rows(spark, 1), "b": rows(spark, 1)}, folder)

    def late(*args):
        monkeypatch.setattr(CT, "_claim", real)
        assert CT.write_version({"b": rows(spark, 7)}, folder) == 2
        return real(*args)

    monkeypatch.setattr(CT, "_claim", late)
    assert CT.write_version({"a": rows(spark, 8)}, folder) == 3
    assert read(spark, folder, "a") == [8] and read(spark, folder, "b") == [7]
    results = []

    def write(name: str, value: int) -> None:
        try:
            results.append(CT.write_version({name: rows(spark, value)}, folder))
        except RuntimeError:
            results.append(None)

    both = [threading.Thread(target=write, args=x) for x in (("a", 20), ("b", 30))]
    for t in both:
        t.start()
    for t in both:
        t.join()
    won = [r for r in results if r]
    assert won and len(set(won)) == len(won) and CT.current_version(spark, folder)[0] == max(won)


def test_pinned_versions_stay(spark, tmp_path):
    folder = str(tmp_path)
    CT.write_version({"logs": rows(spark, 1).selectExpr("x AS id")}, folder)
    catalog, name = CT.pin(spark, folder)
    for i in (2, 3):
        CT.write_version({"logs": rows(spark, i).selectExpr("x AS id")}, folder)
    CT.remove_old_versions(spark, folder, lease=0)
    assert len(list(tmp_path.glob("version=*"))) == 2 and [r.id for r in catalog.logs.select("id").collect()] == [1]
    CT.unpin(spark, folder, name)
    _, passed = CT.pin(spark, folder, seconds=-1)
    CT.remove_old_versions(spark, folder, lease=0)
    assert len(list(tmp_path.glob("version=*"))) == 1 and not list(tmp_path.glob(passed))

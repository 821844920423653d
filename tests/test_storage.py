import os

import pytest


def test_scratch_deletes_what_was_saved_inside(spark):
    from orrery.storage import scratch, shared_folder, store

    local = lambda path: path.removeprefix("file://")
    before = store(spark, spark.range(3), "before")
    with scratch(spark) as keep:
        kept = shared_folder(spark, "kept")
        keep.append(kept)
        inner = store(spark, spark.range(5), "inner")
        gone = inner.inputFiles()[0]
        inner.write.parquet(kept)
    assert before.count() == 3 and spark.read.parquet(kept).count() == 5 and not os.path.exists(local(gone))


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from orrery.storage import shared_folder

    class Conf(dict):
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "local-cluster[2,1,512]"
            getConf = staticmethod(Conf)

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session(), "x")
    Session.sparkContext.master = "local[2]"
    assert "orrery-" in shared_folder(Session(), "x")

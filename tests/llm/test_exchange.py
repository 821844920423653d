"""Numbers of tasks of the exchange, and keys that a single 64-bit hash can't tell apart."""

from __future__ import annotations

import numpy as np


def test_tasks_grow_with_the_text(spark):
    from orrery.llm import exchange as X

    df = spark.range(400).selectExpr("id AS doc_id", "repeat('word ', 200) AS text")
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    for size in (20_000, 5_000):
        dealt = X.deal(df, group_bytes=size)
        assert dealt.groups == 400_000 // size and dealt.docs.rdd.getNumPartitions() == dealt.groups
        asked = X.ask(dealt, lambda group, table, _: [(0, group, 1, b"", b"")])
        answered = X.answer(dealt, asked, lambda keys, aux: [b""] * len(keys))
        done = X.finish(dealt, answered, lambda table, replies: table.select(["doc_id"]), "doc_id long")
        assert answered.rdd.getNumPartitions() == done.rdd.getNumPartitions() == dealt.groups and done.count() == 400


def test_every_group_has_a_task_of_its_own(spark):
    from pyspark.sql import functions as F

    from orrery.llm import exchange as X

    for n in (1, 2, 7, 100, 5000):
        ids = X.even_ids(n)
        assert len(set(ids.tolist())) == n
    df = spark.createDataFrame([(int(i),) for i in X.even_ids(300)], "i int").repartition(300, "i")
    assert df.select(F.spark_partition_id()).distinct().count() == 300
    dealt = X.deal(spark.range(4000).selectExpr("id AS doc_id", "repeat('word ', 20) AS text"), group_bytes=10_000)
    tasks = dealt.docs.select(X.GROUP, F.spark_partition_id().alias("p")).distinct().groupBy("p").count()
    assert dealt.groups == 40 and tasks.agg(F.max("count"), F.count("*")).first()[:] == (1, 40)


def test_the_second_hash_is_independent():
    from orrery.llm import textcore as T

    t = T.join_texts([b"alpha beta gamma alpha delta"])
    w = T.find_words(t)
    a, b = (T.range_hashes(t.buf, w.starts, w.ends, second=x) for x in (False, True))
    assert a[0] == a[3] and b[0] == b[3] and len(set(a.tolist())) == len(set(b.tolist())) == 4 and not set(a.tolist()) & set(b.tolist())
    assert T.window_hashes(a, 2)[0] != T.window_hashes(a, 2, second=True)[0]


def test_first_by_both_words_of_a_key():
    from orrery.llm import exchange as X

    keys = np.array([[1, 5], [1, 6], [1, 5]], np.uint64)
    first, second = X.resolve_first(2)([keys[:2].tobytes(), keys[2:].tobytes()], [X.runs(np.array([3, 3])), X.runs(np.array([4]))])
    assert np.unpackbits(np.frombuffer(first[4:], np.uint8))[:2].tolist() == [1, 1] and np.unpackbits(np.frombuffer(second[4:], np.uint8))[0] == 0


def test_products_count_shared_columns():
    from orrery.llm.jaccard_join import _blocks, _products

    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(0, 40)), dtype=np.uint64)) for _ in range(200)]
    pairs = rng.integers(0, 200, (500, 2))
    got = _products([sets[a].tobytes() for a, _ in pairs], [sets[b].tobytes() for _, b in pairs])
    assert got.tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in pairs]
    assert list(_blocks(np.array([5, 5, 20, 1, 1, 1]), 10)) == [(0, 2), (2, 3), (3, 6)] and list(_blocks(np.array([], int))) == []


def test_columns_of_any_type_pass_through(spark):
    from orrery.llm.line_dedup import dedup_lines

    df = spark.sql(
        """SELECT * FROM VALUES (1L, 'one line that is long\nx', timestamp'2024-03-01 10:00:00', date'2024-03-01', 1.5BD, array(1, null), named_struct('a', 'b', 'c', array(named_struct('d', 1))), map('k', 2), X'00ff', true),
           (2L, 'one line that is long', null, null, null, null, null, null, null, null) AS t(doc_id, text, at, day, price, numbers, nested, pairs, raw, flag)"""
    )
    got = sorted(dedup_lines(df).collect())
    assert [(r.n_lines, r.n_dropped, r.text) for r in got] == [(2, 0, "one line that is long\nx"), (1, 1, "")]
    keep = [c for c in df.columns if c != "text"]
    assert [tuple(r[c] for c in keep) for r in got] == [tuple(r[c] for c in keep) for r in sorted(df.collect())]


def test_blobs_at_100_tb():
    from orrery.llm import exchange as X

    assert X.group_count(0, 8, 16 << 20) == X.group_count(100 << 20, 8, 16 << 20) == 8 and X.group_count(30 << 30, 8, 16 << 20) == 1920
    before = 0
    for size in (10**9, 10**10, 10**11, 10**12, 10**13, 10**14):
        n = X.group_count(size, 8, 16 << 20)
        assert before < n and n * n <= max(size / 4096 * 1.001, (size / (16 << 20) + 1) ** 2)
        before = n
    assert 150_000 < n < 160_000 and 10**14 / n < 700 << 20


def test_rows_without_an_id_lie_in_all_groups(spark):
    from pyspark.sql import functions as F

    from orrery.llm import exchange as X

    df = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text of its own "), "id").alias("text"))
    for by_text in (True, False):
        dealt = X.deal(df, group_bytes=2_000, by_text=by_text)
        rows = X.finish(dealt, X.answer(dealt, X.ask(dealt, lambda group, table, _: [(0, group, 1, b"", b"")]), lambda keys, aux: [b""] * len(keys)), lambda table, replies: table.select([X.GROUP]), f"{X.GROUP} int")
        sizes = [r["count"] for r in rows.groupBy(X.GROUP).count().collect()]
        assert dealt.groups > 15 and len(sizes) == dealt.groups and max(sizes) < 5 * 2000 / dealt.groups


def test_results_do_not_depend_on_groups_of_rows_without_an_id(spark, monkeypatch):
    """Rows of no id and of one id, in 4 and in 40 groups: windows, lines and sets are judged alike."""
    import re

    from orrery.llm import exchange as X
    from orrery.llm.jaccard_join import similarity_groups
    from orrery.llm.line_dedup import dedup_lines
    from orrery.llm.substring_dedup import dedup_substrings

    rng = np.random.default_rng(8)
    shared = [" ".join(f"s{k}w{j}" for j in range(30)) for k in range(6)]
    rows = []
    for i in range(240):
        own = " ".join(f"o{i}x{j}" for j in range(int(rng.integers(0, 12))))
        rows.append((None if i % 3 == 0 else 7 if i % 3 == 1 and i < 60 else i, f"{own}\n{shared[i % 6]}" if i % 5 else shared[i % 6].upper() if i % 2 else shared[i % 6]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rank = lambda i: -(2**63) if i is None else i
    count, got = X.group_count, []
    for n in (4, 40):
        monkeypatch.setattr(X, "group_count", lambda size, least, group_bytes, n=n: n)
        a = sorted((rank(r.doc_id), r.n_words, r.n_removed, r.text) for r in dedup_substrings(df).collect())
        b = sorted((rank(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in dedup_lines(df).collect())
        c = sorted((rank(r.doc_id), r.n_shingles, rank(r.component_id)) for r in similarity_groups(df).collect())
        got.append((a, b, c))
    assert got[0] == got[1] and count is not X.group_count
    first: dict[str, int] = {}
    for i, t in rows:
        for x in t.split("\n"):
            first[x.lower()] = min(first.get(x.lower(), 2**63), rank(i))
    keep = sorted((rank(i), "\n".join(x for x in t.split("\n") if len(x) < 10 or first[x.lower()] == rank(i))) for i, t in rows)
    assert keep == sorted((i, t) for i, _, _, t in got[0][1])
    windows: dict[tuple, int] = {}
    words = [(rank(i), re.findall(r"\S+", t)) for i, t in rows]
    for i, w in words:
        for j in range(len(w) - 19):
            windows[tuple(w[j : j + 20])] = min(windows.get(tuple(w[j : j + 20]), 2**63), i)
    gone = sorted((i, len(w), len({k for j in range(len(w) - 19) if windows[tuple(w[j : j + 20])] < i for k in range(j, j + 20)})) for i, w in words)
    assert gone == sorted(x[:3] for x in got[0][0])

"""Similarity join of documents by the Jaccard index of their word n-grams.

Documents are rows and n-grams columns of a sparse incidence matrix. Equal rows are merged first.
Columns are ordered from the rarest by counts over all documents; a row can reach the threshold
only with rows that share one of its first columns, as many as its size allows to miss. The product over
these columns gives the pairs that size and position bounds don't rule out; for these alone the product over all
columns is taken, block by block: each column that both rows hold adds one to their overlap.

A column that many rows share isn't multiplied out. Its rows are first joined with one of them,
the most central; only rows that this leaves in another component are compared with the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import connected_components
from . import exchange as X
from . import textcore as T
from .storage import shared_folder

_NULL_ID = -(2**63)
_LENGTH = np.uint64(0xA24BAED4963EE407)
ROWS = "doc_id long, mark long, n_shingles long, node binary, size int, alone int, columns array<struct<token: long, place: int>>, grams binary"


def gram_sets(values: list, k: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its `k`-word shingles; of fewer words, of the whole sequence."""
    t = T.join_texts(values)
    low = T.LOWER[t.buf]
    w = T.find_words(t, low)
    h = T.mix(T.range_hashes(low, w.starts, w.ends))
    full = T.window_hashes(h, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        n = b - a
        if n >= k:
            out.append(np.unique(full[a : b - k + 1]))
        else:
            out.append(T.window_hashes(h[a:b], n) ^ T.mix(np.array([k - n], np.uint64)) if n else np.empty(0, np.uint64))
    return out


def signature(grams: np.ndarray) -> tuple[int, int]:
    m = T.mix(grams ^ _LENGTH)
    return int(T.mix(m.sum(dtype=np.uint64)[None] + np.uint64(len(grams)))[0]), int(np.bitwise_xor.reduce(T.mix(m + np.uint64(1))))


def resolve_rarity(keys: list[bytes], aux: list[bytes]) -> list[bytes]:
    """For each key the class of its total count: 0 for one, then four classes for each doubling."""
    blobs = [np.frombuffer(k, np.uint32) for k in keys]
    every = np.concatenate(blobs)
    counts = np.concatenate([np.frombuffer(a, np.uint8) for a in aux]).astype(np.int64)
    order = np.argsort(every)
    s = every[order]
    heads = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    total = np.add.reduceat(counts[order], heads)
    grade = np.where(total > 1, 1 + np.floor(4 * np.log2(np.maximum(total, 1))), 0).clip(0, 255).astype(np.uint8)
    out = np.empty(len(every), np.uint8)
    out[order] = np.repeat(grade, np.diff(np.append(heads, len(s))))
    return [x.tobytes() for x in np.split(out, np.cumsum([len(b) for b in blobs])[:-1])]


def _least_overlap(size: int, num: int, den: int) -> int:
    """Of a set of `size` with any set that reaches num/den."""
    return -(-num * size // den)


def incidence(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """A row for each document; those that stand for their set and may have a partner carry its leading columns and all columns that others share."""
    dealt = X.deal(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text"), by_text=False)
    shards = dealt.shards

    def parts(table: pa.Table):
        ids = pc.fill_null(table.column("doc_id"), _NULL_ID).to_numpy()
        values = T.column_bytes(table.column("text"))
        order = sorted(range(len(ids)), key=lambda i: (ids[i], values[i] or b""))
        values = [values[i] for i in order]
        return table.column("mark").take(pa.array(order, pa.int64())), ids[order], [g for a, b in T.slices(values) for g in gram_sets(values[a:b], k)]

    def first_step(group: int, table: pa.Table):
        marks, ids, sets = parts(table)
        signs = np.array([signature(g) for g in sets], np.uint64).reshape(-1, 2)
        lead: dict[tuple, int] = {}
        for i, s in enumerate(map(tuple, signs.tolist())):
            if len(sets[i]):
                lead.setdefault(s, i)
        at = np.fromiter(lead.values(), np.int64, len(lead))
        # One row stands for a set: rows without an id lie in several groups, and are told apart by their texts.
        own = np.where(ids == _NULL_ID, _NULL_ID + (marks.to_numpy().view(np.uint64) >> np.uint64(12)).astype(np.int64), ids)
        rows, sent = X.pack(shards, group, 1, signs[at], np.uint64, own[at])
        return marks, ids, sets, signs, at, rows, sent

    def ask_signs(group: int, table: pa.Table, _):
        return first_step(group, table)[5]

    def second_step(group: int, table: pa.Table, replies: pa.Table):
        marks, ids, sets, signs, at, _, sent = first_step(group, table)
        reps = np.sort(at[X.unpack(replies, 1, sent)])
        grams, counts = np.unique(np.concatenate([sets[i] for i in reps] or [np.empty(0, np.uint64)]), return_counts=True)
        small = np.minimum(counts, 255).astype(np.uint8)
        shard_rows, sent = _pack_counts(shards, group, grams, small)
        return marks, ids, sets, signs, reps, grams, shard_rows, sent

    def ask_grams(group: int, table: pa.Table, replies: pa.Table):
        return second_step(group, table, replies)[6]

    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("size", pa.int32()), ("alone", pa.int32()), ("columns", pa.list_(pa.struct([("token", pa.int64()), ("place", pa.int32())]))), ("grams", pa.binary())])

    def apply(table: pa.Table, replies: pa.Table) -> pa.Table:
        marks, ids, sets, signs, reps, grams, _, sent = second_step(table.column(X.GROUP)[0].as_py(), table, replies)
        grade = X.unpack(replies, 2, sent, np.uint8)
        n = len(ids)
        size, alone, columns, blobs = [None] * n, [None] * n, [None] * n, [None] * n
        for i in reps.tolist():
            own = sets[i]
            g = grade[np.searchsorted(grams, own)]
            single = int((g == 0).sum())
            most = len(own) - _least_overlap(len(own), num, den) + 1
            if single >= most:
                continue
            order = np.lexsort((own, g))
            size[i], alone[i] = len(own), single
            columns[i] = [{"token": t, "place": p} for p, t in enumerate(own[order[single:most]].view(np.int64).tolist(), single)]
            blobs[i] = own[g > 0].tobytes()
        counts = np.fromiter(map(len, sets), np.int64, n)
        node = pa.array([x.tobytes() if k else None for x, k in zip(signs, counts.tolist(), strict=True)], pa.binary())
        return pa.Table.from_arrays([pa.array(ids, mask=ids == _NULL_ID), marks, pa.array(counts), node, *(pa.array(x, f.type) for x, f in zip((size, alone, columns, blobs), list(schema)[4:], strict=True))], schema=schema)

    first = X.answer(dealt, X.ask(dealt, ask_signs), X.resolve_first(2))
    rarity = X.answer(dealt, X.ask(dealt, ask_grams, first), resolve_rarity)
    return X.finish(dealt, first.unionByName(rarity), apply, ROWS)


def _pack_counts(shards: int, group: int, grams: np.ndarray, counts: np.ndarray):
    rows, order = X.pack(shards, group, 2, grams, np.uint32)
    flat, at = counts[order].tobytes(), 0
    out = []
    for p, g, s, keys, _ in rows:
        n = len(keys) // 4
        out.append((p, g, s, keys, flat[at : at + n]))
        at += n
    return out, order


def overlaps(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (x, y) those that reach num/den, by their overlap over all columns."""
    # Both joins take the table as it is read, dealt out once: then the rows of a set that thousands are compared with can be split.
    own = sets.select("node", "size", "grams")
    given = pairs.join(own.select(F.col("node").alias("x"), F.col("size").alias("size_x"), F.col("grams").alias("grams_x")), "x")
    given = given.join(own.select(F.col("node").alias("y"), F.col("size").alias("size_y"), F.col("grams").alias("grams_y")), "y")

    def run(batches):
        for batch in batches:
            weight = np.array([len(u) + len(v) for u, v in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]) // 8
            for a, b in _blocks(weight):
                x, y, sx, sy, gx, gy = batch.slice(a, b - a).columns
                both = _products(gx.to_pylist(), gy.to_pylist())
                keep = pa.array((den + num) * both >= num * (sx.to_numpy().astype(np.int64) + sy.to_numpy()))
                yield pa.RecordBatch.from_arrays([x.filter(keep), y.filter(keep)], names=["x", "y"])

    return given.select("x", "y", "size_x", "size_y", "grams_x", "grams_y").mapInArrow(run, "x binary, y binary")


def _blocks(weight: np.ndarray, most: int = 1 << 20):
    """Yields (from, to) so that each block weighs about `most`, one row at least."""
    at = 0
    while at < len(weight):
        end = max(at + 1, int(np.searchsorted(np.cumsum(weight[at:]), most, "right")) + at)
        yield at, end
        at = end


def _products(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Entries of the product of two incidence blocks, row by row: the columns that both rows hold, added up."""
    cells, rows = [], []
    for side in (left, right):
        cells.append(np.frombuffer(b"".join(side), np.uint64))
        rows.append(np.repeat(np.arange(len(side)), [len(x) // 8 for x in side]))
    cell, row = np.concatenate(cells), np.concatenate(rows)
    order = np.lexsort((cell, row))
    cell, row = cell[order], row[order]
    # A row holds a column once, so that a cell comes twice only if both hold it.
    twice = (cell[1:] == cell[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[1:][twice], minlength=len(left))


def _sizes_fit(a: Column, b: Column, num: int, den: int) -> Column:
    return den * F.least(a, b) >= num * F.greatest(a, b)


def similarity_groups(docs: DataFrame, *, shingle: int = 5, num: int = 4, den: int = 5, save: Callable[[DataFrame, str], DataFrame] | None = None, keep: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id: the smallest doc_id reachable by links.

    With `keep` also mark (a hash of the row's text), and keep_id and keep_mark: the row of the component that stays if one does, of the smallest doc_id that isn't
    null (null if all are), and of its rows the one of the least mark.

    A document's set holds the distinct `shingle`-word shingles of its words (runs without ASCII white
    space, A-Z lower-cased), or the whole sequence if it has fewer words. Documents link if
    den * intersection >= num * union. Every link between different sets counts, however common their parts are.

    Null and empty texts, and those without words, have an empty set and stay alone. A null doc_id counts as the
    smallest and is returned as null. Repeated rows are each returned, in one component. Other columns are left out.
    """
    spark = docs.sparkSession
    f = gcd(num, den)
    num, den = num // f, den // f

    def write(df: DataFrame, name: str) -> DataFrame:
        path = shared_folder(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    save = save or write
    rows = save(incidence(docs, shingle, num, den), "incidence")
    sets = rows.where(F.col("size").isNotNull())
    cells = sets.select("node", "size", "alone", F.explode("columns").alias("c")).select("node", "size", "alone", "c.token", "c.place")
    # The most central row has the smallest share of columns to itself.
    share = (F.col("alone").cast("long") * 1_000_000 / F.col("size")).cast("long").alias("share")
    leaders = cells.groupBy("token").agg(F.min(F.struct(share, F.xxhash64("node").alias("by"), "node", "size", "place")).alias("l"), F.count("*").alias("n")).where("n > 1")
    # Saved, as the strays below: a join of two tables as they are read can be split where a column is hot, one over an aggregate or another join can't.
    leaders = save(leaders.select("token", F.col("l.node").alias("lead"), F.col("l.size").alias("lead_size"), F.col("l.place").alias("lead_place")), "leaders")
    placed = lambda s, p, t, q: (num * (s + t) <= (den + num) * F.least(s - p, t - q))  # noqa: E731  positions bound the overlap
    star = cells.join(leaders, "token").where((F.col("node") != F.col("lead")) & _sizes_fit(F.col("size"), F.col("lead_size"), num, den) & placed(F.col("size"), F.col("place"), F.col("lead_size"), F.col("lead_place")))
    links = save(overlaps(star.select(F.col("node").alias("x"), F.col("lead").alias("y")).distinct(), sets, num, den), "links")
    linked = connected_components(links, lambda df: save(df, "star"), src="x", dst="y")
    # Rows that aren't in the component of their column's leader are compared with all other components' rows in it.
    linked = save(linked, "components")
    part = cells.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lead_part = leaders.join(linked.withColumnRenamed("node", "lead"), "lead", "left").select("token", F.coalesce("component", "lead").alias("lead_component"), "lead")
    stray = part.join(lead_part, "token").where(F.col("component") != F.col("lead_component"))
    stray = save(stray.select("token", F.col("node").alias("x"), F.col("size").alias("sx"), F.col("place").alias("px"), F.col("component").alias("cx")), "strays")
    rest = part.select("token", F.col("node").alias("y"), F.col("size").alias("sy"), F.col("place").alias("py"), F.col("component").alias("cy"))
    crossed = stray.join(rest, "token").where((F.col("cx") != F.col("cy")) & _sizes_fit(F.col("sx"), F.col("sy"), num, den) & placed(F.col("sx"), F.col("px"), F.col("sy"), F.col("py")))
    crossed = crossed.select("x", "y").distinct()
    more = save(overlaps(crossed, sets, num, den), "more-links")
    every = connected_components(linked.select(F.col("node").alias("x"), F.col("component").alias("y")).unionByName(more), lambda df: save(df, "all"), src="x", dst="y")
    named_row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))
    nodes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(named_row).alias("least"), (F.count("*") > F.count("doc_id")).alias("nameless"))
    nodes = nodes.join(every, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = nodes.groupBy("component").agg(F.min("least").alias("least"), F.max("nameless").alias("nameless"))
    named = named.select("component", F.col("least.doc_id").alias("keep_id"), F.col("least.mark").alias("keep_mark"), F.when(~F.col("nameless"), F.col("least.doc_id")).alias("component_id"))
    of_node = nodes.select("node", "component").join(named, "component").select("node", "component_id", "keep_id", "keep_mark", F.lit(True).alias("known"))
    out = rows.select("doc_id", "mark", "n_shingles", "node").join(of_node, "node", "left")
    own = lambda c, alone: F.when(F.col("known"), F.col(c)).otherwise(F.col(alone)).alias(c)
    return out.select("doc_id", "n_shingles", own("component_id", "doc_id"), *(["mark", own("keep_id", "doc_id"), own("keep_mark", "mark")] if keep else []))

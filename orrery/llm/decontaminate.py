"""Search for benchmark passages by a stored, document-partitioned positional inverted index.

Documents are indexed in blocks: for each term (a hash of a word) the ascending positions at which the block
holds it, written as one row of term, count and position lists. What the index says about the benchmark's terms, by block,
is its directory: it gives the corpus' counts, by which the terms of every window are ranked, and the blocks that hold a
window's rarest term, to which the window is sent. There the lists are intersected from the rarest on, each
shifted by its term's place in the window, a bounded number of positions at a time.

Neither the benchmark nor anything found is broadcast: windows and blocks meet in joins. A Bloom filter of fixed
size keeps rows of other terms out of the directory's join.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema

from . import textcore as T
from .storage import store

SPAN = S.ArrayType(S.StructType([S.StructField("start", S.IntegerType()), S.StructField("end", S.IntegerType())]))
NEAR = S.ArrayType(S.StructType([S.StructField("item", S.StringType()), S.StructField("start", S.IntegerType()), S.StructField("end", S.IntegerType())]))
_HITS = S.StructType([S.StructField("doc_id", S.LongType()), S.StructField("mark", S.LongType()), S.StructField("spans", SPAN), S.StructField("items", S.ArrayType(S.StringType())), S.StructField("n_near", S.LongType()), S.StructField("near", NEAR)])
_BLOCK = "block long, n_docs int, ids array<long>, marks array<long>, firsts array<int>, terms binary, counts binary, places binary"
_FOUND = "doc_id long, mark long, window binary, exact boolean, n long, starts array<int>, ends array<int>"
_RARE = 3  # terms that a proximity match needs
_CHUNK = 1 << 20  # positions that are looked at together
_BLOOM_BITS = 1 << 23


def lower_words(values: list) -> tuple[T.Texts, T.Words, np.ndarray]:
    """Words of letters, digits and all that isn't ASCII, after lower-casing A-Z, with their hashes."""
    t = T.join_texts(values)
    low = T.LOWER[t.buf]
    w = T.find_words(t, low, T.ALNUM)
    return t, w, T.range_hashes(low, w.starts, w.ends)


def by_term(h: np.ndarray) -> np.ndarray:
    """The order of entries by hash, then by position."""
    bits = np.uint64(len(h).bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    order = (np.sort((h & ~mask) | np.arange(len(h), dtype=np.uint64)) & mask).astype(np.int64)
    s = h[order]
    # Hashes that differ in their lowest bits only may be mixed up.
    return order if (s[1:] >= s[:-1]).all() else np.argsort(h, kind="stable")


def pack_places(order: np.ndarray, heads: np.ndarray) -> bytes:
    """Positions by term as differences, the first of each term as it is; equal bytes of the numbers stand together, which compresses well."""
    step = np.empty(len(order), np.uint32)
    if len(order):
        step[1:] = np.maximum(order[1:] - order[:-1], 0)
        step[heads] = order[heads]
    return step.view(np.uint8).reshape(-1, 4).T.tobytes()


class Postings:
    """Position lists of the wanted terms of one block, as the index has them."""

    def __init__(self, terms: bytes, counts: bytes, places: bytes, firsts: np.ndarray, wanted: np.ndarray):
        """`wanted`: ascending terms; `firsts`: where each document's words begin, with a last entry."""
        own, n = np.frombuffer(terms, np.uint64), np.frombuffer(counts, np.uint32).astype(np.int64)
        step = np.frombuffer(places, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()
        begin = np.cumsum(n) - n
        at = np.minimum(np.searchsorted(own, wanted), max(len(own) - 1, 0))
        there = own[at] == wanted if len(own) else np.zeros(len(wanted), bool)
        self.sizes = np.where(there, n[at] if len(n) else 0, 0)
        self.cuts = np.append(0, np.cumsum(self.sizes))
        owner = np.repeat(np.arange(len(wanted)), self.sizes)
        local = np.arange(len(owner)) - self.cuts[owner]
        steps = step[begin[at[owner]] + local].astype(np.int64) if len(owner) else np.empty(0, np.int64)
        total = np.append(0, np.cumsum(steps))
        self.positions = total[1:] - total[self.cuts[owner]] if len(owner) else steps
        self.firsts, self.total = firsts, int(firsts[-1])
        self.term = np.full(self.total, -1, np.int32)
        self.term[self.positions] = owner
        self.keys = owner * (self.total + 1) + self.positions

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, at, "right") - 1

    def _occurrences(self, lead: np.ndarray, chunk: int):
        """Yields (row, position) for every occurrence of each row's leading term, at most `chunk` at a time."""
        ends = np.cumsum(self.sizes[lead])
        for a in range(0, int(ends[-1]) if len(ends) else 0, chunk):
            flat = np.arange(a, min(a + chunk, int(ends[-1])))
            row = np.searchsorted(ends, flat, "right")
            yield row, self.positions[self.cuts[lead[row]] + flat - (ends - self.sizes[lead])[row]]

    def phrases(self, terms: np.ndarray, lengths: np.ndarray, chunk: int = _CHUNK):
        """Yields (window, start, document) of exact matches. `terms`: by window, as places in the wanted terms, -1 after the end."""
        size = np.where(terms >= 0, self.sizes[terms], np.iinfo(np.int64).max)
        live = np.flatnonzero(size.min(axis=1, initial=1) > 0)
        rank = np.argsort(size[live], axis=1, kind="stable")
        for row, at in self._occurrences(terms[live, rank[:, 0]] if len(live) else np.empty(0, np.int64), chunk):
            at = at - rank[row, 0]
            for k in range(1, terms.shape[1]):
                place = rank[row, k]
                own, there = terms[live[row], place], at + place
                ok = (own < 0) | ((there >= 0) & (there < self.total) & (self.term[np.clip(there, 0, self.total - 1)] == own))
                row, at = row[ok], at[ok]
            window = live[row]
            ok = (at >= 0) & (at + lengths[window] <= self.total)
            window, at = window[ok], at[ok]
            doc = self.doc_of(at)
            ok = doc == self.doc_of(at + lengths[window] - 1)
            yield window[ok], at[ok], doc[ok]

    def near(self, terms: np.ndarray, rare: np.ndarray, slop: int, chunk: int = _CHUNK):
        """Yields (window, start, document) of places where the window's rarest terms lie within `slop` of theirs, in one text. `rare`: their places, -1 after the last."""
        own = np.where(rare >= 0, np.take_along_axis(terms, np.maximum(rare, 0), axis=1), -1)
        live = np.flatnonzero((own[:, 0] >= 0) & ((own < 0) | (self.sizes[own] > 0)).all(axis=1))
        for row, lead in self._occurrences(own[live, 0], chunk):
            row = live[row]
            doc = self.doc_of(lead)
            for k in range(1, rare.shape[1]):
                term, place = own[row, k], lead + rare[row, k] - rare[row, 0]
                low, high = np.maximum(place - slop, self.firsts[doc]), np.minimum(place + slop, self.firsts[doc + 1] - 1)
                base = term * (self.total + 1)
                at = np.searchsorted(self.keys, base + low)
                ok = (term < 0) | ((low <= high) & (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= base + high))
                row, lead, doc = row[ok], lead[ok], doc[ok]
            yield row, lead - rare[row, 0], doc

    def ranges(self, matches, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Matches by document and window: document, window, how many, and their merged ranges (owner, start, end) within the document."""
        parts = [self._merge(*m, lengths) for m in matches]
        if not parts:
            return (np.empty(0, np.int64),) * 6
        doc, window, n, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((start, window, doc))
        doc, window, n, start, end = doc[order], window[order], n[order], start[order], end[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (window[1:] != window[:-1]))[: len(doc)]
        heads = np.flatnonzero(new)
        owner = np.cumsum(new) - 1
        return doc[heads], window[heads], np.add.reduceat(n, heads) if len(heads) else n, owner, start, end

    @staticmethod
    def _merge(window: np.ndarray, at: np.ndarray, doc: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Overlapping ranges of a document and window become one, with the number of matches in each."""
        order = np.lexsort((at, window, doc))
        doc, window, at = doc[order], window[order], at[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (window[1:] != window[:-1]) | (at[1:] > at[:-1] + lengths[window[:-1]]))[: len(at)]
        heads = np.flatnonzero(new)
        last = np.append(heads[1:], len(at)) - 1 if len(heads) else heads
        return doc[heads], window[heads], last - heads + 1, at[heads], at[last] + lengths[window[last]] if len(last) else at


def build_index(docs: DataFrame, block_bytes: int) -> DataFrame:
    """One row for each block of about `block_bytes` of text, one text at least. `docs`: doc_id, mark, text."""
    arrow = pa.schema([("block", pa.int64()), ("n_docs", pa.int32()), ("ids", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int32())), ("terms", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])

    def run(batches):
        for batch in batches:
            values = T.column_bytes(batch.column(2))
            for a, b in T.slices(values, block_bytes):
                _, w, h = lower_words(values[a:b])
                order = by_term(h)
                s = h[order]
                heads = np.flatnonzero(np.append(True, s[1:] != s[:-1])[: len(s)])
                counts = np.diff(np.append(heads, len(s))).astype(np.uint32)
                ids, marks = batch.column(0)[a:b], batch.column(1)[a:b]
                # Blocks of the same rows have the same name, and the same content.
                name = hashlib.blake2b(repr((ids.to_pylist(), marks.to_pylist())).encode(), digest_size=8).digest()
                row = [[int.from_bytes(name, "little", signed=True)], [b - a], [ids.to_pylist()], [marks.to_pylist()], [w.first], [s[heads].tobytes()], [counts.tobytes()], [pack_places(order, heads)]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, arrow, strict=True)], schema=arrow)
            T.release()

    return docs.mapInArrow(run, _BLOCK)


def windows_of(benchmark: DataFrame, width: int) -> DataFrame:
    """item, window (a digest of its terms) and terms of every window of the benchmark, each once for an item."""

    def run(batches):
        for batch in batches:
            values = T.column_bytes(batch.column(1))
            for lo, hi in T.slices(values, 1 << 18):
                _, w, h = lower_words(values[lo:hi])
                rows = {}
                for item, a, b in zip(batch.column(0)[lo:hi].to_pylist(), w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                    for j in range(max(1, b - a - width + 1) if b > a else 0):
                        rows.setdefault((item, h[a + j : min(a + j + width, b)].tobytes()))
                columns = [[i for i, _ in rows], [hashlib.blake2b(x, digest_size=16).digest() for _, x in rows], [np.frombuffer(x, np.int64) for _, x in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["item", "window", "terms"])

    given = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return given.mapInArrow(run, "item string, window binary, terms array<long>").dropDuplicates(["item", "window"])


def _bloom(vocabulary: DataFrame) -> np.ndarray:
    """One bit for each term: at most _BLOOM_BITS / 64 rows come back, however many terms there are."""
    slot = F.pmod(F.col("term"), F.lit(_BLOOM_BITS))
    words = vocabulary.groupBy(F.shiftright(slot, 6).alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(term, {_BLOOM_BITS}) % 64 AS int))")).alias("bits")).toArrow()
    out = np.zeros(_BLOOM_BITS // 64, np.int64)
    out[words.column("i").to_numpy()] = words.column("bits").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def _directory(index: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, block, n: how often each block holds each term of the vocabulary."""
    shared = index.sparkSession.sparkContext.broadcast(np.packbits(_bloom(vocabulary)))

    def run(batches):
        some = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            for block, terms, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t, n = np.frombuffer(terms, np.int64), np.frombuffer(counts, np.uint32)
                ok = some[t & (_BLOOM_BITS - 1)]
                t, n = t[ok], n[ok]
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.full(len(t), block)), pa.array(n.astype(np.int64))], names=["term", "block", "n"])

    return index.select("block", "terms", "counts").mapInArrow(run, "term long, block long, n long").join(vocabulary, "term", "left_semi")


def _ranked(windows: DataFrame, totals: DataFrame, slop: int) -> DataFrame:
    """By window: its terms, the places of its rarest ones (of terms the corpus holds; empty if too few), whether all are held, and the term that leads."""
    cells = windows.select("window", F.posexplode("terms").alias("place", "term")).join(totals, "term", "left")
    cell = F.struct(F.col("total").isNull().alias("absent"), F.col("total"), F.col("place"), F.col("term"))
    by = cells.groupBy("window").agg(F.sort_array(F.collect_list(cell)).alias("c"))  # as many as a window has words
    held = F.filter("c", lambda x: ~x["absent"])
    near = F.lit(bool(slop)) & (F.size("held") >= F.least(F.size("c"), F.lit(_RARE)))
    by = by.withColumn("held", held).withColumns({"exact": F.size("held") == F.size("c"), "rare": F.when(near, F.transform(F.slice("held", 1, _RARE), lambda x: x["place"])).otherwise(F.array().cast("array<int>"))})
    terms = F.transform(F.sort_array(F.transform("c", lambda x: F.struct(x["place"], x["term"]))), lambda x: x["term"])
    return by.where(F.col("exact") | (F.size("rare") > 0)).select("window", terms.alias("terms"), "rare", "exact", F.get("held", F.lit(0))["term"].alias("lead"))


def _search(index: DataFrame, requests: DataFrame, blocks: int, slop: int) -> DataFrame:
    """Matches by document and window."""
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-blocks // 4))
    arrow = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("window", pa.binary()), ("exact", pa.bool_()), ("n", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])

    def match(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return arrow.empty_table()
        row = {c: rows.column(c)[0] for c in rows.column_names}
        # Equal blocks of repeated rows have one name: one of them stands for all, and each window is asked for once.
        asked = asked.take(list({w: i for i, w in enumerate(asked.column("window").to_pylist())}.values()))
        lists = asked.column("terms").to_pylist()
        lengths = np.array([len(x) for x in lists])
        raw = np.zeros((len(lists), int(lengths.max())), np.int64)
        for i, x in enumerate(lists):
            raw[i, : len(x)] = x
        given = np.arange(raw.shape[1]) < lengths[:, None]
        wanted = np.unique(raw[given].view(np.uint64))
        terms = np.where(given, np.searchsorted(wanted, raw.view(np.uint64)), -1)
        p = Postings(row["terms"].as_py(), row["counts"].as_py(), row["places"].as_py(), np.array(row["firsts"].as_py(), np.int64), wanted)
        windows, ids, marks = asked.column("window").to_pylist(), row["ids"].as_py(), row["marks"].as_py()
        rare = np.full((len(lists), _RARE), -1)
        for i, x in enumerate(asked.column("rare").to_pylist()):
            rare[i, : len(x)] = x
        all_held = np.flatnonzero(asked.column("exact").to_numpy())
        exact = ((all_held[w], at, doc) for w, at, doc in p.phrases(terms[all_held], lengths[all_held]))
        out = []
        for kind, matches in ((True, exact), (False, p.near(terms, rare, slop) if slop else ())):
            doc, window, n, owner, start, end = p.ranges(matches, lengths)
            first, size = p.firsts[doc], np.diff(p.firsts)[doc]
            edge = np.append(np.searchsorted(owner, np.arange(len(doc))), len(owner)).astype(np.int32)
            inside = lambda x: pa.ListArray.from_arrays(edge, np.clip(x - first[owner], 0, size[owner]).astype(np.int32))  # noqa: E731, B023
            d, w = doc.tolist(), window.tolist()
            columns = [[ids[i] for i in d], [marks[i] for i in d], [windows[i] for i in w], [kind] * len(d), n, inside(start), inside(end)]
            out.append(pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow))
        T.release()
        return pa.concat_tables(out)

    left, right = index.repartition(tasks, "block").groupBy("block"), requests.repartition(tasks, "block").groupBy("block")
    return left.cogroup(right).applyInArrow(match, _FOUND)


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges made one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _by_document(found: DataFrame, windows: DataFrame) -> DataFrame:
    """What was found in each document: merged spans, items, and proximity matches by item."""
    arrow = to_arrow_schema(_HITS)
    named = found.join(windows.select("window", "item"), "window")
    grouped = named.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("exact", "window", "item", "n", "starts", "ends")).alias("m"))

    def run(batches):
        for batch in batches:
            rows = []
            for d, mark, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans, items, n_near, near = {}, set(), {}, {}
                for x in m:
                    r = list(zip(x["starts"], x["ends"], strict=True))
                    if x["exact"]:
                        spans[x["window"]] = r
                        items.add(x["item"])
                    else:
                        n_near[x["window"]] = x["n"]
                        near.setdefault(x["item"], []).extend(r)
                rows.append({
                    "doc_id": d, "mark": mark, "spans": [{"start": s, "end": e} for s, e in _merged([y for r in spans.values() for y in r])], "items": sorted(i for i in items if i is not None),
                    "n_near": sum(n_near.values()), "near": [{"item": i, "start": s, "end": e} for i in sorted(near, key=lambda i: (i is not None, i or "")) for s, e in _merged(near[i])],
                })
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return grouped.mapInArrow(run, _HITS)


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, slop: int = 2, block_bytes: int = 4 << 20) -> DataFrame:
    """A row for each document: doc_id, mark (a hash of its text), n_words, spans (word ranges that windows cover, start inclusive, end not,
    merged and ascending), items (ids of items with an exact match, as sorted strings), n_near (places of windows
    whose three rarest terms lie within `slop` words of their places: proximity matches, exact ones included) and near
    (their items and word ranges, merged by item; the item may be null). Terms are rare by their counts in all of `docs`, so that
    no match depends on how texts are batched; terms that no text holds are passed over. Without `slop` only exact matches are sought.

    A window is `width` consecutive words of an item; an item of fewer words, but not none, is one
    window. Null and empty texts have no words and match nothing; a null item_id is left out of items but
    its windows count. Repeated items and documents are each reported, the latter a row each; a null doc_id is one like any other. Empty
    tables give no rows, or rows without matches. Other columns of `docs` are left out.

    The index and its directory are written to the shared folder. Words are told apart by 64 bits, windows by 128.
    """
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    index = store(spark, build_index(given, block_bytes), "postings", compression="zstd")
    windows = store(spark, windows_of(benchmark, width), "windows")
    each = windows.select("window", "terms").dropDuplicates(["window"])
    directory = store(spark, _directory(index, each.select(F.explode("terms").alias("term")).distinct()), "directory")
    ranked = _ranked(each, directory.groupBy("term").agg(F.sum("n").alias("total")), slop)
    requests = ranked.join(directory.select(F.col("term").alias("lead"), "block"), "lead").drop("lead")
    hits = _by_document(_search(index, requests, index.select("block").count(), slop), windows)
    sizes = F.transform(F.sequence(F.lit(0), F.col("n_docs") - 1), lambda i: F.struct(F.col("ids")[i].alias("doc_id"), F.col("marks")[i].alias("mark"), (F.col("firsts")[i + 1] - F.col("firsts")[i]).cast("long").alias("n_words")))
    every = index.select(F.explode(sizes).alias("d")).select("d.*")
    out = every.join(hits.withColumnsRenamed({"doc_id": "_id", "mark": "_mark"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    nothing = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return out.select("doc_id", "mark", "n_words", nothing("spans", SPAN), nothing("items", "array<string>"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), nothing("near", NEAR))


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, few: int = 200_000) -> DataFrame:
    """The rows of `docs` without an exact match, with all their columns; a null doc_id is judged like any other.

    Keys of contaminated documents are broadcast if there are at most `few` of them; more are joined by a shuffle.
    """
    spark = docs.sparkSession
    found = find_contamination(docs, benchmark, width=width, slop=0).where(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    gone = store(spark, found.distinct(), "contaminated")
    gone = F.broadcast(gone) if gone.count() <= few else gone
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_mark")), "left_anti")


def n_hit(spans: str = "spans"):
    """Words that spans cover."""
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))

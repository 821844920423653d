"""Removal of repeated word sequences by difference-cover anchors.

A difference cover modulo `period` meets every difference, so two equal windows, wherever they
start, hold at least one pair of cover positions at the same offset. Anchors, hashes of
`window - period + 1` words, are therefore taken at cover positions only. Anchors seen once rule
out every window around them; what is left is extended to whole windows, whose first occurrence
decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import exchange as X
from . import textcore as T

#: Perfect difference covers, by period.
COVERS = {1: (0,), 3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}

RESULT = "doc_id long, n_words long, n_removed long, text string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])
_NULL_ID = -(2**63)


def choose_period(window: int) -> int:
    """The longest period that leaves anchors of 8 words or half the window, whichever is less."""
    return max(v for v in COVERS if window - v + 1 >= min(8, (window + 1) // 2))


class _Part:
    """Some documents of a group: their words, anchors and windows."""

    def __init__(self, ids: np.ndarray, values: list, window: int, period: int):
        self.ids, self.texts = ids, T.join_texts(values)
        self.words = w = T.find_words(self.texts)
        self.n, counts = len(w), w.counts
        self.doc = w.text_of()
        self.hashes = T.mix(T.range_hashes(self.texts.buf, w.starts, w.ends))
        width = window - period + 1
        local = np.arange(self.n) - np.repeat(w.first[:-1], counts)
        at = np.isin(local % period, COVERS[period])[: max(0, self.n - width + 1)] & T.within(counts, w.first, width)
        self.cover = np.flatnonzero(at)
        self.anchors = T.window_hashes(self.hashes, width)[self.cover] if len(self.cover) else np.empty(0, np.uint64)
        self.valid = T.within(counts, w.first, window)
        self.window, self.period = window, period

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of windows that hold a repeated anchor."""
        hit = np.zeros(self.n + 1, np.int64)
        hit[self.cover[repeated] + 1] = 1
        total = np.cumsum(hit)
        n = len(self.valid)
        ends = np.minimum(np.arange(n) + self.period, self.n)
        return np.flatnonzero(self.valid & (total[ends] > total[:n]))

    def window_keys(self, at: np.ndarray) -> np.ndarray:
        """Two independent 64-bit hashes of each window."""
        if not len(at):
            return np.empty((0, 2), np.uint64)
        more = T.mix(T.range_hashes(self.texts.buf, self.words.starts, self.words.ends, second=True))
        return np.stack([T.window_hashes(self.hashes, self.window)[at], T.window_hashes(more, self.window, second=True)[at]], axis=1)


def _parts(table: pa.Table, window: int, period: int) -> list[_Part]:
    ids = pc.fill_null(table.column("doc_id").cast(pa.int64()), _NULL_ID).to_numpy()
    order = np.argsort(ids, kind="stable")
    values = T.column_bytes(table.column("text"))
    # Rows of the same id are put in the order of their texts, so that all steps agree.
    order = np.array(sorted(order.tolist(), key=lambda i: (ids[i], values[i] or b"")), np.int64)
    values = [values[i] for i in order]
    return [_Part(ids[order[a:b]], values[a:b], window, period) for a, b in T.slices(values)]


def _unique(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and whether each occurs more than once."""
    s = np.sort(hashes)
    new = np.append(True, s[1:] != s[:-1])[: len(s)]
    at = np.flatnonzero(new)
    return s[at], np.diff(np.append(at, len(s))) > 1


def dedup_substrings(docs: DataFrame, *, window: int = 20, period: int | None = None) -> DataFrame:
    """Removes every word that lies in a window of `window` words whose sequence also starts earlier.

    Earlier is a smaller `doc_id`, or the same document at an earlier start; windows are judged on
    the input. Returns doc_id, n_words, n_removed and the kept words joined by one space.

    Words are runs without ASCII white space. Null and empty texts have no words and an empty result;
    texts shorter than the window keep everything. Rows of equal doc_id don't remove each other's
    words; a null doc_id counts as the smallest. An empty table gives no rows. Other columns are left out.

    Hashes have 128 bits in the deciding step (32 bits within a shard in the first, where a
    collision costs work only).
    """
    period = period or choose_period(window)
    dealt = X.deal(docs.select("doc_id", "text"))
    shards = dealt.shards

    def first_step(group: int, parts: list[_Part]):
        every, many = _unique(np.concatenate([p.anchors for p in parts])) if parts else (np.empty(0, np.uint64), np.empty(0, bool))
        rows, order = X.pack(shards, group, 1, every, np.uint32, many)
        return every, rows, order

    def ask_anchors(group: int, table: pa.Table, _):
        return first_step(group, _parts(table, window, period))[1]

    def second_step(group: int, parts: list[_Part], replies: pa.Table):
        every, _, order = first_step(group, parts)
        repeated = every[X.unpack(replies, 1, order)]
        starts, hashes, docs_, rows_ = [], [], [], []
        for i, p in enumerate(parts):
            hit = np.isin(p.anchors, repeated)
            at = p.candidates(hit)
            starts.append(at)
            hashes.append(p.window_keys(at))
            docs_.append(p.ids[p.doc[at]] if len(at) else np.empty(0, np.int64))
            rows_.append((p.doc[at] if len(at) else np.empty(0, np.int64)) + (i << 32))
        h = np.concatenate(hashes) if hashes else np.empty((0, 2), np.uint64)
        d = np.concatenate(docs_) if docs_ else np.empty(0, np.int64)
        # Of a hash in a group the first occurrence alone is sent: documents come in ascending order.
        order = np.lexsort((h[:, 1], h[:, 0]))
        new = np.append(True, (h[order][1:] != h[order][:-1]).any(axis=1))[: len(h)]
        lead = np.sort(order[new])
        rows, sent = X.pack(shards, group, 2, h[lead], np.uint64, d[lead])
        return starts, h, d, np.concatenate(rows_), order, new, lead, rows, sent

    def ask_windows(group: int, table: pa.Table, replies: pa.Table):
        return second_step(group, _parts(table, window, period), replies)[7]

    def apply(table: pa.Table, replies: pa.Table) -> pa.Table:
        parts = _parts(table, window, period)
        starts, h, d, row, order, new, lead, _, sent = second_step(table.column(X.GROUP)[0].as_py(), parts, replies)
        # A window stays if it is the first of its row, its id is the least of its group, and no other group has it
        # in a smaller document. Rows of one id may lie in several groups; the shard tells each of them that its id is the least.
        first = np.zeros(len(h), bool)
        if len(h):
            told = X.unpack(replies, 2, sent)[np.searchsorted(lead, order[new])]
            run = np.cumsum(new) - 1
            ds, rs = d[order], row[order]
            opens = new | np.append(True, rs[1:] != rs[:-1])
            first[order] = opens & (ds == ds[np.flatnonzero(new)][run]) & told[run]
        at, ids, words, removed, texts = 0, [], [], [], []
        for p, s in zip(parts, starts, strict=True):
            again = np.zeros(p.n, bool)
            again[s] = ~first[at : at + len(s)]
            at += len(s)
            drop = T.covered(again, window, p.n)
            gone = np.zeros(p.n + 1, np.int64)
            np.cumsum(drop, out=gone[1:])
            ids.append(p.ids)
            words.append(p.words.counts)
            removed.append(np.diff(gone[p.words.first]))
            texts += T.keep_words(p.texts, p.words, ~drop)
        out = np.concatenate(ids)
        return pa.Table.from_arrays([pa.array(out, mask=out == _NULL_ID), pa.array(np.concatenate(words)), pa.array(np.concatenate(removed)), pa.array(texts, pa.binary()).cast(pa.string())], schema=_ARROW)

    anchors = X.answer(dealt, X.ask(dealt, ask_anchors), X.resolve_repeated)
    windows = X.answer(dealt, X.ask(dealt, ask_windows, anchors), X.resolve_first(2))
    return X.finish(dealt, anchors.unionByName(windows), apply, RESULT)

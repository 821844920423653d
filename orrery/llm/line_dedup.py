"""Removal of lines that an earlier document holds, by two Bloom filters and an exact second step.

A shard keeps one filter of line hashes seen once and one of hashes seen again, and tells each
group which of its lines may be repeats. Only those travel a second time, as 128-bit digests with
their document, to be confirmed and to find the smallest document that holds the line.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as S

from . import exchange as X
from . import textcore as T

_NULL_ID = -(2**63)


class BloomPair:
    """Two Bloom filters over 32-bit hashes: of those seen once at least, and of those seen again."""

    def __init__(self, n: int, bits_each: int = 16, probes: int = 3):
        self.m, self.probes = max(64, n * bits_each), probes
        self.once, self.twice = np.zeros(self.m, bool), np.zeros(self.m, bool)

    def _at(self, keys: np.ndarray) -> list[np.ndarray]:
        h = T.mix(keys.astype(np.uint64))
        a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
        return [((a + np.uint64(i) * b) % np.uint64(self.m)).astype(np.int64) for i in range(self.probes)]

    def add(self, keys: np.ndarray, many: np.ndarray) -> None:
        """`keys`: distinct among themselves; `many`: those known to repeat."""
        at = self._at(keys)
        again = np.logical_and.reduce([self.once[x] for x in at]) | many
        for x in at:
            self.twice[x[again]] = True
            self.once[x] = True

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([self.twice[x] for x in self._at(keys)])


def resolve_bloom(keys: list[bytes], aux: list[bytes]) -> list[bytes]:
    blobs = [np.frombuffer(k, np.uint32) for k in keys]
    pair = BloomPair(sum(map(len, blobs)))
    for b, a in zip(blobs, aux, strict=True):
        pair.add(b, np.unpackbits(np.frombuffer(a, np.uint8), count=len(b)).view(bool))
    return [X.bits(pair.repeated(b)) for b in blobs]


class _Part:
    """Lines of some documents; `key` says which lines have a key that is long enough."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, values: list, least: int):
        self.rows, self.ids, self.texts = rows, ids, T.join_texts(values)
        t = self.texts
        low = T.LOWER[t.buf]
        cut = t.buf == 0x0A
        cut[t.ends] = True
        self.ends = np.flatnonzero(cut)
        self.doc = np.searchsorted(t.ends, self.ends)
        self.counts = np.bincount(self.doc, minlength=len(t))
        self.starts = np.empty_like(self.ends)
        self.starts[1:] = self.ends[:-1] + 1
        if len(self.starts):
            self.starts[0] = t.starts[0]
        solid = np.append(np.flatnonzero(T.NON_SPACE[t.buf]), len(t.buf))
        a, b = np.searchsorted(solid, self.starts), np.searchsorted(solid, self.ends)
        some = b > a
        s, e = solid[a], solid[np.maximum(b - 1, 0)] + 1
        chars = T.code_points(t.buf)
        self.key = np.flatnonzero(some & (chars[np.minimum(e, len(t.buf))] - chars[np.minimum(s, len(t.buf))] >= least))
        self.s, self.e, self.low = s[self.key], e[self.key], low
        self.hashes = T.range_hashes(low, self.s, self.e)

    def digests(self, at: np.ndarray) -> np.ndarray:
        flat = self.low.tobytes()
        made = b"".join(hashlib.blake2b(flat[a:b], digest_size=16).digest() for a, b in zip(self.s[at].tolist(), self.e[at].tolist(), strict=True))
        return np.frombuffer(made, np.uint64).reshape(-1, 2)

    def kept(self, drop: np.ndarray) -> list[bytes]:
        t = self.texts
        flat, first = t.buf.tobytes(), np.append(0, np.cumsum(self.counts))
        some = np.add.reduceat(drop, first[:-1]) if len(drop) else []
        out = []
        for i, (a, b, n) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), some, strict=False)):
            if n:
                out.append(b"\n".join(flat[s:e] for s, e, d in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), drop[a:b].tolist(), strict=True) if not d))
            else:
                out.append(flat[t.starts[i] : t.ends[i]])
        return out


def dedup_lines(docs: DataFrame, *, min_chars: int = 10) -> DataFrame:
    """Drops lines whose key a document of smaller `doc_id` holds too.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased; keys of fewer
    than `min_chars` code points are always kept. All lines of such a key go except in the smallest
    document that holds it, which keeps all of its own. Returns the columns of `docs`, `text` being
    the lines that stay joined by a line feed, with n_lines (before dropping) and n_dropped; columns
    of these names in the input give way.

    A null or empty text is one empty line and becomes an empty text. Rows of equal doc_id count as
    one document; a null doc_id counts as the smallest. An empty table gives no rows.
    """
    clash = [c for c in docs.columns if c in ("n_lines", "n_dropped") or c.startswith("_x_")]
    docs = docs.drop(*clash)
    schema = S.StructType([*docs.schema.fields, S.StructField("n_lines", S.LongType()), S.StructField("n_dropped", S.LongType())])
    dealt = X.deal(docs)
    shards = dealt.shards

    def parts_of(table: pa.Table) -> list[_Part]:
        ids = pc.fill_null(table.column("doc_id").cast(pa.int64()), _NULL_ID).to_numpy()
        values = T.column_bytes(table.column("text"))
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], values[i] or b"")), np.int64)
        values = [values[i] for i in order]
        return [_Part(order[a:b], ids[order[a:b]], values[a:b], min_chars) for a, b in T.slices(values)]

    def joined(parts: list, what) -> np.ndarray:
        return np.concatenate([what(p) for p in parts])

    def first_step(group: int, parts: list[_Part]):
        """Distinct hashes of the group, and which of them several of its documents hold."""
        h, d = joined(parts, lambda p: p.hashes), joined(parts, lambda p: p.ids[p.doc[p.key]])
        order = np.argsort(h, kind="stable")
        hs, ds = h[order], d[order]
        new = np.append(True, hs[1:] != hs[:-1])[: len(hs)]
        at = np.flatnonzero(new)
        many = np.zeros(len(at), bool)
        if len(at):
            many = np.maximum.reduceat(ds, at) != np.minimum.reduceat(ds, at)
        rows, sent = X.pack(shards, group, 1, hs[at], np.uint32, many)
        return hs[at], rows, sent

    def ask_hashes(group: int, table: pa.Table, _):
        return first_step(group, parts_of(table))[1]

    def second_step(group: int, parts: list[_Part], replies: pa.Table):
        every, _, sent = first_step(group, parts)
        suspects = every[X.unpack(replies, 1, sent)]
        at = [np.flatnonzero(np.isin(p.hashes, suspects)) for p in parts]
        digests = np.concatenate([p.digests(a) for p, a in zip(parts, at, strict=True)])
        ids = np.concatenate([p.ids[p.doc[p.key[a]]] for p, a in zip(parts, at, strict=True)])
        rows, sent = X.pack(shards, group, 2, digests, np.uint64, ids)
        return at, rows, sent

    def ask_lines(group: int, table: pa.Table, replies: pa.Table):
        return second_step(group, parts_of(table), replies)[1]

    names = docs.columns

    def apply(table: pa.Table, replies: pa.Table) -> pa.Table:
        parts = parts_of(table)
        at, _, sent = second_step(table.column(X.GROUP)[0].as_py(), parts, replies)
        first = X.unpack(replies, 2, sent)
        done, texts, lines, dropped = 0, [], [], []
        for p, a in zip(parts, at, strict=True):
            drop = np.zeros(len(p.starts), bool)
            drop[p.key[a]] = ~first[done : done + len(a)]
            done += len(a)
            texts += p.kept(drop)
            lines.append(p.counts)
            dropped.append(np.bincount(p.doc, drop, minlength=len(p.texts)).astype(np.int64))
        out = table.select(names).take(pa.array(joined(parts, lambda p: p.rows)))
        text = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(out.schema.field("text").type)
        out = out.set_column(names.index("text"), "text", text)
        return out.append_column("n_lines", pa.array(np.concatenate(lines))).append_column("n_dropped", pa.array(np.concatenate(dropped)))

    suspected = X.answer(dealt, X.ask(dealt, ask_hashes), resolve_bloom)
    firsts = X.answer(dealt, X.ask(dealt, ask_lines, suspected), X.resolve_first(2))
    return X.finish(dealt, suspected.unionByName(firsts), apply, schema)

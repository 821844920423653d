"""Language-model scores from a sharded Elias-Fano trie of words, pairs and triples of words.

Counts are gathered from all training documents: each shard receives the pairs and triples of its contexts from every
group, and holds them as a trie. Contexts, for each of them its successor words, and for each pair the words that follow it are monotone
sequences in Elias-Fano coding; the smoothed probability of each is quantised on a logarithmic scale. The levels lie in one
memory-mapped file in memory and are searched there as they are stored, each entry relative to its context.
A word or pair that holds much of the corpus is split over several shards by its successors; nothing is asked of a part but its own entries.
"""

from __future__ import annotations

import mmap
import os
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import textcore as T

#: Hashes of the marks for the end and the start of a text.
END, START = np.uint64(0xE0D0E0D0E0D0E0D1), np.uint64(0x57A2757A2757A275)
_STEPS = 8  # codes for each halving of a probability

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
#: Of each byte the number of zero bits, and where its first, second, ... zero bit is.
_ZEROS = (8 - _BITS.sum(axis=1)).astype(np.uint8)
_ZERO_AT = np.argsort(_BITS, axis=1, kind="stable").astype(np.uint8)


class EliasFano:
    """A non-decreasing sequence of 64-bit integers: lower bits as they are, upper bits in unary, as words with a count of the zero bits ahead of each."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ahead: np.ndarray, n: int, shift: int):
        self.low, self.high, self.ahead, self.n, self.shift = low, high.view(np.uint8).reshape(-1, 8), ahead, n, shift

    @staticmethod
    def parts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Lower bits (8, 16, 32 or 64 of them, whichever leaves about one entry for each upper value or fewer), upper bits, their directory, shift."""
        n, top = len(values), int(values[-1]) if len(values) else 0
        want = max(0, top.bit_length() - max(1, n).bit_length())
        shift = next(s for s in (0, 8, 16, 32, 48) if s >= min(want, 48))
        low = (values & np.uint64((1 << shift) - 1)).astype({0: np.uint8, 8: np.uint8, 16: np.uint16, 32: np.uint32, 48: np.uint64}[shift])
        high = (values >> np.uint64(shift)).astype(np.int64)
        bits = np.zeros(-(-(int(high[-1] if n else 0) + n + 1) // 64) * 64, bool)
        bits[high + np.arange(n)] = True
        packed = np.packbits(bits, bitorder="little")
        zeros = _ZEROS[packed].reshape(-1, 8).sum(axis=1, dtype=np.uint32)
        return low, packed.view(np.uint64), np.append(0, np.cumsum(zeros)).astype(np.uint32 if len(bits) < 1 << 32 else np.uint64), shift

    def _zero_at(self, nth: np.ndarray) -> np.ndarray:
        """Where the zero bit of each number is, counted from 0."""
        word = np.searchsorted(self.ahead, nth, "right") - 1
        left = nth - self.ahead[word].astype(np.int64)
        own = self.high[word]
        upto = np.cumsum(_ZEROS[own], axis=1, dtype=np.int64)
        byte = (upto > left[:, None]).argmax(axis=1)
        row = np.arange(len(nth))
        left -= np.where(byte > 0, upto[row, np.maximum(byte - 1, 0)], 0)
        return word * 64 + byte * 8 + _ZERO_AT[own[row, byte], left]

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the entries begin and end whose upper bits are each given value: they are the ones between two zero bits."""
        first = np.zeros(len(high), np.int64)
        some = np.flatnonzero(high > 0)
        first[some] = self._zero_at(high[some] - 1) + 1 - high[some]
        return first, np.minimum(self._zero_at(high) - high, self.n)

    def find(self, values: np.ndarray, most: int = 1 << 16) -> np.ndarray:
        """Index of each value, -1 where it isn't there: its successor among entries of equal upper bits, by binary search beyond the first."""
        out = np.full(len(values), -1, np.int64)
        for a in range(0, len(values) if self.n else 0, most):
            v = values[a : a + most]
            high = (v >> np.uint64(self.shift)).astype(np.int64)
            at = np.flatnonzero(high < int(self.ahead[-1]))
            want = (v & np.uint64((1 << self.shift) - 1)).astype(self.low.dtype)[at]
            i, end = self._bucket(high[at])
            last = end.copy()
            there = np.minimum(i, self.n - 1)
            hit = (i < end) & (self.low[there] == want)
            open_ = np.flatnonzero(~hit & (end - i > 1))
            i[open_] += 1
            while open_.size:
                mid = (i[open_] + end[open_]) // 2
                less = self.low[mid] < want[open_]
                i[open_[less]] = mid[less] + 1
                end[open_[~less]] = mid[~less]
                ended = i[open_] >= end[open_]
                done = open_[ended]
                done = done[i[done] < last[done]]
                hit[done] = self.low[i[done]] == want[done]
                open_ = open_[~ended]
            out[a + at[hit]] = i[hit]
        return out


class Trie:
    """Contexts, their successors, the successors of these pairs, and codes of probabilities, in one memory map that is read only."""

    def __init__(self, contexts: np.ndarray, pairs: np.ndarray, triples: np.ndarray, of_pairs: np.ndarray, of_triples: np.ndarray):
        """`contexts`: sorted; `pairs`: sorted, the index of a context and 32 bits of a word; `triples`: the same with the index of a pair; probabilities of both."""
        arrays, levels = [], []
        for values in (contexts, pairs, triples):
            *own, shift = EliasFano.parts(values)
            arrays += own
            levels.append((len(values), shift))
        arrays += [code_of(of_pairs), code_of(of_triples)]
        # A file that lives in memory and goes with its last map: nothing stays on the machine.
        fd = os.memfd_create("levels")
        try:
            with open(fd, "wb", closefd=False) as f:
                for x in arrays:
                    f.write(x.tobytes() + bytes(-x.nbytes % 8))
                f.write(bytes(8))
            self.map = mmap.mmap(fd, 0, prot=mmap.PROT_READ)
        finally:
            os.close(fd)
        views, at = [], 0
        for x in arrays:
            views.append(np.frombuffer(self.map, x.dtype, len(x), at))
            at += -(-x.nbytes // 8) * 8
        self.contexts, self.pairs, self.triples = (EliasFano(*views[3 * k : 3 * k + 3], n, shift) for k, (n, shift) in enumerate(levels))
        self.codes, self.codes_3 = views[9:]

    def look_up(self, contexts: np.ndarray, owner: np.ndarray, words: np.ndarray, owner_3: np.ndarray, words_3: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of pairs and of triples, 0 for those that aren't there. `owner`: of each pair its context; `owner_3`: of each triple its pair."""
        found, codes = _below(self.pairs, self.codes, self.contexts.find(contexts)[owner], words)
        return codes, _below(self.triples, self.codes_3, found[owner_3], words_3)[1]


def _below(level: EliasFano, codes: np.ndarray, above: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and code of the entries that stand for words under entries of the level above (-1: not there)."""
    found, out = np.full(len(words), -1, np.int64), np.zeros(len(words), codes.dtype)
    at = np.flatnonzero(above >= 0)
    found[at] = level.find(above[at].astype(np.uint64) << np.uint64(32) | words[at].astype(np.uint64))
    ok = found >= 0
    out[ok] = codes[found[ok]]
    return found, out


def code_of(probabilities: np.ndarray) -> np.ndarray:
    """Codes of probabilities above 0: of 8 bits, or of 16 if one of them needs it, so that none is too small."""
    codes = 1 + np.round(-_STEPS * np.log2(probabilities))
    return codes.astype(np.uint8 if not len(codes) or codes.max() <= 255 else np.uint16)


def probability_of(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, np.exp2((1 - codes.astype(np.float64)) / _STEPS), 0.0)


def _zip(x: bytes) -> bytes:
    """Counts and codes are mostly small numbers, which take a bit or two each."""
    return zstandard.ZstdCompressor(level=1).compress(x)


def _unzip(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as their differences, equal bytes of which stand together: those of a shard are near each other, so that the upper ones are 0."""
    return _zip(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(_unzip(b), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def resolve_counts(keys: list[bytes], aux: list[bytes]) -> list[bytes]:
    """Totals of words; ahead of each answer, with the upper byte first, the shard's number of distinct training words and of training tokens."""
    blobs = [unpack_sorted(k) for k in keys]
    every = np.concatenate(blobs)
    counts = np.concatenate([np.frombuffer(_unzip(a), np.int64) for a in aux])
    order = np.argsort(every)
    s = every[order]
    heads = np.flatnonzero(np.append(True, s[1:] != s[:-1])[: len(s)])
    total = np.add.reduceat(counts[order], heads) if len(heads) else np.empty(0, np.int64)
    real = s[heads] != START
    head = int((total[real] > 0).sum()).to_bytes(8, "big") + int(total[real].sum()).to_bytes(8, "big")
    wide = np.uint64 if len(total) and total.max() >= 1 << 32 else np.uint32
    out = np.empty(len(every), wide)
    out[order] = np.repeat(total, np.diff(np.append(heads, len(s))))
    return [head + bytes([np.dtype(wide).itemsize]) + _zip(x.tobytes()) for x in np.split(out, np.cumsum([len(b) for b in blobs])[:-1])]


_WIDE = np.dtype([("at", np.uint32), ("n", np.uint64)])


def pack_ngrams(contexts: np.ndarray, degree: np.ndarray, words: np.ndarray, counts: np.ndarray, wide: np.ndarray, degree_3: np.ndarray, words_3: np.ndarray, counts_3: np.ndarray) -> tuple[bytes, bytes]:
    """A blob: contexts, of each the number of its words; counts of contexts that are split; of each pair the number of words that follow it."""
    names = np.frombuffer(pack_sorted(contexts), np.uint8)
    sizes = np.array([len(contexts), len(words), len(wide), len(words_3), len(names)], np.uint32)
    keys = [sizes, names, words.astype(np.uint32), words_3.astype(np.uint32)]
    aux = [degree.astype(np.uint32), counts.astype(np.uint32), degree_3.astype(np.uint32), counts_3.astype(np.uint32), wide]
    return b"".join(x.tobytes() for x in keys), _zip(b"".join(x.tobytes() for x in aux))


def unpack_ngrams(keys: bytes, aux: bytes) -> tuple[np.ndarray, ...]:
    n, m, k, m_3, size = np.frombuffer(keys, np.uint32, 5).tolist()
    contexts, aux = unpack_sorted(keys[20 : 20 + size]), _unzip(aux)
    take = lambda b, at, kinds: [np.frombuffer(b, kind, size, at + sum(np.dtype(x).itemsize * y for x, y in kinds[:i])) for i, (kind, size) in enumerate(kinds)]
    words, words_3 = take(keys, 20 + size, [(np.uint32, m), (np.uint32, m_3)])
    degree, counts, degree_3, counts_3, wide = take(aux, 0, [(np.uint32, n), (np.uint32, m), (np.uint32, m), (np.uint32, m_3), (_WIDE, k)])
    return contexts, np.repeat(np.arange(n), degree), words, counts, wide, np.repeat(np.arange(m), degree_3), words_3, counts_3


def _totals(owner: np.ndarray, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries (owner and word) that are counted at all, their totals, and the entry of each row (-1: not counted)."""
    keys, back = np.unique(owner.astype(np.uint64) << np.uint64(32) | words.astype(np.uint64), return_inverse=True)
    total = np.bincount(back, counts, minlength=len(keys)).astype(np.int64)
    ok = total > 0
    place = np.where(ok, np.cumsum(ok) - 1, -1)
    return keys[ok], total[ok], place[back]


def resolve_ngrams(strength: float):
    """Builds the shard's trie from all entries, and looks up every blob's entries in it."""

    def resolve(keys: list[bytes], aux: list[bytes]) -> list[bytes]:
        blobs = [unpack_ngrams(k, a) for k, a in zip(keys, aux, strict=True)]
        joined = lambda i: np.concatenate([b[i] for b in blobs])
        moved = lambda i, to: np.concatenate([b[i] + at for b, at in zip(blobs, np.cumsum([0, *(len(b[to]) for b in blobs)]), strict=False)])
        names, back = np.unique(joined(0), return_inverse=True)
        pairs, total, place = _totals(back[moved(1, 0)], joined(2), joined(3))
        # All pairs of a context are here, unless it is split: then its groups have sent its count.
        mass = np.bincount((pairs >> np.uint64(32)).astype(np.int64), total, minlength=len(names))
        for b in blobs:
            mass[np.searchsorted(names, b[0][b[4]["at"]])] = b[4]["n"]
        above = place[moved(5, 2)]
        some = above >= 0  # what isn't counted as a pair isn't as a triple
        triples, total_3, _ = _totals(above[some], joined(6)[some], joined(7)[some])
        of_pairs = total / (mass[(pairs >> np.uint64(32)).astype(np.int64)] + strength)
        of_triples = total_3 / (total[(triples >> np.uint64(32)).astype(np.int64)] + strength)
        trie = Trie(names, pairs, triples, of_pairs, of_triples)
        out = []
        for contexts, owner, words, _, _, owner_3, words_3, _ in blobs:
            two, three = trie.look_up(contexts, owner, words, owner_3, words_3)
            out.append(bytes([two.itemsize, three.itemsize]) + _zip(two.tobytes() + three.tobytes()))
        return out

    return resolve


class _Group:
    """All tokens of a group's documents in ascending order of their ids."""

    def __init__(self, table: pa.Table, folds: int, held: int):
        self.ids = table.column("doc_id").to_pylist()
        values = T.column_bytes(table.column("text"))
        order = sorted(range(len(values)), key=lambda i: (self.ids[i] is not None, self.ids[i] or 0, values[i] or b""))
        self.ids, values = [self.ids[i] for i in order], [values[i] for i in order]
        self.held = np.array([zlib.crc32(str("" if i is None else i).encode()) % folds == held for i in self.ids])
        parts, counts = [], []
        for a, b in T.slices(values):
            t = T.join_texts(values[a:b])
            low = T.LOWER[t.buf]
            w = T.find_words(t, low)
            flat = np.full(len(w) + b - a, END, np.uint64)
            ends = np.cumsum(w.counts + 1) - 1
            mask = np.ones(len(flat), bool)
            mask[ends] = False
            flat[mask] = T.range_hashes(low, w.starts, w.ends)
            parts.append(flat)
            counts.append(w.counts + 1)
        self.counts = np.concatenate(counts)
        self.first = np.append(0, np.cumsum(self.counts))
        tokens = np.concatenate(parts)
        # The start mark is the last entry of the vocabulary's source, so that it has an index.
        self.words, at = np.unique(np.append(tokens, START), return_inverse=True)
        self.token, self.start = at[:-1], int(at[-1])
        train = np.repeat(~self.held, self.counts)
        self.trained = np.bincount(self.token[train], minlength=len(self.words)).astype(np.int64)
        self.trained[self.start] = int((~self.held).sum())
        self.train = train

    def ask_words(self, shards: int, group: int):
        rows, order = X.pack(shards, group, 1, self.words, np.uint64)
        flat, at, out = self.trained[order].tobytes(), 0, []
        for p, _, _, keys, _ in rows:
            # Words are sorted, and shards are ranges of their upper bits.
            out.append((p, group, 1, pack_sorted(np.frombuffer(keys, np.uint64)), _zip(flat[at : at + len(keys)])))
            at += len(keys)
        return out, order

    def counts_from(self, replies: pa.Table, order: np.ndarray) -> tuple[np.ndarray, int, int]:
        """Counts of the group's words, and the corpus' numbers of distinct words and of tokens."""
        every = list(zip(replies.column("_x_shard").to_pylist(), replies.column("_x_step").to_pylist(), replies.column("_x_bits").to_pylist(), strict=True))
        rows = sorted((p, b) for p, s, b in every if s == 1)
        sums = next(b for _, s, b in every if s == 0)
        flat = np.concatenate([np.frombuffer(_unzip(b[17:]), np.uint32 if b[16] == 4 else np.uint64).astype(np.int64) for _, b in rows])
        out = np.empty(len(order), np.int64)
        out[order] = flat
        return out, int.from_bytes(sums[:8], "big"), int.from_bytes(sums[8:], "big")

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs as words, their training counts, and the pair that ends at each token."""
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[self.first[:-1]] = self.start
        key, back = np.unique(before * len(self.words) + self.token, return_inverse=True)
        counts = np.bincount(back[self.train], minlength=len(key))
        return key // len(self.words), key % len(self.words), counts, back

    def triples(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct triples as (pair, word), their training counts, the tokens that a triple ends at (all but the first of each text), and the triple."""
        at = np.ones(len(self.token), bool)
        at[self.first[:-1]] = False
        at = np.flatnonzero(at)
        key, back = np.unique(pair[at - 1] * len(self.words) + self.token[at], return_inverse=True)
        counts = np.bincount(back[self.train[at]], minlength=len(key))
        return key // len(self.words), key % len(self.words), counts, at, back


class _Ngrams:
    """A group's pairs and triples, as blobs for the shards and as what the answers say of them."""

    def __init__(self, g: _Group, replies: pa.Table, shards: int, order: int):
        self.g, self.shards = g, shards
        _, sent = g.ask_words(shards, 0)
        self.counts, self.distinct, self.total = g.counts_from(replies, sent)
        self.v, self.w, self.n, self.back = g.pairs()
        none = np.empty(0, np.int64)
        self.p, self.w_3, self.n_3, self.at, self.back_3 = g.triples(self.back) if order > 2 else (none,) * 5

    def blobs(self, group: int) -> list[tuple]:
        """Rows for the exchange; `layout` keeps the pairs and triples of each, in order."""
        counts, shards, v, w, p, w_3 = self.counts, self.shards, self.v, self.w, self.p, self.w_3
        word = T.mix(self.g.words)
        # A context with more than its share of a shard is dealt to several by its successors.
        ways = np.minimum(1 + counts * 4 * shards // max(self.total, 1), shards)
        # What isn't in the training documents has no pair there.
        sent = np.flatnonzero((counts[v] > 0) & (counts[w] > 0))
        turn = (word[w[sent]] >> np.uint64(40)).astype(np.int64) % ways[v[sent]]
        context = T.mix(word[v[sent]] + turn.astype(np.uint64))
        wide = np.where(ways[v[sent]] > 1, counts[v[sent]], 0)
        # A pair of two such words may hold as much: its triples don't lie below it but are dealt by their last word, with a context of their own.
        both = np.minimum(ways[v], ways[w])
        known = (counts[v] > 0) & (counts[w] > 0)
        able = known[p] & (counts[w_3] > 0)
        self.apart = np.flatnonzero(able & (both[p] > 1))
        below = np.flatnonzero(able & (both[p] == 1))
        turn = (word[w_3[self.apart]] >> np.uint64(40)).astype(np.int64) % both[p[self.apart]]
        own = T.mix(T.mix(word[v[p[self.apart]]] + T.mix(word[w[p[self.apart]]])) + turn.astype(np.uint64))
        # One list of entries: pairs, then triples that stand apart.
        entry = np.concatenate([sent, len(v) + self.apart])
        context, last = np.concatenate([context, own]), np.concatenate([w[sent], w_3[self.apart]])
        count = np.concatenate([self.n[sent], self.n_3[self.apart]])
        wide = np.concatenate([wide, np.full(len(self.apart), self.total)])
        shard = ((context >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        by = np.argsort(context)
        entry, context, last, count, wide, shard = entry[by], context[by], last[by], count[by], wide[by], shard[by]
        heads = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (shard[1:] != shard[:-1]))[: len(entry)])
        degree = np.diff(np.append(heads, len(entry)))
        # Triples come in the order of their pairs, as the pairs are sent.
        rank = np.full(len(v), -1, np.int64)
        pairs = np.flatnonzero(entry < len(v))
        rank[entry[pairs]] = pairs
        below = below[np.argsort(rank[p[below]])]
        place = rank[p[below]]
        degree_3 = np.bincount(place, minlength=len(entry))
        rows, self.layout = [], []
        edges = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[: len(shard)])
        for a, b in zip(edges.tolist(), np.append(edges, len(entry))[1:].tolist(), strict=True):
            c, d = np.searchsorted(heads, [a, b]).tolist()
            e, f = np.searchsorted(place, [a, b]).tolist()
            lead = heads[c:d]
            split = np.zeros(int((wide[lead] > 0).sum()), _WIDE)
            split["at"] = np.flatnonzero(wide[lead] > 0)
            split["n"] = wide[lead][split["at"]]
            low = lambda x: word[x] & np.uint64(0xFFFFFFFF)
            keys, aux = pack_ngrams(context[lead], degree[c:d], low(last[a:b]), count[a:b], split, degree_3[a:b], low(w_3[below[e:f]]), self.n_3[below[e:f]])
            rows.append((int(shard[a]), group, 2, keys, aux))
            self.layout.append((int(shard[a]), entry[a:b], below[e:f]))
        return rows

    def log_probabilities(self, replies: pa.Table, strength: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each token the logarithm of its probability after the words before it, and by itself. blobs() has been called."""
        every = zip(replies.column("_x_shard").to_pylist(), replies.column("_x_step").to_pylist(), replies.column("_x_bits").to_pylist(), strict=True)
        bits = {p: b for p, s, b in every if s == 2}
        stored, stored_3 = np.zeros(len(self.v) + len(self.p)), np.zeros(len(self.p))
        for p, entry, below in self.layout:
            kinds, b = [np.uint8 if x == 1 else np.uint16 for x in bits[p][:2]], _unzip(bits[p][2:])
            stored[entry] = probability_of(np.frombuffer(b, kinds[0], len(entry)))
            stored_3[below] = probability_of(np.frombuffer(b, kinds[1], len(below), np.dtype(kinds[0]).itemsize * len(entry)))
        base = (self.counts + 0.5) / (self.total + 0.5 * (self.distinct + 1))
        of = self.counts[self.v] + strength
        # Quantising must not leave less than the base's share.
        two = np.minimum(stored[: len(self.v)], self.counts[self.v] / of)
        pair_count = two * of
        out = (two + strength / of * base[self.w])[self.back]
        if len(self.p):
            # Triples that stand apart are counted as a share of all tokens.
            own = pair_count[self.p] + strength
            stored_3[self.apart] = stored[len(self.v) + self.apart] * (self.total + strength) / own[self.apart]
            three = np.minimum(stored_3, pair_count[self.p] / own)
            out[self.at] = three[self.back_3] + strength / (pair_count[self.back[self.at - 1]] + strength) * out[self.at]
        return np.log10(out), np.log10(base)[self.g.token]


def _sums(words: DataFrame, dealt: X.Dealt) -> DataFrame:
    """A reply to every group with the corpus' numbers of distinct words and of tokens: each shard's own, added up."""
    number = lambda at: F.conv(F.hex(F.substring("_x_bits", at, 8)), 16, 10).cast("long")
    by_shard = words.groupBy("_x_shard").agg(F.max(number(1)).alias("v"), F.max(number(9)).alias("n"))
    one = by_shard.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    ids, step = dealt.ids, 4096

    def run(batches):
        for batch in batches:
            for v, n, a in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = ids.value[a * step : (a + 1) * step]
                k = len(own)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([-1] * k, pa.int32()), pa.array([0] * k, pa.int32()), pa.array([v.to_bytes(8, "big") + n.to_bytes(8, "big")] * k)], names=["_x_group", "_x_shard", "_x_step", "_x_bits"])

    return one.select("v", "n", F.explode(F.sequence(F.lit(0), F.lit((dealt.groups - 1) // step))).alias("a")).mapInArrow(run, X.REPLIES)


def score_documents(docs: DataFrame, *, folds: int = 5, held: int = 1, strength: float = 4.0, order: int = 3, group_bytes: int = 8 << 20) -> DataFrame:
    """Scores every document with a model of the documents whose crc32(doc_id as text) mod `folds` isn't `held`.

    Tokens are the words (runs without ASCII white space, A-Z lower-cased) and one end for each text. base_score sums
    log10((c+0.5)/(N+0.5*(V+1))). score uses all pairs and, with `order` 3, all triples of training tokens, those seen once too: with the base probability p(w),
    p(w|v) = q(vw) + s / (c(v) + s) * p(w) and p(w|uv) = q(uvw) + s / (c'(uv) + s) * p(w|v), s being `strength`, q the quantised value of c(vw) / (c(v) + s) and
    c(uvw) / (c(uv) + s) (bounded by what smoothing leaves), and c'(uv) the count of the pair as its quantised probability gives it, so that the probabilities
    of a context sum to 1, but for the quantising (5 % each at most; of triples of frequent pairs twice that). The first token of a text has the mark of its start before it, and no triple.
    Entries are told apart by 64 bits of the context and 32 of each further word; words by 64.

    A null or empty text has the end alone. A null doc_id is in the training part (as an empty text). Repeated rows
    count and are scored each. With an empty table there are no rows. Other columns are left out.
    """
    if order not in (2, 3):
        raise ValueError("pairs, or pairs and triples")
    dealt = X.deal(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), group_bytes=group_bytes)
    shards = dealt.shards

    def ask_words(group: int, table: pa.Table, _):
        return _Group(table, folds, held).ask_words(shards, group)[0]

    def ask_ngrams(group: int, table: pa.Table, replies: pa.Table):
        return _Ngrams(_Group(table, folds, held), replies, shards, order).blobs(group)

    def apply(table: pa.Table, replies: pa.Table) -> pa.Table:
        g = _Group(table, folds, held)
        n = _Ngrams(g, replies, shards, order)
        n.blobs(table.column(X.GROUP)[0].as_py())
        scores, base = n.log_probabilities(replies, strength)
        known = n.counts > 0
        known[g.start] = False
        add = lambda x: np.add.reduceat(x, g.first[:-1])  # noqa: E731  every text has a token
        return pa.Table.from_arrays(
            [pa.array(g.ids, pa.int64()), pa.array(g.held), pa.array(g.counts.astype(np.int64)), pa.array(add(known[g.token].astype(np.int64))), pa.array(np.full(len(g.ids), n.total)), pa.array(add(base)), pa.array(np.round(add(scores), 6))],
            schema=_ARROW,
        )

    words = X.answer(dealt, X.ask(dealt, ask_words), resolve_counts)
    words = words.unionByName(_sums(words, dealt))
    ngrams = X.answer(dealt, X.ask(dealt, ask_ngrams, words), resolve_ngrams(strength))
    return X.finish(dealt, words.unionByName(ngrams), apply, RESULT)

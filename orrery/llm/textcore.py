"""Vectorised byte-level text primitives shared by the corpus operators.

Texts are held as one byte buffer in which every text is preceded and followed by a space, so
that word and line boundaries never cross a text. Hashes are 64 bits wide and depend on the bytes
only, hence are the same on every executor and in every run.
"""

from __future__ import annotations

import ctypes
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words for `[^\x20\x09-\x0D]+`.
NON_SPACE = ~_SPACE
#: Bytes of words for `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BLOCK = 1 << 20
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Of a second hash that doesn't depend on the first: together they have 128 bits.
_STEP_2 = np.uint64(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = (mix(np.arange(1, 257, dtype=np.uint64) * _BASE), mix(np.arange(1001, 1257, dtype=np.uint64) * _STEP))
_POWERS = {_STEP: np.ones(1, np.uint64), _STEP_2: np.ones(1, np.uint64)}


def _powers(n: int, step: np.uint64) -> np.ndarray:
    if len(_POWERS[step]) < n:
        p = np.full(max(n, 64), step, np.uint64)
        p[0] = 1
        _POWERS[step] = np.multiply.accumulate(p)
    return _POWERS[step]


@dataclass
class Texts:
    """`buf`: the bytes; `starts`, `ends`: of each text in it."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)


def join_texts(values: list[bytes | None]) -> Texts:
    """Null counts as empty."""
    values = [v or b"" for v in values]
    lens = np.fromiter(map(len, values), np.int64, len(values))
    ends = np.cumsum(lens + 1)
    return Texts(np.frombuffer(b" " + b" ".join(values) + b" ", np.uint8), ends - lens, ends)


def release() -> None:
    """Gives freed memory back to the system: a worker lives on after its task, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def as_type(column: pa.Array, kind: pa.DataType) -> pa.Array:
    """A cast where one is needed: Arrow refuses to cast a type to itself if null rows stand beside fields that can't be null."""
    return column if column.type.equals(kind) else column.cast(kind)


def column_bytes(col: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return col.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def slices(values: list[bytes | None], most: int = 2 << 20):
    """Yields (from, to) so that each slice holds about `most` bytes, one text at least."""
    at, size = 0, 0
    for i, v in enumerate(values):
        size += len(v or b"") + 1
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(values):
        yield at, len(values)


@dataclass
class Words:
    """`starts`, `ends`: byte ranges; `first`: index of each text's first word, with a last entry for the end."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def find_words(t: Texts, buf: np.ndarray | None = None, table: np.ndarray = NON_SPACE) -> Words:
    buf = t.buf if buf is None else buf
    inside = table[buf]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    return Words(starts, ends, np.append(np.searchsorted(starts, t.starts), len(starts)))


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """64-bit hashes of disjoint, ascending, non-empty byte ranges; `second` gives other ones, independent of the first."""
    out = np.empty(len(starts), np.uint64)
    size = ends - starts
    for i in np.flatnonzero(size > _BLOCK).tolist():
        # Ranges of many megabytes take no memory of their own.
        digest = hashlib.blake2b(memoryview(np.ascontiguousarray(buf[starts[i] : ends[i]])), digest_size=8, salt=b"second" if second else b"first")
        out[i] = int.from_bytes(digest.digest(), "little")
    short = np.flatnonzero(size <= _BLOCK)
    out[short] = _short_hashes(buf, starts[short], ends[short], second)
    return mix(out)


def _short_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool) -> np.ndarray:
    n = len(starts)
    out = np.empty(n, np.uint64)
    if not n:
        return out
    cuts = [0]
    while cuts[-1] < n:
        i = int(np.searchsorted(starts, starts[cuts[-1]] + _BLOCK))
        cuts.append(min(n, max(i, cuts[-1] + 1)))
    for a, b in zip(cuts, cuts[1:], strict=False):
        s, e = starts[a:b], ends[a:b]
        lo, hi = int(s[0]), int(e[-1])
        lens = e - s
        at = np.arange(hi - lo, dtype=np.int32)
        nxt = np.append(s[1:], hi)
        at -= np.repeat((s - lo).astype(np.int32), nxt - s)
        longest = int(lens.max())
        power = _powers(longest + 1, _STEP_2 if second else _STEP)
        np.minimum(at, longest, out=at)
        val = _BYTE[second][buf[lo:hi]]
        val *= power[at]
        idx = np.empty(2 * len(s), np.int64)
        idx[::2], idx[1::2] = s - lo, np.minimum(e - lo, hi - lo - 1)
        sums = np.add.reduceat(val, idx)[::2]
        sums[-1] = val[int(s[-1]) - lo :].sum(dtype=np.uint64)
        out[a:b] = sums ^ (lens.astype(np.uint64) * _BASE)
    return out


def window_hashes(h: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """Hashes of every `k` consecutive entries; the result has len(h)-k+1 entries (none if that is less than 1)."""
    n = len(h) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    have, acc, done = h, None, 0
    width, power = 1, _STEP_2 if second else _STEP
    while True:
        if k & width:
            acc = have if acc is None else acc[: len(h) - done - width + 1] * power + have[done : done + len(h) - done - width + 1]
            done += width
        if width * 2 > k:
            break
        with np.errstate(over="ignore"):
            have = have[: len(have) - width] * power + have[width:]
            power = power * power
        width *= 2
    return mix(acc[:n])


def within(counts: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Of the windows of `k` words over all words: whether the window lies in one text."""
    n = int(first[-1])
    ok = np.zeros(n, bool)
    if n:
        left = np.repeat(first[1:], counts) - np.arange(n)
        ok = left >= k
    return ok[: max(0, n - k + 1)]


def covered(flags: np.ndarray, k: int, n: int) -> np.ndarray:
    """Whether each of `n` positions lies in a flagged window of `k`."""
    step = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(flags)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + k, n), -1)
    return np.cumsum(step[:n]) > 0


def keep_words(t: Texts, w: Words, keep: np.ndarray) -> list[bytes]:
    """Of each text the kept words, joined by one space."""
    step = np.zeros(len(t.buf) + 2, np.int8)
    s, e = w.starts[keep], w.ends[keep]
    step[s] += 1
    np.subtract.at(step, e + 1, 1)
    mask = np.cumsum(step[: len(t.buf)], dtype=np.int8) > 0
    flat = t.buf.copy()
    flat[e] = 0x20
    out = flat[mask].tobytes()
    size = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(np.where(keep, w.ends - w.starts + 1, 0), out=size[1:])
    at = size[w.first]
    return [out[a : max(a, b - 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def code_points(buf: np.ndarray) -> np.ndarray:
    """Running count of characters before each byte, with a last entry for the end."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out

"""Encoding of texts through their distinct chunks.

Texts are cut where the tokenizer never joins what stands on both sides, equal chunks of a batch are
encoded once and remembered, and the ids are put together again by array indexing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import textcore as T


class ChunkEncoder:
    """`encode(chunks)` gives the ids of all chunks (bytes) in a row and each one's number; about `remember` chunks are kept.

    Remembered chunks are found by their hash, and are the same only if their first and last bytes agree too.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], remember: int = 200_000):
        self.encode, self.remember = encode, remember
        self.keys, self.heads = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.slot, self.used = np.empty(0, np.int64), np.empty(0, np.int64)
        self.at, self.flat, self.turn = np.zeros(1, np.int64), np.empty(0, np.int32), 0

    def _forget(self) -> None:
        """Keeps the half that was used last."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: self.remember // 2])
        self.keys, self.heads, self.used, slot = self.keys[keep], self.heads[keep], self.used[keep], self.slot[keep]
        lens = self.at[slot + 1] - self.at[slot]
        total = np.append(0, np.cumsum(lens))
        self.flat = self.flat[np.arange(total[-1]) + np.repeat(self.at[slot] - total[:-1], lens)]
        self.at, self.slot = total, np.arange(len(keep))

    def _slots(self, keys: np.ndarray, heads: np.ndarray, chunks: Callable[[np.ndarray], list[bytes]]) -> np.ndarray:
        """Where the ids of each chunk lie, given ascending keys; `chunks` gives the bytes of some of them."""
        if len(self.keys) > self.remember:
            self._forget()
        self.turn += 1
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            near = np.minimum(at, len(self.keys) - 1)
            known = (self.keys[near] == keys) & (self.heads[near] == heads)
            self.used[near[known]] = self.turn
        out = np.empty(len(keys), np.int64)
        out[known] = self.slot[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            ids, lens = self.encode(chunks(new))
            out[new] = len(self.at) - 1 + np.arange(len(new))
            self.at = np.append(self.at, self.at[-1] + np.cumsum(lens))
            self.flat = np.append(self.flat, ids.astype(np.int32))
            put = lambda old, more: np.insert(old, at[new], more)
            self.keys, self.heads, self.slot, self.used = put(self.keys, keys[new]), put(self.heads, heads[new]), put(self.slot, out[new]), put(self.used, self.turn)
        return out

    def texts(self, t: T.Texts, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and their numbers, given chunks (byte ranges) and where each text's begin."""
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(first) - 1, np.int64)
        keys, lead, back = np.unique(T.range_hashes(t.buf, starts, ends), return_index=True, return_inverse=True)
        s, e = starts[lead], ends[lead]

        def chunks(of: np.ndarray) -> list[bytes]:
            flat = memoryview(t.buf)
            return [bytes(flat[a:b]) for a, b in zip(s[of].tolist(), e[of].tolist(), strict=True)]

        place = self._slots(keys, _heads(t.buf, s, e), chunks)
        length = (self.at[place + 1] - self.at[place])[back]
        total = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        shift = self.at[place][back]
        shift -= total[:-1]
        where = np.repeat(shift, length)
        where += np.arange(total[-1])
        return self.flat[where], np.diff(total[first])


def _heads(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first four and the last four bytes of each range (those it has)."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(4):
        out = out << np.uint64(16) | buf[np.minimum(starts + k, ends - 1)].astype(np.uint64) << np.uint64(8) | buf[np.maximum(ends - 1 - k, starts)].astype(np.uint64)
    return out


def cut(t: T.Texts, before: np.ndarray, lead: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks from positions to cut before; each non-empty text starts `lead` bytes early. Returns starts, ends and first."""
    some = t.ends > t.starts
    inside = before.copy()
    inside[np.minimum(t.ends, len(before) - 1)] = False
    inside[t.starts] = False
    inside[t.starts[some] - lead] = True
    edges = np.flatnonzero(inside)
    edges = edges[np.append(True, edges[1:] != edges[:-1])] if len(edges) else edges
    text = np.searchsorted(t.ends, edges, side="right") if len(edges) else edges
    first = np.searchsorted(edges, t.starts - lead)
    ends = np.append(edges[1:], 0)
    last = np.append(text[1:] != text[:-1], True) if len(edges) else np.empty(0, bool)
    ends = ends[: len(edges)]
    ends[last] = t.ends[text[last]]
    return edges, ends, np.append(first, len(edges))

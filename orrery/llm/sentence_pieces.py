"""SentencePiece encoding and decoding by suffix-array matching.

The distinct chunks of a batch are joined and indexed by a suffix array; every piece is found by
binary search as a range of suffixes, which gives an edge for each occurrence. Edges are sorted by
position, and each chunk is relaxed over them: of the edges that join two neighbouring symbols the one of
the best score, the leftmost among equals, is taken until none is left, as byte-pair merging does.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema

from . import textcore as T
from .chunks import ChunkEncoder, cut

_MARK = 0x2581
_NONE = np.iinfo(np.int32).max
_WINDOW = 1 << 16  # characters that are matched together


@lru_cache(1)
def piece_encoder(path: str) -> tuple[PieceModel, ChunkEncoder]:
    """One for each worker process."""
    model = PieceModel(path)
    return model, ChunkEncoder(SuffixMatcher(model).encode)


@lru_cache(1)
def piece_surfaces(path: str) -> Surfaces:
    return Surfaces(piece_encoder(path)[0])


class PieceModel:
    """Pieces of a byte-pair model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.trainer_spec.model_type != 2 or m.normalizer_spec.name != "identity" or not m.trainer_spec.byte_fallback or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.add_dummy_prefix:
            raise ValueError("only byte-pair models with byte fallback, identity normalisation and a dummy prefix are supported")
        normal = [(p.piece, i, p.score) for i, p in enumerate(m.pieces) if p.type == 1]
        self.pieces = [p for p, _, _ in normal]
        self.ids = np.array([i for _, i, _ in normal], np.int32)
        # Equal scores have equal ranks; the best is 0.
        self.ranks = np.unique(-np.array([s for _, _, s in normal]), return_inverse=True)[1].astype(np.int32)
        self.longest = max(map(len, self.pieces))
        self.rank_of = dict(zip(self.pieces, self.ranks.tolist(), strict=True))
        self.id_of = dict(zip(self.pieces, self.ids.tolist(), strict=True))
        self.bytes = np.zeros(256, np.int32)
        for i, p in enumerate(m.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[3:-1], 16)] = i
        self.surface = [p.piece.replace("▁", " ").encode() if p.type == 1 else bytes([int(p.piece[3:-1], 16)]) if p.type == 6 else b" \xe2\x81\x87 " if p.type == 2 else b"" for p in m.pieces]
        joined = "".join(self.pieces)
        self.breaks_at_newline = "\n" not in joined
        if any("▁" in p.lstrip("▁") for p in self.pieces):
            raise ValueError("pieces must not run over white space")
        padded = [tuple(map(ord, p)) + (0,) * (self.longest - len(p)) for p in self.pieces]
        self.padded = np.array(padded, ">u4")
        self.lens = np.array(list(map(len, self.pieces)), np.int64)


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` codes, by doubling."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < depth:
        nxt = np.full(len(rank), 0, np.int64)
        nxt[:-width] = rank[width:] + 1 if width < len(rank) else 0
        rank = np.unique(rank * (int(rank.max()) + 2) + nxt, return_inverse=True)[1]
        width *= 2
    return np.argsort(rank, kind="stable")


class SuffixMatcher:
    def __init__(self, model: PieceModel):
        self.m = model
        self.low = model.padded.view(f"S{4 * model.longest}").ravel()
        high = model.padded.copy()
        for i, n in enumerate(model.lens.tolist()):
            high[i, n:] = 0xFFFFFFFF
        self.high = high.view(f"S{4 * model.longest}").ravel()

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and pieces of all occurrences, sorted by position then length."""
        sa = suffix_array(codes, self.m.longest)
        padded = np.zeros(len(codes) + self.m.longest, ">u4")
        padded[: len(codes)] = codes
        keys = np.lib.stride_tricks.sliding_window_view(padded, self.m.longest)[: len(codes)][sa]
        keys = np.ascontiguousarray(keys).view(self.low.dtype).ravel()
        lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        n = hi - lo
        piece = np.repeat(np.arange(len(n)), n)
        at = sa[np.arange(len(piece)) + np.repeat(lo - np.cumsum(n) + n, n)]
        order = np.argsort(at * (self.m.longest + 1) + self.m.lens[piece], kind="stable")
        return at[order], piece[order]

    def encode(self, chunks: list[bytes], most: int = _WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in a row, and each one's number."""
        flat, counts, owner = [], [], []
        batch, size = [], 0

        def done() -> None:
            nonlocal batch, size
            if batch:
                ids, n = self._encode(batch)
                flat.append(ids)
                counts.append(n)
            batch, size = [], 0

        for i, c in enumerate(chunks):
            text = c.decode().replace(" ", "▁")
            for part in self.segments(text, most) if len(text) > 2 * most else (text,):
                owner.append(i)
                if len(part) > 4 * most:
                    done()
                    ids = self.encode_run(part)
                    flat.append(ids)
                    counts.append(np.array([len(ids)]))
                    continue
                batch.append(part)
                size += len(part) + 1
                if size >= most:
                    done()
        done()
        n = np.concatenate([np.empty(0, np.int64), *counts])
        return np.concatenate([np.empty(0, np.int32), *flat]), np.bincount(np.array(owner, np.int64), n, minlength=len(chunks)).astype(np.int64)

    def segments(self, text: str, most: int = _WINDOW) -> Iterator[str]:
        """Parts of a long chunk, cut where no piece of two characters or more lies across: nothing is ever joined there.

        Pieces are matched in windows, so that memory doesn't grow with the chunk.
        """
        longest = self.m.longest
        start, carry = 0, np.zeros(longest, np.int64)
        for a in range(0, len(text), most):
            codes = np.frombuffer(text[a : a + most + longest].encode("utf-32-le"), np.uint32)
            at, piece = self.edges(codes)
            n = self.m.lens[piece]
            own = (at < most) & (n > 1)
            # Of the boundary before each character: how many pieces lie across.
            step = np.zeros(most + longest + 1, np.int64)
            step[: len(carry)] += np.diff(carry, prepend=0)
            step[len(carry)] -= carry[-1]
            np.add.at(step, at[own] + 1, 1)
            np.subtract.at(step, at[own] + n[own], 1)
            across = np.cumsum(step)
            carry = across[most : most + longest].copy()
            free = np.flatnonzero(across[: min(most, len(text) - a)] == 0) + a
            if len(free) and free[-1] > start:
                yield text[start : free[-1]]
                start = int(free[-1])
        yield text[start:]

    def encode_run(self, text: str) -> np.ndarray:
        """Ids of a chunk that can't be cut, by lists of places for each rank, at some bytes for each character."""
        m, n = self.m, len(text)
        size, before, after = bytearray(b"\1" * n), array("i", range(-1, n - 1)), array("i", range(1, n + 1))
        places: dict[int, array] = {}
        ranks: list[int] = []

        def rank(i: int) -> int:
            j = after[i]
            return m.rank_of.get(text[i : i + size[i] + size[j]], -1) if size[i] and j < n else -1

        def push(i: int, r: int) -> None:
            if r not in places:
                places[r] = array("i")
                heapq.heappush(ranks, r)
            places[r].append(i)

        for i in range(n - 1):
            if (r := rank(i)) >= 0:
                push(i, r)
        while ranks:
            # All places of the best rank from the left; joining may give further ones of this rank, or a better one.
            r = heapq.heappop(ranks)
            todo = np.sort(np.frombuffer(places.pop(r), np.int32))
            stream = (i for a in range(0, len(todo), _WINDOW) for i in todo[a : a + _WINDOW].tolist())
            more: list[int] = []
            ahead, read = next(stream, n), 1
            while more or ahead < n:
                if more and more[0] <= ahead:
                    i = heapq.heappop(more)
                else:
                    i, ahead, read = ahead, next(stream, n), read + 1
                if rank(i) != r:
                    continue
                j = after[i]
                size[i], size[j], after[i] = size[i] + size[j], 0, after[j]
                if after[i] < n:
                    before[after[i]] = i
                for x in (i, before[i]):
                    if x >= 0 and (new := rank(x)) == r:
                        heapq.heappush(more, x)
                    elif x >= 0 and new >= 0:
                        push(x, new)
                if ranks and ranks[0] < r:
                    rest = todo[read - 1 :].tolist() + more
                    if rest:
                        places[r] = array("i", rest)
                        heapq.heappush(ranks, r)
                    break
        ids = array("i")
        i = 0
        while i < n:
            piece = text[i : i + size[i]]
            ids.extend(m.bytes[list(piece.encode())].tolist() if piece not in m.id_of else (m.id_of[piece],))
            i = after[i]
        return np.array(ids, np.int32)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        m = self.m
        codes = np.frombuffer("\0".join(texts).encode("utf-32-le"), np.uint32)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(lens + 1) - lens - 1
        at, piece = self.edges(codes)
        width = m.longest + 1
        best = np.full(len(codes) * width, _NONE, np.int32)
        name = np.full(len(codes) * width, -1, np.int32)
        key = at * width + m.lens[piece]
        best[key], name[key] = m.ranks[piece], m.ids[piece]
        owner = np.repeat(np.arange(len(texts)), lens)
        start = np.arange(len(owner)) + owner  # one separator before each further text
        size = np.ones(len(start), np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        long = np.flatnonzero(lens > 200)
        if len(long):
            here = np.isin(owner, long)
            for i in long.tolist():
                s, z = self._merge_long(int(first[i]), int(lens[i]), best, width)
                done.append((np.full(len(s), i), s, z))
            owner, start, size = owner[~here], start[~here], size[~here]
        while len(owner):
            total = size[:-1] + size[1:]
            rank = np.full(len(owner), _NONE, np.int32)
            ok = np.flatnonzero((owner[1:] == owner[:-1]) & (total < width))
            rank[ok] = best[start[ok] * width + total[ok]]
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, heads)
            group = np.cumsum(np.append(True, owner[1:] != owner[:-1])) - 1
            live = least[group] < _NONE
            if not live.all():
                done.append((owner[~live], start[~live], size[~live]))
            hit = np.flatnonzero(live & (rank == least[group]))
            if not len(hit):
                break
            hit = hit[np.append(True, group[hit][1:] != group[hit][:-1])]  # the leftmost of each chunk
            size[hit] += size[hit + 1]
            live[hit + 1] = False
            owner, start, size = owner[live], start[live], size[live]
        owner, start, size = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.empty(0, np.int64),) * 3
        order = np.argsort(start, kind="stable")
        owner, start, size = owner[order], start[order], size[order]
        ids = name[start * width + size]
        # A character without a piece becomes its bytes.
        bare = ids < 0
        n = np.ones(len(ids), np.int64)
        code = codes[start]
        n[bare] = (1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))[bare]
        ends = np.cumsum(n)
        flat = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        flat[(ends - n)[~bare]] = ids[~bare]
        if bare.any():
            raw = np.frombuffer("".join(map(chr, code[bare].tolist())).encode(), np.uint8)
            flat[np.arange(len(raw)) + np.repeat((ends - n)[bare] - (np.cumsum(n[bare]) - n[bare]), n[bare])] = m.bytes[raw]
        return flat, np.bincount(owner, n, minlength=len(texts)).astype(np.int64)

    @staticmethod
    def _merge_long(first: int, n: int, best: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long chunk, with a heap instead of rounds over all symbols."""
        size = [1] * n
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]

        def push(i: int) -> None:
            j = after[i]
            if j >= 0 and (t := size[i] + size[j]) < width and (r := int(best[(first + i) * width + t])) < _NONE:
                heapq.heappush(heap, (r, i, t))

        heap: list[tuple[int, int, int]] = []
        for i in range(n):
            push(i)
        while heap:
            _, i, t = heapq.heappop(heap)
            j = after[i]
            if not size[i] or j < 0 or size[i] + size[j] != t:
                continue
            size[i], size[j], after[i] = t, 0, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        s = np.flatnonzero(size)
        return s + first, np.array(size, np.int64)[s]


def _cuts(t: T.Texts, model: PieceModel) -> np.ndarray:
    """Before a space that follows neither a space nor the mark for one, and around line feeds."""
    b = t.buf
    before = np.zeros(len(b), bool)
    before[1:] = (b[1:] == 0x20) & (b[:-1] != 0x20) & (b[:-1] != 0x81)
    if model.breaks_at_newline:
        line = b == 0x0A
        before |= line
        before[1:] |= line[:-1]
    return before


class Surfaces:
    """What each id stands for, as bytes in a row."""

    def __init__(self, model: PieceModel):
        self.lens = np.fromiter(map(len, model.surface), np.int64, len(model.surface))
        self.at, self.flat = np.cumsum(self.lens) - self.lens, np.frombuffer(b"".join(model.surface), np.uint8)

    def texts(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """Of rows of ids, given where each row's begin (with a last entry); the space that encoding puts in front goes."""
        n = self.lens[ids]
        total = np.append(0, np.cumsum(n))
        raw = self.flat[np.arange(total[-1]) + np.repeat(self.at[ids] - total[:-1], n)].tobytes()
        return [raw[a + (raw[a : a + 1] == b" ") : b] for a, b in zip(total[first[:-1]].tolist(), total[first[1:]].tolist(), strict=True)]


def encode_texts(docs: DataFrame, model_path: str, *, column: str = "tokens", check: str | None = None) -> DataFrame:
    """Adds the ids of each whole text as `column` (which gives way if there); a null or empty text has none.

    Ids are those that the model's own library gives. With `check`, a column of that name says whether they decode to
    the text, found in the same pass. Other columns, repeated rows and null keys pass through.
    """
    docs = docs.drop(column, *([check] if check else []))
    schema = S.StructType([*docs.schema.fields, S.StructField(column, S.ArrayType(S.IntegerType())), *([S.StructField(check, S.BooleanType())] if check else [])])
    arrow = to_arrow_schema(schema)

    def run(batches):
        model, encoder = piece_encoder(model_path)
        surfaces = piece_surfaces(model_path) if check else None
        for batch in batches:
            values = T.column_bytes(batch.column(batch.schema.get_field_index("text")))
            for a, b in T.slices(values, 1 << 20):
                t = T.join_texts(values[a:b])
                ids, counts = encoder.texts(t, *cut(t, _cuts(t, model), lead=1))
                first = np.append(0, np.cumsum(counts))
                new = [pa.ListArray.from_arrays(first.astype(np.int32), ids)]
                if surfaces:
                    new.append(pa.array([x == (v or b"") for x, v in zip(surfaces.texts(ids, first), values[a:b], strict=True)]))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(T.as_type(c, f.type) for c, f in zip(part.columns, arrow, strict=False)), *new], schema=arrow)
            T.release()

    return docs.mapInArrow(run, schema)


def decode_texts(docs: DataFrame, model_path: str, *, tokens: str = "tokens", column: str = "decoded") -> DataFrame:
    """Adds the text of each row's ids as `column`: the exact inverse, but for U+2581, which becomes a space. Null ids give an empty text."""
    docs = docs.drop(column)
    schema = S.StructType([*docs.schema.fields, S.StructField(column, S.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        surfaces = piece_surfaces(model_path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(tokens)).fill_null([])
            for k in range(0, batch.num_rows, 512):
                part = lists.slice(k, 512)
                first = part.offsets.to_numpy().astype(np.int64)
                made = surfaces.texts(part.values.to_numpy(zero_copy_only=False)[first[0] : first[-1]], first - first[0])
                rows = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([*(T.as_type(c, f.type) for c, f in zip(rows.columns, arrow, strict=False)), pa.array([x.decode("utf-8", "replace") for x in made], pa.string())], schema=arrow)

    return docs.mapInArrow(run, schema)

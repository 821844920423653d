"""A two-way exchange of packed hashes between groups of documents and hash shards.

Documents are dealt to groups by a hash of their id and text; a group's text fits in a Python worker.
A group packs the hashes it wants to know something about into one blob for each shard, the
shard answers each blob, and the answers return to the group, where they are read in the order in
which the hashes were sent. Only hashes and answers of a bit or a byte travel, a hot hash
counts once for each group that holds it, and shards and groups grow with the square root of the corpus at most: their
numbers grow with it, and so do those of tasks, since both are dealt to as many partitions as there are of them.
The documents themselves travel as compressed batches, of those that an input batch has for one group.

All steps of an operator form one lazy query, so that the documents are dealt out once (Spark
reuses the exchange) and a lost executor's part is recomputed from the source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import textcore as T
from .textcore import release

GROUP = "_x_group"
BLOBS = "_x_shard int, _x_group int, _x_step int, _x_keys binary, _x_aux binary"
REPLIES = "_x_group int, _x_shard int, _x_step int, _x_bits binary"

_BLOB_SCHEMA = pa.schema([("_x_shard", pa.int32()), ("_x_group", pa.int32()), ("_x_step", pa.int32()), ("_x_keys", pa.binary()), ("_x_aux", pa.binary())])
_REPLY_SCHEMA = pa.schema([("_x_group", pa.int32()), ("_x_shard", pa.int32()), ("_x_step", pa.int32()), ("_x_bits", pa.binary())])


@dataclass(frozen=True)
class Dealt:
    """Documents with their group, as packed batches of rows; their schema; how many groups and shards there are, and the numbers that stand for them, as even_ids() gives them."""

    docs: DataFrame
    schema: pa.Schema
    groups: int
    shards: int
    ids: Broadcast


def even_ids(n: int) -> np.ndarray:
    """`n` different numbers that Spark's hash partitioning deals to `n` partitions, one to each: otherwise some would get several, and others none."""
    out, at, size = np.full(n, -1, np.int64), 0, min(max(1024, 4 * n), 1 << 23)
    while (out < 0).any():
        i = np.arange(at, at + size, dtype=np.uint32)
        place = _spark_hash(i).view(np.int32).astype(np.int64) % n
        place, first = np.unique(place, return_index=True)
        new = out[place] < 0
        out[place[new]] = i[first[new]]
        at += size
    return out.astype(np.int32)


def _spark_hash(i: np.ndarray) -> np.ndarray:
    """Murmur3 of 32-bit integers with the seed that partitioning uses."""
    u, turn = np.uint32, lambda x, k: (x << np.uint32(k)) | (x >> np.uint32(32 - k))
    # Constants of Murmur3, and the seed.
    h = turn(i * u(0xCC9E2D51), 15) * u(0x1B873593) ^ u(42)
    h = turn(h, 13) * u(5) + u(0xE6546B64) ^ u(4)
    h = (h ^ h >> u(16)) * u(0x85EBCA6B)
    h = (h ^ h >> u(13)) * u(0xC2B2AE35)
    return h ^ h >> u(16)


def _rows(packed: pa.Table, schema: pa.Schema) -> pa.Table:
    """The documents of one group, with a column for the group."""
    unzip = zstandard.ZstdDecompressor().decompress
    table = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(unzip(x.as_buffer())), schema) for c in packed.column("_x_rows").chunks for x in c], schema)
    return table.append_column(GROUP, pa.array(np.full(table.num_rows, packed.column(GROUP)[0].as_py(), np.int32)))


def group_count(size: int, least: int, group_bytes: int) -> int:
    """Groups, and shards, for so many bytes of text. Their product is the number of blobs, so from 4096 groups on their size grows with the square root of the text
    (16 MB up to 64 GB, 640 MB at 100 TB): blobs then grow no faster than the text, one for each 4 KB."""
    return max(least, math.ceil(size / (group_bytes * max(1.0, math.sqrt(size / (4096 * group_bytes))))))


def deal(docs: DataFrame, *, group_bytes: int = 16 << 20, text: str = "text", key: str = "doc_id", by_text: bool = True) -> Dealt:
    """Numbers of groups and shards follow the bytes of text. Rows of one id are spread by their texts, or only those without an id if not `by_text`."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = group_count(size, parts, group_bytes)
    spread = F.col(text) if by_text else F.when(F.col(key).isNull(), F.col(text))
    group = F.pmod(F.xxhash64(F.col(key).cast("string"), spread), F.lit(n)).cast("int")
    schema, ids = to_arrow_schema(docs.schema), docs.sparkSession.sparkContext.broadcast(even_ids(n))

    def run(batches):
        zipped = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            groups = ids.value[batch.column(batch.num_columns - 1).to_numpy()]
            order = np.argsort(groups, kind="stable")
            sorted_ = groups[order]
            heads = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])[: len(order)])
            rows = pa.RecordBatch.from_arrays([T.as_type(c, f.type) for c, f in zip(batch.columns, schema, strict=False)], schema=schema)
            made = [zipped(rows.take(pa.array(order[a:b])).serialize()) for a, b in zip(heads.tolist(), np.append(heads, len(order))[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(sorted_[heads]), pa.array(made, pa.binary())], names=[GROUP, "_x_rows"])

    packed = docs.withColumn(GROUP, group).mapInArrow(run, f"{GROUP} int, _x_rows binary")
    return Dealt(packed.repartition(n, GROUP), schema, n, n, ids)


def pack(shards: int, group: int, step: int, hashes: np.ndarray, dtype, aux: np.ndarray | None = None) -> tuple[list[tuple], np.ndarray]:
    """Blobs of (hash, aux) by shard, each sorted by shard then in the given order, and the order used.

    The shard comes from the upper 32 bits; `dtype` uint32 sends the lower ones only. Hashes may be
    rows of several words.
    """
    lead = hashes if hashes.ndim == 1 else hashes[:, 0]
    shard = ((lead >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    sorted_shard = shard[order]
    heads = np.flatnonzero(np.append(True, sorted_shard[1:] != sorted_shard[:-1])[: len(order)])
    keys = hashes[order].astype(dtype)
    aux = None if aux is None else aux[order]
    rows = []
    for p, a, b in zip(sorted_shard[heads].tolist(), heads.tolist(), np.append(heads, len(order))[1:].tolist(), strict=True):
        rows.append((p, group, step, keys[a:b].tobytes(), b"" if aux is None else np.packbits(aux[a:b]).tobytes() if aux.dtype == bool else runs(aux[a:b])))
    return rows, order


def runs(ids: np.ndarray) -> bytes:
    """Run-length coding: ids in the order of documents repeat."""
    at = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    return ids[at].astype(np.int64).tobytes() + np.diff(np.append(at, len(ids))).astype(np.int32).tobytes()


def unruns(blob: bytes) -> np.ndarray:
    n = len(blob) // 12
    return np.repeat(np.frombuffer(blob, np.int64, n), np.frombuffer(blob, np.int32, n, 8 * n))


def blob_table(rows: list[tuple], ids: np.ndarray) -> pa.Table:
    """Blobs under the numbers of their shards."""
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip([ids[np.array(columns[0], np.int64)], *columns[1:]], _BLOB_SCHEMA, strict=True)], schema=_BLOB_SCHEMA)


def _released(table: pa.Table) -> pa.Table:
    release()
    return table


def ask(dealt: Dealt, emit, replies: DataFrame | None = None) -> DataFrame:
    """`emit(group, table, replies)` returns blob rows of one group; replies are those of earlier steps."""
    schema, ids = dealt.schema, dealt.ids
    if replies is None:

        def run(table: pa.Table) -> pa.Table:
            return _released(blob_table(emit(table.column(GROUP)[0].as_py(), _rows(table, schema), None), ids.value))

        return dealt.docs.groupBy(GROUP).applyInArrow(run, BLOBS)

    def both(table: pa.Table, answers: pa.Table) -> pa.Table:
        return _released(blob_table(emit(table.column(GROUP)[0].as_py(), _rows(table, schema), answers) if table.num_rows else [], ids.value))

    return dealt.docs.groupBy(GROUP).cogroup(replies.repartition(dealt.groups, "_x_group").groupBy("_x_group")).applyInArrow(both, BLOBS)


def answer(dealt: Dealt, blobs: DataFrame, resolve) -> DataFrame:
    """`resolve(keys, aux)` takes the blobs of a shard and step and returns bytes for each of them.

    Blobs come in the order of their groups, so that an answer that depends on it is the same each time.
    """

    ids = dealt.ids

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(GROUP)
        # Answers bear the shard's place, by which groups order them.
        place = int(np.flatnonzero(ids.value == table.column("_x_shard")[0].as_py())[0])
        groups, steps = (table.column(c).to_pylist() for c in ("_x_group", "_x_step"))
        out = resolve(table.column("_x_keys").to_pylist(), table.column("_x_aux").to_pylist())
        return pa.Table.from_arrays([pa.array(groups, pa.int32()), pa.array(np.full(len(groups), place, np.int32)), pa.array(steps, pa.int32()), pa.array(out, pa.binary())], schema=_REPLY_SCHEMA)

    return blobs.repartition(dealt.shards, "_x_shard").groupBy("_x_shard").applyInArrow(run, REPLIES)


def finish(dealt: Dealt, replies: DataFrame, apply, schema) -> DataFrame:
    """`apply(table, replies)` returns the rows of one group."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    struct = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow, given = to_arrow_schema(struct), dealt.schema

    def both(table: pa.Table, answers: pa.Table) -> pa.Table:
        return _released(apply(_rows(table, given), answers)) if table.num_rows else arrow.empty_table()

    return dealt.docs.groupBy(GROUP).cogroup(replies.repartition(dealt.groups, "_x_group").groupBy("_x_group")).applyInArrow(both, struct)


def unpack(replies: pa.Table, step: int, order: np.ndarray, dtype=bool) -> np.ndarray:
    """The answers to one step in the order of the hashes given to pack()."""
    rows = sorted((p, b) for p, s, b in zip(replies.column("_x_shard").to_pylist(), replies.column("_x_step").to_pylist(), replies.column("_x_bits").to_pylist(), strict=True) if s == step)
    if dtype is bool:
        # Each blob's bits are padded to whole bytes; its length leads as four bytes.
        parts = [np.unpackbits(np.frombuffer(b, np.uint8, offset=4), count=int.from_bytes(b[:4], "little")).view(bool) for _, b in rows]
    else:
        parts = [np.frombuffer(b, dtype) for _, b in rows]
    flat = np.concatenate(parts) if parts else np.empty(0, dtype)
    out = np.empty(len(order), flat.dtype)
    out[order] = flat
    return out


def bits(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(4, "little") + np.packbits(flags).tobytes()


def resolve_repeated(keys: list[bytes], aux: list[bytes]) -> list[bytes]:
    """Which 32-bit keys more than one blob holds, or one blob more than once (its flag)."""
    blobs = [np.frombuffer(k, np.uint32) for k in keys]
    every = np.sort(np.concatenate(blobs))
    again = every[1:][every[1:] == every[:-1]]
    again = again[np.append(True, again[1:] != again[:-1])] if len(again) else again
    out = []
    for b, a in zip(blobs, aux, strict=True):
        flag = np.unpackbits(np.frombuffer(a, np.uint8), count=len(b)).view(bool).copy()
        if len(again):
            at = np.searchsorted(again, b)
            flag |= again[np.minimum(at, len(again) - 1)] == b
        out.append(bits(flag))
    return out


def resolve_first(width: int):
    """For keys of `width` 64-bit words, each with a document id: whether no smaller id holds the same key."""

    def resolve(keys: list[bytes], aux: list[bytes]) -> list[bytes]:
        k = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, width)
        ids = [unruns(a) for a in aux]
        d = np.concatenate(ids)
        order = np.argsort(k[:, 0], kind="stable") if width == 1 else np.lexsort(k.T[::-1])
        s = k[order]
        new = np.append(True, (s[1:] != s[:-1]).any(axis=1))
        least = np.minimum.reduceat(d[order], np.flatnonzero(new))
        first = np.empty(len(d), bool)
        first[order] = d[order] == least[np.cumsum(new) - 1]
        return [bits(f) for f in np.split(first, np.cumsum([len(x) for x in ids])[:-1])]

    return resolve

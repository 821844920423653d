"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are dealt to files by ranges of doc_id and sorted, so that stripes hold disjoint ranges
whose statistics prune reads, and stripes are read in parallel.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema

from . import textcore as T
from .chunks import ChunkEncoder, cut

_ABC, _SIGN, _FEED = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[0x30:0x3A] = _KIND[0x27] = 0
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _ABC
_KIND[0x09:0x0E] = _FEED
FILE = S.StructType([S.StructField("part", S.IntegerType()), S.StructField("ordinal", S.LongType()), S.StructField("doc_id", S.LongType()), S.StructField("n_tokens", S.LongType()), S.StructField("tokens", S.ArrayType(S.IntegerType()))])


@lru_cache(1)
def byte_bpe(path: str) -> tuple[ChunkEncoder, tuple[bytes, ...]]:
    """For byte-level BPE whose pattern starts a new token at every run of white space, with the strings of its added tokens. One for each worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    added = tok.get_added_tokens_decoder()
    # The bytes of each token: in this kind of vocabulary a character stands for a byte.
    size = np.zeros(tok.get_vocab_size(), np.int64)
    for t, i in tok.get_vocab().items():
        size[i] = len(t.encode()) if i in added else len(t)

    def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """In one text, where chunks that start with white space follow one without it at its end; their bytes tell them apart."""
        lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
        alone = [i for i, c in enumerate(chunks) if c[0] > 0x20 or not (0x20 < c[-1] < 0x7F or c[-1] >= 0x80 and not _may_be_space(c))]
        left = np.ones(len(chunks), bool)
        left[alone] = False
        rest = np.flatnonzero(left).tolist()
        ids = np.array(tok.encode_batch_fast([b"".join([chunks[i] for i in rest]).decode()], add_special_tokens=False)[0].ids, np.int64)
        cuts = np.searchsorted(np.cumsum(size[ids]), np.cumsum(lens[rest]), side="left") + 1
        if len(rest) and int(size[ids].sum()) != int(lens[rest].sum()):
            raise ValueError("tokens don't add up to their text")
        counts = np.zeros(len(chunks), np.int64)
        counts[rest] = np.diff(np.append(0, cuts))
        own = [e.ids for e in tok.encode_batch_fast([chunks[i].decode() for i in alone], add_special_tokens=False)]
        counts[alone] = [len(x) for x in own]
        flat = np.empty(int(counts.sum()), np.int64)
        mask = np.repeat(left, counts)
        flat[mask] = ids
        flat[~mask] = np.concatenate([*map(np.asarray, own), np.empty(0, np.int64)])
        return flat, counts

    return ChunkEncoder(encode, remember=1_200_000), tuple(t.content.encode() for t in added.values())


def _may_be_space(chunk: bytes) -> bool:
    return len(chunk) > 1 and (chunk[-2] == 0xC2 or len(chunk) > 2 and 0xE1 <= chunk[-3] <= 0xE3)


def sure_cuts(t: T.Texts, whole: tuple[bytes, ...] = ()) -> np.ndarray:
    """Where the pattern always starts a new token, whatever stands around.

    Before ASCII white space that follows a byte which surely doesn't end a white-space character; between a letter (of
    ASCII, or U+00C0 to U+00FF) and an ASCII sign other than the apostrophe; between a line feed or tab that stands alone and an ASCII letter.
    None lies inside one of the strings `whole`, which the library takes out of a text before it applies its pattern.
    """
    b = t.buf
    before = np.zeros(len(b), bool)
    kind = _KIND[b]
    solid = (b > 0x20) & (b != 0x7F)
    two, three = np.zeros(len(b), np.uint8), np.zeros(len(b), np.uint8)
    two[1:], three[2:] = b[:-1], b[:-2]
    # White space beyond ASCII: C2 85, C2 A0, E1 9A 80, E2 80 xx, E2 81 9F, E3 80 80.
    solid &= ~((b >= 0x80) & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3))))
    # U+00D7 and U+00F7 are signs; 0xC3 never follows in a character's middle.
    letter = (kind == _ABC) | ((two == 0xC3) & (b != 0x97) & (b != 0xB7))
    before[1:] = (solid[:-1] & ~T.NON_SPACE[b[1:]]) | (letter[:-1] & (kind[1:] == _SIGN))
    before[2:] |= solid[:-2] & (kind[1:-1] == _FEED) & (kind[2:] == _ABC)
    if whole:
        flat = b.tobytes()
        for x in whole:
            at = flat.find(x)
            while at >= 0:
                before[at + 1 : at + len(x)] = False
                at = flat.find(x, at + 1)
    return before


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 0, range_bytes: int = 16 << 20) -> None:
    """Encodes every text, appends `end_id`, and writes ids by ascending doc_id (equal ones by text, null first).

    A null or empty text has the end id alone. Other columns are left out; an empty table gives empty files.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    arrow = to_arrow_schema(FILE)

    def run(batches):
        (encoder, whole), part, row = byte_bpe(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            values = T.column_bytes(batch.column(1))
            for a, b in T.slices(values):
                t = T.join_texts(values[a:b])
                ids, counts = encoder.texts(t, *cut(t, sure_cuts(t, whole)))
                ends = np.cumsum(counts + 1) - 1
                flat = np.full(len(ids) + len(counts), end_id, np.int32)
                mask = np.ones(len(flat), bool)
                mask[ends] = False
                flat[mask] = ids
                tokens = pa.ListArray.from_arrays(np.append(0, ends + 1).astype(np.int32), flat)
                k = b - a
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, part, np.int32)), pa.array(np.arange(row, row + k)), batch.column(0)[a:b], pa.array(counts + 1), tokens], schema=arrow)
                row += k

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    out = ranged.mapInArrow(run, FILE).write.option("compression", "zstd")
    for key, value in (("bloom.filter.columns", "doc_id"), ("bloom.filter.fpp", "0.01"), ("row.index.stride", "1000"), ("stripe.size", str(8 << 20)), ("create.index", "true")):
        out = out.option(f"orc.{key}", value)
    out.orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """part, ordinal (place in the part), doc_id, n_tokens, tokens. Filters on doc_id reach stripe statistics and Bloom filters."""
    return spark.read.schema(FILE).orc(path)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files: doc_id, start (ids before it), n_tokens, ids_crc32 (of its ids as little-endian 32-bit integers)."""
    schema = "part int, ordinal long, doc_id long, n_tokens long, ids_crc32 long"

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            at = lists.offsets.to_numpy()
            flat = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "ordinal", "doc_id", "n_tokens", "ids_crc32"])

    files = read_tokens(spark, path)
    rows = files.select("part", "ordinal", "doc_id", "tokens").mapInArrow(run, schema)
    # One row for each file, of two narrow columns: their running total gives where a file's first document starts.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    return rows.withColumn("inside", inside).join(before, "part").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")

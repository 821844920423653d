"""Cuts and remembered chunks against the library's own ids on texts that are hard to cut."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

SIGNS = ["a", "the", "Z", "é", "×", "÷", "ß", "1", "23", "'", "'s", "'re", "’", ",", ".", "###", "…", " ", "  ", "\n", "\n\n", "\t", " \n", "\xa0", "　", " ", "\x85", "中", "😀", "\r\n", "<|endoftext|>", "_", "-", "ª", "\x7f", "\x1f", "\x0b"]


@pytest.fixture(scope="module")
def path():
    from orrery.llm.queries import tokenizer_path

    return tokenizer_path("byte_bpe_50k.json")


@pytest.mark.parametrize("remember", [20, 1_000_000])
def test_cuts_give_the_ids_of_whole_texts(path, remember):
    from tokenizers import Tokenizer

    from orrery.llm import textcore as T
    from orrery.llm.chunks import ChunkEncoder, cut
    from orrery.llm.token_files import byte_bpe, sure_cuts

    rng, tok = random.Random(5), Tokenizer.from_file(path)
    made, whole = byte_bpe(path)
    encoder = ChunkEncoder(made.encode, remember=remember)
    for _ in range(40):
        texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(60))) for _ in range(40)]
        t = T.join_texts([x.encode() for x in texts])
        ids, counts = encoder.texts(t, *cut(t, sure_cuts(t, whole)))
        got = np.split(ids, np.cumsum(counts)[:-1])
        assert [x.tolist() for x in got] == [tok.encode(x, add_special_tokens=False).ids for x in texts]


def test_equal_hashes_are_told_apart_by_their_bytes():
    from orrery.llm.chunks import ChunkEncoder

    encoder = ChunkEncoder(lambda chunks: (np.array([c[0] for c in chunks]), np.ones(len(chunks), np.int64)))
    key = np.array([7], np.uint64)

    def ids(head: int, chunk: bytes) -> int:
        slot = encoder._slots(key, np.array([head], np.uint64), lambda _: [chunk])[0]
        return encoder.flat[encoder.at[slot]]

    assert ids(1, b"a") == 97 and ids(2, b"b") == 98 and ids(2, b"x") == 98


def test_repeated_and_null_ids(spark, path):
    from tokenizers import Tokenizer

    from orrery.llm.storage import shared_folder
    from orrery.llm.token_files import token_digests, write_tokens

    rows = [(None, "z"), (1, "b b"), (1, "a"), (1, "a"), (0, None), (2, "")]
    out, tok = shared_folder(spark, "t"), Tokenizer.from_file(path)
    write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), out, path)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_digests(spark, out).collect())
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want

"""Unbroken runs of many characters: the library's own ids, in bounded memory."""

from __future__ import annotations

import random
import resource
import subprocess
import sys

import numpy as np
import pytest

RUNS = {
    "spaces": lambda n, rng: " " * n,
    "blanks": lambda n, rng: "".join(rng.choices([" ", "  ", "a", "the"], [8, 4, 1, 1], k=n))[:n],
    "same": lambda n, rng: "a" * n,
    "words": lambda n, rng: ("the" * n)[:n],
    "base64": lambda n, rng: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=n)),
    "ideographs": lambda n, rng: "".join(map(chr, rng.choices(range(0x4E00, 0x5000), k=n))),
    "dashes": lambda n, rng: "".join(rng.choices(["-", "=", "--", "e", "er", "s"], k=n))[:n],
}


@pytest.fixture(scope="module")
def matcher():
    from orrery.llm.queries import tokenizer_path
    from orrery.llm.sentence_pieces import PieceModel, SuffixMatcher

    return SuffixMatcher(PieceModel(tokenizer_path("piece_bpe_32k.model")))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    from orrery.llm.queries import tokenizer_path

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


@pytest.mark.parametrize("kind", RUNS)
def test_parts_and_runs_give_the_ids_of_the_whole(matcher, library, kind):
    rng = random.Random(2)
    for n in (1, 7, 300, 5000):
        text = RUNS[kind](n, rng)
        want = library.encode(text)
        for most in (16, 200, 1 << 16):
            ids, counts = matcher.encode([("▁" + text).encode(), "▁x".encode()], most)
            assert ids[: counts[0]].tolist() == want and counts.tolist() == [len(want), 1], (n, most)
        marked = "▁" + text.replace(" ", "▁")
        assert matcher.encode_run(marked).tolist() == want
        parts = list(matcher.segments(marked, 50))
        assert "".join(parts) == marked
        assert kind != "base64" or n < 300 or max(map(len, parts)) < 250


def test_a_long_run_of_ideographs(matcher, library):
    text = RUNS["ideographs"](300_000, random.Random(1))
    ids, counts = matcher.encode([("▁" + text).encode()])
    assert ids.tolist() == library.encode(text) and counts.tolist() == [len(ids)]


@pytest.mark.parametrize("kind", ["same", "base64"])
def test_ten_megabytes_take_bounded_memory(kind):
    code = f"""
import random, resource, sys
sys.path[:0] = {sys.path!r}
import numpy as np
from orrery.llm import textcore as T
from orrery.llm.chunks import cut
from orrery.llm.queries import tokenizer_path
from orrery.llm.sentence_pieces import _cuts, piece_encoder
rng = np.random.default_rng(1)
text = b"a" * (10 << 20) if {kind!r} == "same" else np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)[rng.integers(0, 64, 10 << 20)].tobytes()
model, encoder = piece_encoder(tokenizer_path("piece_bpe_32k.model"))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
t = T.join_texts([text])
ids, counts = encoder.texts(t, *cut(t, _cuts(t, model), lead=1))
print(len(ids), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    n, peak = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=600).stdout.split())
    assert n > 500_000 and peak < 500
    assert np.isfinite(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)

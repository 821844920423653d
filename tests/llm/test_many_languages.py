"""More declared languages than the 64 that were kept once."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("max_hosts", [100_000, 1])
def test_every_declared_language_is_scored(spark, max_hosts):
    from orrery.llm.language_id import fit_languages, identify

    rng = random.Random(5)
    codes = [f"{a}{b}" for a in "abcdefgh" for b in "abcdefghij"][:70]
    words = {c: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(6)] for c in codes}
    rows = [(i * 100 + j, " ".join(rng.choice(words[c]) for _ in range(12)), c, f"h{i}") for i, c in enumerate(codes) for j in range(2 if i == 69 else 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model, priors = fit_languages(df, declared=F.col("lang"), host=F.col("source"), max_hosts=max_hosts)
    assert model.languages == sorted(codes) and (priors is None) == (max_hosts > 1)
    got = {r.doc_id: r for r in identify(df, model, declared=F.col("lang"), host=F.col("source"), priors=priors).collect()}
    assert all(got[i].detected_lang == got[i].text_lang == lang and got[i].accepted for i, _, lang, _ in rows)
    # What is summed up in a task and what is counted by text give the same model.
    few = fit_languages(df, declared=F.col("lang"), host=F.col("source"), dense=3)[0]
    assert (few.weights == model.weights).all() and few.floor == model.floor

"""Language identification by brute force, and verdicts that the fused evidence changes."""

from __future__ import annotations

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

BUCKETS, STRENGTH, TRUST = 1 << 14, 20.0, 0.9
SPACE = {0x20, *range(9, 14)}


def buckets_of(text: str | None) -> list[int]:
    b = [0x20, *(0x20 if x in SPACE else x + 32 if 65 <= x <= 90 else x for x in (text or "").encode()), 0x20]
    letter = lambda x: x >= 128 or 97 <= x <= 122
    return [((b[i - 1] * 0x9E3779B1 + b[i] * 0x85EBCA77 + b[i + 1] * 0xC2B2AE3D) % 2**32) >> 18 for i in range(1, len(b) - 1) if letter(b[i])]


def by_brute_force(rows: list[tuple]) -> list[tuple]:
    """(language, confidence) for rows of (text, declared, host, suffix)."""
    langs = sorted({d for _, d, _, _ in rows if d})
    total = collections.Counter(d for _, d, _, _ in rows if d)
    overall = {x: (total[x] + 1) / (sum(total.values()) + len(langs)) for x in langs}
    grams = {x: collections.Counter() for x in langs}
    for t, d, _, _ in rows:
        if d:
            grams[d].update(buckets_of(t))
    size = {x: sum(grams[x].values()) + 0.5 * BUCKETS for x in langs}
    weight = lambda x, b: math.log((grams[x][b] + 0.5) / size[x])
    mean = sum(sum((grams[x][b] + 0.5) / size[x] * weight(x, b) for b in range(BUCKETS)) for x in langs) / len(langs)
    floor = mean - 0.6 * (mean + math.log(BUCKETS))

    def smoothed(key: int, value, above: dict) -> dict:
        n = collections.Counter(r[1] for r in rows if r[key] == value and r[1])
        return {x: (n[x] + STRENGTH * above[x]) / (sum(n.values()) + STRENGTH) for x in langs}

    out = []
    for t, d, host, suffix in rows:
        own = buckets_of(t)
        text = {x: sum(weight(x, b) for b in own) for x in langs}
        prior = smoothed(2, host, smoothed(3, suffix, overall) if suffix else overall) if host else overall
        post = {x: text[x] + math.log(prior[x]) + (0 if d not in langs else math.log(TRUST if x == d else (1 - TRUST) / (len(langs) - 1))) for x in langs}
        best = max(langs, key=lambda x: (round(post[x], 5), -langs.index(x)))
        known = bool(own) and text[best] >= floor * len(own) - 20
        out.append((best, 1 / sum(math.exp(post[x] - post[best]) for x in langs)) if known else ("und", 0.0))
    return out


def made(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = {"en": "the house and garden were there with them in other room".split(), "de": "der hund und die katze sind nicht mit dem haus verbunden".split(), "sv": "och det är inte en stor hund som var med hem".split()}
    rows = []
    for i in range(150):
        lang = ("en", "de", "sv")[i % 3]
        said = lang if rng.random() < 0.7 else rng.choice([None, "de", "en"])
        rows.append((" ".join(rng.choices(words[lang], k=rng.randrange(1, 9))), said, f"h{rng.randrange(6)}.{lang[:2]}" if i % 5 else None, lang if i % 5 else None))
    # The same short text everywhere: only its evidence tells.
    rows += [("en", said, host, host and host[-2:]) for said in (None, "de", "sv") for host in (None, "h1.de", "h1.sv", "new.sv")]
    return rows + [(None, "en", "h1.en", "en"), ("", None, None, None), ("12", "de", None, None), ("en", "sv", "h1.de", "de"), ("en", "sv", "h1.de", "de")]


@pytest.mark.parametrize("with_suffix", [True, False])
def test_by_brute_force(spark, with_suffix):
    from orrery.llm.language_id import fit_languages, identify

    rows = [(*r[:3], r[3] if with_suffix else None) for r in made(1)]
    df = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], "doc_id long, text string, lang string, host string, suffix string, confidence string")
    columns = {"declared": F.col("lang"), "host": F.col("host")}
    for most in (100_000, 2):
        model, priors = fit_languages(df, **columns, **({"suffix": F.col("suffix")} if with_suffix else {}), max_hosts=most)
        assert (priors is None) == (most > 2)
        got = {r.doc_id: r for r in identify(df, model, **columns, priors=priors).collect()}
        for i, (lang, sure) in enumerate(by_brute_force(rows)):
            assert (got[i].detected_lang, got[i].accepted) == (lang, sure >= 0.5) and got[i].confidence == pytest.approx(sure, abs=1e-4), (i, rows[i])


def test_evidence_changes_the_verdict(spark):
    rows = made(1)
    verdicts = {(said, host): v[0] for (t, said, host, _), v in zip(rows, by_brute_force(rows), strict=True) if t == "en"}
    # By declaration, by host, and by the suffix of a host that nothing else is known of.
    assert verdicts[None, "h1.de"] == "de" and verdicts[None, "h1.sv"] == verdicts[None, "new.sv"] == "sv"
    assert verdicts["de", None] == "de" and verdicts["sv", None] == "sv"


def test_no_nested_loop_without_suffixes(spark):
    from orrery.llm.language_id import fit_languages

    df = spark.createDataFrame([(i, "some words here", "en", f"h{i % 9}") for i in range(50)], "doc_id long, text string, lang string, host string")
    _, priors = fit_languages(df, declared=F.col("lang"), host=F.col("host"), max_hosts=2)
    assert "NestedLoop" not in priors._jdf.queryExecution().toString() and priors.count() == 9


def test_repeated_rows_and_null_ids(spark):
    from orrery.llm.language_id import identify_documents

    rows = [(None, "the house and the garden", "en", "a"), (1, "the house", "en", "a"), (1, "the house", "en", "a"), (1, None, None, None), (2, "der hund und die katze", "de", None)]
    got = sorted((r.doc_id or 0, r.detected_lang) for r in identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect())
    assert got == [(0, "en"), (1, "en"), (1, "en"), (1, "und"), (2, "de")]

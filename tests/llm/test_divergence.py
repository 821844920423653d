"""The audit of sources against every group with every term."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from orrery.llm.divergence import audit_sources, count_terms, document_sketch

SCHEMA = "doc_id long, text string, lang string, source string"


def terms_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def by_hand(rows, least: int, top: int) -> set[tuple]:
    rows = [(t or "", lang or "", s or "") for _, t, lang, s in rows]
    n, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        groups[lang].add(source)
        n[lang, source].update(terms_of(text))
        held[lang].update(set(terms_of(text)))
    out = set()
    for lang, sources in groups.items():
        terms = [t for t, k in held[lang].items() if k >= least]

        def p_of(count, lang=lang, terms=terms):
            total = sum(count[t] for t in terms)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(terms)) for t in terms}

        p = {s: p_of(n[lang, s]) for s in sources}
        q = p_of(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in terms), o.encode(), o) for o in sources if o != s)
            out |= {(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pairs, 1)}
            stand = sorted((q[t] - p[s][t], t.encode(), t) for t in terms if n[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(stand[:top], 1)}
    return out


def made(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(60)] + ["Über", "über", "ÀB", "日本", "x1y", "Zz", "\U0001f600"]
    rows = []
    for i in range(150):
        source = rng.choice(["hot"] * 4 + ["a", "b", "ä", None])
        lang = rng.choice(["en", "en", "de", None])
        text = " ".join(rng.choice(words[: 20 if source == "a" else None]) for _ in range(rng.choice([0, 3, 40])))
        rows.append((rng.choice([None, i]), rng.choice([text, text.upper(), None]), lang, source))
    return rows + rows[:30] + [(1, None, "lone", "one"), (2, "", "en", "silent"), (3, "word " * 5000, "lone", "one")]


@pytest.mark.parametrize("least,width", [(4, 1 << 16), (1, 1 << 17), (200, 1 << 16)])
def test_against_every_term(spark, least, width):
    rows = made(least)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("term", F.lit(1)).withColumn("rank", F.lit("x")).repartition(4)
    out = audit_sources(df, least=least, top=7, width=width)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(rows, least, 7)


def test_sketch_never_underestimates_and_discards(spark):
    rng = random.Random(8)
    rows = [(i, f"common{chr(97 + i % 3)} " + " ".join("rare" + "".join(rng.choices("abcdefghij", k=6)) for _ in range(300)), "en", "s") for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA).select("text", "lang", "source").repartition(5)
    got = {r.term: (r.n, r.n_docs) for r in count_terms(df, least=30, width=1 << 16, depth=4).collect()}
    assert {t: got[t] for t in ("commona", "commonb", "commonc")} == {t: (30, 30) for t in ("commona", "commonb", "commonc")}
    # 27000 rare terms stay out of the shuffle.
    assert len(got) < 30
    # A sketch that is far too small lets terms through, and never holds one back.
    small = document_sketch(df, 30, 1 << 16, 1)
    assert sum(bin(b).count("1") for b in small[0]) >= 3


def test_empty(spark):
    assert audit_sources(spark.createDataFrame([], SCHEMA)).collect() == []

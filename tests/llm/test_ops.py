"""Each operator against a brute-force version, with nulls, ties, repeated rows, long texts, empty tables and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def corpus() -> list[tuple[int | None, str | None]]:
    """Invented texts with shared passages, near and exact copies, and odd cases."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)] + ["Émile", "ÉMILE", "the", "The", "naïve", "日本", "x-y", "C++"]
    passage = " ".join(rng.choice(words) for _ in range(60))
    line = "A line that many documents share, at some length."
    out: list[tuple[int | None, str | None]] = []
    for i in range(40):
        t = " ".join(rng.choice(words) + (str(rng.randrange(900)) if rng.random() < 0.5 else "") for _ in range(rng.randrange(1, 160)))
        if i % 3 == 0:
            t += "\n" + passage + "\n" + line
        if i % 4 == 0:
            t = f"  {line.upper()}\t\n\n" + t
        out.append((i, t))
    base = [w for w in out[9][1].split(" ")]
    for i in range(40, 70):
        copy = base.copy()
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
        out.append((i, " ".join(copy)))
    out += [(70, None), (71, ""), (72, "   \n\t "), (73, "one"), (74, "One"), (75, "two words"), (76, out[5][1]), (77, out[5][1]), (78, (passage + " ") * 40), (79, "a" * 5000 + " " + passage), (80, "\n\n\n"), (81, "z " * 3000)]
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = ["n_words", "text_", "_x_group", "tokens", "score", "kept", "size", "node"]
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, f"h{(i or 0) % 3}", *["clash"] * len(clash)) for i, t in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in clash))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_core_hashes_depend_on_bytes_only():
    from orrery.llm import textcore as T

    values = [b"alpha beta  gamma", None, b"", b"beta alpha " * 40, "Ü ü".encode()]
    t = T.join_texts(values)
    w = T.find_words(t)
    assert w.counts.tolist() == [3, 0, 0, 80, 2]
    h = T.range_hashes(t.buf, w.starts, w.ends)
    assert h[0] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 5
    for k in (1, 2, 3, 5, 8, 13, 20):
        win = T.window_hashes(h, k)
        assert len(win) == max(0, len(h) - k + 1)
        same = collections.defaultdict(set)
        for i in range(len(win)):
            same[tuple(h[i : i + k].tolist())].add(int(win[i]))
        assert all(len(v) == 1 for v in same.values()) and len({x for v in same.values() for x in v}) == len(same)
    long = T.join_texts([b"x" * (3 << 20) + b" y"])
    w = T.find_words(long)
    assert len(T.range_hashes(long.buf, w.starts, w.ends)) == 2


def test_covers_meet_every_difference():
    from orrery.llm.substring_dedup import COVERS, choose_period

    for v, cover in COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))
    assert choose_period(20) == 13 and choose_period(1) == 1


@pytest.mark.parametrize("window", [3, 20])
def test_substrings(spark, docs, rows, empty, window):
    from orrery.llm.substring_dedup import dedup_substrings

    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in dedup_substrings(docs, window=window).collect()}
    seen = set()
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        drop = [False] * len(w)
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            if key in seen:
                drop[j : j + window] = [True] * window
            seen.add(key)
        assert got[i] == (len(w), sum(drop), " ".join(x for x, d in zip(w, drop) if not d)), i
    assert dedup_substrings(empty).count() == 0


def test_substrings_repeated_and_null_ids(spark):
    from orrery.llm.substring_dedup import dedup_substrings

    t = " ".join(f"q{i}" for i in range(30))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in dedup_substrings(df).collect())
    assert got == [(False, 1, 30), (False, 1, 30), (False, 2, 30), (True, 0, 0)]
    got = sorted((r.doc_id, r.n_removed) for r in dedup_substrings(df.where("doc_id IS NOT NULL")).collect())
    assert got == [(1, 0), (1, 0), (2, 30)]


def test_lines(spark, docs, rows, empty):
    from orrery.llm.line_dedup import dedup_lines

    got = {r.doc_id: r for r in dedup_lines(docs).collect()}
    strip = "\t\n\x0b\x0c\r "
    first: dict[str, int] = {}
    for i, t in sorted(rows):
        for x in (t or "").split("\n"):
            first.setdefault(x.strip(strip).translate(LOWER), i)
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(k := x.strip(strip).translate(LOWER)) < 10 or first[k] == i]
        assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (len(lines), len(lines) - len(keep), "\n".join(keep)), i
        assert got[i].source == f"h{i % 3}"
    assert dedup_lines(empty).count() == 0


def test_bloom_pair_finds_all_repeats():
    from orrery.llm.line_dedup import BloomPair

    rng = np.random.default_rng(0)
    a, b = np.unique(rng.integers(0, 2**32, 4000, dtype=np.uint32)), np.unique(rng.integers(0, 2**32, 4000, dtype=np.uint32))
    b[:100] = a[:100]
    pair = BloomPair(8000)
    pair.add(a, np.zeros(len(a), bool))
    pair.add(b, np.zeros(len(b), bool))
    assert pair.repeated(a[:100]).all() and pair.repeated(a[200:]).mean() < 0.05


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 4, 5), (2, 1, 2)])
def test_jaccard(spark, docs, rows, empty, k, num, den):
    from orrery.llm.jaccard_join import similarity_groups

    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity_groups(docs, shingle=k, num=num, den=den).collect()}
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and den * len(sets[x] & sets[y]) >= num * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                label[b] = a
    for i in ids:
        assert got[i] == (len(sets[i]), root(i)), i
    assert similarity_groups(empty).count() == 0


def test_quality(spark, docs, rows, empty):
    from orrery.llm.quality import apply_rules, choose_threshold, fit_quality

    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(0, 60, 3)], "doc_id long, quality int, toxic int")
    model = fit_quality(docs, labels, buckets=1 << 10)
    got = {r.doc_id: r for r in apply_rules(docs, model).collect()}
    for i, t in rows:
        w = WORD.findall(t or "")
        c = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        rep = set()
        for j in range(len(w) - 7):
            if c[tuple(w[j : j + 8])] > 1:
                rep |= set(range(j, j + 8))
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep), failed), i
        assert r.kept == (not failed and r.score >= model.threshold)
    assert apply_rules(empty, model).count() == 0
    assert fit_quality(empty, labels.limit(0)).threshold == 0
    assert choose_threshold(np.array([0.1, 0.2]), np.array([-0.5, 0.0])) == pytest.approx(0.05)


def test_contamination(spark, docs, rows, empty):
    from orrery.llm.decontaminate import find_contamination, n_hit

    items = [("b", " ".join(rows[9][1].split(" ")[3:30])), ("a", rows[9][1][:200]), ("s", "one"), ("e", ""), ("n", None), ("l", rows[3][1]), ("a", "two words")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = {}
    wins = [(k, tuple(w[j : j + 10])) for k, t in items if (w := ALNUM.findall((t or "").translate(LOWER))) for j in range(max(1, len(w) - 9))]
    for i, t in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        at = collections.defaultdict(list)
        for n in {len(x) for _, x in wins}:
            for j in range(len(w) - n + 1):
                at[tuple(w[j : j + n])].append(j)
        hit, names = set(), set()
        for k, x in wins:
            for j in at.get(x, ()):
                hit |= set(range(j, j + len(x)))
                names.add(k)
        want[i] = (len(w), len(hit), sorted(names))
    for size in (4 << 20, 2000):
        out = find_contamination(docs, bench, block_bytes=size).select("doc_id", "n_words", n_hit().alias("n"), "items", "n_near").collect()
        assert {r.doc_id: (r.n_words, r.n, r.items) for r in out} == want
        assert any(r.n_near for r in out)
    assert find_contamination(empty, bench).count() == 0
    assert find_contamination(docs, bench.limit(0)).where(F.size("spans") > 0).count() == 0


def test_language(spark, docs, empty):
    from orrery.llm.language_id import address_host, base_code, fit_languages, identify, identify_documents, markup_lang

    en, de = "the house and the garden were there with them in the other room ", "der hund und die katze sind nicht mit dem haus verbunden worden "
    rng = random.Random(3)
    made = [(i, " ".join(rng.sample((en if i % 2 else de).split(), 8)), "EN-gb" if i % 2 else "de", f"{'a' if i % 2 else 'b'}{i % 4}.example") for i in range(200)]
    made += [(900, None, "en", "a1.example"), (901, "", None, None), (902, "12 34 !!", "en", "a1.example"), (903, de, "en", "zz"), (904, "ᚠᚢᚦᚨᚱᚲ ᚷᚹᚺᚾᛁᛃ " * 20, "en", "a1.example")]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    for most in (100, 1):
        model, priors = fit_languages(df.where("doc_id < 200"), declared=F.col("lang"), host=F.col("source"), max_hosts=most)
        assert model.languages == ["de", "en"] and (priors is None) == (most == 100)
        got = {r.doc_id: r for r in identify(df, model, declared=F.col("lang"), host=F.col("source"), priors=priors).collect()}
        assert all(got[i].detected_lang == ("en" if i % 2 else "de") and got[i].accepted for i in range(200))
        assert got[903].text_lang == "de" and got[903].detected_lang == "de"
        assert all(not got[i].accepted and got[i].detected_lang == "und" for i in (900, 901, 902, 904))
    assert identify_documents(empty).count() == 0
    assert identify_documents(docs).count() == docs.count()
    x = spark.range(1).select(address_host(F.lit("https://u@M.Example.ORG:80/a")).alias("h"), markup_lang(F.lit("<!doctype><HTML class=x lang='pt-BR'>")).alias("m"), base_code(F.lit(" EN_us")).alias("b")).first()
    assert tuple(x) == ("m.example.org", "pt-BR", "en")


def test_token_files(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    from orrery.llm.queries import tokenizer_path
    from orrery.llm.storage import shared_folder
    from orrery.llm.token_files import read_tokens, token_digests, write_tokens

    path = tokenizer_path("byte_bpe_50k.json")
    tok, out = Tokenizer.from_file(path), shared_folder(spark, "t")
    more = spark.createDataFrame([(200, "<|endoftext|> a  b  c  \n\n d don't  "), (201, "\x1c y \x85 z"), (202, "  lead")], "doc_id long, text string")
    write_tokens(docs.select("doc_id", "text").unionByName(more), out, path)
    got = {r.doc_id: r for r in token_digests(spark, out).collect()}
    start = 0
    for i, t in sorted(rows) + [(r.doc_id, r.text) for r in more.collect()]:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
    assert read_tokens(spark, out).where("doc_id = 9").count() == 1
    out = shared_folder(spark, "t")
    write_tokens(empty, out, path)
    assert token_digests(spark, out).count() == 0


def test_pieces(spark, docs, rows, empty):
    import sentencepiece

    from orrery.llm.queries import tokenizer_path
    from orrery.llm.sentence_pieces import decode_texts, encode_texts

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    more = spark.createDataFrame([(200, "▁x ▁  y"), (201, "ᚠ 🎉 日本語\t\x00 x"), (202, "the" * 400), (203, " <s> </s> <0x0A>"), (204, " " * 70 + "x")], "doc_id long, text string")
    given = docs.select("doc_id", "text").unionByName(more)
    out = decode_texts(encode_texts(given, path), path).collect()
    assert len(out) == given.count()
    for r in out:
        assert r.tokens == sp.encode(r.text or ""), r.doc_id
        assert r.decoded == (r.text or "").replace("▁", " "), r.doc_id
    marked = {r.doc_id: r.ok for r in encode_texts(given, path, check="ok").collect()}
    assert not marked[200] and all(v for k, v in marked.items() if k != 200)
    assert encode_texts(docs, path).columns.count("tokens") == 1
    assert decode_texts(encode_texts(empty, path), path).count() == 0


def test_html(spark):
    from orrery.llm.html_extract import extract_pages, extract_text

    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="page has-sidebar"><nav><ul><li>Menu</ul></nav><header><h1>Site</h1></header>
    <div class="cookie-notice">We use cookies</div><!-- <p>hidden</p> --><article class=post><h1>Head &amp; shoulders</h1><p><b>First&nbsp; paragraph,<br>of  some length, with <a href=x>a link</a> and more words.<p>Second &lt;one&gt; &#233; of the article, which is long enough.</p>
    <div class="ad">Buy</div><aside>Related</aside><p>Sh.</p><form><label>Mail</label><input></form><section id="comments"><p>A reader's comment that is rather long and could look like text.</p></section></article><div id=sidebar>Side</div><footer>Foot</footer></body></html>"""
    want = "Head & shoulders\n\nFirst paragraph, of some length, with a link and more words.\n\nSecond <one> é of the article, which is long enough.\n\nSh."
    assert extract_text(page) == want
    assert extract_text(page.replace("<article class=post>", '<div><div class="content">').replace("</article>", "</div></div>")) == want
    assert extract_text("<p>just <i>text</i>") == "just text" and extract_text("plain") == "plain"
    assert extract_text("") == extract_text(None) == extract_text("<nav>x</nav>") == ""
    assert extract_text("<div class=ad>x<article><p>y</article>") == "y"
    df = spark.createDataFrame([(1, "u", page, "old"), (1, "u", page, "old"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in extract_pages(df).collect()) == ["", want, want]
    assert extract_pages(df.limit(0)).count() == 0


def lm_by_brute_force(texts: dict, order: int = 3) -> dict:
    """(held out, tokens, known tokens, training tokens, base score, score) by document."""
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in texts.items()}
    train = {i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1}
    c = collections.Counter(w for i in train for w in tokens[i])
    pairs = collections.Counter(p for i in train for p in zip([0, *tokens[i]], tokens[i]))
    triples = collections.Counter(p for i in train for p in zip([0, *tokens[i]], tokens[i], tokens[i][1:]))
    context = c + collections.Counter({0: len(train)})
    n, v = sum(c.values()), len(c)
    quantised = lambda p: 2 ** (-round(-8 * math.log2(p)) / 8)
    two = {p: min(quantised(k / (context[p[0]] + 4)), context[p[0]] / (context[p[0]] + 4)) for p, k in pairs.items()}
    three = {p: quantised(k / (pairs[p[:2]] + 4)) for p, k in triples.items()}
    out = {}
    for i, own in tokens.items():
        p = {w: (c[w] + 0.5) / (n + 0.5 * (v + 1)) for w in own}
        s = 0.0
        for k, w in enumerate(own):
            before = own[k - 1] if k else 0
            x = two.get((before, w), 0) + 4 / (context[before] + 4) * p[w]
            if k and order > 2:
                first = own[k - 2] if k > 1 else 0
                count = two.get((first, before), 0) * (context[first] + 4)
                x = min(three.get((first, before, w), 0), count / (count + 4)) + 4 / (count + 4) * x
            s += math.log10(x)
        out[i] = (i not in train, len(own), sum(c[w] > 0 for w in own), n, sum(math.log10(p[w]) for w in own), s)
    return out


@pytest.mark.parametrize("order,group_bytes", [(2, 8 << 20), (3, 8 << 20), (3, 900)])
def test_lm(spark, docs, rows, empty, order, group_bytes):
    from orrery.llm.lm_score import score_documents

    got = {r.doc_id: r for r in score_documents(docs, order=order, group_bytes=group_bytes).collect()}
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in rows}
    c = collections.Counter(w for i in tokens for w in tokens[i])
    shards = max(4, -(-sum(len((t or "").encode()) for _, t in rows) // group_bytes))
    # Words that may be split; triples of pairs of such words are quantised as shares of all tokens, and so a little off.
    c[0] = len(tokens)
    wide = {w for w, n in c.items() if n * 4 * shards * 1.5 >= sum(c.values())}
    strict = 0
    for i, want in lm_by_brute_force(dict(rows), order).items():
        r = got[i]
        apart = sum(order > 2 and a in wide and b in wide for a, b in zip([0, *tokens[i]], tokens[i]))
        strict += not apart
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4], i
        assert r.base_score == pytest.approx(want[4], abs=1e-6) and r.score == pytest.approx(want[5], abs=1e-5 + 0.04 * apart), i
    assert strict > (30 if order == 2 else 2)
    assert score_documents(empty).count() == 0


def test_lm_keeps_pairs_seen_once(spark):
    from orrery.llm.lm_score import score_documents

    texts = {0: "alpha beta gamma", 2: "delta beta", 3: "gamma delta", 4: "alpha gamma"}
    texts = {i: t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1} | {i: "alpha beta" for i in range(5, 60) if zlib.crc32(str(i).encode()) % 5 == 1}
    want = lm_by_brute_force(texts)
    held = next(i for i in want if want[i][0])
    # The pair is in one training document alone, and counts for much more than the words by themselves.
    assert not want[0][0] and want[held][5] > want[held][4] + 0.5
    for r in score_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        # Every word of so few holds much of the whole, so that triples stand apart.
        assert r.score == pytest.approx(want[r.doc_id][5], abs=0.04 * r.n_tokens), r.doc_id


def test_lm_probabilities_have_no_lower_bound():
    from orrery.llm.lm_score import _WIDE, _unzip, code_of, pack_ngrams, probability_of, resolve_ngrams

    p = np.array([1.0, 0.5, 1e-6, 1e-9, 1e-13])
    assert np.allclose(probability_of(code_of(p)), p, rtol=0.05) and code_of(p[:3]).dtype == np.uint8 and code_of(p).dtype == np.uint16
    # A split context: its count of 10**13 comes with the pairs, of which this part has one; a triple lies below it.
    ints = lambda *x: np.array(x, np.int64)
    for wide, share in ((np.array([(0, 10**13)], _WIDE), 100 / 10**13), (np.zeros(0, _WIDE), 100 / 104)):
        keys, aux = pack_ngrams(np.array([7], np.uint64), ints(1), ints(9), ints(25), wide, ints(2), ints(3, 4), ints(5, 0))
        for b in resolve_ngrams(4.0)([keys] * 4, [aux] * 4):
            (two, three), codes = (np.uint8 if x == 1 else np.uint16 for x in b[:2]), _unzip(b[2:])
            assert np.isclose(probability_of(np.frombuffer(codes, two, 1))[0], share, rtol=0.05)
            assert np.allclose(probability_of(np.frombuffer(codes, three, 2, b[0])), [20 / 104, 0], rtol=0.05)


def test_elias_fano():
    from orrery.llm.lm_score import EliasFano, Trie

    rng = np.random.default_rng(1)
    for n, top in ((0, 63), (1, 63), (7, 63), (5000, 63), (5000, 14), (70_000, 40)):
        values = np.unique(rng.integers(0, 2**top, n, dtype=np.uint64))
        *arrays, shift = EliasFano.parts(values)
        ef = EliasFano(*arrays, len(values), shift)
        assert ef.find(values).tolist() == list(range(len(values)))
        other = rng.integers(0, 2**63, 50, dtype=np.uint64)
        assert (ef.find(other[~np.isin(other, values)]) == -1).all()
        near = np.setdiff1d(values + np.uint64(1), values)
        assert (ef.find(near) == -1).all()
        # Stored as it is searched: upper bits and their directory take two bytes for each entry at most.
        assert len(values) < 5000 or arrays[1].nbytes + arrays[2].nbytes <= 2 * len(values)
    pairs = np.array([0 << 32 | 5, 0 << 32 | 8, 1 << 32 | 5], np.uint64)
    trie = Trie(np.array([3, 9], np.uint64), pairs, np.array([1 << 32 | 2, 2 << 32 | 6], np.uint64), np.array([0.5, 0.25, 1.0]), np.array([1.0, 0.5]))
    assert not trie.codes.flags.writeable and not trie.pairs.low.flags.writeable and not trie.triples.high.flags.writeable
    two, three = trie.look_up(np.array([9, 3, 4], np.uint64), np.array([0, 1, 1, 2]), np.array([5, 8, 9, 5], np.uint32), np.array([0, 1, 1, 3]), np.array([6, 2, 6, 2], np.uint32))
    assert two.tolist() == [1, 17, 0, 0] and three.tolist() == [9, 1, 0, 0]


def test_pipeline(spark, sf):
    import corpus_pipeline as cp

    before = spark.read.parquet(f"{sf}/documents.parquet")
    out = cp.run(spark, sf)
    assert 4 <= len(cp.STAGES) <= 5 and out.columns[: len(before.columns)] == before.columns
    rows = out.collect()
    assert rows and all(r.round_trip and r.n_tokens == len(r.tokens) for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    assert before.join(out, "doc_id", "left_semi").count() == len(rows)


def test_pipeline_stages_on_odd_rows(spark, sf, rows):
    import corpus_pipeline as cp

    docs = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
        out.count()
    near = {r.doc_id for r in cp.near_duplicates(spark, docs, sf).collect()}
    assert 5 in near and 76 not in near and 77 not in near and {70, 71, 72} <= near
    kept = {r.doc_id: r.text for r in cp.lines(spark, docs, sf).collect()}
    assert 76 not in kept and hashlib.sha256(kept[5].encode()).hexdigest()
